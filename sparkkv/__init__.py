"""A keyed analytics engine on Spark DataFrames."""
