"""Search in points (key, lat, lon)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


class GeoIndex:
    """Points out of range are an error when they are read. Where a key comes more than once with a seq, its last point counts."""

    def __init__(self, points: DataFrame, precision: int = 6):
        if "seq" in points.columns:
            points = points.groupBy("key").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("p")).select("key", "p.lat", "p.lon")
        self.points, self.precision = points, precision

    def validated(self) -> DataFrame:
        ok = geo.valid_point(F.col("lat"), F.col("lon"))
        return self.points.withColumn("lat", F.when(ok, F.col("lat")).otherwise(F.raise_error(F.lit("point out of range")).cast("double")))

    def add(self, points: DataFrame) -> "GeoIndex":
        return GeoIndex(self.points.join(points.select("key"), "key", "left_anti").unionByName(points), self.precision)

    def remove(self, keys: DataFrame) -> "GeoIndex":
        return GeoIndex(self.points.join(keys.select("key"), "key", "left_anti"), self.precision)

    def get(self, key: object) -> DataFrame:
        return self.points.where(F.col("key") == F.lit(key))

    def _distance(self, lat: float, lon: float):
        return geo.haversine(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon"))

    def radius(self, lat: float, lon: float, metres: float) -> DataFrame:
        """(key, metres), the edge included; a box around the circle is compared first."""
        near = self.points.where(geo.near_box(F.col("lat"), F.col("lon"), lat, lon, metres))
        return near.select("key", self._distance(lat, lon).alias("metres")).where(F.col("metres") <= metres)

    def box(self, south: float, west: float, north: float, east: float) -> DataFrame:
        return self.points.where(geo.in_box(F.col("lat"), F.col("lon"), south, west, north, east)).select("key")

    def nearest(self, lat: float, lon: float, k: int) -> DataFrame:
        """(key, metres) of the k nearest, ties by key. Each task keeps its k best."""
        return self.points.select("key", self._distance(lat, lon).alias("metres")).where(~F.isnan("metres")).orderBy("metres", "key").limit(k)

    def cells(self) -> DataFrame:
        return self.points.select("key", geo.geohash(F.col("lat"), F.col("lon"), self.precision).alias("cell"))

    def stats(self) -> DataFrame:
        """(points, cells, precision)."""
        return self.cells().agg(F.count("*").alias("points"), F.countDistinct("cell").alias("cells"), F.lit(self.precision).alias("precision"))


class GeoManager:
    """Named indexes; a search in one that is not there finds nothing, and creating one again replaces it."""

    def __init__(self):
        self._indexes: dict[str, GeoIndex] = {}

    def create(self, name: str, points: DataFrame, precision: int = 6) -> None:
        self._indexes[name] = GeoIndex(points, precision)

    def names(self) -> list[str]:
        return sorted(self._indexes)

    def drop(self, name: str) -> bool:
        return self._indexes.pop(name, None) is not None

    def radius(self, name: str, *args) -> DataFrame | None:
        return self._indexes[name].radius(*args) if name in self._indexes else None

    def box(self, name: str, *args) -> DataFrame | None:
        return self._indexes[name].box(*args) if name in self._indexes else None

    def nearest(self, name: str, *args) -> DataFrame | None:
        return self._indexes[name].nearest(*args) if name in self._indexes else None
