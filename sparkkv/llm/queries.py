"""The queries of this subpackage by name, and the SQL of the one that SQL can express; for the others see tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, language_model, media, neighbours, packing, quality, simhash_dedup, source_mixing, substring_dedup, url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_simhash_dedup": simhash_dedup.query,
        "op2_chat_format": chat_format.query,
        "op3_neighbours": neighbours.query,
        "op4_url_filter": url_filter.query,
        "op5_source_mixing": source_mixing.query,
        "op6_quality": quality.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_language_model": language_model.query,
        "op9_packing": packing.query,
        "op10_media": media.query,
        "pipeline": pipeline,
    }


_OP7 = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM texts WHERE len(w) >= 35),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i : i + 34], ' ')) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM repeated, range(35) AS t(k)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM texts),
kept AS (SELECT words.r, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY words.i) AS text
         FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM texts LEFT JOIN kept ON texts.r = kept.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": _OP7}
