"""op4: exact duplicates of whole texts, white space aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_dedup


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null, empty and blank texts are equal."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS plain
  FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = first(doc_id) OVER w AS kept, sha256(plain) AS text_sha256
FROM d WINDOW w AS (PARTITION BY plain ORDER BY chars DESC, doc_id)
"""
