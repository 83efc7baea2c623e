"""op1: every whole text encoded and decoded, as digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents, public_path
from .common import table

VOCABULARY = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the digests of its ids and of what they decode to; a null or empty text has no ids."""
    rows = encode_documents(table(spark, sf_dir, "documents"), public_path(VOCABULARY))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
