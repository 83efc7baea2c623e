"""op5: every document tokenised and packed into sequences of 4096."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import public_path
from .common import table
from .packing import pack, tokenize_pieces

CAPACITY = 4096


def packed(docs: DataFrame) -> DataFrame:
    pieces = tokenize_pieces(docs, public_path("word_bpe_49k.json"), CAPACITY)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), CAPACITY)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece; a document with a null or empty text is the one id that ends it."""
    return packed(table(spark, sf_dir, "documents"))
