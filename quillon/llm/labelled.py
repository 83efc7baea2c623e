"""Labelled rows for the classifiers: a bounded sample, and the folds that the queries hold out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """crc32 of the id as text is divisible by five; a null id is never held out and never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of all labelled rows outside the held-out fold, one for each id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_q_id"), F.col(label_col).cast("int").alias("label"))
    return known.groupBy("_q_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most `most` labelled rows of each class outside the held-out fold, those with the least hash
    of the id. Only these rows' ids are broadcast: 2 * most at the outside."""
    known = learnable(labels, label_col, id_col)
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("_q_id"), "_q_id").limit(most) for k in (0, 1)]
    chosen = parts[0].union(parts[1])
    return docs.select(F.col(id_col).alias("_q_id"), F.coalesce(text_col, F.lit("")).alias("_q_text")).join(F.broadcast(chosen), "_q_id")
