"""op6 and op7: toxicity and quality of every document, learnt from four folds of five."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .common import table
from .labelled import held_out


def _shown(scores: DataFrame, least: float) -> DataFrame:
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null and empty texts have the score of a text without terms."""
    docs = table(spark, sf_dir, "documents")
    return _shown(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null and empty texts have the score of statistics that are all zero."""
    docs = table(spark, sf_dir, "documents")
    return _shown(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)
