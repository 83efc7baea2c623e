"""A corpus from documents: quality, line dedup, near dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. run() applies them one after the other; what passes between two stages is Parquet in the shared folder.
A stage keeps rows with null ids (they take part in no comparison) and empty texts that score well enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import quality
from quillon.llm.common import discard, materialize_alone, table
from quillon.llm.line_dedup import line_dedup
from quillon.llm.minhash import near_dedup
from quillon.llm.packing_query import packed
from quillon.llm.suffix_dedup import suffix_dedup

#: Documents that score below it go.
LEAST_QUALITY = 0.3


def _with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The columns of docs from rows that carry them, with the new text and its length."""
    new = {"text": F.col(text)} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*((new[c] if c in new else F.col("doc_id" if c == "doc_id" else f"_in_{c}")).alias(c) for c in docs.columns))


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one."""
    return _with_text(docs, line_dedup(docs, carry=_others(docs)), "kept_text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, 0.8) the smallest doc_id stays."""
    gone = near_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that were seen earlier go; a character that is cut in two goes as a whole."""
    return _with_text(docs, suffix_dedup(docs, carry=_others(docs)), "kept_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of 4096: the rows of op5."""
    return packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("suffix_array", suffix_stage),
    ("packing", packing_stage),
]

#: Neither the classifier nor the packing can be expressed in SQL; tests compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. A stage's own tables and the one it read are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = materialize_alone(lambda stage=stage, before=before: stage(spark, before, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
