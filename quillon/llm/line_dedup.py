"""Line dedup: explode normalised lines, hash them, count distinct documents per hash, drop the lines over the
threshold, put the rest together by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, schema_of

_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A 128-bit hash of the normalised line, or None where it is shorter than min_chars code points.
    bytes.lower() changes A-Z alone."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """docs to (id_col, kept_text string, n_lines long, n_dropped long), one row per input row.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least min_chars code
    points in at least min_docs distinct documents lose all their lines but those in the largest id that has the key.
    A null or empty text is one empty line. Rows that share an id count as one document and lose the same keys. A row
    with a null id counts as no document and keeps every line. Other columns of docs do not matter; those named in
    carry come along as _in_<name>.

    A frequent line costs one partial count per task; what a document loses is bounded by its own lines.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_q_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("_q_text"))
    whole = docs.select(F.col(id_col).alias("_q_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("_q_text"), *(F.col(c).alias(f"_q_{k}") for k, c in enumerate(carry)))

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            ids, keys = [], []
            for k, text in enumerate(batch.column(1)):
                own = {line_key(x, min_chars) for x in text.as_py().split(b"\n")}
                own.discard(None)
                ids += [k] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary())], ["_q_id", "_q_key"])

    lines = materialize(rows.where(F.col("_q_id").isNotNull()).mapInArrow(explode, f"_q_id {kind}, _q_key binary"), "lines")
    frequent = lines.groupBy("_q_key").agg(F.count_distinct("_q_id").alias("n"), F.max("_q_id").alias("_q_last")).where(F.col("n") >= min_docs)
    # a table of its own: of the join that follows Spark can then split a frequent line's rows
    frequent = materialize(frequent, "frequent-lines")
    lost = lines.join(frequent.select("_q_key", "_q_last"), "_q_key").where("_q_id <> _q_last").groupBy("_q_id").agg(F.collect_set("_q_key").alias("_q_lost"))

    def reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            texts, totals, dropped = [], [], []
            for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                lines = text.as_py().split(b"\n")
                gone = set(lost.as_py() or ())
                kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            out = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    schema = schema_of(f"`{id_col}` {kind}, kept_text string, n_lines long, n_dropped long", docs, carry)
    joined = whole.join(lost, "_q_id", "left").select("_q_id", "_q_text", "_q_lost", *(f"_q_{k}" for k in range(len(carry))))
    return joined.mapInArrow(reassemble, schema)
