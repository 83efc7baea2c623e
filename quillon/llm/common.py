"""What the operators of this subpackage share: shared-folder tables, Arrow helpers, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Octets that count as white space wherever a contract names [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests, one machine), one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillon_checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, columns stay prunable, and an
    executor's loss costs nothing that was written."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    for made in _made:
        made.append(out)
    return out


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that materialize() writes meanwhile."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)


def materialize_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, as a table; all other tables that it wrote are deleted."""
    with tables_made() as made:
        out = materialize(make(), name)
    for other in made:
        if other is not out:
            discard(other)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def local_tmp() -> str:
    """A task's scratch folder on its own executor: nothing in it outlives the task."""
    import tempfile

    return tempfile.mkdtemp(prefix="quillon-")


def arrow_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A text column as Python strings, nulls as empty ones."""
    return [x if x is not None else "" for x in column.to_pylist()]


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy where Arrow allows it; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset :] if off is not None else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def connected_components(links: DataFrame, name: str = "cc") -> DataFrame:
    """links (a, b long) to (node, component), component the smallest node reachable; only nodes with a link appear.

    Rounds of "star contraction": each node hooks on to the smallest neighbour, the hook's root is looked up once more,
    and links between what are now equal roots go. Each round is two equi-joins and one pre-aggregated groupBy, its
    result a table in the shared folder; the number of rounds grows with the logarithm of the longest chain. Nothing
    but the number of links left reaches the driver.
    """
    spark = links.sparkSession
    both = links.where("a <> b").select("a", "b")
    edges = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = None
    while True:
        # each node's smallest neighbour or itself
        hook = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-hook")
        while True:  # chains of hooks to their ends
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            once = hook.join(up, "root", "left").select("node", F.col("root").alias("was"), F.coalesce("up", "root").alias("root"))
            twice = once.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("was")).alias("moved"))
            jumped = materialize(twice, f"{name}-jump")
            moved = jumped.where("moved").limit(1).count()
            discard(hook)
            hook = jumped.select("node", "root")
            hook._quillon_path = jumped._quillon_path
            if not moved:
                break
        if label is None:
            new = hook
        else:
            to = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            new = materialize(label.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-label")
            discard(label)
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialize(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"{name}-edges")
        discard(edges)
        if hook is not new:
            discard(hook)
        label, edges = new, left
        if not edges.limit(1).count():
            discard(edges)
            return label.select("node", F.col("root").alias("component"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(made: str, docs: DataFrame, carry: Sequence[str]) -> T.StructType:
    """The fields in `made` (a DDL string), then those of docs that are carried along, as _in_<name>: an input column may
    have the name of an output column."""
    out = T.StructType.fromDDL(made)
    for name in carry:
        out.add(f"_in_{name}", docs.schema[name].dataType)
    return out


#: Rows, and bytes on average, of an Arrow batch worked on at once.
SLICE_ROWS, SLICE_BYTES = 512, 4_000_000


def lean(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices (no copies), so that Python objects exist for few rows and bytes at a time. Workers serve
    many tasks: freed arrays go back to the system, at the task's end all of them."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        lib = ctypes.CDLL(None)
        lib.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        trim = lib.malloc_trim
    except (OSError, AttributeError):  # another C library
        trim = None
    for batch in batches:
        size = max(1, min(rows, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    if trim is not None:
        trim(0)


def remove_tree(path: str) -> None:
    import shutil

    if os.path.isdir(path):
        shutil.rmtree(path, ignore_errors=True)
