"""Sources and sinks: what Spark reads and writes, by one pair of functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "text", "avro", "jdbc")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table at a path. csv and json need a schema: inference would read everything twice."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), mode: str = "error", **options: str) -> None:
    """df to a path, in folders by the columns named."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return read(spark, f"{sf_dir}/{name}.parquet")
