"""The kernels on streams. Row-level kernels hold no state and need nothing; counts over time need a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def with_kernels(df: DataFrame, **columns: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """df with columns made by row-level kernels; df may be a stream or not."""
    return df.withColumns({k: v(df) if callable(v) and not isinstance(v, Column) else v for k, v in columns.items()})


def crosstab_windows(df: DataFrame, time: str, x: str, y: str, width: str, late: str) -> DataFrame:
    """The long contingency table of each window of time; a window is final once the watermark has passed it."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withWatermark(time, late)
    return pairs.groupBy(F.window(time, width), x, y).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), x, y, "n")
