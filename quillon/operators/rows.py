"""Operators that change rows or look at a whole column: splitting, set membership, contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.textmath import minus, segments


def divide_rows(df: DataFrame, a: str, b: str, out: str = "segment") -> DataFrame:
    """One row per segment of a between occurrences of b, with its place."""
    return df.select("*", F.posexplode(segments(F.col(a), F.col(b))).alias("segment_pos", out))


def dict_op(df: DataFrame, a: str, b: str, op: str, out: str = "value") -> DataFrame:
    """Operators on two repeating text columns: add, subtract; multiply leaves a as it is; divide expands rows."""
    x, y = F.col(a), F.col(b)
    if op == "divide":
        return divide_rows(df, a, b, out)
    made = {"add": lambda: F.concat(x, y), "subtract": lambda: minus(x, y), "multiply": lambda: F.when(y.isNotNull(), x)}
    if op not in made:
        raise ValueError(f"{op!r} is not defined on text")
    return df.withColumn(out, made[op]())


def co_partition(left: DataFrame, right: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out alike by a key, so that joins and groupings on it that follow need no further shuffle."""
    return left.repartition(n, key), right.repartition(n, key)


def in_mask(df: DataFrame, a: Column, b: Column, out: str = "in_mask", negate: bool = False) -> DataFrame:
    """Whether a's value is among the values that b has in any row. b is boiled down to one row of two booleans."""
    seen = df.agg(F.coalesce(F.bool_or(b), F.lit(False)).alias("_any_true"), F.coalesce(F.bool_or(~b), F.lit(False)).alias("_any_false"))
    value = (a & F.col("_any_true")) | (~a & F.col("_any_false"))
    return df.crossJoin(F.broadcast(seen)).withColumn(out, ~value if negate else value).drop("_any_true", "_any_false")


def not_in_mask(df: DataFrame, a: Column, b: Column, out: str = "not_in_mask") -> DataFrame:
    return in_mask(df, a, b, out, negate=True)


def crosstab_long(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n) over rows where both are known: a partial count in each task, then one shuffle."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, x: str, y: str, labels: list[str] | None = None, most: int = 10_000, position: str | None = None) -> DataFrame:
    """A row per x, a column per y, 0 where they never meet. labels: y's values, where known; else they are looked up, in
    order of first appearance by `position` or, without it, of themselves; more than `most` are an error, and so is none."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if labels is None:
        first = F.min(position) if position else F.min(y)
        labels = [r[0] for r in pairs.groupBy(y).agg(first.alias("_first")).orderBy("_first", y).limit(most + 1).select(y).collect()]
        if len(labels) > most:
            raise ValueError(f"{y} has more than {most} values")
        if not labels:
            raise ValueError("no row has both values")
    return pairs.groupBy(x).pivot(y, labels).agg(F.count(F.lit(1))).na.fill(0)


def cross_tabulate(df: DataFrame, x: str, y: str, position: str) -> DataFrame:
    """(x, y, n, x_place, y_place, total): the pairs that occur, how often, the labels' places in order of first
    appearance among rows that have both, and the number of such rows. No such row is an error when the result is read.

    One pre-aggregation by pair gives all of it: labels and total come from the pairs, not from the rows."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"), F.min(position).alias("_q_first"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    total = total.select(F.when(F.col("total") > 0, F.col("total")).otherwise(F.raise_error(F.lit("no row has both values")).cast("bigint")).alias("total"))
    places = [first_seen(pairs, label, "_q_first").withColumnRenamed("place", f"{name}_place") for name, label in (("x", x), ("y", y))]
    placed = pairs.drop("_q_first").join(places[0], x).join(places[1], y)
    # one row, even without pairs: the error is raised there
    return F.broadcast(total).join(placed, F.lit(True), "left").select(x, y, "n", "x_place", "y_place", "total")


def first_seen(df: DataFrame, x: str, position: str, slices: int = 4096) -> DataFrame:
    """(x, place): labels numbered from 0 in order of first appearance, by a whole-number position; of one position in
    order of themselves.

    Labels are counted in slices of the range of positions, so that only the slices are numbered in one task."""
    first = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.min(position).alias("_first"))
    ends = first.agg(F.min("_first").alias("_low"), F.max("_first").alias("_high"))
    width = F.col("_high").cast("double") - F.col("_low").cast("double") + 1
    slice_ = F.floor((F.col("_first").cast("double") - F.col("_low").cast("double")) / width * slices).cast("int")
    sliced = first.crossJoin(F.broadcast(ends)).select(x, "_first", slice_.alias("_slice"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy("_first", x))
    return sliced.join(F.broadcast(counts), "_slice").select(x, (F.col("_base") + within - 1).cast("int").alias("place"))


def sampled_cardinality(df: DataFrame, s: str, position: str, sample: int = 256) -> DataFrame:
    """One row, `ratio`: distinct texts over the sample's size, from every (rows / sample)-th row by `position` (from 0);
    0.0 without rows. A null counts as an empty text."""
    n = df.agg(F.count("*").alias("_n"))
    step = F.greatest(F.call_function("div", F.col("_n"), F.lit(max(sample, 1))), F.lit(1))
    seen = df.crossJoin(F.broadcast(n)).where(F.col(position) % step == 0).agg(F.least(F.count_distinct(F.coalesce(F.col(s), F.lit(""))), F.lit(sample)).alias("_seen"))
    size = F.least(F.col("_n"), F.lit(sample))
    return n.crossJoin(F.broadcast(seen)).select(F.when(size > 0, F.col("_seen") / F.greatest(size, F.lit(1))).otherwise(F.lit(0.0)).alias("ratio"))
