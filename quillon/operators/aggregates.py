"""Aggregates over text, global or grouped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.boolean import all_differ, all_eq, all_false, all_ne, all_true, popcount

__all__ = ["all_differ", "all_eq", "all_false", "all_ne", "all_true", "popcount", "str_min", "str_max", "str_count_distinct", "str_join"]


def str_min(s: Column) -> Column:
    """Least by bytes, nulls aside; null where there is none."""
    return F.min(s)


def str_max(s: Column) -> Column:
    return F.max(s)


def str_count_distinct(s: Column) -> Column:
    return F.count_distinct(s)


def str_join(s: Column, delimiter: str, order: Column) -> Column:
    """Joined in the order given, nulls aside; null where there is none. A group's texts meet in one row."""
    kept = F.collect_list(F.when(s.isNotNull(), F.struct(order.alias("o"), s.alias("s"))))
    return F.when(F.count(s) > 0, F.array_join(F.transform(F.array_sort(kept), lambda x: x["s"]), delimiter))
