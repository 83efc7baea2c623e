"""Boolean masks as Column expressions. Validity is Spark's own null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def and_masks(a: Column, b: Column) -> Column:
    return a & b


def or_masks(a: Column, b: Column) -> Column:
    return a | b


def xor_masks(a: Column, b: Column) -> Column:
    return a != b


def not_mask(a: Column) -> Column:
    return ~a


def eq_mask(a: Column, b: Column) -> Column:
    return a == b


def ne_mask(a: Column, b: Column) -> Column:
    return a != b


def binop(a: Column, b: Column, op: str) -> Column:
    made = {"and": and_masks, "or": or_masks, "xor": xor_masks}
    if op not in made:
        raise ValueError(f"unknown logical operator {op!r}")
    return made[op](a, b)


def unop(a: Column, op: str = "not") -> Column:
    if op != "not":
        raise ValueError(f"{op!r} does not apply to a mask")
    return not_mask(a)


def propagate(value: Column, *inputs: Column) -> Column:
    """Null wherever an input is null, for masks where false AND null must not be false."""
    valid = inputs[0].isNotNull()
    for x in inputs[1:]:
        valid = valid & x.isNotNull()
    return F.when(valid, value)


def merge_validity(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def bitfield_eq(data: Column, field_mask: int, target: int) -> Column:
    """(data & field_mask) == target."""
    return data.bitwiseAND(F.lit(field_mask)) == F.lit(target)


# ------------------------------------------------------------------ aggregates over a window of rows; empty ones are true


def all_eq(a: Column, b: Column) -> Column:
    return F.coalesce(F.bool_and(a == b), F.lit(True))


def all_ne(a: Column, b: Column) -> Column:
    """True when any row differs: the negation of all_eq."""
    return ~all_eq(a, b)


def all_differ(a: Column, b: Column) -> Column:
    """True when every row differs."""
    return F.coalesce(F.bool_and(a != b), F.lit(True))


def popcount(a: Column) -> Column:
    return F.count_if(a)


def all_true(a: Column) -> Column:
    return F.coalesce(F.bool_and(a), F.lit(True))


def all_false(a: Column) -> Column:
    return ~F.coalesce(F.bool_or(a), F.lit(False))
