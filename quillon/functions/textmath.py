"""Arithmetic on text: append, take away, repeat and split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .convert import format_finite

#: Fixed value: no more copies than this.
MOST_COPIES = 1_000_000


def _unsupported(op: str) -> ValueError:
    return ValueError(f"{op!r} is not defined on text")


def minus(a: Column, b: Column) -> Column:
    """a without the first occurrence of b."""
    at = F.instr(a, b)
    return F.when((b == "") | (at == 0), a).otherwise(F.concat(F.left(a, at - 1), F.substring(a, at + F.char_length(b), F.char_length(a))))


def divided(a: Column, b: Column) -> Column:
    """a split by b and joined by |."""
    return F.when(b == "", a).otherwise(F.replace(a, b, F.lit("|")))


def str_num(a: Column, n: Column, op: str = "multiply") -> Column:
    """multiply repeats; a negative, NaN or null-like count is 0, at most MOST_COPIES. Other operators leave a as it is."""
    if op != "multiply":
        return F.when(n.isNotNull(), a)
    whole = F.coalesce(F.when(n.cast("double") >= MOST_COPIES, MOST_COPIES).otherwise(n.try_cast("int")), F.lit(0))
    # NaN is larger than any number to Spark
    whole = F.when(F.isnan(n.cast("double")), 0).otherwise(F.greatest(whole, F.lit(0)))
    return F.when(n.isNotNull(), F.repeat(a, whole))


def str_float(a: Column, x: Column, op: str) -> Column:
    """add appends the number's text, subtract takes its first occurrence away, multiply repeats |round(x)| modulo
    MOST_COPIES + 1 times, divide splits by it."""
    t = format_finite(x)
    if op == "add":
        return F.concat(a, t)
    if op == "subtract":
        return minus(a, t)
    if op == "multiply":
        return F.repeat(a, F.coalesce((F.abs(F.round(x)) % (MOST_COPIES + 1)).try_cast("int"), F.when(x.isNotNull(), F.lit(0))))
    if op == "divide":
        return divided(a, t)
    raise _unsupported(op)


def str_str(a: Column, b: Column, op: str) -> Column:
    """add appends, subtract takes the first occurrence away, multiply repeats a as often as b has bytes (MOST_COPIES at
    most), divide splits a by b and joins by |."""
    if op == "add":
        return F.concat(a, b)
    if op == "subtract":
        return minus(a, b)
    if op == "multiply":
        return F.repeat(a, F.when(b.isNotNull(), F.least(F.octet_length(b), F.lit(MOST_COPIES))))
    if op == "divide":
        return divided(a, b)
    raise _unsupported(op)


def segments(a: Column, b: Column) -> Column:
    """The parts of a between occurrences of b; a alone where b is empty; a null alone where either is null."""
    quoted = F.concat(F.lit("\\Q"), F.replace(b, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(a.isNull() | b.isNull(), F.array(F.lit(None).cast("string"))).when(b == "", F.array(a)).otherwise(F.split(a, quoted, -1))
