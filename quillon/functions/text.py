"""Text transforms and predicates as Column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"\p{IsWhite_Space}+"


def _literal(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def concat_rev(a: Column, b: Column) -> Column:
    """b, then a."""
    return F.concat(b, a)


def concat_null_empty(a: Column, b: Column) -> Column:
    """Nulls count as empty text; never null."""
    return F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def _predicate(value: Column, pattern: Column, nulls_false: bool) -> Column:
    value = value & (pattern != "")  # an empty pattern matches nothing
    return F.coalesce(value, F.lit(False)) if nulls_false else value


def contains(a: Column, b: Column | str, nulls_false: bool = False) -> Column:
    b = _literal(b)
    return _predicate(F.contains(a, b), b, nulls_false)


def starts_with(a: Column, b: Column | str, nulls_false: bool = False) -> Column:
    b = _literal(b)
    return _predicate(F.startswith(a, b), b, nulls_false)


def ends_with(a: Column, b: Column | str, nulls_false: bool = False) -> Column:
    b = _literal(b)
    return _predicate(F.endswith(a, b), b, nulls_false)


def regex_match(a: Column, pattern: Column | str) -> Column:
    """Found anywhere; \\d, \\w and \\s are Unicode classes; an invalid pattern is an error."""
    p = _literal(pattern)
    return F.when(p != "", F.regexp(a, F.concat(F.lit("(?U)"), p))).otherwise(F.when(a.isNotNull() & p.isNotNull(), F.lit(False)))


def regex_replace(a: Column, pattern: str, replacement: str) -> Column:
    """Every match; $1 and ${name} refer to groups."""
    return F.regexp_replace(a, "(?U)" + pattern, replacement)


def char_len(s: Column) -> Column:
    return F.char_length(s)


def byte_len(s: Column) -> Column:
    return F.octet_length(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def trim(s: Column) -> Column:
    """Unicode White_Space at both ends."""
    return F.regexp_replace(s, f"^{_BLANK}|{_BLANK}$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_BLANK}", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, f"{_BLANK}$", "")


def reverse(s: Column) -> Column:
    """By code point."""
    return F.reverse(s)


def find(s: Column, needle: Column | str) -> Column:
    """The byte place, from 0, of the first match, or -1."""
    n = _literal(needle)
    at = F.instr(s, n)
    return F.when(at == 0, F.lit(-1)).when(at.isNotNull(), F.octet_length(F.left(s, at - 1))).cast("int")


def count_matches(s: Column, needle: str) -> Column:
    """Matches that do not overlap; an empty needle is found at every boundary."""
    if not needle:
        return (F.char_length(s) + 1).cast("int")
    return F.call_function("div", F.char_length(s) - F.char_length(F.replace(s, F.lit(needle), F.lit(""))), F.lit(len(needle))).cast("int")


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """From a code point counted from 0; beyond the end there is empty text."""
    return F.substring(s, start + 1, 2**31 - 1 if length is None else length)


def replace(s: Column, old: str, new: str) -> Column:
    """Every occurrence; an empty old text stands at every boundary."""
    if not old:
        return F.regexp_replace(s, "", new.replace("\\", "\\\\").replace("$", "\\$"))
    return F.replace(s, F.lit(old), F.lit(new))


def repeat(s: Column, n: int) -> Column:
    return F.repeat(s, n)


def pad(s: Column, width: int, fill: str = " ", side: str = "left") -> Column:
    """To width code points; longer texts stay. Of an odd padding on both sides the right one gets more."""
    if len(fill) != 1:
        raise ValueError("fill is one character")
    if side not in ("left", "right", "both"):
        raise ValueError("side is 'left', 'right' or 'both'")
    gap = F.lit(width) - F.char_length(s)
    half = F.call_function("div", gap, F.lit(2)).cast("int")
    before = {"left": gap, "right": F.lit(0), "both": half}[side]
    after = {"left": F.lit(0), "right": gap, "both": gap - half}[side]
    return F.when(gap <= 0, s).otherwise(F.concat(F.repeat(F.lit(fill), before), s, F.repeat(F.lit(fill), after)))
