"""Conversions between numbers, times and text."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers from 10^-least to below 10^most are written without an exponent, by the float's width.
PLAIN = {"double": (5, 16), "float": (6, 13)}
_SCIENTIFIC = re.compile(r"(-?)(\d)(?:\.(\d+))?e([+-]\d+)")


def int_to_text(a: Column) -> Column:
    return a.cast("string")


def _positional(s: str) -> str:
    """Text with an exponent, written out."""
    sign, one, more, e = _SCIENTIFIC.fullmatch(s).groups()
    digits, e = one + (more or ""), int(e)
    if e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    if len(digits) <= e + 1:
        return sign + digits + "0" * (e + 1 - len(digits))
    return f"{sign}{digits[: e + 1]}.{digits[e + 1 :]}"


def _scientific(s: str) -> str:
    """Text with or without an exponent, with one: 1e20, 1.5e-7."""
    got = _SCIENTIFIC.fullmatch(s)
    if got:
        sign, one, more, e = got.groups()
        digits, e = one + (more or ""), int(e)
    else:
        sign, s = ("-", s[1:]) if s.startswith("-") else ("", s)
        whole, _, part = s.partition(".")
        digits = (whole + part).lstrip("0")
        e = len(whole) - 1 if whole != "0" else len(digits) - len(part) - 1
        digits = digits.rstrip("0")
    return f"{sign}{digits[0]}{'.' if digits[1:] else ''}{digits[1:]}e{e}"


def _replaced(text: pa.Array, where: pa.Array, make) -> pa.Array:
    """text with the rows where `where` is true made anew."""
    if not pc.any(where).as_py():
        return text
    return pc.replace_with_mask(text, pc.fill_null(where, False), pa.array([make(s) for s in text.filter(where).to_pylist()], pa.string()))


def _float_text(a: pa.Array, far: tuple[int, int] | None) -> pa.Array:
    """Arrow's number printing is the shortest that reads back; this settles the exponents and the names of what is not finite."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    text = pc.cast(a, pa.string())
    text = pc.if_else(pc.is_nan(a), "NaN", text)
    e = pc.match_substring(text, "e")
    if far is None:
        return _replaced(text, e, _positional)
    size, (least, most) = pc.abs(a), (pa.scalar(float(f"1e{e10}"), a.type) for e10 in (-far[0], far[1]))
    is_far = pc.and_(pc.is_finite(a), pc.and_(pc.not_equal(size, pa.scalar(0.0, a.type)), pc.or_(pc.less(size, least), pc.greater_equal(size, most))))
    text = _replaced(text, pc.and_not(e, is_far), _positional)
    return _replaced(text, is_far, _scientific)


def _text_of(a: Column, far: dict[str, tuple[int, int]] | None) -> Column:
    # the type decides how many digits are needed; it is known only where the expression runs
    def made(x: pa.Array) -> pa.Array:
        kind = "float" if pa.types.is_float32(x.type) else "double"
        if not pa.types.is_floating(x.type):
            x = pc.cast(x, pa.float64())
        return _float_text(x, far[kind] if far else None)

    return F.arrow_udf(made, "string")(a)


def float_to_text(a: Column) -> Column:
    """Shortest text that reads back, never with an exponent: 1, 0.00012, 100000000000000000000; NaN, inf and -inf.

    A double or a float, each with its own digits. The JVM's own number printing is not always the shortest, so this is
    done on Arrow batches."""
    return _text_of(a, None)


def format_finite(a: Column) -> Column:
    """As float_to_text within the limits of PLAIN, with an exponent (1e20, 1.5e-7) beyond."""
    return _text_of(a, PLAIN)


# ------------------------------------------------------------------ times

_DAY_MS = 86_400_000


def _number(part: Column) -> Column:
    """Digits as a number; 0 where there are none."""
    return F.coalesce(part.try_cast("int"), F.lit(0))


def _iso_day(year: Column, month: Column, day: Column, day_of_year: Column, week: Column, day_of_week: Column) -> Column:
    """The date by month, by day of the year or by week; null for a day that is not there."""
    january = F.concat(year, F.lit("-01-01")).try_cast("date")
    counted = F.date_add(january, _number(day_of_year) - 1)
    fourth = F.date_add(january, 3)  # always in week 1
    of_week = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (_number(week) - 1) * 7 + _number(day_of_week) - 1)
    in_week = _number(day_of_week).between(1, 7) & (_number(week) >= 1) & (F.extract(F.lit("YEAROFWEEK"), of_week) == year.try_cast("int"))
    return (
        F.when(month != "", F.concat_ws("-", year, month, day).try_cast("date"))
        .when(day_of_year != "", F.when((_number(day_of_year) >= 1) & (F.year(counted) == year.try_cast("int")), counted))
        .when(in_week, of_week)
    )


def _iso(s: Column, dash: str, colon: str, offset: str) -> Column:
    """Milliseconds of a date, a time that may end at any unit with a fraction of it, and an offset."""
    pattern = (
        rf"^(\d{{4}}){dash}(?:(\d{{2}}){dash}(\d{{2}})|(\d{{3}})|W(\d{{2}}){dash}(\d))"
        rf"[Tt](\d{{2}})(?:{colon}(\d{{2}})(?:{colon}(\d{{2}}))?)?(?:[.,](\d+))?(?:[Zz]|([+-])(\d{{2}})(?:{offset}(\d{{2}}))?)\z"
    )

    def milliseconds(p: Column) -> Column:
        hour, minute, second, off_hour, off_minute = (_number(F.get(p, F.lit(k))) for k in (6, 7, 8, 11, 12))
        digits = F.get(p, F.lit(9))
        last = F.when(F.get(p, F.lit(8)) != "", 1).when(F.get(p, F.lit(7)) != "", 60).otherwise(3600)
        # nine digits of a fraction; of seconds three are milliseconds
        fraction = F.call_function("div", F.rpad(F.left(digits, F.lit(9)), 9, "0").try_cast("bigint") * last, F.lit(1_000_000))
        away = (off_hour * 60 + off_minute) * 60_000 * F.when(F.get(p, F.lit(10)) == "-", -1).otherwise(1)
        good = (hour < 24) & (minute < 60) & (second < 60) & (off_hour <= 25) & (off_minute < 60)
        days = F.unix_date(_iso_day(*(F.get(p, F.lit(k)) for k in range(6)))).cast("bigint")
        return F.when(good, days * _DAY_MS + ((hour * 60 + minute) * 60 + second) * 1000 + F.coalesce(F.when(digits != "", fraction), F.lit(0)) - away)

    # one match for all groups; the list of one binds them, so that each use does not match anew
    groups = F.split(F.regexp_replace(s, pattern, ",".join(f"${k}" for k in range(1, 14))), ",", -1)
    return F.when(s.rlike(pattern), F.element_at(F.transform(F.array(groups), milliseconds), 1))


def parse_datetime(s: Column) -> Column:
    """Milliseconds since 1970: RFC 3339 and ISO 8601 with an offset, date and time, date, time (of today), a whole
    number of milliseconds, in that order; anything else, and empty text, is null. Without an offset UTC is meant.

    ISO 8601 dates are of months, days of the year or weeks; times may end at the hour, minute or second, with a fraction
    of it; the basic form is without dashes and colons throughout. Years have four digits."""
    day, time = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}"
    spaced = s.rlike(rf"^{day} {time}(\.\d+)?([Zz]|[+-]\d{{2}}:\d{{2}})\z")
    zoned = _iso(F.when(spaced, F.replace(s, F.lit(" "), F.lit("T"))).otherwise(s), "-", ":", ":?")
    basic = _iso(s, "", "", "")
    plain = F.when(s.rlike(rf"^{day} {time}\z"), F.concat(s, F.lit("Z")))
    date = F.when(s.rlike(rf"^{day}\z"), F.concat(s, F.lit(" 00:00:00Z")))
    today = F.when(s.rlike(rf"^{time}\z"), F.concat(F.current_date().cast("string"), F.lit(" "), s, F.lit("Z")))
    number = F.when(s.rlike(r"^[+-]?\d+\z"), s.try_cast("bigint"))
    return F.coalesce(zoned, basic, *(F.unix_millis(x.try_cast("timestamp")) for x in (plain, date, today)), number)


def cardinality_ratio(s: Column) -> Column:
    """Distinct values over values, approximately; an aggregate; 0 where there are none."""
    return F.when(F.count(s) > 0, F.approx_count_distinct(s) / F.greatest(F.count(s), F.lit(1))).otherwise(F.lit(0.0))
