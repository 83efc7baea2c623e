"""Integer, float and tick arithmetic as Column expressions; null in, null out.

Integers wrap at their width, whatever the session's ANSI setting. A kind names the width: tinyint, smallint, int and
bigint are two's complement; utinyint, usmallint, uint (held in smallint, int, bigint) and ubigint (held in
decimal(20,0)) are unsigned. 64-bit results are put together from 32- and 16-bit halves in longs, so no product can
overflow on the way and no decimals are needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kind: (bits, signed, Spark type that holds it)
KINDS = {
    "tinyint": (8, True, "tinyint"), "smallint": (16, True, "smallint"), "int": (32, True, "int"), "bigint": (64, True, "bigint"),
    "utinyint": (8, False, "smallint"), "usmallint": (16, False, "int"), "uint": (32, False, "bigint"), "ubigint": (64, False, "decimal(20,0)"),
}
OPERATORS = ("add", "subtract", "multiply", "divide", "remainder", "power", "floordiv")
_LOW = 0xFFFFFFFF
_INF = float("inf")


def _kind(kind: str) -> tuple[int, bool, str]:
    if kind not in KINDS:
        raise ValueError(f"unknown integer kind {kind!r}")
    return KINDS[kind]


def _and(a: Column, mask: int) -> Column:
    return a.bitwiseAND(F.lit(mask).cast("bigint"))


def _add64(a: Column, b: Column) -> Column:
    low = _and(a, _LOW) + _and(b, _LOW)
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(_and(low, _LOW))


def _mul32(a: Column, b: Column) -> Column:
    """The low 32 bits, unsigned, of the product of two unsigned 32-bit numbers."""
    return _and(a * _and(b, 0xFFFF) + F.shiftleft(_and(a * F.shiftright(b, 16), 0xFFFF), 16), _LOW)


def _mul64(a: Column, b: Column) -> Column:
    a0, b0 = _and(a, _LOW), _and(b, _LOW)
    a1, b1 = F.shiftrightunsigned(a, 32), F.shiftrightunsigned(b, 32)
    low = _add64(a0 * _and(b0, 0xFFFF), F.shiftleft(a0 * F.shiftright(b0, 16), 16))
    return _add64(low, F.shiftleft(_and(_mul32(a0, b1) + _mul32(a1, b0), _LOW), 32))


def _narrow(x: Column, bits: int, signed: bool, held: str) -> Column:
    """A long that did not overflow, wrapped to fewer bits."""
    mask = (1 << bits) - 1
    if not signed:
        return _and(x, mask).cast(held)
    half = 1 << (bits - 1)
    return (_and(x + F.lit(half).cast("bigint"), mask) - F.lit(half).cast("bigint")).cast(held)


_TWO64 = "18446744073709551616"


def _unsigned64(a: Column, b: Column, op: str) -> Column:
    big = F.lit(_TWO64).cast("decimal(20,0)")
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    if op == "add":
        x = a + b
    elif op == "subtract":
        x = a - b + big
    else:  # halves: the full product would have 39 digits
        two32 = F.lit("4294967296").cast("decimal(11,0)")
        a1, b1 = F.call_function("div", a, two32).cast("decimal(10,0)"), F.call_function("div", b, two32).cast("decimal(10,0)")
        a0, b0 = F.pmod(a, two32).cast("decimal(10,0)"), F.pmod(b, two32).cast("decimal(10,0)")
        cross = F.pmod(a1 * b0 + a0 * b1, two32).cast("decimal(10,0)")
        x = (a0 * b0).cast("decimal(22,0)") + (cross * two32).cast("decimal(22,0)")
    return F.pmod(x.cast("decimal(24,0)"), big).cast("decimal(20,0)")


def _wrapping(op: str, kind: str) -> Callable[[Column, Column], Column]:
    bits, signed, held = _kind(kind)
    if kind == "ubigint":
        return lambda a, b: _unsigned64(a, b, op)

    def apply(a: Column, b: Column) -> Column:
        a, b = a.cast("bigint"), b.cast("bigint")
        if bits == 64:
            return {"add": lambda: _add64(a, b), "subtract": lambda: _add64(_add64(a, F.bitwise_not(b)), F.lit(1).cast("bigint")), "multiply": lambda: _mul64(a, b)}[op]()
        if op == "multiply" and kind == "uint":
            return _mul32(a, b)
        return _narrow({"add": a + b, "subtract": a - b, "multiply": a * b}[op], bits, signed, held)

    return apply


def int_add(a: Column, b: Column, kind: str = "bigint") -> Column:
    return _wrapping("add", kind)(a, b)


def int_subtract(a: Column, b: Column, kind: str = "bigint") -> Column:
    return _wrapping("subtract", kind)(a, b)


def int_multiply(a: Column, b: Column, kind: str = "bigint") -> Column:
    return _wrapping("multiply", kind)(a, b)


def _by_zero(b: Column, on_zero: str, value: Column) -> Column:
    if on_zero == "null":
        return F.when(b != 0, value)
    if on_zero == "error":
        return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(value)
    raise ValueError("on_zero is 'null' or 'error'")


def _whole(a: Column, b: Column, kind: str) -> Column:
    """The truncated quotient; div itself gives a long, which 64 unsigned bits do not fit."""
    held = _kind(kind)[2]
    if kind == "ubigint":
        a, b = a.cast(held), b.cast(held)
        return ((a - a % b).cast(held) / b).cast(held)
    return F.call_function("div", a, b).cast(held)


def int_divide(a: Column, b: Column, kind: str = "bigint", on_zero: str = "null") -> Column:
    """Truncates towards zero; the least number divided by -1 wraps to itself."""
    _, signed, held = _kind(kind)
    whole = _whole(a, b, kind)
    if signed:
        whole = F.when(b == -1, int_subtract(F.lit(0).cast(held), a, kind)).otherwise(whole)
    return _by_zero(b, on_zero, whole)


def int_remainder(a: Column, b: Column, kind: str = "bigint", on_zero: str = "null") -> Column:
    """The sign is the dividend's."""
    _, signed, held = _kind(kind)
    rest = (a % b).cast(held)
    if signed:
        rest = F.when(b == -1, F.when(a.isNotNull(), F.lit(0).cast(held))).otherwise(rest)
    return _by_zero(b, on_zero, rest)


def int_floordiv(a: Column, b: Column, kind: str = "bigint", on_zero: str = "null") -> Column:
    """Towards minus infinity."""
    _, signed, held = _kind(kind)
    whole = _whole(a, b, kind)
    if signed:
        lower = ((a % b) != 0) & ((a < 0) != (b < 0))
        whole = F.when(b == -1, int_subtract(F.lit(0).cast(held), a, kind)).when(lower, (whole - F.lit(1)).cast(held)).otherwise(whole)
    return _by_zero(b, on_zero, whole)


def int_power(a: Column, b: Column | int, kind: str = "bigint") -> Column:
    """Wrapping power; negative exponents and those over 32 bits count as 0.

    Up to 2^52 a power of doubles is exact and runs in generated code; only rows beyond it square over the exponent's
    bits. An exponent up to 3 given as a number is multiplied out."""
    _, _, held = _kind(kind)
    times = _wrapping("multiply", kind)
    one = F.lit(1).cast(held)
    if isinstance(b, int):
        if 0 <= b <= 3:
            base = a.cast(held)
            made = {0: lambda: F.when(a.isNotNull(), one), 1: lambda: base, 2: lambda: times(base, base), 3: lambda: times(times(base, base), base)}
            return made[b]().cast(held)
        b = F.lit(b).cast("bigint")
    e = F.when((b >= 0) & (b <= _LOW), b).otherwise(F.when(b.isNotNull(), F.lit(0))).cast("bigint")

    def step(s: Column, k: Column) -> Column:
        odd = _and(F.call_function("shiftright", e, k), 1) == 1
        return F.struct(F.when(odd, times(s["acc"], s["base"])).otherwise(s["acc"]).alias("acc"), times(s["base"], s["base"]).alias("base"))

    start = F.struct(one.alias("acc"), a.cast(held).alias("base"))
    # only as many rounds as the exponent has bits
    rounds = F.when(e > 0, F.sequence(F.lit(0), F.floor(F.log2(e.cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    wide = F.aggregate(rounds, start, step)["acc"]
    size = F.abs(a.cast("double"))
    small = e.cast("double") * F.log2(F.greatest(size, F.lit(1.0))) < 52
    exact = F.pow(a.cast("double"), e.cast("double")).cast("bigint")
    exact = exact.cast(held) if kind in ("bigint", "ubigint") else _narrow(exact, *_kind(kind))
    return F.when(small, exact).when(a.isNotNull() & e.isNotNull(), wide)


def apply_int(a: Column, b: Column | int, op: str, kind: str = "bigint", mask: Column | None = None, on_zero: str = "null") -> Column:
    """Any operator by name; rows where mask is not true are null."""
    made = {
        "add": lambda: int_add(a, b, kind), "subtract": lambda: int_subtract(a, b, kind), "multiply": lambda: int_multiply(a, b, kind),
        "divide": lambda: int_divide(a, b, kind, on_zero), "remainder": lambda: int_remainder(a, b, kind, on_zero),
        "power": lambda: int_power(a, b, kind), "floordiv": lambda: int_floordiv(a, b, kind, on_zero),
    }
    if op not in made:
        raise ValueError(f"unknown operator {op!r}")
    return masked(made[op](), mask)


def masked(value: Column, mask: Column | None) -> Column:
    return value if mask is None else F.when(mask, value)


# ------------------------------------------------------------------ floats


def float_divide(a: Column, b: Column, kind: str = "double") -> Column:
    """IEEE 754: x/0 is an infinity, 0/0 is NaN."""
    a_, b_ = a.cast("double"), b.cast("double")
    return F.when(b_ == 0, a_ * F.pow(b_, F.lit(-1.0))).otherwise(a_ / b_).cast(kind)


def float_remainder(a: Column, b: Column, kind: str = "double") -> Column:
    """The truncated remainder; x % 0 is NaN."""
    return F.when((b == 0) & a.isNotNull(), F.lit(float("nan"))).otherwise(a % b).cast(kind)


def float_power(a: Column, b: Column, kind: str = "double") -> Column:
    """exp(b * ln(a)): NaN for a negative base, for 0^0 and for inf^0. F.pow is another operator."""
    a_, b_ = a.cast("double"), b.cast("double")
    value = F.when(a_ > 0, F.exp(b_ * F.ln(a_))).when(a_ == 0, F.exp(b_ * F.lit(-_INF))).otherwise(F.lit(float("nan")))
    return F.when(a.isNotNull() & b.isNotNull(), value).cast(kind)


def float_floordiv(a: Column, b: Column, kind: str = "double") -> Column:
    """floor(a / b) in floating point; infinities, NaN and whole quotients beyond 2^53 stay as they are."""
    q = float_divide(a, b, kind).cast("double")
    return F.when(F.isnan(q) | (F.abs(q) >= 2.0**53) | (q == 0), q).otherwise(F.floor(q).cast("double")).cast(kind)


def fma(a: Column, b: Column, acc: Column, mask: Column | None = None, fused: bool = True) -> Column:
    """a * b + acc, rounded once; not fused: rounded after each step, in generated code."""
    if not fused:
        return masked(a * b + acc, mask)
    parts = [x.cast("double") for x in (a, b, acc)]
    known = F.lit(True)
    for x in parts:
        known &= x.isNotNull()
    # the class library's own, which the processor does in one instruction
    made = F.when(known, F.java_method(F.lit("java.lang.Math"), F.lit("fma"), *(F.coalesce(x, F.lit(0.0)) for x in parts)).cast("double"))
    return masked(made, mask)


def apply_float(a: Column, b: Column, op: str, kind: str = "double", mask: Column | None = None) -> Column:
    made = {
        "add": lambda: (a + b).cast(kind), "subtract": lambda: (a - b).cast(kind), "multiply": lambda: (a * b).cast(kind),
        "divide": lambda: float_divide(a, b, kind), "remainder": lambda: float_remainder(a, b, kind),
        "power": lambda: float_power(a, b, kind), "floordiv": lambda: float_floordiv(a, b, kind),
    }
    if op not in made:
        raise ValueError(f"unknown operator {op!r}")
    return masked(made[op](), mask)


# ------------------------------------------------------------------ ticks


def ticks(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp; one without a zone is taken in the session's."""
    return F.unix_millis(ts.cast("timestamp"))


def from_ticks(t: Column) -> Column:
    return F.timestamp_millis(t)


def apply_datetime(a: Column, b: Column | int, op: str, kind: str = "bigint") -> Column:
    """Integer arithmetic on raw ticks, power included; null where either is null."""
    return apply_int(a, b, op, kind)
