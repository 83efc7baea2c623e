"""Hand-written vectors and a plain Python model for the numeric kernels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import numeric as N

A, B = [1, 4, 9, 16], [1, 2, 3, 4]


def rows(spark, data, schema, **columns):
    df = spark.createDataFrame(data, schema)
    return [tuple(r) for r in df.select(*(v.alias(k) for k, v in columns.items())).collect()]


def ints(spark, kind, a, b, op, **more):
    held = N.KINDS[kind][2]
    data = [(x, y) for x, y in zip(a, b, strict=True)]
    if held.startswith("decimal"):
        df = spark.createDataFrame([(str(x), str(y)) for x, y in data], "a string, b string")
        col = N.apply_int(F.col("a").cast(held), F.col("b").cast(held), op, kind, **more)
        return [int(r[0]) if r[0] is not None else None for r in df.select(col).collect()]
    return [r[0] for r in rows(spark, data, f"a {held}, b {held}", v=N.apply_int(F.col("a"), F.col("b"), op, kind, **more))]


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint"])
def test_integer_vectors(spark, kind):
    want = {"add": [2, 6, 12, 20], "subtract": [0, 2, 6, 12], "multiply": [1, 8, 27, 64], "divide": [1, 2, 3, 4], "remainder": [0] * 4}
    for op, out in want.items():
        assert ints(spark, kind, A, B, op) == out
    bits = N.KINDS[kind][0]
    half = 1 << (bits - 1)
    assert ints(spark, kind, A, B, "power") == [(x**y + half) % (1 << bits) - half for x, y in zip(A, B, strict=True)]


def test_masked_and_zero(spark):
    data = [(10, 2, True), (20, 0, False), (30, 3, True), (40, 5, False), (100, 0, True)]
    got = rows(spark, data, "a int, b int, m boolean", d=N.apply_int(F.col("a"), F.col("b"), "divide", "int", F.col("m")), r=N.apply_int(F.col("a"), F.col("b"), "remainder", "int", F.col("m")))
    assert got == [(5, 0), (None, None), (10, 0), (None, None), (None, None)]
    with pytest.raises(Exception, match="division by zero"):
        ints(spark, "int", [1], [0], "divide", on_zero="error")
    assert ints(spark, "int", [], [], "add") == []
    with pytest.raises(ValueError):
        N.apply_int(F.col("a"), F.col("b"), "modulo")


def wrap(x, kind):
    bits, signed, _ = N.KINDS[kind]
    x %= 1 << bits
    return x - (1 << bits) if signed and x >= 1 << (bits - 1) else x


@pytest.mark.parametrize("kind", list(N.KINDS))
def test_against_python(spark, kind):
    bits, signed, _ = N.KINDS[kind]
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    rng = random.Random(bits)
    edge = [low, low + 1, high, high - 1, 0, 1, 2, 7] + ([-1, -7] if signed else [])
    pairs = [(x, y) for x in edge for y in edge] + [(rng.randint(low, high), rng.randint(low, high)) for _ in range(60)]
    a, b = zip(*pairs, strict=True)
    assert ints(spark, kind, a, b, "add") == [wrap(x + y, kind) for x, y in pairs]
    assert ints(spark, kind, a, b, "subtract") == [wrap(x - y, kind) for x, y in pairs]
    assert ints(spark, kind, a, b, "multiply") == [wrap(x * y, kind) for x, y in pairs]
    assert ints(spark, kind, a, b, "floordiv") == [None if y == 0 else wrap(x // y, kind) for x, y in pairs]
    trunc = lambda x, y: abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
    assert ints(spark, kind, a, b, "divide") == [None if y == 0 else wrap(trunc(x, y), kind) for x, y in pairs]
    assert ints(spark, kind, a, b, "remainder") == [None if y == 0 else x - y * trunc(x, y) for x, y in pairs]


def test_power(spark):
    assert ints(spark, "bigint", [3, 2, 7, 2, -2, 0], [39, -1, 0, 64, 63, 0], "power") == [4052555153018976267, 1, 1, 0, -(1 << 63), 1]
    assert rows(spark, [(None, 2), (2, None)], "a bigint, b bigint", v=N.int_power(F.col("a"), F.col("b"))) == [(None,), (None,)]


def same(x, y):
    return x == y and math.copysign(1, x) == math.copysign(1, y) or math.isnan(x) and math.isnan(y)


def floats(spark, pairs, op):
    return [r[0] for r in rows(spark, pairs, "a double, b double", v=N.apply_float(F.col("a"), F.col("b"), op))]


def test_floats(spark):
    inf, nan = math.inf, math.nan
    assert floats(spark, [(1.0, 0.5), (4.0, 2.0)], "add") == [1.5, 6.0]
    for op, pairs, want in (
        ("divide", [(7.5, 0.0), (-7.5, 0.0), (0.0, 0.0), (1.0, -0.0), (9.0, 3.0)], [inf, -inf, nan, -inf, 3.0]),
        ("remainder", [(7.5, 0.0), (7.5, 2.0), (-7.5, 2.0)], [nan, 1.5, -1.5]),
        ("power", [(-2.0, 3.0), (0.0, 0.0), (0.0, 2.0), (0.0, -1.0), (inf, 0.0), (nan, 2.0)], [nan, nan, 0.0, inf, nan, nan]),
        ("floordiv", [(7.5, 2.0), (-7.5, 2.0), (1.0, 0.0), (0.0, 0.0), (1e300, 1.0)], [3.0, -4.0, inf, nan, 1e300]),
    ):
        got = floats(spark, pairs, op)
        assert all(same(x, y) for x, y in zip(got, want, strict=True)), (op, got)
    assert rows(spark, [(1.0, 4.0, True), (2.0, 5.0, False)], "a double, b double, m boolean", v=N.fma(F.col("a"), F.col("b"), F.lit(0.5), F.col("m"))) == [(4.5,), (None,)]
    assert floats(spark, [(None, 1.0)], "power") == [None]


def test_ticks(spark):
    got = rows(spark, [(10, 1), (20, 2), (30, 3), (40, 4), (None, 1)], "a bigint, b bigint", **{op: N.apply_datetime(F.col("a"), F.col("b"), op) for op in N.OPERATORS[:6]})
    assert got == [(11, 9, 10, 10, 0, 10), (22, 18, 40, 10, 0, 400), (33, 27, 90, 10, 0, 27000), (44, 36, 160, 10, 0, 2560000), (None,) * 6]
