"""Numbers and times to and from text, against Python; powers, fused products and contingency tables at their edges."""

import random
import struct
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import convert as X
from quillon.functions import numeric as N
from quillon.operators import rows as R


def shortest(value, single):
    return str(np.float32(value)) if single else repr(value)


def plain(text):
    return format(Decimal(text), "f").removesuffix(".0") if "." in format(Decimal(text), "f") else format(Decimal(text), "f")


def scientific(text, least, most):
    d = Decimal(text)
    if d == 0 or Decimal(10) ** -least <= abs(d) < Decimal(10) ** most:
        return plain(text)
    digits = "".join(map(str, d.as_tuple().digits)).rstrip("0")
    sign = "-" if d < 0 else ""
    return f"{sign}{digits[0]}{'.' if digits[1:] else ''}{digits[1:]}e{d.adjusted()}"


@pytest.mark.parametrize(("kind", "fmt", "bits"), [("double", "<d", 64), ("float", "<f", 32)])
def test_random_bit_patterns(spark, kind, fmt, bits):
    rng = random.Random(bits)
    values = [struct.unpack(fmt, rng.getrandbits(bits).to_bytes(bits // 8, "little"))[0] for _ in range(100_000)]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    values += [0.0, -0.0, 1.0, 100.0, 1e13, 1.5e14, 1e16, 9.5e-7, 1e-6, 1e-5, 0.00012, 7.609624449125756e17, 2.0**-44, 9007199254740993.0, 123456789.0]
    values = [struct.unpack(fmt, struct.pack(fmt, v))[0] for v in values]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").repartition(4)
    got = {r.k: (r.t, r.f) for r in df.select("k", X.float_to_text(F.col("v")).alias("t"), X.format_finite(F.col("v")).alias("f")).collect()}
    wrong = []
    for k, v in enumerate(values):
        s = shortest(v, bits == 32)
        want = (plain(s), scientific(s, *X.PLAIN[kind]))
        if got[k] != want:
            wrong.append((v, got[k], want))
    assert not wrong, (len(wrong), wrong[:5])


def test_not_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [tuple(r) for r in df.select(X.float_to_text(F.col("v")), X.format_finite(F.col("v"))).collect()] == [("NaN", "NaN"), ("inf", "inf"), ("-inf", "-inf"), (None, None)]
    assert df.limit(0).select(X.float_to_text(F.col("v"))).collect() == []


def test_iso_times(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        at = datetime(1900, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=rng.randrange(200 * 365 * 86400))
        ms = int(at.timestamp()) * 1000
        basic, away = rng.random() < 0.4, rng.choice([None, "+02", "-05:30", "+14:00"])
        shift = 0 if away is None else int(away[:3]) * 60 + (int(away[0] + away[4:]) if len(away) > 3 else 0)
        local = at + timedelta(minutes=shift)
        week = local.isocalendar()
        day = rng.choice([local.strftime("%Y-%m-%d"), f"{local.year:04}-{local.timetuple().tm_yday:03}", f"{week.year:04}-W{week.week:02}-{week.weekday}"])
        text = day + "T" + local.strftime("%H:%M:%S") + rng.choice(["", ".25", ",5"]) + (away or "Z")
        fraction = 250 if ".25" in text else 500 if ",5" in text else 0
        rows.append((k, text.replace(":", "").replace("T", "_").replace("-", "", 2 if day.count("-") == 2 else 1).replace("_", "T") if basic else text, ms + fraction))
    bad = ["2024-01-01T1:02:03Z", "2024-13-01T00Z", "2024-01-01T00:60Z", "2024-W54-1T00Z", "2024-W10-8T00Z", "2024-000T00Z", "20240101T01:02Z", "2024-01-01 01Z", "2024-01-01T01:02:03Z\n", "2024\n", "1.5", " 2024", "99999999999999999999"]
    rows += [(1000 + k, t, None) for k, t in enumerate(bad)]
    got = spark.createDataFrame(rows, "k int, t string, ms long").select("t", "ms", X.parse_datetime(F.col("t")).alias("got")).where("not (ms <=> got)").collect()
    assert not got, got[:5]
    assert date(2024, 1, 1).isocalendar().week == 1


def test_cardinality_of_nothing(spark):
    df = spark.createDataFrame([(None, 0), (None, 1)], "s string, at int")
    assert df.select(X.cardinality_ratio(F.col("s"))).first()[0] == 0.0
    assert df.limit(0).select(X.cardinality_ratio(F.col("s"))).first()[0] == 0.0
    assert R.sampled_cardinality(df.limit(0), "s", "at").first()[0] == 0.0
    assert R.sampled_cardinality(df, "s", "at").first()[0] == 0.5
    many = spark.range(10_000).select(F.col("id").cast("string").alias("s"), F.col("id").alias("at"))
    assert R.sampled_cardinality(many, "s", "at").first()[0] == 1.0


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "utinyint", "uint", "ubigint"])
def test_powers(spark, kind):
    bits, signed, held = N.KINDS[kind]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    rng = random.Random(bits)
    rows = [(a, b) for a in (low, low + 1, high, 0, 1, 2, 3, min(high, 94906265)) for b in (0, 1, 2, 3, 5, 31, 52, 63, 64, -1)]
    rows += [(rng.randint(low, high), rng.randint(0, 70)) for _ in range(200)] + [(rng.randint(0, 9), rng.randint(0, 30)) for _ in range(200)] + [(None, 2), (2, None)]

    def wrapped(x):
        x %= 1 << bits
        return x - (1 << bits) if signed and x > high else x

    df = spark.createDataFrame([(None if a is None else str(a), b) for a, b in rows], "a string, b long").select(F.col("a").cast(held).alias("a"), "b").cache()
    got = df.select("a", "b", N.int_power(F.col("a"), F.col("b"), kind).alias("p"), *(N.int_power(F.col("a"), k, kind).alias(f"p{k}") for k in (0, 1, 2, 3, 7))).collect()
    for r in got:
        a = None if r.a is None else int(r.a)
        want = None if a is None or r.b is None else wrapped(a ** max(r.b, 0))
        assert (None if r.p is None else int(r.p)) == want, (a, r.b, r.p, want)
        for k in (0, 1, 2, 3, 7):
            assert (None if r[f"p{k}"] is None else int(r[f"p{k}"])) == (None if a is None else wrapped(a**k)), (a, k)


def test_fused(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-1e3, 1e3), rng.uniform(-1e3, 1e3)) for _ in range(500)]
    rows = [(a, b, -a * b) for a, b in rows] + [(1.0, None, 2.0), (None, 1.0, 1.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", N.fma(F.col("a"), F.col("b"), F.col("c")).alias("v"), N.fma(F.col("a"), F.col("b"), F.col("c"), fused=False).alias("u")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.v is None
        else:
            assert r.v == float(Fraction(r.a) * Fraction(r.b) + Fraction(r.c)) and r.u == 0.0
    assert any(r.v not in (None, 0.0) for r in got)


def test_cross_tabulate(spark):
    rows = [(3, "b", "u"), (1, "a", "v"), (2, "a", "u"), (4, "b", "u"), (0, None, "w"), (5, "c", None)]
    df = spark.createDataFrame(rows, "at long, x string, y string")
    got = sorted(tuple(r) for r in R.cross_tabulate(df, "x", "y", "at").collect())
    assert got == [("a", "u", 1, 0, 1, 4), ("a", "v", 1, 0, 0, 4), ("b", "u", 2, 1, 1, 4)]
    assert R.crosstab_wide(df, "x", "y", position="at").columns == ["x", "v", "u"]
    with pytest.raises(Exception, match="no row has both values"):
        R.cross_tabulate(df.where("x is null"), "x", "y", "at").collect()
    with pytest.raises(ValueError, match="no row"):
        R.crosstab_wide(df.where("x is null"), "x", "y")
    many = spark.range(5000).select(F.concat(F.lit("l"), (F.col("id") * 7 % 1301).cast("string")).alias("x"), F.col("id").alias("at"))
    want = {f"l{k * 7 % 1301}": k for k in range(1301)}
    assert {r.x: r.place for r in R.first_seen(many, "x", "at", slices=50).collect()} == want
    assert R.first_seen(many.limit(0), "x", "at").count() == 0
