"""Hand-written vectors for the text kernels."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import convert as X
from quillon.functions import text as T
from quillon.functions import textmath as S
from quillon.operators import aggregates as A
from quillon.operators import rows as R


@pytest.fixture(autouse=True)
def columns(spark):
    global a, b
    a, b = F.col("a"), F.col("b")


def one(spark, data, schema, value):
    return [r[0] for r in spark.createDataFrame(data, schema).select(value).collect()]


def two(spark, pairs, value):
    return one(spark, pairs, "a string, b string", value)


def alone(spark, texts, value):
    return one(spark, [(t,) for t in texts], "a string", value)


def test_concat(spark):
    pairs = [("foo", "baz"), ("", "quux"), ("a", None)]
    assert two(spark, pairs, T.concat(a, b)) == ["foobaz", "quux", None]
    assert two(spark, [("hi", "yo"), ("ho", "no")], T.concat_rev(a, b)) == ["yohi", "noho"]
    assert two(spark, pairs, T.concat_null_empty(a, b)) == ["foobaz", "quux", "a"]


def test_predicates(spark):
    assert two(spark, [("abc", "b"), ("def", "x"), ("ghijk", "jk"), ("foo", ""), ("x", None)], T.contains(a, b)) == [True, False, True, False, None]
    assert two(spark, [("abc", "b"), ("def", None)], T.contains(a, b, nulls_false=True)) == [True, False]
    assert two(spark, [("apricot", "ap"), ("apple", "b")], T.starts_with(a, b)) == [True, False]
    assert two(spark, [("tablet", "let"), ("bet", "xyz")], T.ends_with(a, b)) == [True, False]
    assert two(spark, [("abc", "b."), ("abc", ""), ("٣", r"\d")], T.regex_match(a, b)) == [True, False, True]
    with pytest.raises(Exception):
        alone(spark, ["abc"], T.regex_match(a, "["))
    assert alone(spark, ["abc123def456"], T.regex_replace(a, r"\d+", "N")) == ["abcNdefN"]


def test_shapes(spark):
    assert alone(spark, ["", "café", None], T.char_len(a)) == [0, 4, None]
    assert alone(spark, ["hi", "café"], T.byte_len(a)) == [2, 5]
    assert alone(spark, ["\t\n x  "], T.trim(a)) == ["x"]
    assert alone(spark, ["  x "], T.ltrim(a)) == ["x "] and alone(spark, [" x "], T.rtrim(a)) == [" x"]
    assert alone(spark, ["straße"], T.upper(a)) == ["STRASSE"] and alone(spark, ["HELLO"], T.lower(a)) == ["hello"]
    assert alone(spark, ["añb"], T.reverse(a)) == ["bña"]
    assert two(spark, [("hello world", "world"), ("foo", "x"), ("ñhello", "hello"), (None, "x")], T.find(a, b)) == [6, -1, 2, None]
    assert alone(spark, ["abcabc", "xyz"], T.count_matches(a, "abc")) == [2, 0] and alone(spark, ["abc"], T.count_matches(a, "")) == [4]
    assert alone(spark, ["hello world", "foo"], T.substring(a, 6)) == ["world", ""] and alone(spark, ["hello"], T.substring(a, 1, 3)) == ["ell"]
    assert alone(spark, ["foo bar foo"], T.replace(a, "foo", "baz")) == ["baz bar baz"] and alone(spark, ["abc"], T.replace(a, "", "X")) == ["XaXbXcX"]
    assert alone(spark, ["ab"], T.repeat(a, 3)) == ["ababab"]
    assert alone(spark, ["hi", "hello!"], T.pad(a, 5)) == ["   hi", "hello!"]
    assert alone(spark, ["hi"], T.pad(a, 5, "*", "both")) == ["*hi**"] and alone(spark, ["hi"], T.pad(a, 5, "-", "right")) == ["hi---"]
    for bad in ({"side": "up"}, {"fill": "ab"}):
        with pytest.raises(ValueError):
            T.pad(a, 5, **bad)


def test_arithmetic(spark):
    assert one(spark, [("hi", 3), ("x", 0), ("y", -2)], "a string, n int", S.str_num(a, F.col("n"))) == ["hihihi", "", ""]
    assert one(spark, [("x", float("nan")), ("y", 2.9)], "a string, n double", S.str_num(a, F.col("n"))) == ["", "yy"]
    data = [("foo", 1.0), ("bar1", 1.0), ("baz", 2.0)]
    for op, want in (("add", ["foo1", "bar11", "baz2"]), ("subtract", ["foo", "bar", "baz"]), ("multiply", ["foo", "bar1", "bazbaz"]), ("divide", ["foo", "bar|", "baz"])):
        assert one(spark, data, "a string, x double", S.str_float(a, F.col("x"), op)) == want
    assert two(spark, [("hello", "l"), ("goodbye", "bye"), ("test", "xyz")], S.str_str(a, b, "subtract")) == ["helo", "good", "test"]
    assert two(spark, [("x", "123"), ("ab", "ñ")], S.str_str(a, b, "multiply")) == ["xxx", "abab"]
    assert two(spark, [("a,b,c", ","), ("a--b--c", "--"), ("abc", "")], S.str_str(a, b, "divide")) == ["a|b|c", "a|b|c", "abc"]
    with pytest.raises(ValueError):
        S.str_str(a, b, "power")
    df = spark.createDataFrame([("a:b:c", ":"), ("abc", ""), (None, ":"), ("a.b.", "."), ("x", None)], "a string, b string")
    got = [(r.a, r.segment) for r in R.divide_rows(df, "a", "b").collect()]
    assert got == [("a:b:c", "a"), ("a:b:c", "b"), ("a:b:c", "c"), ("abc", "abc"), (None, None), ("a.b.", "a"), ("a.b.", "b"), ("a.b.", ""), ("x", None)]


def test_aggregates(spark):
    df = spark.createDataFrame([(0, "zulu"), (1, None), (2, "alpha"), (3, "zulu")], "pos int, a string")
    row = df.agg(A.str_min(a), A.str_max(a), A.str_count_distinct(a), A.str_join(a, ",", F.col("pos"))).first()
    assert tuple(row) == ("alpha", "zulu", 2, "zulu,alpha,zulu")
    assert df.where("a is null").agg(A.str_join(a, ",", F.col("pos"))).first()[0] is None


def test_crosstab(spark):
    df = spark.createDataFrame([(0, "a", "p"), (1, "b", "p"), (2, "a", "q"), (3, None, "q")], "pos int, x string, y string")
    assert sorted(map(tuple, R.crosstab_long(df, "x", "y").collect())) == [("a", "p", 1), ("a", "q", 1), ("b", "p", 1)]
    assert sorted(map(tuple, R.crosstab_wide(df, "x", "y").collect())) == [("a", 1, 1), ("b", 1, 0)]
    assert sorted(map(tuple, R.first_seen(df, "x", "pos").collect())) == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError):
        R.crosstab_wide(df.limit(0), "x", "y")


def test_co_partition(spark):
    x, y = R.co_partition(spark.range(20), spark.range(0, 20, 2), "id", 3)
    plan = x.join(y.hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and x.join(y, "id").count() == 10


def test_masks(spark):
    df = spark.createDataFrame([(True, True), (False, True), (True, True)], "a boolean, b boolean")
    assert [r.in_mask for r in R.in_mask(df, a, b).collect()] == [True, False, True]
    assert [r.not_in_mask for r in R.not_in_mask(df, a, b).collect()] == [False, True, False]
    assert [r.in_mask for r in R.in_mask(df, a, F.lit(None).cast("boolean")).collect()] == [False] * 3


def test_conversions(spark):
    texts = ["2024-01-01T01:02:03Z", "2024-01-01T01:02:03.500+02:00", "2024-01-01 01:02:03", "2024-01-01", "2024", "zz", "", "2024-13-01"]
    assert alone(spark, texts, X.parse_datetime(a)) == [1704070923000, 1704063723500, 1704070923000, 1704067200000, 2024, None, None, None]
    numbers = [(1.0,), (1e20,), (0.00012,), (1234567890.125,), (-1.5e-7,), (float("nan"),), (float("-inf"),), (1.25e8,)]
    assert one(spark, numbers, "x double", X.float_to_text(F.col("x"))) == ["1", "100000000000000000000", "0.00012", "1234567890.125", "-0.00000015", "NaN", "-inf", "125000000"]
    assert one(spark, numbers[:5], "x double", X.format_finite(F.col("x"))) == ["1", "1e20", "0.00012", "1234567890.125", "-1.5e-7"]
