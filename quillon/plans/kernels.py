"""The kernels as queries over the test tables, each with the same query in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions

from quillon.functions import boolean, convert, numeric, text, textmath
from quillon.operators import aggregates
from quillon.operators import rows as R
from quillon.sources.tables import table

from .deferred import Deferred, built, defer

F, B, X, N, T, S, A = map(defer, (functions, boolean, convert, numeric, text, textmath, aggregates))
c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LINE = ("l_orderkey", "l_linenumber")


def _add(name: str, source: str, keys: tuple[str, ...], columns: dict[str, Deferred], sql: dict[str, str]) -> None:
    """A projection: the keys and computed columns of one table, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*keys, *(built(v).alias(k) for k, v in columns.items()))

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join([*keys, *(f'{v} AS {k}' for k, v in sql.items())])} FROM {source}"


def _grouped(name: str, source: str, keys: tuple[str, ...], columns: dict[str, Deferred], sql: dict[str, str], where: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return (df.where(where) if where else df).groupBy(*keys).agg(*(built(v).alias(k) for k, v in columns.items()))

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join([*keys, *(f'{v} AS {k}' for k, v in sql.items())])} FROM {source}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {', '.join(keys)}" if keys else "")


def _wrap_sql(x: str, bits: int, held: str, signed: bool = True) -> str:
    two, half = 1 << bits, (1 << (bits - 1)) if signed else 0
    return f"((({x}) + {half}) % {two} + {two}) % {two} - {half}".join(("CAST(", f" AS {held})"))


# ------------------------------------------------------------------ integers

_near = {"tinyint": (c("l_linenumber") * 30 - 100, "l_linenumber * 30 - 100"), "smallint": (c("l_linenumber") * 9000 - 32000, "l_linenumber * 9000 - 32000"), "int": (F.lit(2147483647) - c("l_linenumber"), "2147483647 - l_linenumber")}
for _kind, (_a, _s) in _near.items():
    _bits = numeric.KINDS[_kind][0]
    _b = (c("l_orderkey") % (1 << (_bits - 2))).cast(_kind)
    _sb = f"(l_orderkey % {1 << (_bits - 2)})"
    _ops = {"add": "+", "subtract": "-", "multiply": "*"}
    _add(
        f"int_wrap_{_bits}", "lineitem", _LINE,
        {f"{o}_": N.apply_int(_a.cast(_kind), _b, o, _kind) for o in _ops},
        {f"{o}_": _wrap_sql(f"CAST({_s} AS HUGEINT) {x} {_sb}", _bits, _kind) for o, x in _ops.items()},
    )
_big = F.lit(9223372036854775807) - c("l_orderkey")
_sbig = "(CAST(9223372036854775807 AS HUGEINT) - l_orderkey)"
_add(
    "int_wrap_64", "lineitem", _LINE,
    {"add_": N.int_add(_big, c("l_partkey") * 1000003), "subtract_": N.int_subtract(-c("l_orderkey") - 1, _big), "multiply_": N.int_multiply(_big, c("l_partkey") * 1000003 - 7)},
    {"add_": _wrap_sql(f"{_sbig} + l_partkey * 1000003", 64, "BIGINT"), "subtract_": _wrap_sql(f"CAST(-l_orderkey - 1 AS HUGEINT) - {_sbig}", 64, "BIGINT"), "multiply_": _wrap_sql(f"{_sbig} * (l_partkey * 1000003 - 7)", 64, "BIGINT")},
)
for _kind in ("utinyint", "usmallint", "uint"):
    _bits = numeric.KINDS[_kind][0]
    _held = numeric.KINDS[_kind][2]
    _m = 1 << _bits
    _a, _b = (F.lit(_m - 1) - c("l_linenumber")).cast(_held), (c("l_orderkey") % _m).cast(_held)
    _sa, _sb = f"CAST({_m - 1} - l_linenumber AS HUGEINT)", f"(l_orderkey % {_m})"
    _add(
        f"int_wrap_u{_bits}", "lineitem", _LINE,
        {f"{o}_": N.apply_int(_a, _b, o, _kind) for o in _ops},
        {f"{o}_": _wrap_sql(f"{_sa} {x} {_sb}", _bits, _held.upper(), False) for o, x in _ops.items()},
    )
_u64 = 18446744073709551615
_add(
    "int_wrap_u64", "lineitem", _LINE,
    {"add_": N.int_add(F.lit(str(_u64)).cast("decimal(20,0)"), c("l_orderkey"), "ubigint").cast("string"), "subtract_": N.int_subtract(c("l_linenumber"), c("l_orderkey"), "ubigint").cast("string"), "multiply_": N.int_multiply(F.lit(str(_u64 - 1)).cast("decimal(20,0)"), c("l_orderkey"), "ubigint").cast("string")},
    {"add_": f"CAST((CAST({_u64} AS HUGEINT) + l_orderkey) % {_u64 + 1} AS VARCHAR)", "subtract_": f"CAST((CAST(l_linenumber AS HUGEINT) - l_orderkey + {_u64 + 1}) % {_u64 + 1} AS VARCHAR)", "multiply_": f"CAST(({_u64 + 1} - CAST(2 AS HUGEINT) * l_orderkey % {_u64 + 1}) % {_u64 + 1} AS VARCHAR)"},
)
_a, _b = c("l_orderkey") - 3000, c("l_linenumber") - 4
_sa, _sb = "(l_orderkey - 3000)", "(l_linenumber - 4)"
_add("int_div", "lineitem", _LINE, {"q": N.int_divide(_a, _b)}, {"q": f"CASE WHEN {_sb} = 0 THEN NULL ELSE {_sa} // {_sb} END"})
_add("int_mod", "lineitem", _LINE, {"r": N.int_remainder(_a, _b)}, {"r": f"CASE WHEN {_sb} = 0 THEN NULL ELSE {_sa} % {_sb} END"})
_add("int_floordiv", "lineitem", _LINE, {"q": N.int_floordiv(_a, _b)}, {"q": f"CASE WHEN {_sb} = 0 THEN NULL WHEN {_sa} % {_sb} <> 0 AND ({_sa} < 0) <> ({_sb} < 0) THEN {_sa} // {_sb} - 1 ELSE {_sa} // {_sb} END"})
_add("int_pow", "lineitem", _LINE, {"p": N.int_power(c("l_linenumber").cast("bigint"), c("l_quantity").cast("bigint") % 17 - 1)}, {"p": "CASE WHEN CAST(l_quantity AS BIGINT) % 17 - 1 < 0 THEN 1 ELSE CAST(list_reduce(list_prepend(CAST(1 AS HUGEINT), list_transform(range(CAST(l_quantity AS BIGINT) % 17 - 1), lambda k: CAST(l_linenumber AS HUGEINT))), lambda x, y: x * y) AS BIGINT) END"})
_add("int_masked", "lineitem", _LINE, {"v": N.apply_int(_a, _b, "divide", mask=c("l_returnflag") == "R")}, {"v": f"CASE WHEN l_returnflag = 'R' AND {_sb} <> 0 THEN {_sa} // {_sb} END"})

# ------------------------------------------------------------------ floats

_p, _d, _t = c("l_extendedprice"), c("l_discount"), c("l_tax")
_add("float_add_sub_mul", "lineitem", _LINE, {"a": N.apply_float(_p, _d, "add"), "s": N.apply_float(_p, _t, "subtract"), "m": N.apply_float(_p, _d, "multiply")}, {"a": "l_extendedprice + l_discount", "s": "l_extendedprice - l_tax", "m": "l_extendedprice * l_discount"})
_add("float_div_ieee", "lineitem", _LINE, {"q": N.float_divide(_p, _d), "z": N.float_divide(_d, _d)}, {"q": "CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_discount END", "z": "CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE 1.0::DOUBLE END"})
_add("float_mod_ieee", "lineitem", _LINE, {"r": N.float_remainder(_p, c("l_linenumber") - 4.0)}, {"r": "CASE WHEN l_linenumber = 4 THEN 'nan'::DOUBLE ELSE l_extendedprice % (l_linenumber - 4.0::DOUBLE) END"})
_add("float_floordiv", "lineitem", _LINE, {"q": N.float_floordiv(_p, c("l_linenumber") - 4.0)}, {"q": "CASE WHEN l_linenumber = 4 THEN 'inf'::DOUBLE ELSE floor(l_extendedprice / (l_linenumber - 4.0::DOUBLE)) END"})
_add("float_pow_explog", "customer", ("c_custkey",), {"p": F.round(N.float_power(c("c_acctbal"), F.lit(0.5)), 6)}, {"p": "CASE WHEN c_acctbal > 0 THEN round(exp(0.5::DOUBLE * ln(c_acctbal)), 6) WHEN c_acctbal = 0 THEN 0 ELSE 'nan'::DOUBLE END"})
# whole numbers whose product has over 53 bits, taken away from a power of two: only one rounding gives the exact rest
_fa, _fb, _fc = F.lit(2.0**30) + c("l_orderkey"), F.lit(2.0**30) - c("l_partkey") * 3, F.lit(-(2.0**60)) + c("l_linenumber") * 1024.0
_sfma = "(CAST(1073741824 AS HUGEINT) + l_orderkey) * (1073741824 - CAST(l_partkey AS HUGEINT) * 3) - 1152921504606846976 + l_linenumber * 1024"
_add(
    "fma", "lineitem", _LINE,
    {"v": N.fma(_p, -_d, _p, fused=False), "exact": N.fma(_fa, _fb, _fc), "masked": N.fma(_fa, _fb, _fc, c("l_linestatus") == "O")},
    {"v": "l_extendedprice * (-l_discount) + l_extendedprice", "exact": f"CAST({_sfma} AS DOUBLE)", "masked": f"CASE WHEN l_linestatus = 'O' THEN CAST({_sfma} AS DOUBLE) END"},
)

# ------------------------------------------------------------------ ticks

_ms = N.ticks(c("ts"))
_u = c("user_id")
_add(
    "datetime_ops", "events", ("event_id",),
    {"a": N.apply_datetime(_ms, _u, "add"), "s": N.apply_datetime(_ms, _u, "subtract"), "d": N.apply_datetime(_ms, _u + 1, "divide"), "r": N.apply_datetime(_ms, _u + 1, "remainder"), "m": N.apply_datetime(_ms, _u, "multiply"), "p": N.apply_datetime(_u, 3, "power"), "back": N.from_ticks(N.apply_datetime(_ms, F.lit(86400000).cast("bigint"), "add")).cast("string")},
    {"a": "(epoch_us(ts) // 1000) + user_id", "s": "(epoch_us(ts) // 1000) - user_id", "d": "(epoch_us(ts) // 1000) // (user_id + 1)", "r": "(epoch_us(ts) // 1000) % (user_id + 1)", "m": "(epoch_us(ts) // 1000) * user_id", "p": "user_id * user_id * user_id", "back": "strftime(make_timestamp(((epoch_us(ts) // 1000) + 86400000) * 1000), '%Y-%m-%d %H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0'), '0') END"},
)

# ------------------------------------------------------------------ booleans

_m1, _m2 = c("l_returnflag") == "R", c("l_linestatus") == "O"
_s1, _s2 = "(l_returnflag = 'R')", "(l_linestatus = 'O')"
_add(
    "mask_ops", "lineitem", _LINE,
    {"and_": B.and_masks(_m1, _m2), "or_": B.or_masks(_m1, _m2), "xor_": B.xor_masks(_m1, _m2), "not_": B.not_mask(_m1), "eq_": B.eq_mask(_m1, _m2), "ne_": B.ne_mask(_m1, _m2), "bin_": B.binop(_m1, _m2, "xor"), "un_": B.unop(_m2)},
    {"and_": f"{_s1} AND {_s2}", "or_": f"{_s1} OR {_s2}", "xor_": f"{_s1} <> {_s2}", "not_": f"NOT {_s1}", "eq_": f"{_s1} = {_s2}", "ne_": f"{_s1} <> {_s2}", "bin_": f"{_s1} <> {_s2}", "un_": f"NOT {_s2}"},
)
_n1 = F.when(c("l_linenumber") != 3, _m1)
_add("mask_validity", "lineitem", _LINE, {"valid": B.merge_validity(_n1, F.when(c("l_linenumber") != 5, _m2)), "strict": B.propagate(_n1 & _m2, _n1, _m2)}, {"valid": "l_linenumber <> 3 AND l_linenumber <> 5", "strict": f"CASE WHEN l_linenumber <> 3 THEN {_s1} AND {_s2} END"})
QUERIES["mask_in"] = lambda spark, sf: R.in_mask(table(spark, sf, "labels"), built(c("quality") == 1), built(c("toxic") == 1)).select("doc_id", "in_mask")
SQL["mask_in"] = "SELECT doc_id, (quality = 1) IN (SELECT DISTINCT toxic = 1 FROM labels) AS in_mask FROM labels"
QUERIES["mask_not_in"] = lambda spark, sf: R.not_in_mask(table(spark, sf, "labels"), built(c("quality") == 1), built(c("toxic") == 2)).select("doc_id", "not_in_mask")
SQL["mask_not_in"] = "SELECT doc_id, (quality = 1) NOT IN (SELECT DISTINCT toxic = 2 FROM labels) AS not_in_mask FROM labels"
_grouped(
    "mask_aggregates", "lineitem", ("l_linenumber",),
    {"all_eq_": B.all_eq(_m1, _m2), "all_ne_": B.all_ne(_m1, _m2), "differ": B.all_differ(_m1, _m2), "bits": B.popcount(_m1), "trues": B.all_true(c("l_tax") >= 0), "falses": B.all_false(c("l_tax") < 0)},
    {"all_eq_": f"bool_and({_s1} = {_s2})", "all_ne_": f"NOT bool_and({_s1} = {_s2})", "differ": f"bool_and({_s1} <> {_s2})", "bits": f"count(*) FILTER (WHERE {_s1})", "trues": "bool_and(l_tax >= 0)", "falses": "NOT bool_or(l_tax < 0)"},
)
_grouped("mask_empty", "lineitem", (), {"all_eq_": B.all_eq(_m1, _m2), "trues": B.all_true(_m1), "falses": B.all_false(_m1), "bits": B.popcount(_m1)}, {"all_eq_": f"coalesce(bool_and({_s1} = {_s2}), true)", "trues": f"coalesce(bool_and({_s1}), true)", "falses": f"NOT coalesce(bool_or({_s1}), false)", "bits": f"count(*) FILTER (WHERE {_s1})"}, where="l_orderkey < 0")
_add("bitfield_eq", "events", ("event_id",), {"hit": B.bitfield_eq(c("event_id"), 15, 3)}, {"hit": "(event_id & 15) = 3"})

# ------------------------------------------------------------------ text

_brand, _type, _name = c("p_brand"), c("p_type"), c("p_name")
_gap = F.when(c("p_size") % 7 != 0, _type)
_sgap = "CASE WHEN p_size % 7 <> 0 THEN p_type END"
_PART = ("p_partkey",)
_add("str_concat", "part", _PART, {"ab": T.concat(_brand, _gap), "ba": T.concat_rev(_brand, _gap), "filled": T.concat_null_empty(_brand, _gap)}, {"ab": f"p_brand || ({_sgap})", "ba": f"({_sgap}) || p_brand", "filled": f"p_brand || coalesce({_sgap}, '')"})
_pat = F.when(c("p_size") % 5 == 0, F.lit("")).when(c("p_size") % 5 == 1, F.lit(None).cast("string")).when(c("p_size") % 5 == 2, F.left(_name, F.lit(3))).when(c("p_size") % 5 == 3, F.right(_name, F.lit(2))).otherwise(F.lit("a"))
_spat = "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN left(p_name, 3) WHEN 3 THEN right(p_name, 2) ELSE 'a' END"
_spatn = f"({_spat})"
for _n, _f, _sf in (("contains", T.contains, "contains"), ("starts_with", T.starts_with, "starts_with"), ("ends_with", T.ends_with, "suffix")):
    _add(f"str_{_n}", "part", _PART, {"hit": _f(_name, _pat), "hit_nf": _f(_name, _pat, nulls_false=True)}, {"hit": f"{_sf}(p_name, {_spatn}) AND {_spatn} <> ''", "hit_nf": f"coalesce({_sf}(p_name, {_spatn}) AND {_spatn} <> '', false)"})
_add("regex_match", "pages", ("page_id",), {"hit": T.regex_match(c("url"), r"/[a-z]{2}/[0-9]*7"), "none": T.regex_match(c("url"), "")}, {"hit": "regexp_matches(url, '/[a-z]{2}/[0-9]*7')", "none": "false"})
_add("regex_replace", "pages", ("page_id",), {"v": T.regex_replace(c("url"), r"([a-z]+)\.example", "$1.test")}, {"v": r"regexp_replace(url, '([a-z]+)\.example', '\1.test', 'g')"})
_add("str_lengths", "documents", ("doc_id",), {"chars": T.char_len(c("text")), "bytes": T.byte_len(c("text"))}, {"chars": "CAST(length(text) AS INTEGER)", "bytes": "CAST(strlen(text) AS INTEGER)"})
_grouped("str_min_max", "documents", ("lang",), {"lo": A.str_min(c("source")), "hi": A.str_max(c("source")), "n": A.str_count_distinct(c("source"))}, {"lo": "min(source)", "hi": "max(source)", "n": "count(DISTINCT source)"})
_grouped("str_global", "part", (), {"lo": A.str_min(_gap), "hi": A.str_max(_gap), "n": A.str_count_distinct(_gap)}, {"lo": f"min({_sgap})", "hi": f"max({_sgap})", "n": f"count(DISTINCT {_sgap})"})
_add("str_case", "part", _PART, {"up": T.upper(_type), "low": T.lower(_type)}, {"up": "upper(p_type)", "low": "lower(p_type)"})
_padded = F.concat(F.lit("\t  \n"), _name, F.lit(" 　\r\n"))
_WS = "chr(9) || ' ' || chr(160) || chr(10) || chr(13) || chr(12288)"
_spadded = "(chr(9) || ' ' || chr(160) || chr(10) || p_name || ' ' || chr(12288) || chr(13) || chr(10))"
_add("str_trim", "part", _PART, {"t": T.trim(_padded), "l": T.ltrim(_padded), "r": T.rtrim(_padded)}, {"t": f"trim({_spadded}, {_WS})", "l": f"ltrim({_spadded}, {_WS})", "r": f"rtrim({_spadded}, {_WS})"})
_add("str_shape", "customer", ("c_custkey",), {"rev": T.reverse(c("c_name")), "sub": T.substring(c("c_name"), 9), "mid": T.substring(c("c_name"), 2, 5), "past": T.substring(c("c_name"), 100), "twice": T.repeat(c("c_name"), 2), "none": T.repeat(c("c_name"), 0)}, {"rev": "reverse(c_name)", "sub": "substr(c_name, 10)", "mid": "substr(c_name, 3, 5)", "past": "''", "twice": "c_name || c_name", "none": "''"})
_add("str_replace", "part", _PART, {"v": T.replace(_name, "a", "<>"), "edge": T.replace(F.left(_name, F.lit(3)), "", "-")}, {"v": "replace(p_name, 'a', '<>')", "edge": "'-' || substr(p_name, 1, 1) || '-' || substr(p_name, 2, 1) || '-' || substr(p_name, 3, 1) || '-'"})
_seg = c("c_mktsegment")
_add("str_pad", "customer", ("c_custkey",), {"l": T.pad(_seg, 10, " ", "left"), "r": T.pad(_seg, 10, "-", "right"), "b": T.pad(_seg, 13, "*", "both")}, {"l": "CASE WHEN length(c_mktsegment) >= 10 THEN c_mktsegment ELSE lpad(c_mktsegment, 10, ' ') END", "r": "CASE WHEN length(c_mktsegment) >= 10 THEN c_mktsegment ELSE rpad(c_mktsegment, 10, '-') END", "b": "CASE WHEN length(c_mktsegment) >= 13 THEN c_mktsegment ELSE repeat('*', CAST((13 - length(c_mktsegment)) // 2 AS INTEGER)) || c_mktsegment || repeat('*', CAST(13 - length(c_mktsegment) - (13 - length(c_mktsegment)) // 2 AS INTEGER)) END"})
_add("str_find", "documents", ("doc_id",), {"at": T.find(c("text"), "ie"), "first": T.find(c("text"), "")}, {"at": "CAST(CASE WHEN instr(text, 'ie') = 0 THEN -1 ELSE strlen(left(text, instr(text, 'ie') - 1)) END AS INTEGER)", "first": "0"})
_add("str_count", "documents", ("doc_id",), {"n": T.count_matches(c("text"), "en"), "edges": T.count_matches(c("text"), "")}, {"n": "CAST((length(text) - length(replace(text, 'en', ''))) // 2 AS INTEGER)", "edges": "CAST(length(text) + 1 AS INTEGER)"})
_grouped("str_join", "conversations", ("conv_id",), {"all_": A.str_join(c("text"), " / ", F.struct("turn", "role", "text"))}, {"all_": "string_agg(text, ' / ' ORDER BY turn, role, text)"})

# ------------------------------------------------------------------ arithmetic on text

_add("strnum_repeat", "part", _PART, {"v": S.str_num(_brand, c("p_size") % 4 - 1), "same": S.str_num(_brand, c("p_size"), "add")}, {"v": "repeat(p_brand, greatest(p_size % 4 - 1, 0))", "same": "p_brand"})
_vowel = F.when(c("p_size") % 3 == 0, F.lit("")).otherwise(F.lit(" "))
_svowel = "CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' END"
_add("str_arith", "part", _PART, {"a": S.str_str(_name, _gap, "add"), "s": S.str_str(_name, _vowel, "subtract"), "m": S.str_str(_brand, F.left(_name, F.lit(2)), "multiply"), "d": S.str_str(_name, _vowel, "divide")}, {"a": f"p_name || ({_sgap})", "s": f"CASE WHEN ({_svowel}) = '' OR instr(p_name, ' ') = 0 THEN p_name ELSE left(p_name, instr(p_name, ' ') - 1) || substr(p_name, instr(p_name, ' ') + 1) END", "m": "repeat(p_brand, CAST(strlen(left(p_name, 2)) AS INTEGER))", "d": f"CASE WHEN ({_svowel}) = '' THEN p_name ELSE replace(p_name, ' ', '|') END"})
QUERIES["str_div_explode"] = lambda spark, sf: R.divide_rows(table(spark, sf, "part").select("p_partkey", "p_name", functions.lit(" ").alias("sep")), "p_name", "sep").select("p_partkey", functions.col("segment_pos").cast("bigint").alias("segment_pos"), "segment")
SQL["str_div_explode"] = "SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS segment_pos, unnest(string_split(p_name, ' ')) AS segment FROM part"
QUERIES["str_dict_ops"] = lambda spark, sf: R.dict_op(R.dict_op(R.dict_op(table(spark, sf, "part"), "p_brand", "p_type", "add", "a"), "p_brand", "p_type", "multiply", "m"), "p_brand", "p_brand", "subtract", "s").select("p_partkey", "a", "m", "s")
SQL["str_dict_ops"] = "SELECT p_partkey, p_brand || p_type AS a, p_brand AS m, '' AS s FROM part"
_q = c("l_quantity")
_add("strfloat_ops", "lineitem", _LINE, {"a": S.str_float(c("l_returnflag"), _q, "add"), "s": S.str_float(F.concat(F.lit("x17y"), c("l_returnflag")), _q, "subtract"), "m": S.str_float(c("l_returnflag"), _q, "multiply"), "d": S.str_float(F.lit("1-17-170"), _q, "divide"), "wide": S.str_float(c("l_returnflag"), _p * 1e17, "add"), "cut": S.str_float(F.lit("a0.5b"), _q / 2, "subtract")}, {"wide": "l_returnflag || replace(CAST(l_extendedprice * 1e17 AS VARCHAR), 'e+', 'e')", "cut": "CASE WHEN l_quantity = 1 THEN 'ab' ELSE replace('a0.5b', regexp_replace(CAST(l_quantity / 2 AS VARCHAR), '\\.0$', ''), '') END", "a": "l_returnflag || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)", "s": "CASE WHEN instr('x17y', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) = 0 THEN 'x17y' ELSE left('x17y', instr('x17y', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) - 1) || substr('x17y', instr('x17y', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) + length(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))) END || l_returnflag", "m": "repeat(l_returnflag, CAST(l_quantity AS INTEGER))", "d": "replace('1-17-170', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '|')"})

# ------------------------------------------------------------------ contingency tables

QUERIES["crosstab_long"] = lambda spark, sf: R.crosstab_long(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
SQL["crosstab_long"] = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL"
QUERIES["crosstab_wide"] = lambda spark, sf: R.crosstab_wide(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])
SQL["crosstab_wide"] = "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY ALL"
QUERIES["crosstab_labels"] = lambda spark, sf: R.first_seen(table(spark, sf, "events"), "event_type", "event_id").withColumn("place", functions.col("place").cast("bigint"))
SQL["crosstab_labels"] = "SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS place FROM events GROUP BY event_type"

# ------------------------------------------------------------------ conversions

#: Texts and their milliseconds; a time without an offset is UTC.
_TIMES = [
    ("2024-01-01T01:02:03Z", 1704070923000), ("2024-01-01T01:02:03.500+02:00", 1704063723500), ("2024-01-01 01:02:03", 1704070923000), ("2024-01-01", 1704067200000), ("2024", 2024), ("zz", None), ("", None),
    ("2024-01-01T01:02+02", 1704063720000), ("2024-01-01T01Z", 1704070800000), ("20240101T010203Z", 1704070923000), ("20240101T0102,5+0130", 1704065550000), ("2024-060T00:00:00Z", 1709164800000), ("2024-W01-3T12Z", 1704283200000),
    ("2024-02-30T00:00:00Z", None), ("2024-01-01T24:00:00Z", None), ("2024-01-01T01:02:03", None), ("2024\n", None), ("-7", -7), ("1969-12-31T23:59:59.999Z", -1), ("2023-366T00Z", None),
]
_when = F.element_at(F.array(*(F.lit(x) for x, _ in _TIMES)), (c("event_id") % len(_TIMES) + 1).cast("int"))
_add("parse_datetime", "events", ("event_id",), {"ms": X.parse_datetime(_when)}, {"ms": f"CAST([{', '.join('NULL' if x is None else str(x) for _, x in _TIMES)}][event_id % {len(_TIMES)} + 1] AS BIGINT)"})
_add("int_to_text", "orders", ("o_orderkey",), {"s": X.int_to_text(-c("o_custkey"))}, {"s": "CAST(-o_custkey AS VARCHAR)"})


def _positional_sql(x: str) -> str:
    """A double's shortest text without an exponent."""
    s = f"CAST({x} AS VARCHAR)"
    digits, e = f"replace(split_part({s}, 'e', 1), '.', '')", f"CAST(split_part({s}, 'e', 2) AS INTEGER)"
    return rf"CASE WHEN contains({s}, 'e-') THEN '0.' || repeat('0', -{e} - 1) || {digits} WHEN contains({s}, 'e') THEN rpad({digits}, CAST(greatest({e} + 1, length({digits})) AS INTEGER), '0') ELSE regexp_replace({s}, '\.0$', '') END"


_far, _tiny = _p * 1e17, _p * 1e-17
_add(
    "float_to_text", "lineitem", _LINE,
    {"q": X.float_to_text(_q), "p": X.float_to_text(_p), "f": X.format_finite(_d), "far": X.float_to_text(_far), "tiny": X.float_to_text(_tiny), "far_e": X.format_finite(_far), "tiny_e": X.format_finite(_tiny), "third": X.float_to_text(_p / 3)},
    {"q": "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)", "p": r"regexp_replace(CAST(l_extendedprice AS VARCHAR), '\.0$', '')", "f": r"regexp_replace(CAST(l_discount AS VARCHAR), '\.0$', '')",
     "far": _positional_sql("(l_extendedprice * 1e17)"), "tiny": _positional_sql("(l_extendedprice * 1e-17)"), "far_e": "replace(CAST(l_extendedprice * 1e17 AS VARCHAR), 'e+', 'e')", "tiny_e": "regexp_replace(CAST(l_extendedprice * 1e-17 AS VARCHAR), 'e-0?', 'e-')", "third": r"regexp_replace(CAST(l_extendedprice / 3 AS VARCHAR), '\.0$', '')"},
)
QUERIES["cardinality"] = lambda spark, sf: table(spark, sf, "part").agg(built(X.cardinality_ratio(c("p_brand")) < 0.75).alias("low"), built(X.cardinality_ratio(F.when(c("p_size") < 0, c("p_brand")))).alias("none"))
SQL["cardinality"] = "SELECT count(DISTINCT p_brand) / count(p_brand) < 0.75 AS low, 0.0::DOUBLE AS none FROM part"


def _cardinality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (functions.col("event_id") % 97).cast("string").alias("few"), (functions.col("event_id") - functions.lit(1)).alias("at"), functions.col("event_id").cast("string").alias("own"))
    lowest = rows.agg(functions.min("at").alias("low"))
    rows = rows.crossJoin(functions.broadcast(lowest)).withColumn("at", functions.col("at") - functions.col("low"))
    made = [R.sampled_cardinality(rows, name, "at").select(functions.lit(name).alias("name"), "ratio") for name in ("event_type", "few", "own")]
    made.append(R.sampled_cardinality(rows.where("at < 0"), "own", "at").select(functions.lit("empty").alias("name"), "ratio"))
    return functools.reduce(DataFrame.union, made)


QUERIES["cardinality_sample"] = _cardinality_sample
SQL["cardinality_sample"] = """
WITH r AS (SELECT event_type, CAST(event_id % 97 AS VARCHAR) AS few, CAST(event_id AS VARCHAR) AS own, event_id - min(event_id) OVER () AS place, greatest(count(*) OVER () // 256, 1) AS step, least(count(*) OVER (), 256) AS size FROM events),
s AS (SELECT * FROM r WHERE place % step = 0)
SELECT 'event_type' AS name, least(count(DISTINCT event_type), 256) / CAST(max(size) AS DOUBLE) AS ratio FROM s
UNION ALL SELECT 'few', least(count(DISTINCT few), 256) / CAST(max(size) AS DOUBLE) FROM s
UNION ALL SELECT 'own', least(count(DISTINCT own), 256) / CAST(max(size) AS DOUBLE) FROM s
UNION ALL SELECT 'empty', 0.0"""


def _co_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines dealt out alike: the join and the grouping that follow need no other shuffle."""
    left, right = R.co_partition(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return left.join(right.hint("merge"), "o_orderkey").groupBy("o_orderkey").agg(functions.count("*").alias("n"), functions.max("l_linenumber").alias("last"))


QUERIES["co_partition"] = _co_partitioned
SQL["co_partition"] = "SELECT o_orderkey, count(*) AS n, max(l_linenumber) AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


def _text_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which operators arithmetic on text defines: the others are an error when the expression is built."""
    a, x = functions.col("p_brand"), functions.col("p_size")

    def defined(make: Callable[[], object]) -> bool:
        try:
            make()
        except ValueError:
            return False
        return True

    rows = [(op, defined(lambda op=op: textmath.str_str(a, a, op)), defined(lambda op=op: textmath.str_float(a, x, op))) for op in numeric.OPERATORS]
    return spark.createDataFrame(rows, "op string, text boolean, float boolean")


QUERIES["text_operators"] = _text_operators
SQL["text_operators"] = "SELECT op, op IN ('add', 'subtract', 'multiply', 'divide') AS text, op IN ('add', 'subtract', 'multiply', 'divide') AS float FROM (VALUES ('add'), ('subtract'), ('multiply'), ('divide'), ('remainder'), ('power'), ('floordiv')) t(op)"
QUERIES["cross_tabulate"] = lambda spark, sf: R.cross_tabulate(table(spark, sf, "events").withColumn("odd", functions.col("user_id") % 5), "event_type", "odd", "event_id")
SQL["cross_tabulate"] = """
WITH e AS (SELECT event_type, user_id % 5 AS odd, event_id FROM events),
x AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS x_place FROM e GROUP BY event_type),
y AS (SELECT odd, row_number() OVER (ORDER BY min(event_id)) - 1 AS y_place FROM e GROUP BY odd)
SELECT event_type, odd, count(*) AS n, CAST(any_value(x_place) AS INTEGER) AS x_place, CAST(any_value(y_place) AS INTEGER) AS y_place, CAST(sum(count(*)) OVER () AS BIGINT) AS total
FROM e JOIN x USING (event_type) JOIN y USING (odd) GROUP BY event_type, odd"""


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
