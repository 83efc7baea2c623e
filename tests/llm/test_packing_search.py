"""The packing search against an exact one, where best-fit misses the optimum; columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import packing


def least(items, capacity):
    """The least number of sequences, over all subsets."""
    dp = [(len(items) + 1, 0)] * (1 << len(items))
    dp[0] = (0, capacity)
    for m in range(1 << len(items)):
        n, full = dp[m]
        for k, x in enumerate(items):
            if not m >> k & 1:
                dp[m | 1 << k] = min(dp[m | 1 << k], (n, full + x) if full + x <= capacity else (n + 1, x))
    return dp[-1][0]


def count(items):
    out = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out


def test_best_fit_misses_and_the_search_proves():
    items = [1994, 735, 1466, 2120, 1205, 1158, 1402, 1900]
    c = count(items)
    assert sum(n for _, n in packing.best_fit(c, 4096)) == 4
    patterns, proved = packing.search(c, 4096)
    assert sum(n for _, n in patterns) == 3 and proved
    assert packing._histogram(patterns) == c and all(sum(p) <= 4096 for p, _ in patterns)
    # the same with every length many times: patterns are applied often, and one less often than it fits
    many = {x: 1000 * n for x, n in c.items()}
    patterns, _ = packing.search(many, 4096)
    assert packing._histogram(patterns) == many and sum(n for _, n in patterns) <= 3 * 1000 + 334


def test_search_is_exact_on_small_histograms():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([30, 100, 4096])
        items = [rng.randint(max(1, capacity // 10), capacity * 6 // 10) for _ in range(rng.randint(6, 11))]
        patterns, proved = packing.search(count(items), capacity)
        assert packing._histogram(patterns) == count(items) and all(sum(p) <= capacity for p, _ in patterns)
        assert proved and sum(n for _, n in patterns) == least(items, capacity), items


def test_fillings_are_complete():
    import numpy as np

    c = np.zeros(21, np.int64)
    for x, n in {9: 2, 7: 1, 5: 2, 4: 1, 2: 1}.items():
        c[x] = n
    got = list(packing.completions(c, 20, 3))
    pool = [9, 9, 7, 5, 5, 4, 2]
    want = set()
    for m in range(1 << len(pool)):
        f = tuple(sorted((x for k, x in enumerate(pool) if m >> k & 1), reverse=True))
        rest = list(pool)
        for x in f:
            rest.remove(x)
        waste = 20 - sum(f)
        if 0 <= waste <= 3 and not any(x <= waste for x in rest):
            want.add(f)
    assert set(got) == want and len(got) == len(want)
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
    assert list(packing.completions(c, 20, 3, effort=5))[-1] is None


def test_clashing_columns(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).cast("long").alias("length"), *(F.lit(5).alias(n) for n in ("sequence_id", "offset", "_q_part", "_q_rank")))
    df = df.union(spark.createDataFrame([(99, None, 1, 1, 1, 1), (98, 0, 1, 1, 1, 1)], df.schema))
    out = packing.pack(df, 10)
    assert out.columns[-2:] == ["sequence_id", "offset"] and "_in_offset" in out.columns
    rows = out.collect()
    assert len(rows) == 22 and {r.doc_id for r in rows if r.sequence_id is None} == {98, 99}
    with pytest.raises(ValueError, match="longer"):
        packing.pack(df, 3)
