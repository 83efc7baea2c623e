"""The pigeonhole join finds every pair with a fraction of all comparisons; its SQL agrees on planted links."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import embedding_dedup as E
from quillon.llm.embedding_dedup_query import OP2_SQL


def vectors(rng, n, d=64):
    """n random unit vectors, every twentieth with a near copy beside the threshold."""
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, n - 1, 20):
        side = rng.standard_normal(d)
        side -= side @ x[k] * x[k]
        c = rng.choice([0.9795, 0.9805, 0.99, 0.9999])
        x[k + 1] = c * x[k] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    return x


def joined(labels, parts=1, grid=1):
    """(pairs, comparisons) of the dealt cells of vectors by label."""
    batches, comparisons = [], 0
    ids = 0
    for label, x in labels.items():
        n = len(x)
        column = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        batches.append(pa.RecordBatch.from_arrays([pa.array(np.arange(ids, ids + n)), pa.array([label] * n), column, pa.array([parts] * n, pa.int32()), pa.array([grid] * n, pa.int32())], ["rep", "l", "v", "p", "g"]))
        ids += n
    budget = 2 - 2 * 0.98
    rows = sorted((r for b in E._deal(batches, budget) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:5])
    names = [x.split()[0] for x in E._DEALT.split(", ")]
    made = []
    pairs = E.Cell.pairs

    def counted(self, *args, **named):
        for a, b, n in pairs(self, *args, **named):
            made.append(n)
            yield a, b, n

    E.Cell.pairs = counted
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
        found = {p for b in E._range_join([batch], budget) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    finally:
        E.Cell.pairs = pairs
    return found, sum(made)


@pytest.mark.parametrize(("parts", "grid"), [(1, 1), (1, 2), (3, 1), (2, 2)])
def test_all_links_with_few_comparisons(parts, grid):
    rng = np.random.default_rng(parts * 10 + grid)
    labels = {f"l{k}": vectors(rng, 200) for k in range(5)}
    found, comparisons = joined(labels, parts, grid)
    want, base = set(), 0
    for x in labels.values():
        a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
        want |= set(zip((a + base).tolist(), (b + base).tolist(), strict=True))
        base += len(x)
    assert want and want <= found
    all_pairs = 5 * 200 * 199 / 2
    assert comparisons <= 0.2 * all_pairs, comparisons / all_pairs
    assert len(found) < 2 * len(want) + 20


def test_sql_on_planted_links(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = vectors(rng, 300)
    rows = [(k, v.tolist(), k // 100) for k, v in enumerate(x)]
    rows += [(1000, x[5].tolist(), 0), (1001, x[5].tolist(), 1), (1002, None, 0), (1003, [0.0] * 64, 0), (1004, (x[5] * 3).tolist(), 0), (1005, x[5].tolist(), None), (1006, [float("nan")] * 64, 0), (1007, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({OP2_SQL})").fetchall())
    got = sorted(tuple(r) for r in E.embedding_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want
    assert sum(r[1] for r in got) > 20
