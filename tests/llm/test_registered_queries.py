"""The registered queries on whole tables: their SQL in DuckDB, or the tokenizers library and plain Python."""

import os
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from quillon.llm import bpe, quality, registry, toxicity
from quillon.llm.common import table


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_path("word_bpe_49k.json"))


def test_all_are_registered():
    import __spark_entry__ as e

    assert sorted(registry.queries()) == sorted(["op1_bpe", "op2_embedding_dedup", "op3_suffix_array", "op4_exact_dedup", "op5_best_fit_packing", "op6_toxicity", "op7_quality", "op8_minhash", "op9_license_scan", "op10_line_dedup"])
    assert set(registry.queries()) | {"pipeline"} <= set(e.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toArrow()
    want = duck.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    assert names == sorted(got.column_names)
    order = [next(k for k, d in enumerate(want.description) if d[0] == n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.to_pylist()) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_op1(spark, sf_dir, texts, library):
    rows = registry.queries()["op1_bpe"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5(spark, sf_dir, texts, library):
    df = registry.queries()["op5_best_fit_packing"](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {k: kinds[k] for k in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")} == {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    by, places, total = {}, {}, 0
    for r in df.collect():
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert sorted(by) == sorted(texts)
    for i, rows in by.items():
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        rows.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in rows] == [(k, 4096 * k) for k in range(-(-len(ids) // 4096))]
        for r in rows:
            own = ids[r.start : r.start + 4096]
            assert r.length == len(own) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-total // 4096)


def plain_machine(machine, text):
    """The score by a sum over all pairs."""
    place = {int(t): k for k, t in enumerate(machine.terms)}
    own = [place[t] for t in toxicity.terms(text).tolist() if t in place]
    z = machine.bias + sum(machine.weight[k] for k in own)
    z += sum(float(machine.vector[a] @ machine.vector[b]) for n, a in enumerate(own) for b in own[:n])
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def plain_trees(trees, text):
    """The score by a walk from the root of each tree."""
    x, z = quality.statistics(text), trees.base
    for root in trees.roots.tolist():
        k = root
        while trees.feature[k] >= 0:
            k = trees.left[k] if x[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
        z += trees.value[k]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@pytest.mark.parametrize(("name", "module", "plain", "least", "label"), [("op6_toxicity", toxicity, plain_machine, 0.5, "toxic"), ("op7_quality", quality, plain_trees, 0.3, "quality")])
def test_classifiers(spark, sf_dir, texts, name, module, plain, least, label):
    rows = registry.queries()[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    model = module.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= least) and 0 <= r.score <= 1
        assert abs(r.score - plain(model, texts[r.doc_id])) < 1e-9


def grown(x, y, trees, depth, rate, least, ridge):
    """Boosted trees by trying every threshold between two values of each statistic."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    total = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        parts = [np.ones(len(y), bool)]
        for _ in range(depth):
            made = []
            for part in parts:
                best = (1e-6, None)
                for f in range(x.shape[1]):
                    for edge in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
                        low = part & (x[:, f] <= edge)
                        high = part & ~low
                        if min(h[low].sum(), h[high].sum()) < least / 4:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (low, high)) - g[part].sum() ** 2 / (h[part].sum() + ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, (low, high))
                made += best[1] or [part]
            parts = made
        for part in parts:
            total[part] += -rate * g[part].sum() / (h[part].sum() + ridge)
    return 1 / (1 + np.exp(-total))


def test_growth_by_plain_search():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    got = quality.grow(x, y, trees=4, depth=2, rate=0.3).score(x)
    want = grown(x, y, 4, 2, 0.3, 5.0, 1.0)
    assert np.abs(got - want).max() < 1e-6
