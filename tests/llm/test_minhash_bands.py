"""Bands whose documents are apart, in many blocks; the band's largest group next to its candidates; recall."""

import random

import numpy as np
import pytest

from quillon.llm import minhash
from quillon.llm.minhash import Near


def brute(texts, p):
    sets = {i: set(minhash.shingles(t.encode(), p.words).tolist()) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= p.percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [200, 2_000, 100_000])
def test_hot_bands(spark, block):
    rng = random.Random(block)
    words = [f"w{k}" for k in range(400)]
    texts, n = {}, 0
    for group in range(3):
        base = [rng.choice(words) for _ in range(80)]
        for k in range(40):
            w = list(base)
            # chains and stragglers: from copies beside the threshold to texts well below it
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts[1000 - 7 * n] = " ".join(w)
            n += 1
    p = Near(words=3, percent=85, block=block, asking=7)
    got = minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), p)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(texts, p)


def test_blocks_joined_before():
    rng = np.random.default_rng(1)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.r_[base[rng.permutation(100)[:95]], rng.integers(1000, 10**6, 3).astype(np.uint64)]) for _ in range(30)]
    ids = list(range(30))

    def components(links, joined):
        up = list(joined)
        for a, b in links:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    alone = components(minhash.block_links(ids, sets, 85), ids)
    joined = [0 if k < 10 else k for k in ids]
    links = minhash.block_links(ids, sets, 85, joined)
    assert not any(a < 10 and b < 10 for a, b in links)
    after = components(links, joined)
    assert [len({after[j] for j in ids if alone[j] == c}) for c in sorted(set(alone))] == [1] * len(set(alone))


def test_recall_of_bands():
    """Pairs at the threshold share a band: 400 pairs at 0.85 and none is missed; the bound of the README is far smaller."""
    rng = np.random.default_rng(5)
    p, missed = Near(words=3, percent=85), 0
    for _ in range(400):
        common = rng.integers(0, 1 << 63, 170).astype(np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 1 << 63, 15).astype(np.uint64)]) for _ in range(2))
        x, y = (set(minhash.band_keys(minhash.signature(s, p.bands * p.rows), p.bands, p.rows).tolist()) for s in (a, b))
        missed += not x & y
    assert missed == 0
