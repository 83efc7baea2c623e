"""Texts longer than the operators' working parts, and nulls in lists."""

import random

import numpy as np
import pytest

from quillon.llm import bpe, exact_dedup, license_scan, line_dedup, minhash, packing, quality, suffix_dedup, toxicity

PATH = bpe.public_path("word_bpe_49k.json")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def long(spark):
    """1: long; 2: a near copy with other ends; 3: one word; 4: a tail of 1; 5: null."""
    rng = random.Random(9)
    a = prose(rng, 330_000)
    assert len(a.encode()) > suffix_dedup._PART_BYTES and len(a) > bpe._PART_CHARS
    texts = {1: a, 2: "other words first " + a + " and last", 3: "x" * 30_000, 4: a[-50_000:], 5: None}
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2).cache(), texts


def test_tokens(long):
    from tokenizers import Tokenizer

    docs, texts = long
    t = Tokenizer.from_file(PATH)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}
    for r in bpe.encode_documents(docs, PATH).collect():
        assert r.ids == want[r.doc_id] and r.decoded == t.decode(want[r.doc_id], skip_special_tokens=False)
    pieces = packing.pack(packing.tokenize_pieces(docs, PATH, 4096), 4096).collect()
    assert sum(r.length for r in pieces) == sum(len(v) + 1 for v in want.values())
    full, rest = sum((len(v) + 1) // 4096 for v in want.values()), [(len(v) + 1) % 4096 for v in want.values()]
    patterns, proved = packing.search({x: rest.count(x) for x in rest if x}, 4096)
    assert proved and len({r.sequence_id for r in pieces}) == full + sum(n for _, n in patterns)


def test_repeats(long):
    docs, texts = long
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[1].kept.decode() == texts[1] and got[4].kept == b"" and got[5].kept == b""
    assert len(got[2].kept) < 120 and got[2].kept.startswith(b"other words first ")
    # one run of one letter: all but the first window
    assert len(got[3].kept) == 1


def test_near_copies(long):
    docs, _ = long
    p = minhash.Near(words=3, percent=85)
    got = {r.doc_id: r for r in minhash.near_dedup(docs, p).collect()}
    assert got[1].n_shingles > p.block and got[2].component_id == 1
    assert [got[k].component_id for k in (3, 4, 5)] == [3, 4, 5] and got[5].n_shingles == 0


def test_others(long):
    docs, texts = long
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs.union(docs.selectExpr("doc_id + 10", "upper(text)")).union(docs.selectExpr("doc_id + 20", "text || ' '"))).collect()}[1] == 21
    assert all(r.n_dropped == 0 for r in line_dedup.line_dedup(docs).collect())
    machine, trees = toxicity.learn([], np.zeros(0)), quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert {r.score for r in toxicity.score(docs, machine).collect()} | {r.score for r in quality.score(docs, trees).collect()} == {0.5}
    files = docs.selectExpr("doc_id", "'a/x' as path", "if(doc_id = 1, text || '\\nReleased under the MIT License.', text) as text")
    assert {r.doc_id: r.license for r in license_scan.license_scan(files).collect()} == {1: "MIT", 2: None, 3: None, 4: None, 5: None}


def test_decoding_of_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 5, None]), (None, [5]), (4, [5, 99_999_999, -1])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode_documents(rows, PATH).collect()}
    assert got[1] == got[2] == "" and got[3] == got[None] == got[4] != ""
