"""Each operator against a brute-force version on awkward documents; empty tables and repeated rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, embedding_dedup, exact_dedup, license_scan, line_dedup, minhash, packing, quality, suffix_dedup, toxicity
from quillon.llm.common import connected_components

PATH = bpe.public_path("word_bpe_49k.json")
SPACE = " \t\n\x0b\x0c\r"


def by_id(df, key="doc_id"):
    """{id: row}; rows of one id must agree."""
    out = {}
    for r in df.collect():
        if r[key] in out and r[key] is not None:
            assert out[r[key]] == r
        out[r[key]] = r
    return out


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_bpe(docs, plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = bpe.encode_documents(docs, PATH)
    assert rows.count() == docs.count()
    for i, r in by_id(rows).items():
        if i is not None:
            want = t.encode(plain[i] or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == t.decode(want, skip_special_tokens=False)
    assert {r.doc_id: r.decoded for r in bpe.decode_documents(rows, PATH).collect()} == {r.doc_id: r.decoded for r in rows.collect()}
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_bpe_words():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(PATH), bpe.BpeTokenizer(PATH)
    letters = st.sampled_from(list(" '’\n\tabcdestvrlm019.,!?éÀñßΣſİK<|>") + ["<|endoftext|>", "aaaa", "'ll", "日本", "\x1c", "\x85", "́"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(letters, max_size=40).map("".join))
    def same(text):
        assert own.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids

    same()
    assert own.encode(["a" * 3001])[0].tolist() == t.encode("a" * 3001, add_special_tokens=False).ids
    assert own.encode([None, ""])[0].tolist() == []
    assert own.decode([[1 << 20, -1]]) == [""]


def test_exact_dedup(docs, plain):
    got = exact_dedup.exact_dedup(docs)
    assert got.count() == docs.count()
    groups = defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    key = lambda t: t.translate({ord(c): None for c in SPACE})
    for i, t in rows:
        groups[key(t)].append((-len(t), i is None, i or 0, i))
    for r in got.collect():
        match = [g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256]
        best = min(match[0], key=lambda x: x[:3])[3]
        assert (r.keep_id, r.group_size, r.kept) == (best, len(match[0]), r.doc_id == best)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_lsm_index():
    index = exact_dedup.LsmIndex(width=4, memtable_bytes=600, memtable_entries=3)
    try:
        for k in range(40):
            index.put([bytes([0, 0, 0, k % 7])], [b"t%d" % (k % 7)], [k % 3], [k], [1])
        assert len(index.runs) > 2
        assert [(m[0][3], m[1], m[2], m[3], m[4]) for m in index.merged()] == [(d, 2, min(k for k in range(40) if k % 7 == d and k % 3 == 2), len(range(d, 40, 7)), b"t%d" % d) for d in range(7)]
        with pytest.raises(ValueError):
            index.put([bytes([0, 0, 0, 1])], [b"other"], [1], [1], [1])
    finally:
        index.close()


def test_line_dedup(docs, plain):
    got = line_dedup.line_dedup(docs, min_chars=20, min_docs=3, carry=["lang", "n_lines"])
    assert got.count() == docs.count()
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    holders = defaultdict(set)
    for i, t in plain.items():
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    for i, r in by_id(got).items():
        lines = ((plain[i] if i is not None else r.kept_text) or "").split("\n")
        kept = [x for x in lines if i is None or not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        assert (r.kept_text, r.n_lines, r.n_dropped, r["_in_lang"]) == ("\n".join(kept), len(lines), len(lines) - len(kept), "en")
    assert any(r.n_dropped for r in got.collect())
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 400_000), (5, 80, 300)])
def test_near_dedup(docs, plain, k, percent, block):
    got = minhash.near_dedup(docs, minhash.Near(words=k, percent=percent, block=block))
    assert got.count() == docs.count()
    sets = {i: shingle_set(t, k) for i, t in plain.items()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(links, ids)
    assert links
    for i, r in by_id(got).items():
        if i is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), root[i], root[i] == i)
        else:
            assert r.component_id is None and r.kept
    assert minhash.near_dedup(docs.limit(0)).count() == 0


def test_block_links():
    rng = np.random.default_rng(0)
    pool = [np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(4)]
    sets = []
    for k in range(160):
        s = pool[k % 4].copy()
        s[: rng.integers(0, 9)] = rng.integers(0, 1 << 60, 9).astype(np.uint64)[0]
        sets.append(np.unique(s))
    ids = list(range(160))
    want = [(a, b) for a in ids for b in ids if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert roots(minhash.block_links(ids, sets, 85), ids) == roots(want, ids)
    assert minhash.block_links([], [], 85) == []


def removed(texts, span):
    seen, out = {}, {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - span + 1):
            w = raw[p : p + span]
            if w in seen:
                gone[p : p + span] = True
            else:
                seen[w] = 1
        out[i] = raw, gone
    return out


@pytest.mark.parametrize("span", [64, 100])
def test_suffix_dedup(docs, plain, span):
    got = suffix_dedup.suffix_dedup(docs, span=span, shard_bytes=20_000, carry=["lang"])
    assert got.count() == docs.count()
    want = removed(plain, span)
    for i, r in by_id(got).items():
        if i is None:
            assert r.spans == []
            continue
        raw, gone = want[i]
        assert bytes(r.kept) == raw[:0] + bytes(np.frombuffer(raw, np.uint8)[~gone]) and r.n_bytes == len(raw)
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        assert [(s.start, s.stop) for s in r.spans] == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        assert r.kept_text == bytes(r.kept).decode("utf-8", "ignore")
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs, span=20)


def test_suffix_sort(monkeypatch):
    import random

    from quillon.llm import induced

    rng = random.Random(5)
    for case in range(400):
        monkeypatch.setattr(induced, "BLOCK_TUPLES", rng.choice([3, 16_000]))
        monkeypatch.setattr(induced, "_HEAD", rng.choice([1, 7, 65_536]))
        n, sigma = rng.choice([0, 1, 2, 5, 20, 60, 200]), rng.choice([1, 2, 4, 200])
        t = [rng.randint(1, sigma) for _ in range(n)]
        if rng.random() < 0.4:
            t = (t[: rng.randint(0, n)] * 6)[:200]
        if rng.random() < 0.3:
            t = sorted(t) * 2
        text, cap = np.array([*t, 0], np.uint8), rng.choice([3, 10, 50])
        parts = list(induced.suffix_sort(text, 256, cap, memory=rng.choice([10, 10**8])))
        b = text.tolist()
        order = sorted(range(len(b)), key=lambda i: b[i:], reverse=True)
        common = [0] + [next((k for k in range(cap) if b[x + k : x + k + 1] != b[y + k : y + k + 1]), cap) for x, y in zip(order, order[1:], strict=False)]
        assert np.concatenate([p for p, _ in parts]).tolist() == order
        assert np.concatenate([v for _, v in parts]).tolist() == common


def checked_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, plain):
    pieces = packing.tokenize_pieces(docs, PATH, 64).select("doc_id", "piece", "start", "length").cache()
    rows = packing.pack(pieces, 64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == Counter(map(tuple, pieces.collect()))
    total = sum(r.length for r in rows)
    assert checked_packing(rows, 64) <= -(-total // 64) + 1
    assert packing.pack(pieces.limit(0), 64).count() == 0
    odd = pieces.limit(2).withColumn("length", F.lit(None).cast("long"))
    assert [r.sequence_id for r in packing.pack(odd, 64).collect()] == [None, None]
    with pytest.raises(ValueError):
        packing.pack(pieces.limit(1).withColumn("length", F.lit(65).cast("long")), 64)


def test_packing_solver():
    import itertools
    import random

    def least(lengths, capacity):
        for n in itertools.count(1):
            def place(k, rooms):
                return k == len(lengths) or any(place(k + 1, [*rooms[:j], r - lengths[k], *rooms[j + 1 :]]) for j, r in enumerate(rooms) if r >= lengths[k] and r not in rooms[:j])
            if place(0, [capacity] * n):
                return n

    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 10))), reverse=True)
        patterns = packing.solve(Counter(lengths), 20)
        assert Counter(x for f, n in patterns for x in f * n) == Counter(lengths)
        assert all(sum(f) <= 20 for f, _ in patterns)
        assert sum(n for _, n in patterns) == least(lengths, 20)
    assert packing.solve({}, 20) == []


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 64))
    rows = []
    for k in range(120):
        v = base[k % 12] + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.2, 0.3])
        rows.append((k, v.tolist(), k % 3 if k % 10 else None))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 64, 1), (203, [float("nan")] + [1.0] * 63, 1), (204, [None] + [1.0] * 63, 1), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1), (207, [float("inf")] * 64, 1), (None, base[0].tolist(), 0), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("a", F.lit(1)).repartition(3)
    got = by_id(embedding_dedup.embedding_dedup(df), "vec_id")
    good = {i: (np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    ids = [r[0] for r in rows if r[0] is not None]
    root, n = roots(links, ids), Counter(x for pair in links for x in pair)
    assert len(links) > 20
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], root[i], root[i] == i)
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_components(spark):
    import random

    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(pairs, sorted({x for p in pairs for x in p}))
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {x for a, b in pairs if a != b for x in (a, b)}


def labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, docs, module, column):
    known, labels = labelled(spark, "/root/testdata/sf0.01")
    model = module.fit(known, labels)
    rows = module.score(known, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    y, s = np.array([r[column] for r in rows]), np.array([r.score for r in rows])
    good, bad = s[y == 1], s[y == 0]
    assert np.mean(good[:, None] > bad[None, :]) > (0.95 if column == "quality" else 0.8)
    odd = module.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    none = module.fit(known, labels.limit(0))
    assert {r.score for r in module.score(docs.limit(5), none).collect()} == {0.5}
    one = module.fit(known, labels.where(F.col(column) == 1))
    assert all(r.score > 0.9 for r in module.score(docs, one).collect())
    assert module.score(docs.limit(0), model).count() == 0


def test_interactions():
    """Two terms that are harmless alone and toxic together need the machine's vectors."""
    rng = np.random.default_rng(0)
    word = lambda w: toxicity.word_terms(w)[0]
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({word("filler%d" % rng.integers(40))} | ({word("insult")} if a else set()) | ({word("group")} if b else set())), np.int32))
        y.append(float(a and b))
    m = toxicity.learn(rows, np.array(y), epochs=30)
    at = {int(t): k for k, t in enumerate(m.terms)}
    score = lambda *w: m.bias + sum(m.weight[at[word(x)]] for x in w) + (m.vector[at[word(w[0])]] @ m.vector[at[word(w[1])]] if len(w) == 2 else 0)
    assert score("insult", "group") > 0 > max(score("insult"), score("group"))


def test_license_scan(spark, docs):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "nothing here"), (3, "a/b/COPYING", "Licensed under CC BY-NC 4.0."),
        (4, "a/b/c/y.txt", "# Licensed under the Apache License, Version 2.0.\ncode"), (5, "z/x.txt", "the license of the release"), (6, None, "All rights reserved."),
        (7, "a/x.txt", None), (8, "LICENSE.md", "nothing"), (9, "ab/x.txt", ""), (1, "a/LICENSE", "Released under the MIT License."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("term", F.lit(1)).withColumn("name", F.lit("x"))
    got = {r.doc_id: (r.license, r.how, r.directory) for r in license_scan.license_scan(df).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("CC-BY-NC-4.0", "inherited", "a/b"), 3: ("CC-BY-NC-4.0", "own", None), 4: ("Apache-2.0", "own", None), 5: (None, None, None),
        6: ("proprietary", "own", None), 7: ("MIT", "inherited", "a"), 8: (None, None, None), 9: (None, None, None),
    }
    assert license_scan.license_scan(df).count() == len(rows)
    assert license_scan.license_scan(df.limit(0)).count() == 0
    assert license_scan.license_scan(docs.withColumn("path", F.lit("p/q"))).count() == docs.count()
