"""The pipeline against plain Python, stage by stage decisions included."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from test_operators import PATH, checked_packing, removed, roots, shingle_set

import corpus_pipeline
from quillon.llm import quality
from quillon.llm.bpe import BpeTokenizer


def plain_run(texts, trees):
    score = trees.score(np.array([quality.statistics(t or "") for t in texts.values()]).reshape(-1, len(quality.FEATURES)))
    texts = {i: t or "" for (i, t), s in zip(texts.items(), score, strict=True) if s >= corpus_pipeline.LEAST_QUALITY}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i
    texts = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}
    sets = {i: shingle_set(t, 5) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    texts = {i: texts[i] for i, r in roots(links, ids).items() if r == i}
    cut = removed(texts, 100)
    texts = {i: bytes(np.frombuffer(raw, np.uint8)[~hit]).decode("utf-8", "ignore") for i, (raw, hit) in cut.items()}
    t = BpeTokenizer(PATH)
    out = Counter()
    for (i, _), ids_ in zip(texts.items(), t.encode_bytes(texts.values()), strict=True):
        ids_ += (1).to_bytes(4, "little")
        for k in range(0, len(ids_), 4 * 4096):
            part = ids_[k : k + 4 * 4096]
            out[i, k // (4 * 4096), k // 4, len(part) // 4, zlib.crc32(part)] += 1
    return out


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == plain_run({r.doc_id: r.text for r in docs.collect()}, trees)
    assert checked_packing(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_stages_on_awkward_rows(spark, docs, sf_dir):
    """Null ids and texts, repeated rows, more columns; and an empty table."""
    now = docs.select("doc_id", "text", "lang", "source", "n_chars", "kept", "doc")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, now, sf_dir)
        assert new.columns == now.columns and 0 < new.count() <= now.count()
        assert stage(spark, now.limit(0), sf_dir).count() == 0
        now = new
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert last.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
