"""Equal stretches are reduced before they are dealt out by marker; shards are sorted on disk; bytes decide."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quillon.llm import induced, suffix_dedup


def test_runs_of_one_character():
    texts = ["-" * 30_000, "head " + "-" * 20_000 + " tail", " " * 10_000]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([t.encode() for t in texts], pa.binary())], ["_q_id", "_q_text"])
    marks = list(suffix_dedup._mark([batch], 100, 64))
    # one entry for each content, not one for each window
    assert sum(len(x.as_py()) // 8 for m in marks for x in m.column(1)) < 500
    rows = sorted((r for m in marks for r in zip(*(c.to_pylist() for c in m.columns), strict=True)), key=lambda r: r[0])
    packed = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 8))], marks[0].schema.names)
    windows = {1: np.zeros(29_901, bool), 2: np.zeros(19_911, bool), 3: np.zeros(9_901, bool)}
    raw = {k + 1: t for k, t in enumerate(texts)}
    for spans in suffix_dedup._match([packed], 100):
        for kind, _, doc, start, run, source, at in zip(*(c.to_pylist() for c in spans.columns), strict=True):
            if kind == 0:
                windows[doc][start : start + run] = True
                assert raw[doc][start : start + run + 99] == raw[source][at : at + run + 99]
    # all windows of the run but the very first are repeats
    assert not windows[1][0] and windows[1][1:].all()
    # the window at 5 lies in a stretch with those before it, which is left to the sort
    assert windows[2][6:19_906].all() and not windows[2][:5].any()
    assert not windows[3][0] and windows[3][1:].all()


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab cd") for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text.encode(), b"short"], pa.binary())], ["_q_id", "_q_text"])
    for size in (128, 1000, 1 << 23):
        monkeypatch.setattr(suffix_dedup, "_LONG_BYTES", size)
        windows = np.zeros(4901, int)
        for m in suffix_dedup._mark([batch], 100, 64):
            for start, run in zip(m.column(4), m.column(5), strict=True):
                for a, n in zip(np.frombuffer(start.as_py(), np.int32), np.frombuffer(run.as_py(), np.uint8), strict=True):
                    windows[a : a + n] += 1
        assert (windows == 1).all()


def _stretches(texts, size=2000):
    """Batches of whole texts as stretches, in order of place."""
    for at in range(0, len(texts), size):
        part = texts[at : at + size]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(at, at + len(part)), pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([len(t) - 99 for t in part], pa.int32()), pa.array(part, pa.binary())],
            ["doc", "start", "run", "raw"],
        )


def test_shard_larger_than_memory(monkeypatch):
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(np.frombuffer(b"etaoinshrdlu", np.uint8), rng.integers(2, 9)).tolist()) for _ in range(3000)]
    base = [b" ".join(words[i] for i in rng.integers(0, 3000, 120)) for _ in range(1000)]
    # half of the texts hold a passage of an earlier one
    texts = [t if k % 2 else base[k // 2][50:400] + t for k, t in enumerate(base)]
    total, memory = sum(map(len, texts)), 150_000
    spills, stores = [], []
    spill, make = induced.BlockQueue.spill, induced.Store.array
    monkeypatch.setattr(induced.BlockQueue, "spill", lambda q: (spills.append(q.bytes), spill(q)))
    monkeypatch.setattr(induced.Store, "array", lambda st, *a, **k: (stores.append(st), make(st, *a, **k))[1])
    # pieces of work as small against the shard as they are against one of a gigabyte
    monkeypatch.setattr(induced.pieces, "__defaults__", (2048,))
    monkeypatch.setattr(induced, "_HEAD", 2048)
    monkeypatch.setattr(suffix_dedup, "_AT_ONCE", 32)
    monkeypatch.setattr(induced, "BLOCK_TUPLES", 4000)
    list(suffix_dedup._sort(_stretches(texts[:50], 50), 100, memory))  # what is imported on the way does not count
    spills.clear(), stores.clear()
    tracemalloc.start()
    got = [r for b in suffix_dedup._sort(_stretches(texts, 50), 100, memory) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 5 * memory and spills and stores[0].on_disk > 10 * total
    assert max(spills) < 2 * memory
    # in memory all of it would take over 25 MB; the rows found are in the figure, too
    assert peak < 10_000_000, peak
    found = {(d, s + k) for d, s, n in got for k in range(n)}
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                want.add((d, s))
            seen.add(w)
    assert found == want and want


def test_hot_marker(spark, monkeypatch):
    """A phrase in many surroundings: its stretches are cut by longer markers, the answer stays."""
    rng = random.Random(2)
    phrase = "a phrase of fifty bytes that very many texts hold. "
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) + " " + phrase + " ".join(rng.choice(words) for _ in range(12)) for _ in range(300)]
    texts += [texts[k][20:] for k in range(0, 300, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.kept for r in suffix_dedup.suffix_dedup(df).collect()}
    monkeypatch.setattr(suffix_dedup, "HOT_CONTENTS", 3)
    assert {r.doc_id: r.kept for r in suffix_dedup.suffix_dedup(df, shard_bytes=5_000).collect()} == want
    assert all(len(want[300 + k]) < len(texts[300 + k]) for k in range(30))


def test_unequal_bytes_of_equal_hashes_stay():
    found = pa.array([[{"start": 0, "run": 1, "raw": b"x" * 100}], [{"start": 0, "run": 1, "raw": b"y" * 100}]], pa.list_(pa.struct([("start", pa.int64()), ("run", pa.int64()), ("raw", pa.binary())])))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"y" * 100, b"y" * 100], pa.binary()), found], ["i", "t", "f"])
    out = next(iter(suffix_dedup._cut([batch], 100, ["doc_id", "n_bytes", "spans", "kept", "kept_text"])))
    assert out.column("kept").to_pylist() == [b"y" * 100, b""]
