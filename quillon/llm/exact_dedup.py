"""Exact dedup by a log-structured merge index over digests.

Each task keeps an index: a memtable that is flushed as a run sorted by digest, with a Bloom filter of its own, when it
reaches its bound; a compaction that merges all runs and keeps the smallest identifiers. A digest that is met again is
a hit, and a hit is verified byte for byte against the text the index holds before it counts. The first level works on
the input's partitions, so that of a group of copies each task passes on one entry; the second on the entries dealt
out by digest.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, lean, local_tmp, remove_tree

#: Bytes of text and number of entries at which a memtable is flushed.
MEMTABLE_BYTES = 24_000_000
MEMTABLE_ENTRIES = 60_000
_LAST = (1 << 63) - 1  # stands for a null id: after every other


class _Run:
    """Entries sorted by digest in files of one folder: a column each for digests, longest, id and count, and the texts."""

    def __init__(self, path: str, digests: np.ndarray, stats: np.ndarray, texts: Iterable[bytes], width: int):
        self.n, self.width = len(digests), width
        digests.tofile(f"{path}.digest")
        stats.tofile(f"{path}.stats")
        ends = np.zeros(self.n + 1, np.int64)
        with open(f"{path}.text", "wb") as f:
            for k, t in enumerate(texts):
                f.write(t)
                ends[k + 1] = ends[k] + len(t)
        self.ends = ends
        self.digests = np.memmap(f"{path}.digest", f"S{width}", "r", shape=(self.n,))
        self.stats = np.memmap(f"{path}.stats", np.int64, "r", shape=(self.n, 3))
        self.file = open(f"{path}.text", "rb")
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ) if ends[-1] else b""
        self.bits = 1 << max(10, int(self.n * 10).bit_length())
        self.filter = np.zeros(self.bits // 8, np.uint8)
        for h in self._hashes(digests):
            np.bitwise_or.at(self.filter, h >> 3, np.uint8(1) << (h & 7).astype(np.uint8))

    def _hashes(self, digests: np.ndarray) -> Iterator[np.ndarray]:
        raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), self.width)
        words = np.zeros((len(digests), 16), np.uint8)
        words[:, : min(16, self.width)] = raw[:, :16]
        words = words.view("<u8")
        for k in range(4):
            yield ((words[:, 0] + np.uint64(k) * (words[:, 1] | np.uint64(1))) % np.uint64(self.bits)).astype(np.int64)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Each digest's place, or -1; the filter spares most searches."""
        out = np.full(len(digests), -1)
        maybe = np.ones(len(digests), bool)
        for h in self._hashes(digests):
            maybe &= (self.filter[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(maybe)
        if len(at):
            p = np.minimum(np.searchsorted(self.digests, digests[at]), self.n - 1)
            hit = self.digests[p] == digests[at]
            out[at[hit]] = p[hit]
        return out

    def text(self, k: int) -> bytes:
        return self.map[self.ends[k] : self.ends[k + 1]]

    def close(self) -> None:
        if self.map:
            self.map.close()
        self.file.close()


class LsmIndex:
    """digest -> (code points of the longest original, its id, how many); ids that are null come last.

    put() takes batches; merged() yields the compacted entries in digest order. Different texts with equal digests
    raise ValueError: no result is given that bytes do not bear out.
    """

    def __init__(self, width: int = 32, memtable_bytes: int = MEMTABLE_BYTES, memtable_entries: int = MEMTABLE_ENTRIES):
        self.folder, self.width = local_tmp(), width
        self.most_bytes, self.most_entries = memtable_bytes, memtable_entries
        self.table: dict[bytes, list] = {}
        self.bytes = 0
        self.runs: list[_Run] = []

    def put(self, digests: list[bytes], texts: list[bytes], chars: list[int], ids: list[int], counts: list[int]) -> None:
        known: dict[int, tuple[_Run, int]] = {}
        if self.runs:
            asked = np.array(digests, f"S{self.width}")
            for run in self.runs:
                for k in np.flatnonzero((at := run.find(asked)) >= 0).tolist():
                    known.setdefault(k, (run, int(at[k])))
        for k, (d, text, c, i, n) in enumerate(zip(digests, texts, chars, ids, counts, strict=True)):
            have = self.table.get(d)
            if have is None:
                stored = text
                if k in known:  # a hit in an older run: its text stays there
                    run, at = known[k]
                    self._same(run.text(at), text, d)
                    stored = b""
                self.table[d] = [c, i, n, stored, known.get(k)]
                self.bytes += len(stored) + 200
                continue
            held = have[3] if have[4] is None else have[4][0].text(have[4][1])
            self._same(held, text, d)
            if (c, -i) > (have[0], -have[1]):
                have[0], have[1] = c, i
            have[2] += n
        if self.bytes > self.most_bytes or len(self.table) > self.most_entries:
            self.flush()

    @staticmethod
    def _same(a: bytes, b: bytes, digest: bytes) -> None:
        if a != b:
            raise ValueError(f"different texts share the digest {digest.hex()}")

    def flush(self) -> None:
        if not self.table:
            return
        order = sorted(self.table)
        rows = [self.table[d] for d in order]
        stats = np.array([r[:3] for r in rows], np.int64)
        self.runs.append(_Run(os.path.join(self.folder, f"run{len(self.runs)}"), np.array(order, f"S{self.width}"), stats, (r[3] for r in rows), self.width))
        self.table, self.bytes = {}, 0

    def merged(self) -> Iterator[tuple[bytes, int, int, int, bytes]]:
        """Compaction: (digest, code points, id, count, text) of all runs, in digest order, one run's row at a time."""
        import heapq

        self.flush()

        def rows(run: _Run, age: int) -> Iterator[tuple]:
            raw = run.digests.tobytes() if run.n < 200_000 else None
            for k in range(run.n):
                d = raw[k * self.width : (k + 1) * self.width] if raw is not None else run.digests[k : k + 1].tobytes()
                yield d, age, k

        now = None
        for d, age, k in heapq.merge(*(rows(r, a) for a, r in enumerate(self.runs))):
            run = self.runs[age]
            c, i, n = run.stats[k].tolist()
            if now is not None and now[0] == d:
                if (c, -i) > (now[1], -now[2]):
                    now[1], now[2] = c, i
                now[3] += n
                continue
            if now is not None:
                yield tuple(now)
            now = [d, c, i, n, run.text(k)]  # the oldest run has the text
        if now is not None:
            yield tuple(now)

    def close(self) -> None:
        for r in self.runs:
            r.close()
        remove_tree(self.folder)


_ENTRY = "_q_digest binary, _q_chars long, _q_id long, _q_n long, _q_text binary"


def _level(batches: Iterable[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ENTRY.split(", ")][: 5 if with_text else 4]
    index = LsmIndex()
    try:
        for part in lean(batches):
            index.put(*(part.column(k).to_pylist() for k in (0, 4, 1, 2, 3)))
        out, size = [], 0
        for row in index.merged():
            out.append(row)
            size += len(row[4]) + 100
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out))[: len(names)], (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out))[: len(names)], (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)
    finally:
        index.close()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to (id_col, keep_id long, group_size long, kept boolean, text_sha256 string), a row per input row.

    Texts are equal when identical after ASCII white space is deleted; null counts as empty. Of equal texts the row with
    the most code points in its original text stays, then the smallest id (null ids last). Repeated rows count in
    group_size and are kept or dropped together. id_col is a whole number; other columns do not matter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_q_doc"), text.alias("_q_raw")).select(
        "_q_doc", F.sha2(F.translate("_q_raw", ASCII_SPACE, ""), 256).alias("text_sha256"), "_q_raw"
    )
    entries = rows.select(
        F.unhex("text_sha256").alias("_q_digest"),
        F.char_length("_q_raw").cast("long").alias("_q_chars"),
        F.coalesce("_q_doc", F.lit(_LAST)).alias("_q_id"),
        F.lit(1).cast("long").alias("_q_n"),
        F.translate("_q_raw", ASCII_SPACE, "").cast("binary").alias("_q_text"),
    )
    runs = entries.mapInArrow(lambda b: _level(b, True), _ENTRY)
    groups = runs.repartition("_q_digest").mapInArrow(lambda b: _level(b, False), _ENTRY.rpartition(",")[0])
    groups = groups.select(F.lower(F.hex("_q_digest")).alias("text_sha256"), F.when(F.col("_q_id") != _LAST, F.col("_q_id")).alias("keep_id"), F.col("_q_n").alias("group_size"))
    out = rows.select("_q_doc", "text_sha256").join(groups, "text_sha256")
    return out.select(F.col("_q_doc").alias(id_col), "keep_id", "group_size", F.col("_q_doc").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
