"""Near dedup by circulant MinHash, banding and exact verification.

One permutation spreads the shingles over 2^32 places; a second, shifted by 0, 1, 2, ... places round the circle, gives
every coordinate of the signature. Documents that share a band are candidates; copies with equal sets are one node. Each
document is verified against its bands' leaders (the smallest ids) on the full shingle sets, and what is linked is
joined. A band is done unless documents other than its leader are still apart in it: these, and no others, are verified
among one another. So a band's documents never pull those of another band along, no pairs within a band are emitted, no
band is capped, and one of any size spreads over tasks: a leader's askers are dealt out, and a band that is not done is
cut into blocks of a bounded number of shingles, each pair of blocks one piece of work that gives only links that join
what was apart. Sets are made once for each candidate; texts do not move beyond that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, lean, materialize

_CACHE_WORDS = 150_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Near:
    """Link where 100 * intersection >= percent * union of `words`-word shingles. bands * rows coordinates: at the
    default 32 * 4 a pair at 0.8 is missed by every band once in 2 * 10^7 times."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    #: shingles in one block of a band that is not done, and documents that ask a leader in one task
    block: int = 50_000
    asking: int = 250


_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    cache = _words
    if len(cache) > _CACHE_WORDS:
        cache.clear()
    got = list(map(cache.get, words))
    if None in got:
        for i, v in enumerate(got):
            if v is None:
                w = words[i]
                got[i] = v = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 64:
                    cache[w] = v
    h = np.array(got, np.uint64)
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out + h[i : len(h) - n + 1 + i]) * (_M1 + np.uint64(2 * i))
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


_SLICE = 512


def signature(s: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit hashes: `size` coordinates of 32 bits."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    # first permutation
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _SLICE):
        p = x[at : at + _SLICE] + shift
        # second permutation, of the shifted places
        p *= np.uint32(0x9E3779B1)
        p ^= p >> np.uint32(15)
        p *= np.uint32(0x85EBCA6B)
        p ^= p >> np.uint32(13)
        p *= np.uint32(0xC2B2AE35)
        np.minimum(out, p.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _M2
    for r in range(rows):
        key = _mix(key + parts[:, r] * _M1 + np.uint64(r))
    return key.view(np.int64)


def _sign(batches: Iterable[pa.RecordBatch], p: Near) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        n, digests, keys = [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py() or b"", p.words)
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys.append(band_keys(signature(s, p.bands * p.rows), p.bands, p.rows) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["_q_id", "n_shingles", "_q_set", "_q_bands"],
        )


def block_links(ids: list[int], sets: list[np.ndarray], percent: int, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the documents of a block as all of its links would: exact, by prefix filter and verification.
    joined: a number for each document, equal for those that are joined already.

    The rarest tokens of each set come first; two sets over the threshold share a token among their first
    size - ceil(percent * size / 100) + 1. A document asks only candidates that are not yet joined to it, a few at
    first, all the rest next.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) < 2:
        return []
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(token)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    lone = int((often == 1).sum())  # ranks below it occur once and join nothing
    mark = np.zeros(len(often), np.int8)
    group = np.arange(len(sets))
    if joined is not None:
        first: dict[int, int] = {}
        group = np.array([first.setdefault(c, k) for k, c in enumerate(joined)])
    posting: dict[int, list[int]] = {}
    out: list[tuple[int, int]] = []
    order = np.lexsort((np.array(ids), sizes))

    def find(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    def ask(x: int, others: np.ndarray) -> None:
        """Verify all of others against the marked set of x at once, then join."""
        length = sizes[others]
        ends = np.cumsum(length)
        flat = np.repeat(starts[others] - np.r_[0, ends[:-1]], length) + np.arange(ends[-1])
        inter = np.add.reduceat(mark[token[flat]].astype(np.int64), np.r_[0, ends[:-1]])
        good = others[100 * inter >= percent * (sizes[x] + length - inter)]
        for y in good.tolist():
            a, b = find(x), find(y)
            if a != b:
                group[max(a, b)] = min(a, b)
                out.append((ids[x], ids[y]))

    for x in order.tolist():
        size = int(sizes[x])
        mine = np.sort(token[starts[x] : starts[x] + size])
        prefix = mine[: size - -(-percent * size // 100) + 1]
        prefix = prefix[prefix >= lone].tolist()
        near = [posting[t] for t in prefix if t in posting]
        if near:
            cand = np.unique(np.concatenate([np.array(c) for c in near]))
            cand = cand[100 * sizes[cand] >= percent * size]
            if len(cand):
                mark[mine] = 1
                rest, some = cand[::-1], 8
                while len(rest):
                    own = find(x)
                    rest = rest[[find(y) != own for y in rest.tolist()]]
                    if not len(rest):
                        break
                    ask(x, rest[:some])
                    rest, some = rest[some:], 512
                mark[mine] = 0
        for t in prefix:
            posting.setdefault(t, []).append(x)
    return out


def _shingled(batches: Iterable[pa.RecordBatch], p: Near) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        sets = [shingles(t.as_py() or b"", p.words).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _asked(batches: Iterable[pa.RecordBatch], p: Near) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, role, node, set) sorted by the first three: the leader's own comes before its askers'."""
    key, own = None, np.zeros(0, np.uint64)
    for batch in lean(batches):
        a, b = [], []
        for lead, salt, role, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = np.frombuffer(raw, np.uint64)
            if role == 0:
                key, own = (lead, salt), s
            elif (lead, salt) == key and len(s) and len(own):
                at = np.searchsorted(own, s)
                inter = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                if 100 * inter >= p.percent * (len(own) + len(s) - inter):
                    a.append(node)
                    b.append(lead)
        if a:
            yield _pairs(a, b)


def _verify(batches: Iterable[pa.RecordBatch], p: Near) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, component, node, set) sorted by band and block pair; each run of equal ones is one block."""
    key, ids, sets, joined = None, [], [], []

    def links() -> pa.RecordBatch:
        found = block_links(ids, sets, p.percent, joined)
        return _pairs([a for a, _ in found], [b for _, b in found])

    for batch in lean(batches):
        for *now, component, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if len(ids) > 1:
                    yield links()
                key, ids, sets, joined = now, [], [], []
            ids.append(node)
            sets.append(np.frombuffer(raw, np.uint64))
            joined.append(component)
    if len(ids) > 1:
        yield links()


def near_dedup(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to (id_col, n_shingles long, component_id long, kept boolean), one row per input row.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a shingle is one shingle; a
    null, empty or blank text has none and links with nothing. component_id is the smallest id reachable by links,
    itself included; kept is id = component_id. A row with a null id links with nothing: its component_id is null and
    it is kept. Rows that share an id are one node and have one answer. id_col is a whole number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_q_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("_q_text"))
    signed = materialize(rows.mapInArrow(lambda b: _sign(b, near), "_q_id long, n_shingles long, _q_set binary, _q_bands array<long>"), "near-signed")
    some = signed.where("_q_set is not null and _q_id is not null")
    reps = materialize(some.groupBy("_q_set").agg(F.min("_q_id").alias("rep"), F.first("_q_bands").alias("bands"), F.max("n_shingles").alias("size")), "near-sets")
    keyed = reps.select("rep", "size", F.explode("bands").alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("rep", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    # a table of its own: of the join that follows Spark can then split a frequent band's rows
    first = materialize(first, "near-bands")
    entries = keyed.join(first, "key").where("rep <> lead.rep").select("key", "rep", "size", F.col("lead.rep").alias("lead"), F.col("lead.size").alias("lead_size"))
    entries = materialize(entries, "near-entries")
    candidates = entries.select(F.col("rep").alias("_q_id")).union(entries.select("lead")).distinct()
    sets = materialize(rows.join(candidates.hint("merge"), "_q_id").mapInArrow(lambda b: _shingled(b, near), "node long, set binary"), "near-shingles")

    # each document against its bands' leaders, where the sizes allow a link
    asks = entries.where(100 * F.least("size", "lead_size") >= near.percent * F.greatest("size", "lead_size")).select("lead", "rep").distinct()
    salts = asks.groupBy("lead").agg(F.ceil(F.count("*") / near.asking).cast("int").alias("salts"))
    salts = materialize(salts, "near-salts")
    member = asks.join(salts, "lead").select("lead", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("rep").alias("node"))
    leader = salts.select("lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("lead").alias("node"))
    dealt = member.union(leader).join(sets.hint("merge"), "node").select("lead", "salt", "role", "node", "set")
    dealt = dealt.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role")
    links = materialize(dealt.mapInArrow(lambda b: _asked(b, near), "a long, b long"), "near-links")
    joined = materialize(connected_components(links, "near-first"), "near-joined")

    # bands in which documents other than the leader are still apart; bands of the same documents are one
    of = entries.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("component"))
    marks = [F.sum(F.pmod(F.xxhash64("rep"), F.lit(1 << 31))), F.bit_xor(F.xxhash64("rep", F.lit(1))), F.bit_xor(F.xxhash64("rep", F.lit(2)))]
    within = of.groupBy("key", "component").agg(F.sum("size").alias("size"), *(m.alias(f"m{k}") for k, m in enumerate(marks)))
    whole = [F.sum("m0"), F.bit_xor("m1"), F.bit_xor("m2")]
    open_ = within.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("size"), *(m.alias(f"m{k}") for k, m in enumerate(whole)))
    open_ = open_.where("n > 1").groupBy("m0", "m1", "m2").agg(F.min(F.struct("key", "top", "size")).alias("k"))
    # the largest component's documents, which need no comparison among one another, are in blocks of their own
    blocks = [F.ceil(x / near.block).cast("int") for x in (F.col("k.top.size"), F.col("k.size") - F.col("k.top.size"))]
    open_ = materialize(open_.select("k.key", F.col("k.top.component").alias("top"), blocks[0].alias("p"), blocks[1].alias("q")), "near-open")
    at_top = F.col("component") == F.col("top")
    mine = F.when(at_top, F.pmod(F.xxhash64("rep"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("rep"), F.col("q"))).cast("int")
    members = of.join(open_, "key").select("key", F.col("rep").alias("node"), "component", "p", "q", at_top.alias("at_top"), mine.alias("mine"))
    last = F.col("p") + F.col("q") - 1
    others = F.when(F.col("at_top"), F.sequence("p", last)).otherwise(F.array_remove(F.sequence(F.lit(0), last), F.col("mine")))
    dealt = (
        members.select("key", "node", "component", "mine", F.explode(others).alias("other"))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "component", "node")
        .join(sets.hint("merge"), "node")
        .select("key", "i", "j", "component", "node", "set")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "node")
    )
    late = materialize(dealt.mapInArrow(lambda b: _verify(b, near), "a long, b long"), "near-late")
    if late.limit(1).count():
        joined = connected_components(late.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), "near-last")
    joined = joined.select(F.col("node").alias("rep"), "component")
    for done in (first, entries, sets, salts, links, open_, late):
        discard(done)
    to = reps.select("_q_set", "rep").join(joined, "rep", "left").select("_q_set", F.coalesce("component", "rep").alias("component"))
    out = signed.select("_q_id", "n_shingles", F.when(F.col("_q_id").isNotNull(), F.col("_q_set")).alias("_q_set")).join(to, "_q_set", "left")
    component = F.coalesce("component", "_q_id")
    return out.select(F.col("_q_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("_q_id").eqNullSafe(component).alias("kept"))
