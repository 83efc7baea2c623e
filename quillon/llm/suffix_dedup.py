"""Suffix-array dedup: bytes that lie in a passage found earlier go.

1. Every window of `span` bytes has a marker, the k-gram of least hash in it; windows in a row with one marker form a
   stretch. Equal windows have equal markers, so only stretches whose marker occurs twice can hold a repeat, and windows
   are compared only within a marker. Markers, contents' hashes and places are dealt out by marker. Of stretches whose
   contents agree the earliest goes on, at the map side first (of each 250,000 stretches of a task); the others are
   copies of it, put together where they follow one another. A copy counts only once its bytes have been compared with
   those of the place it was taken from.
2. What is left of a repeated marker (unequal stretches) is fetched, dealt into shards by marker, and sorted by external
   induced sorting with common-prefix values (induced.py), in bounded memory whatever the size of the shard. In a run of
   suffixes with `span` bytes in common all but the earliest window are repeats. Stretches of a marker with very many
   contents are cut into those of the markers of twice the length, which go to shards of their own.
3. Each document's repeats, and the bytes of those that are copies, are joined to it by its id and cut out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, local_tmp, materialize, remove_tree, schema_of, utf8_views
from .induced import MEMORY_BYTES, Kept, Store, Writer, pieces, suffix_sort

_GRAM = 32
_PART_BYTES = 1 << 20
#: A longer text is marked in parts of this size, which overlap; places in a part have so many bits.
_LONG_BYTES, _PLACE_BITS = 1 << 23, 24
#: Stretches of a shard that are worked on at once.
_AT_ONCE = 512
#: A marker with more contents than this is cut by markers of twice the length.
HOT_CONTENTS = 2_000
_FIVE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MUL[4]
    h ^= h >> np.uint64(29)
    h *= _MUL[5]
    h ^= h >> np.uint64(32)
    return h


def _gram_hashes(raw: np.ndarray, gram: int = _GRAM) -> np.ndarray:
    """A 64-bit hash of the gram bytes, a power of two, from each place on."""
    h = _FIVE[raw]
    size = 1
    while size < gram:
        h = h[:-size] * _MUL[size.bit_length() % 6 - 1] + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    return _mixed(h)


def _row_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """64-bit hashes of the bytes [start, start + size), from the sums of symbol times power up to each place."""
    up, down = powers
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_FIVE[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[start + size] - sums[start]) * down[start]
    return _mixed(h + size.astype(np.uint64) * _MUL[3])


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        base = int(_MUL[0]) | 1
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _tables[size] = (made[0], made[1])
    return _tables[size]


def stretches(raw: np.ndarray, span: int, gram: int = _GRAM) -> tuple[np.ndarray, ...]:
    """(start, windows in it, marker's place, marker's hash) of the stretches of at least span bytes in a row."""
    width = span - gram + 1
    h = _gram_hashes(raw, gram)
    # the place in the low bits makes the least unique: of hashes equal but for these bits the leftmost
    bits = np.uint64(_PLACE_BITS)
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, len(at)]), at[first], h[at[first]]


_MARK = "bucket int, marker binary, content binary, doc binary, start binary, run binary, source binary, source_start binary"
_SPAN = "kind int, key long, doc long, start long, run int, source long, source_start long"
_FETCHED = "kind int, key long, doc long, start long, run int, raw binary"
#: Kinds of spans: copies of another place, stretches to be sorted, those of a marker with very many contents.
_COPY, _SORT, _HOT = 0, 1, 2


def _mark(batches: Iterable[pa.RecordBatch], span: int, buckets: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _MARK.split(", ")]
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def dealt() -> Iterator[pa.RecordBatch]:
        marker, content, doc, start, run = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = (marker % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((start, doc, content, marker, bucket))
        marker, content, doc, start, run, bucket = (x[order] for x in (marker, content, doc, start, run, bucket))
        new = np.r_[True, (marker[1:] != marker[:-1]) | (content[1:] != content[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(marker)), 0))
        later = (doc != doc[first]) | (start != start[first])
        if later.any():
            # copies whatever other tasks hold; without marker and content they only pass through
            d, s, r, o, f = chained(*(x[later] for x in (doc, start, run, doc[first], start[first])))
            own = (d % buckets).astype(np.int32)
            order = np.argsort(own, kind="stable")
            d, s, r, o, f, own = (x[order] for x in (d, s, r, o, f, own))
            yield by_bucket(own, [None, None, d, s.astype(np.int32), r.astype(np.int32), o, f.astype(np.int32)])
        yield by_bucket(bucket[new], [marker[new], content[new], doc[new], start[new].astype(np.int32), run[new].astype(np.uint8), None, None])

    def by_bucket(bucket: np.ndarray, columns: list[np.ndarray | None]) -> pa.RecordBatch:
        ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
        cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        packed = [[b"" if x is None else x[a:b].tobytes() for a, b in cuts] for x in columns]
        return pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1]), *(pa.array(c, pa.binary()) for c in packed)], names)

    for batch in lean(batches):
        raw, offsets = utf8_views(batch.column(1))
        ids = batch.column(0).to_numpy()
        k = 0
        while k < len(ids):
            # several texts at a time: a window may not lie across their borders
            e = k + 1
            while e < len(ids) and offsets[e + 1] - offsets[k] <= _PART_BYTES:
                e += 1
            for base in range(int(offsets[k]), int(offsets[e]), _LONG_BYTES):
                part = raw[base : min(base + _LONG_BYTES + span - 1, int(offsets[e]))]
                if len(part) < span:
                    continue
                start, run, place, marker = stretches(part, span)
                bounds = offsets[k : e + 1] - base
                # a window inside a text has its marker there too; the stretch's other windows cross a border
                own = np.searchsorted(bounds, place, "right") - 1
                stop = np.minimum(start + run, bounds[own + 1] - span + 1)
                start = np.maximum(start, bounds[own])
                good = stop > start
                start, run, marker, own = start[good], (stop - start)[good], marker[good], own[good]
                if len(start):
                    content = _row_hashes(part, start, run + span - 1, _powers(len(part)))
                    held.append((marker, content, ids[k:e][own], start - bounds[own], run))
                    size += len(start)
            k = e
            if size > 250_000:
                yield from dealt()
                size = 0
    if held:
        yield from dealt()


def chained(doc: np.ndarray, start: np.ndarray, run: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Copies, those that follow one another in both places put together."""
    start, run, source_start = (x.astype(np.int64) for x in (start, run, source_start))
    shift = start - source_start
    order = np.lexsort((start, shift, source, doc))
    doc, start, run, source, shift = (x[order] for x in (doc, start, run, source, shift))
    f = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] != start[:-1] + run[:-1])])
    return doc[f], start[f], np.add.reduceat(run, f), source[f], start[f] - shift[f]


def _runs(rows: Iterable[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    key, own = None, []
    for row in rows:
        if row[0] != key:
            if own:
                yield key, own
            key, own = row[0], []
        own.append(row[1:])
    if own:
        yield key, own


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in lean(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _spans(kind: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, run: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((kind, key, doc, start, run, source, source_start), kinds, strict=True)], [x.split()[0] for x in _SPAN.split(", ")])


def _match(batches: Iterable[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """A bucket's stretches: those whose content was seen earlier are copies, the rest of a repeated marker is to be sorted."""
    for _, rows in _runs(_rows(batches)):
        told = [r for r in rows if not r[0]]
        if told:
            kinds = (np.int64, np.int32, np.int32, np.int64, np.int32)
            doc, start, run, source, source_start = (np.frombuffer(b"".join(c), k) for c, k in zip(list(zip(*told))[2:], kinds, strict=True))
            none = np.zeros(len(doc), np.int64)
            yield _spans(none, none, doc, start, run, source, source_start)
        rows = [r for r in rows if r[0]]
        if not rows:
            continue
        kinds = (np.uint64, np.uint64, np.int64, np.int32, np.uint8)
        marker, content, doc, start, run = (np.frombuffer(b"".join(c), k) for c, k in zip(list(zip(*rows))[:5], kinds, strict=True))
        del rows
        order = np.lexsort((start, doc, content, marker))
        marker, content, doc, start, run = (x[order] for x in (marker, content, doc, start, run))
        new_m = np.r_[True, marker[1:] != marker[:-1]]
        new_c = new_m | np.r_[True, content[1:] != content[:-1]]
        first = np.maximum.accumulate(np.where(new_c, np.arange(len(marker)), 0))
        copy = (doc != doc[first]) | (start != start[first])
        contents = np.bincount(np.cumsum(new_m) - 1, weights=new_c)[np.cumsum(new_m) - 1]
        if copy.any():
            d, s, r, o, f = chained(*(x[copy] for x in (doc, start, run, doc[first], start[first])))
            none = np.zeros(len(d), np.int64)
            yield _spans(none, none, d, s, r, o, f)
        m = np.flatnonzero(new_c & (contents > 1))
        if len(m):
            none = np.zeros(len(m), np.int64)
            yield _spans(np.where(contents[m] > hot, _HOT, _SORT), (marker[m] >> np.uint64(1)).astype(np.int64), doc[m], start[m], run[m], none, none)


def _chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, its copies) to copies as long as can be: markers that lie in a row came from several buckets."""
    names = ["doc", "start", "run", "source", "source_start"]
    for batch in lean(batches):
        lists = batch.column(1)
        doc = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
        own = lists.flatten()
        made = chained(doc, *(own.field(k).to_numpy() for k in range(4)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names)


def _fetch(batches: Iterable[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(doc, text, wanted [start, run, kind, key]) to each wanted place's bytes; a hot marker's stretch is cut by the
    markers of twice the length, and has theirs for a key."""
    columns: list[list] = [[] for _ in range(6)]
    size = 0
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FETCHED.split(", ")])
        for c in columns:
            c.clear()
        return out

    def add(*row: object) -> None:
        for c, x in zip(columns, row, strict=True):
            c.append(x)

    for batch in lean(batches):
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_py()
            for x in wanted:
                a, r, kind = x["start"], x["run"], x["kind"]
                piece = raw[a : a + r + span - 1]
                if len(piece) != r + span - 1:  # rows that share an id may have other texts
                    continue
                if kind == _HOT and span >= 3 * _GRAM:
                    for s, n, _, m in zip(*(v.tolist() for v in stretches(np.frombuffer(piece, np.uint8), span, 2 * _GRAM)), strict=True):
                        add(_SORT, m >> 1, doc, a + s, n, piece[s : s + n + span - 1])
                else:
                    add(min(kind, _SORT), x["key"], doc, a, r, piece)
                size += len(piece)
                if size > 4_000_000:
                    yield made()
                    size = 0
    if columns[0]:
        yield made()


def _often(store: Store, raw: Kept) -> tuple[np.ndarray, np.uint64]:
    """How often (0, 1, 2 or more) grams with these leading bits of the hash occur in raw; the bits to shift away."""
    bits = max(8, min(int(8 * len(raw)).bit_length(), int(store.memory // 2).bit_length() - 1))
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, np.uint8)
    for a, b in pieces(max(0, len(raw) - _GRAM + 1)):
        slot = np.sort((_gram_hashes(raw[a : b + _GRAM - 1]) >> shift).astype(np.uint32))
        new = np.r_[True, slot[1:] != slot[:-1]]
        own = slot[new]
        table[own] = np.minimum(table[own] + np.uint8(1), 2)
        table[slot[~new]] = 2
    return table, shift


def _candidates(raw: np.ndarray, size: np.ndarray, run: np.ndarray, span: int, table: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first window, windows) of the part of each stretch, from the first to the last, whose windows can
    repeat: a window with 32 bytes in a row that occur once in the shard is the only one of its kind."""
    once = np.zeros(len(raw) + 1, np.int64)
    n = len(raw) - _GRAM + 1
    np.cumsum(table[(_gram_hashes(raw) >> shift).astype(np.int64)] < 2, out=once[1 : n + 1])
    once[n + 1 :] = once[n]
    window = np.repeat(np.cumsum(size) - size, run) + _within(run)
    good = np.flatnonzero(once[window + span - _GRAM + 1] == once[window])
    owner = np.repeat(np.arange(len(run)), run)[good]
    f = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    at, end = good[f], good[np.r_[f[1:], len(good)] - 1] if len(f) else good
    first = _within(run)[at]
    return owner[f], first, end - at + 1


def _sort(batches: Iterable[pa.RecordBatch], span: int, memory: int = MEMORY_BYTES) -> Iterator[pa.RecordBatch]:
    """Suffix-sort a shard, its stretches in order of place: windows with an earlier equal one come out as repeats.
    Stretches, text, order and results are in files where `memory` does not hold them."""
    store = Store(local_tmp(), memory // 2)
    try:
        yield from _repeats(batches, span, memory, store)
    finally:
        remove_tree(store.folder)


def _repeats(batches: Iterable[pa.RecordBatch], span: int, memory: int, store: Store) -> Iterator[pa.RecordBatch]:
    bytes_, docs, starts, runs = Writer(store, np.uint8), Writer(store, np.int64), Writer(store, np.int64), Writer(store, np.int32)
    before = (None, None)
    for batch in lean(batches, 1 << 16):
        doc, start, run = (batch.column(k).to_numpy() for k in range(3))
        raw, offsets = utf8_views(batch.column(3))
        # a place comes twice where rows share an id
        new = np.r_[(doc[0], start[0]) != before, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]
        before = (doc[-1], start[-1])
        part = raw[offsets[0] : offsets[-1]]
        if not new.all():
            part = part[np.repeat(new, np.diff(offsets))]
        for w, x in ((bytes_, part), (docs, doc[new]), (starts, start[new]), (runs, run[new])):
            w.add(x)
    raw, doc, start, run = bytes_.done(), docs.done(), starts.done(), runs.done()
    if not len(run):
        return
    # the candidates among all windows, each stretch of them ended by a mark
    table, shift = _often(store, raw)
    text_, rows, skips, froms, counts = Writer(store, np.uint8), Writer(store, np.int64), Writer(store, np.int64), Writer(store, np.int64), Writer(store, np.int32)
    byte = 0
    for a, b in pieces(len(run), _AT_ONCE):
        r = run[a:b].astype(np.int64)
        size = r + span - 1
        part = raw[byte : byte + int(size.sum())]
        byte += len(part)
        own, skip, n = _candidates(part, size, r, span, table, shift)
        if not len(own):
            continue
        length = n + span - 1
        at = np.cumsum(length + 1) - length - 1
        made = np.ones(int(length.sum()) + len(own), np.uint8)
        made[np.repeat(at, length) + _within(length)] = part[np.repeat((np.cumsum(size) - size)[own] + skip, length) + _within(length)] + np.uint8(2)
        for w, x in ((rows, a + own), (skips, skip), (froms, text_.n + at), (counts, n), (text_, made)):
            w.add(x)
    store.free(raw, run)
    del table
    if not text_.n:
        return
    text_.add(np.zeros(1, np.uint8))
    text, row, skip, at, count = (w.done() for w in (text_, rows, skips, froms, counts))
    hit = store.array(len(text), np.uint8, 0)
    least = None  # the earliest place of a run of suffixes with span bytes in common that has not ended
    for pos, lcp in suffix_sort(text, 256, span, memory, store):
        heads = np.flatnonzero(lcp < span)
        go_on = pos[: heads[0]] if len(heads) else pos
        if len(go_on):
            every = go_on if least is None else np.r_[least, go_on]
            least = int(every.min())
            hit[every[every != least]] = 1
        if len(heads):
            lows = np.minimum.reduceat(pos, heads)
            own = pos[heads[0] :]
            later = own[own != np.repeat(lows, np.diff(np.r_[heads, len(pos)]))]
            if len(later):
                hit[later] = 1
            least = int(lows[-1])
    for a, b in pieces(len(text)):
        found = a + np.flatnonzero(hit[a:b])
        if not len(found):
            continue
        k = np.searchsorted(at.a, found, "right") - 1
        inside = found - at[k]
        own = inside < count[k]
        k, inside = k[own], inside[own]
        if not len(k):
            continue
        d, s = doc[row[k]], start[row[k]] + skip[k] + inside
        f = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(d[f], pa.int64()), pa.array(s[f], pa.int64()), pa.array(np.diff(np.r_[f, len(d)]), pa.int32())], ["doc", "start", "run"])


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _cut(batches: Iterable[pa.RecordBatch], span: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        n_bytes, spans, kept, texts = [], [], [], []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_py()
            n_bytes.append(len(raw))
            own, pieces, end = [], [], 0
            if found.is_valid:
                # a copy counts if its bytes are those of the place it was taken from
                good = [(x["start"], x["run"]) for x in found.as_py() if x["raw"] is None or x["raw"] == raw[x["start"] : x["start"] + x["run"] + span - 1]]
                for a, b in sorted((start, start + run + span - 1) for start, run in good):
                    a, b = min(a, len(raw)), min(b, len(raw))
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    elif b > a:
                        own.append([a, b])
                for a, b in own:
                    pieces.append(raw[end:a])
                    end = b
            kept.append(b"".join([*pieces, raw[end:]]) if own else raw)
            texts.append(kept[-1].decode("utf-8", "ignore"))
            spans.append([{"start": a, "stop": b} for a, b in own])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), *batch.columns[3:]], names)


def suffix_dedup(docs: DataFrame, span: int = 100, shard_bytes: int = 1 << 30, memory: int = MEMORY_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """docs to (id_col, n_bytes long, spans array<struct<start, stop>>, kept binary, kept_text string), one row per
    input row.

    A text is its UTF-8 bytes (null: none); a match never crosses documents. Each byte goes that a string of `span`
    bytes covers which also starts earlier: in a smaller id, or earlier in the same document. Strings are judged on the
    input. spans are the maximal removed runs, kept the bytes left; kept_text is kept without
    the bytes of characters that were cut in two. A row with a null
    id is kept whole and matches nothing. Rows that share an id and a text are one document. id_col is a whole number.
    span is at least 64 and at most 254. Other columns of docs do not matter; those named in carry come along as _in_<name>.
    """
    if not 2 * _GRAM <= span <= 254:
        raise ValueError("span must be from 64 to 254")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_q_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("_q_text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(64, 4 * partitions)
    marks = rows.where(F.col("_q_id").isNotNull() & (F.octet_length("_q_text") >= span)).mapInArrow(lambda b: _mark(b, span, buckets), _MARK)
    dealt = marks.repartition("bucket").sortWithinPartitions("bucket")
    spans = materialize(dealt.mapInArrow(lambda b: _match(b, HOT_CONTENTS), _SPAN), "suffix-spans")
    told = spans.where(f"kind = {_COPY}").groupBy("doc").agg(F.collect_list(F.struct("start", "run", "source", "source_start")).alias("own"))
    copies = materialize(told.mapInArrow(_chains, "doc long, start long, run long, source long, source_start long"), "suffix-copies")
    sources = copies.select(F.col("source").alias("doc"), F.col("source_start").alias("start"), F.col("run").cast("int").alias("run"), F.lit(_COPY).alias("kind"), F.lit(0).cast("long").alias("key")).distinct()
    to_sort = spans.where(f"kind <> {_COPY}").select("doc", "start", "run", "kind", "key")
    total = to_sort.agg(F.sum(F.col("run").cast("long") + span)).first()[0] or 0
    wanted = to_sort.union(sources).groupBy("doc").agg(F.collect_list(F.struct("start", "run", "kind", "key")).alias("wanted")).withColumnRenamed("doc", "_q_id")
    fetched = materialize(rows.join(wanted, "_q_id").mapInArrow(lambda b: _fetch(b, span), _FETCHED), "suffix-fetched")
    discard(spans)
    shards = max(partitions, -(-total // shard_bytes))
    shard = fetched.where(f"kind <> {_COPY}").select("key", "doc", "start", "run", "raw").repartition(shards, "key").sortWithinPartitions("doc", "start").select("doc", "start", "run", "raw")
    repeats = materialize(shard.mapInArrow(lambda b: _sort(b, span, memory), "doc long, start long, run int"), "suffix-repeats")
    bytes_ = fetched.where(f"kind = {_COPY}").select(F.col("doc").alias("source"), F.col("start").alias("source_start"), F.col("run").cast("long").alias("run"), "raw")
    copied = copies.join(bytes_.hint("merge"), ["source", "source_start", "run"]).select("doc", "start", "run", "raw")
    found = copied.union(repeats.select("doc", "start", F.col("run").cast("long"), F.lit(None).cast("binary").alias("raw")))
    found = found.groupBy("doc").agg(F.collect_list(F.struct("start", "run", "raw")).alias("_q_found"))
    whole = docs.select(F.col(id_col).cast("long").alias("_q_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("_q_text"), *(F.col(c).alias(f"_q_{k}") for k, c in enumerate(carry)))
    out = whole.join(found.withColumnRenamed("doc", "_q_id"), "_q_id", "left").select("_q_id", "_q_text", "_q_found", *(f"_q_{k}" for k in range(len(carry))))
    schema = schema_of(f"`{id_col}` long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary, kept_text string", docs, carry)
    return out.mapInArrow(lambda b: _cut(b, span, schema.names), schema)
