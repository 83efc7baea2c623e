"""Best-fit packing by bin completion over the histogram of piece lengths.

Lengths are whole numbers from 1 to the capacity, so the packing problem is a histogram of at most `capacity` counts
however large the corpus is. The driver solves it by branch and bound: around the largest length left it enumerates
undominated fillings of the rest of the sequence, prunes by the waste that a better solution may still have, and keeps
the best-fit solution as the first incumbent. A filling is applied as often as its lengths allow, so the solution is a
list of patterns that grows with the capacity and not with the rows. Pieces get their places in parallel: a piece is
the r-th of its length, and patterns own ranges of r.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import text_parts, tokenizer
from .common import lean, materialize

Pattern = tuple[tuple[int, ...], int]  # lengths in one sequence, and how many such sequences


def tokenize_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to (id_col, piece int, start long, length long, ids binary), a row per piece; ids: little-endian unsigned
    32-bit. A document is its ids and end_id; only what is longer than capacity is cut. A null or empty text is the one
    id end_id. Repeated rows and null ids give pieces like any other."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = tokenizer(path), int(end_id).to_bytes(4, "little")
        for batch in lean(batches):
            texts = batch.column(1).to_pylist()
            for part in text_parts(texts):
                row, piece, ids = [], [], []
                for k, raw in enumerate(t.encode_bytes(texts[part]), part.start):
                    raw += end
                    for p in range(0, len(raw), 4 * capacity):
                        row.append(k)
                        piece.append(p // (4 * capacity))
                        ids.append(raw[p : p + 4 * capacity])
                n = np.array(piece, np.int32)
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), pa.array(n), pa.array(n.astype(np.int64) * capacity), pa.array(length), pa.array(ids, pa.binary())],
                    [id_col, "piece", "start", "length", "ids"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


# ------------------------------------------------------------------ the solver


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram. Open sequences with the same room and contents stay together, and equal
    lengths go into them at once."""
    out: list[Pattern] = []
    open_: dict[int, list[list]] = {}  # room -> [contents, how many]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                full, rest = divmod(left, per)
                for times, k in ((full, per), (1, rest)):
                    if times and k:
                        contents, room = (length,) * k, capacity - k * length
                        (open_.setdefault(room, []) if room else out).append([contents, times] if room else (contents, times))
                break
            contents, many = open_[room].pop()
            take = min(many, left)
            if take < many:
                open_[room].append([contents, many - take])
            if not open_[room]:
                del open_[room]
            left -= take
            if room == length:
                out.append((contents + (length,), take))
            else:
                open_.setdefault(room - length, []).append([contents + (length,), take])
    out += [(tuple(c), n) for groups in open_.values() for c, n in groups]
    return out


def _dominated(b: tuple[int, ...], a: tuple[int, ...]) -> bool:
    """Whether b's lengths fit, first fit, into a's lengths taken as bins: then a is never worse."""
    room = sorted(a)
    for x in sorted(b, reverse=True):
        k = next((i for i, r in enumerate(room) if r >= x), None)
        if k is None:
            return False
        room[k] -= x
    return True


def completions(c: np.ndarray, room: int, most_waste: int, effort: int = 20_000) -> Iterator[tuple[int, ...]]:
    """All maximal fillings of `room` from the counts c that leave at most `most_waste` empty, least waste first, larger
    lengths first; of any number of lengths. Ends with None where `effort` steps did not suffice for all."""
    lengths = np.flatnonzero(c[: room + 1])[::-1].tolist()
    if not lengths:
        if room <= most_waste:
            yield ()
        return
    if lengths[0] == room:
        yield (room,)  # dominates every other
        return
    # reach[k]: sums of lengths[k:], as bits
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in reversed(lengths):
        bits, k, left = reach[-1], 1, min(int(c[x]), room // x)
        while left:
            k = min(k, left)
            bits |= bits << (k * x) & mask
            left -= k
            k *= 2
        reach.append(bits)
    reach.reverse()
    left = {x: int(c[x]) for x in lengths}
    for waste in range(min(most_waste, room) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        # places in lengths chosen so far, and the next place to try
        chosen: list[int] = []
        k, rest = 0, room - waste
        while True:
            effort -= 1
            if effort < 0:
                yield None
                return
            if rest == 0:
                if not any(n and x <= waste for x, n in left.items()):
                    yield tuple(lengths[j] for j in chosen)
                k = len(lengths)
            # what the lengths from k on cannot reach, those after cannot either
            while k < len(lengths) and reach[k] >> rest & 1 and (lengths[k] > rest or not left[lengths[k]] or not reach[k] >> (rest - lengths[k]) & 1):
                k += 1
            if k < len(lengths) and reach[k] >> rest & 1:
                chosen.append(k)
                left[lengths[k]] -= 1
                rest -= lengths[k]
            elif chosen:
                k = chosen.pop()
                left[lengths[k]] += 1
                rest += lengths[k]
                k += 1
            else:
                break


def _bound(counts: dict[int, int], capacity: int) -> int:
    return max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))


def _histogram(patterns: list[Pattern]) -> dict[int, int]:
    out: dict[int, int] = {}
    for lengths, n in patterns:
        for x in lengths:
            out[x] = out.get(x, 0) + n
    return out


def _branch(counts: dict[int, int], capacity: int, best: list[Pattern], nodes: int, width: int) -> tuple[list[Pattern], bool]:
    """Depth first through the undominated fillings around the largest length left, each as often as it fits and then
    fewer times; best is the incumbent. (the best found, whether the whole tree was seen: then none is better)."""
    total = sum(k * n for k, n in counts.items())
    bound, best_n = _bound(counts, capacity), sum(n for _, n in best)
    c = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        c[k] = n
    chosen: list[tuple[Pattern, int]] = []
    waste = used = tried = 0
    complete = True

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        nonlocal complete
        top = int(np.flatnonzero(c)[-1])
        seen: list[tuple[int, ...]] = []
        c[top] -= 1
        made = completions(c.copy(), capacity - top, max(0, (best_n - 1) * capacity - total - waste))
        c[top] += 1
        for f in made:
            if f is None or len(seen) >= width:
                complete = False
                return
            if any(_dominated(f, other) for other in seen):
                continue
            seen.append(f)
            f = (top, *f)
            for n in range(min(int(c[x]) // f.count(x) for x in f), 0, -1):
                yield f, n

    stack = [options()]
    while stack and best_n > bound:
        tried += 1
        if tried > nodes:
            complete = False
            break
        f, n = next(stack[-1], (None, 0))
        if f is None:
            stack.pop()
            if chosen:
                (lengths, n), lost = chosen.pop()
                used, waste = used - n, waste - lost
                for x in lengths:
                    c[x] += n
            continue
        each = capacity - sum(f)
        if n * each > (best_n - 1) * capacity - total - waste:
            continue
        for x in f:
            c[x] -= n
        chosen.append(((f, n), n * each))
        used, waste = used + n, waste + n * each
        if not c.any():
            if used < best_n:
                best, best_n = [p for p, _ in chosen], used
            stack.append(iter(()))
        else:
            stack.append(options())
    return best, complete or best_n <= bound


def search(counts: dict[int, int], capacity: int, nodes: int = 4_000, width: int = 12, rounds: int = 8) -> tuple[list[Pattern], bool]:
    """(patterns that hold every length as often as it occurs, in as few sequences as the search finds; whether that is
    proved to be the least).

    The search ends at once when a solution meets the lower bound, or when it has seen the whole tree. Beyond the first
    incumbent it goes on in rounds: the sequences with waste and a growing number of others, those with the most pieces
    first, are taken apart and solved anew. nodes (branches per round), width (fillings per branch) and rounds bound the
    search, never the rows packed.
    """
    best = best_fit(counts, capacity)
    bound = _bound(counts, capacity)
    proved = sum(n for _, n in best) <= bound
    for k in range(rounds):
        if proved:
            break
        some, rest, others = [], [], 25 * 2**k
        for lengths, n in sorted(best, key=lambda p: (sum(p[0]) == capacity, -len(p[0]), p[0])):
            take = n if sum(lengths) < capacity and n <= 4 * others else min(n, max(0, others))
            if sum(lengths) == capacity:
                take = min(take, 2) if len(best) > 25 else take
            others -= take if sum(lengths) == capacity else 0
            some += [(lengths, take)] if take else []
            rest += [(lengths, n - take)] if n > take else []
        again = _histogram(some)
        fit = min(some, best_fit(again, capacity), key=lambda p: sum(n for _, n in p))
        fit, complete = _branch(again, capacity, fit, nodes, width)
        best = rest + fit
        proved = sum(n for _, n in best) <= bound or (complete and not rest)
    merged: dict[tuple[int, ...], int] = {}
    for lengths, n in best:
        merged[lengths] = merged.get(lengths, 0) + n
    return list(merged.items()), proved


def solve(counts: dict[int, int], capacity: int, nodes: int = 4_000) -> list[Pattern]:
    """The patterns of search()."""
    return search(counts, capacity, nodes)[0]


# ------------------------------------------------------------------ the operator


def _numbered(pieces: DataFrame) -> DataFrame:
    """pieces with the partition they lie in and their number among its pieces of the same length."""
    names = pieces.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            length = batch.column(names.index("length")).fill_null(0).to_numpy()
            order = np.argsort(length, kind="stable")
            values, starts, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(starts, n)
            rank += np.array([seen.get(v, 0) for v in values.tolist()], np.int64)[np.searchsorted(values, length)]
            for v, k in zip(values.tolist(), n.tolist(), strict=True):
                seen[v] = seen.get(v, 0) + k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], [*names, "_q_part", "_q_rank"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, f"{columns}, _q_part int, _q_rank long")


def pack(pieces: DataFrame, capacity: int, nodes: int = 4_000) -> DataFrame:
    """Adds sequence_id long and offset long to pieces, which have a column length.

    Every row is placed: sequences hold at most `capacity`, offsets are gapless from 0. Lengths that are null or below 1
    get nulls and take no place; a length over capacity is an error. The order of equal lengths is open. Columns of
    pieces named sequence_id, offset, _q_part or _q_rank come out as _in_<name>. What reaches the driver is a histogram of
    at most `capacity` rows.
    """
    for name in ("sequence_id", "offset", "_q_part", "_q_rank"):
        pieces = pieces.withColumnRenamed(name, f"_in_{name}")
    rows = materialize(_numbered(pieces), "pack-pieces")
    good = F.col("length") >= 1
    counts = materialize(rows.where(good).groupBy("length", "_q_part").count(), "pack-counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    if max(histogram, default=0) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    patterns = solve(histogram, capacity, nodes)
    # for each length: from which rank on, how many in a sequence, the first sequence, the offset there
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            slots.setdefault(x, []).append((taken.get(x, 0), k, sequence, offset))
            taken[x] = taken.get(x, 0) + k * n
            offset += k * x
        sequence += n
    keys = np.array(sorted(slots), np.int64)
    ends = np.cumsum([len(slots[int(x)]) for x in keys]) if len(keys) else np.zeros(0, np.int64)
    flat = np.array([s for x in keys for s in slots[int(x)]], np.int64).reshape(-1, 4)
    before = Window.partitionBy("length").orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_q_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_q_base"))
    # a count for each length and partition: not to be broadcast by the size of its file
    ranked = rows.join(bases.hint("merge"), ["length", "_q_part"], "left").withColumn("_q_rank", F.col("_q_rank") + F.col("_q_base"))
    names = pieces.columns

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).fill_null(0).to_numpy().astype(np.int64)
            rank = batch.column(len(names)).fill_null(0).to_numpy()
            seq, off, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.searchsorted(keys, length)
            for x in np.unique(length[length >= 1]).tolist():
                m = np.flatnonzero(length == x)
                k = int(at[m[0]])
                own = flat[(ends[k - 1] if k else 0) : ends[k]]
                s = own[np.searchsorted(own[:, 0], rank[m], "right") - 1]
                t = rank[m] - s[:, 0]
                seq[m], off[m] = s[:, 2] + t // s[:, 1], s[:, 3] + t % s[:, 1] * x
            none = length < 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seq, mask=none), pa.array(off, mask=none)], [*names, "sequence_id", "offset"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "_q_rank").mapInArrow(place, f"{columns}, sequence_id long, offset long")
