"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors with cosine c are sqrt(2 - 2c) apart. After a rotation the dimensions are cut into low-dimensional
blocks, and each block gets a share of the squared distance in proportion to its dimensions: of a pair within the whole
budget at least one block is within its own. Each block is range-joined on a grid over its first dimensions, more of
them the more vectors a label has: a vector lies in its home cell and is a guest of the cells before it that its range
touches, so each pair meets once. Inside a cell a second grid over the next dimensions finds the pairs whose ranges
touch. The union of all blocks' pairs is verified on the vectors in double precision, so no link is lost and none is
wrong.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, lean, materialize

#: Dimensions of a block, the most that its grid between tasks has, and those of the grid inside a cell.
BLOCK_DIMS, GRID_DIMS, INNER_DIMS = 8, 6, 6
#: Vectors of a cell that the number of grid dimensions aims at, and of one part of a cell if all of a label lay in it.
CELL_VECTORS, PART_VECTORS = 50_000, 2_000_000
#: Cells of two ranges' width that unit vectors' coordinates spread over, on average and in one dimension.
_SPREAD = 3.5
_SLACK = 1e-9
_DEALT = "kind string, block int, cell long, part int, role int, ids binary, places binary"


def rotation(d: int) -> np.ndarray:
    """An orthogonal matrix that depends on d alone."""
    q, r = np.linalg.qr(np.random.default_rng(1000 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[slice]:
    n = max(1, d // BLOCK_DIMS)
    edges = [d * k // n for k in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrices(lists: pa.Array, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of list and key, from a column of lists without nulls."""
    length = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    start = np.cumsum(length) - length
    both = keys.astype(np.int64) * (int(length.max(initial=0)) + 1) + length
    order = np.argsort(both, kind="stable")
    ends = np.flatnonzero(np.r_[both[order][1:] != both[order][:-1], True]) + 1 if len(order) else []
    for a, b in zip([0, *ends[:-1]], ends, strict=True) if len(ends) else ():
        rows = order[a:b]
        yield rows, flat[start[rows][:, None] + np.arange(length[rows[0]])]


def _corners(g: int) -> np.ndarray:
    return (np.arange(1 << g)[:, None] >> np.arange(g) & 1).astype(bool)


def _code(cell: np.ndarray) -> np.ndarray:
    """One number for a cell, in lexicographic order; a grid of more than six dimensions would not fit."""
    code = np.zeros(len(cell), np.int64)
    for k in range(cell.shape[1]):
        code = code * (1 << 10) + np.clip(cell[:, k] + (1 << 9), 0, (1 << 10) - 1)
    return code


def _touched(place: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cell, home cell) of the cells, two radii wide, that each row's ball touches: its home, and those behind the
    nearer borders that are no further off than the radius."""
    at = place / (2 * radius)
    home = np.floor(at).astype(np.int64)
    past = at - home >= 0.5
    gap = np.where(past, home + 1 - at, at - home) ** 2
    other, code = np.where(past, home + 1, home - 1), _code(home)
    for up in _corners(place.shape[1]):
        good = np.flatnonzero(gap[:, up].sum(1) <= 0.25 + _SLACK)
        yield good, _code(np.where(up, other[good], home[good])), code[good]


def _deal(batches: Iterable[pa.RecordBatch], budget: float) -> Iterator[pa.RecordBatch]:
    """(rep, label, vector, parts, grid) to packed rows of a label, dimension, block, cell and part: role 0 the vectors
    that lie in it, role 1 its guests."""
    names = [x.split()[0] for x in _DEALT.split(", ")]
    kinds_of = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    for batch in batches:
        ids, parts, grid = (batch.column(k).to_numpy() for k in (0, 3, 4))
        label = batch.column(1).dictionary_encode()
        names_of = label.dictionary.to_pylist()
        rows: list[tuple] = []
        for own, x in _matrices(batch.column(2), label.indices.to_numpy()):
            d, n_parts, own_ids = x.shape[1], int(parts[own[0]]), ids[own]
            kind = f"{names_of[label.indices[int(own[0])].as_py()]}/{d}"
            x = _unit(x) @ rotation(d)
            for b, s in enumerate(blocks(d)):
                place = np.ascontiguousarray(x[:, s])
                radius = np.sqrt(budget * place.shape[1] / d) + _SLACK
                g = min(int(grid[own[0]]), place.shape[1])
                at, code, role, part = [], [], [], []
                for good, cell, home in _touched(place[:, :g], radius):
                    for same, r in ((True, 0), (False, 1)):
                        k = good[(cell == home) if same else (cell < home)]
                        c = cell[(cell == home) if same else (cell < home)]
                        for p in range(n_parts) if r else (None,):
                            at.append(k)
                            code.append(c)
                            role.append(np.full(len(k), r))
                            part.append(own_ids[k] % n_parts if p is None else np.full(len(k), p))
                        if same and n_parts > 1:  # to the vectors of the other parts a vector is a guest
                            for p in range(n_parts):
                                k2 = k[own_ids[k] % n_parts > p]
                                at.append(k2)
                                code.append(c[own_ids[k] % n_parts > p])
                                role.append(np.ones(len(k2), np.int64))
                                part.append(np.full(len(k2), p))
                at, code, role, part = (np.concatenate(v) for v in (at, code, role, part))
                order = np.lexsort((role, part, code))
                at, code, role, part = at[order], code[order], role[order], part[order]
                ends = np.flatnonzero(np.r_[(code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1]), True]) + 1
                packed_ids, packed = own_ids[at], place[at]
                for a, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    rows.append((kind, b, int(code[a]), int(part[a]), int(role[a]), packed_ids[a:e].tobytes(), packed[a:e].tobytes()))
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 5000]), kinds_of, strict=True)], names)


class Cell:
    """The vectors that lie in a cell, by their place in a grid over the dimensions that follow."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, limit: float):
        self.radius, self.limit = np.sqrt(limit) + _SLACK, limit
        # the last dimensions: the first are those of the grid between tasks
        self.dims = slice(max(0, x.shape[1] - INNER_DIMS), x.shape[1])
        code = _code(np.floor(x[:, self.dims] / (2 * self.radius)).astype(np.int64))
        order = np.argsort(code, kind="stable")
        self.ids, self.x, self.code = ids[order], x[order], code[order]

    def pairs(self, ids: np.ndarray | None = None, x: np.ndarray | None = None, at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(ids, ids, comparisons made) of pairs within the limit: of guests with the cell's own, or among its own."""
        own = x is None
        x, ids = (self.x, self.ids) if own else (x, ids)
        for rows, cell, home in _touched(x[:, self.dims], self.radius):
            if own:
                good = cell >= home
                rows, cell, home = rows[good], cell[good], home[good]
            first, stop = np.searchsorted(self.code, cell), np.searchsorted(self.code, cell, "right")
            if own:  # in its own cell those after it
                first = np.where(cell == home, np.maximum(first, rows + 1), first)
            n = np.maximum(stop - first, 0)
            done = np.cumsum(n)
            at = 0
            while at < len(rows):
                e = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + at_once, "right")))
                own_n = n[at:e]
                total = int(own_n.sum())
                if total:
                    p = np.repeat(rows[at:e], own_n)
                    q = np.repeat(first[at:e] - (np.cumsum(own_n) - own_n), own_n) + np.arange(total)
                    gap = ((x[p] - self.x[q]) ** 2).sum(1)
                    good = gap <= self.limit
                    a, b = ids[p[good]], self.ids[q[good]]
                    m = a != b
                    yield np.minimum(a, b)[m], np.maximum(a, b)[m], total
                at = e


def _range_join(batches: Iterable[pa.RecordBatch], budget: float) -> Iterator[pa.RecordBatch]:
    """Pairs (smaller id, larger id) within the block's share of the budget, from rows sorted by cell, part and role."""
    key, home, cell = None, [], None
    out: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in (0, 1)], ["a", "b"])
        out.clear()
        return made

    def ready() -> Cell | None:
        return Cell(np.concatenate([i for i, _ in home]), np.concatenate([x for _, x in home]), limit) if home else None

    def found(pairs: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        nonlocal size
        for a, b, _ in pairs:
            if len(a):
                out.append((a, b))
                size += len(a)
            if size > 200_000:
                yield flushed()
                size = 0

    for batch in batches:
        for kind, block, code, part, role, ids, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, block, code, part) != key:
                if home:
                    cell = ready()
                    yield from found(cell.pairs())
                key, home, cell = (kind, block, code, part), [], None
                d = int(kind.rpartition("/")[2])
                dims = blocks(d)[block]
                n = dims.stop - dims.start
                limit = budget * n / d + _SLACK
            i, x = np.frombuffer(ids, np.int64), np.frombuffer(places, np.float64).reshape(-1, n)
            if role == 0:
                home.append((i, x))
            elif home or cell is not None:
                if cell is None:
                    cell = ready()
                    yield from found(cell.pairs())
                    home = []
                yield from found(cell.pairs(i, x))
    if home:
        yield from found(ready().pairs())
    if out:
        yield flushed()


def _verified(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches, 4096):
        good = np.zeros(batch.num_rows, bool)
        other = batch.column(3).value_lengths().to_numpy().astype(np.int64)
        flat = batch.column(3).flatten().to_numpy()
        start = np.cumsum(other) - other
        for own, x in _matrices(batch.column(2), np.zeros(batch.num_rows, np.int64)):
            y = flat[start[own][:, None] + np.arange(x.shape[1])]
            x = x / np.abs(x).max(axis=1, keepdims=True)
            y = y / np.abs(y).max(axis=1, keepdims=True)
            good[own] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= least
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["a", "b"])


def embedding_dedup(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """rows to (id_col, n_links long, component_id long, kept boolean), one row per input row.

    Vectors link when their labels are equal and not null, their dimensions are equal and their cosine in double
    precision is at least `least`. Null, empty and zero vectors and those with a null or non-finite component link with
    nothing, and so does a row with a null id, whose component_id is null and which is kept. n_links counts other
    vectors linked directly, equal vectors included; component_id is the smallest id reachable; kept is id = component_id.
    Rows that share an id are one vector where they are equal. Equal vectors go through the join once; the links
    between different ones are as many rows as there are such links.
    """
    budget = 2.0 - 2.0 * least
    own = rows.select(F.col(id_col).cast("long").alias("_q_id"), F.col(label_col).cast("string").alias("_q_label"), F.col(vector_col).cast("array<double>").alias("_q_vector"))
    finite = F.forall("_q_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col("_q_id").isNotNull() & F.col("_q_label").isNotNull() & finite & F.exists("_q_vector", lambda x: x != 0)
    own = own.withColumn("_q_good", F.coalesce(good, F.lit(False)))
    different = own.where("_q_good").groupBy("_q_label", "_q_vector").agg(F.min("_q_id").alias("rep"), F.count_distinct("_q_id").alias("copies"))
    different = materialize(different, "vectors")
    n = F.count("*")
    grid = F.ceil(F.log(n / CELL_VECTORS) / math.log(_SPREAD))
    grid = F.least(F.greatest(grid, F.lit(1)), F.lit(GRID_DIMS))
    # a table of its own: of the join that follows Spark can then split a frequent label's vectors
    labels = materialize(different.groupBy("_q_label").agg(F.ceil(n / F.pow(F.lit(_SPREAD), grid) / PART_VECTORS).cast("int").alias("parts"), grid.cast("int").alias("grid")), "vector-labels")
    dealt = different.join(labels.hint("merge"), "_q_label").select("rep", "_q_label", "_q_vector", "parts", "grid").mapInArrow(lambda b: _deal(b, budget), _DEALT)
    at = ["kind", "block", "cell", "part"]
    pairs = dealt.repartition(*at).sortWithinPartitions(*at, "role").mapInArrow(lambda b: _range_join(b, budget), "a long, b long").distinct()
    vector = different.select("rep", "_q_vector")
    pairs = materialize(pairs, "vector-pairs")
    both = pairs.join(vector.select(F.col("rep").alias("a"), F.col("_q_vector").alias("va")), "a").join(vector.select(F.col("rep").alias("b"), F.col("_q_vector").alias("vb")), "b")
    links = materialize(both.select("a", "b", "va", "vb").mapInArrow(lambda b: _verified(b, least), "a long, b long"), "vector-links")
    discard(pairs)
    discard(labels)
    copies = different.select("rep", "copies")
    out_links = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = out_links.join(copies.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "rep")
    component = connected_components(links, "vector-components").select(F.col("node").alias("rep"), "component")
    known = different.join(linked, "rep", "left").join(component, "rep", "left")
    known = known.select("_q_label", "_q_vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = own.withColumn("_q_key", F.when(F.col("_q_good"), F.col("_q_vector"))).drop("_q_vector", "_q_good")
    out = out.join(known.withColumnRenamed("_q_vector", "_q_key"), ["_q_label", "_q_key"], "left")
    found = F.coalesce("component", "_q_id")
    return out.select(F.col("_q_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), found.alias("component_id"), F.col("_q_id").eqNullSafe(found).alias("kept"))
