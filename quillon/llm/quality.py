"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled rows' statistics (not their texts), flattened into
arrays and walked for a batch of documents at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .labelled import learnable, sample

FEATURES = [
    "log_bytes", "words", "mean_word", "upper", "lower", "digits", "space", "newline", "bang", "pipe", "symbols",
    "stops", "other_punctuation", "not_ascii", "distinct_words", "top_word", "repeats", "lines", "distinct_lines",
    "longest_line", "long_words", "capitals", "marked_words",
]
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b"!", b"|", b"#$%&*+<=>@^_~{}[]\\/", b".,;:", b"'\"()-?`"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 11


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n = len(raw)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=12) / n
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    return [
        np.log1p(n), np.log1p(len(words)), n / w, *kinds[1:6], *kinds[6:12],
        len(counts) / w, max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(max(map(len, lines))),
        sum(c for x, c in counts.items() if len(x) > 15) / w,
        sum(c for x, c in counts.items() if x.isupper()) / w,
        sum(c for x, c in counts.items() if not x[-1].isalnum() and x[-1] not in ".,;:") / w,
    ]


@dataclass
class Trees:
    """All trees' nodes in a row: a leaf has feature -1. Scores are sums over the trees' roots."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, walking every tree for all rows at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(go, self.left[node], self.right[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Gradient-boosted trees on the logistic loss, level by level from histograms of binned features. Without rows, or
    with one class alone, the trees are empty and the score is the class's share. A row counts as `weight` rows (without it, one)."""
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    share = float(np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(m)], axis=1)
        offset = np.arange(m) * bins
        flat = binned + offset
        total = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = weight * (p - y), weight * p * (1 - p)
            roots.append(len(feature))
            node = np.zeros(n, np.int64)  # within the level
            place = [len(feature)]
            for k in (feature, threshold, left, right, value):
                k.append(-1 if k is not value else 0.0)
            for level in range(depth + 1):
                live = len(place)
                on = node >= 0
                gs = np.bincount(node[on], g[on], live)
                hs = np.bincount(node[on], h[on], live)
                for k, at in enumerate(place):
                    value[at] = -rate * gs[k] / (hs[k] + ridge)
                if level == depth or not on.any():
                    break
                key = (node[on, None] * (m * bins) + flat[on]).ravel()
                gh = np.bincount(key, np.repeat(g[on], m), live * m * bins).reshape(live, m, bins).cumsum(2)
                hh = np.bincount(key, np.repeat(h[on], m), live * m * bins).reshape(live, m, bins).cumsum(2)
                gr, hr = gs[:, None, None] - gh, hs[:, None, None] - hh
                gain = gh**2 / (hh + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None, None]
                gain[(hh < least / 4) | (hr < least / 4)] = -1
                for f in range(m):
                    gain[:, f, len(edges[f]) :] = -1
                best = gain.reshape(live, -1).argmax(1)
                new_place, child = [], np.full((live, 2), -1)
                for k, at in enumerate(place):
                    f, b = divmod(int(best[k]), bins)
                    if gain[k, f, b] <= 1e-6:
                        continue
                    feature[at], threshold[at] = f, float(edges[f][b])
                    for side, way in enumerate((left, right)):
                        way[at] = len(feature)
                        child[k, side] = len(new_place)
                        new_place.append(len(feature))
                        for q in (feature, threshold, left, right, value):
                            q.append(-1 if q is not value else 0.0)
                split_f = np.array([feature[at] for at in place])
                split_b = np.array([int(best[k]) % bins for k in range(live)])
                f_of = np.where(on, split_f[np.maximum(node, 0)], -1)
                right_side = binned[np.arange(n), np.maximum(f_of, 0)] > split_b[np.maximum(node, 0)]
                leaf = on & (f_of < 0)
                total[leaf] += np.array([value[at] for at in place])[node[leaf]]
                node = np.where(on & ~leaf, child[np.maximum(node, 0), right_side.astype(int)], -1)
                place = new_place
                if not place:
                    break
            on = node >= 0
            if place and on.any():
                total[on] += np.array([value[at] for at in place])[node[on]]
    as_ = lambda v, t: np.array(v, t)
    return Trees(base, as_(roots, np.int64), as_(feature, np.int64), as_(threshold, np.float64), as_(left, np.int64), as_(right, np.int64), as_(value, np.float64), depth + 1)


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        made = [statistics(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees learnt from at most `most` labelled rows of each class outside the held-out fold. The driver gets these
    rows' statistics: 2 * most lists of len(FEATURES) numbers. A row stands for as many as its class has for each one
    taken, so the classes' shares are those of all labels at every size."""
    rows = sample(docs, labels, label_col, most, id_col, text_col).select("label", "_q_text").mapInArrow(_measured, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    count = {r["label"]: r["count"] for r in learnable(labels, label_col, id_col).groupBy("label").count().collect()}
    y = np.array([r["label"] for r in rows], np.float64)
    weight = np.array([max(1.0, count[r["label"]] / most) for r in rows], np.float64)
    # one on average: ridge and least are in rows taken
    return grow(x, y, weight=weight * (len(weight) / max(1.0, weight.sum())))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to (id_col, score double), one row per input row: the probability of label 1 from the whole text. Null and
    empty texts are scored by zero statistics; ids, null or repeated, do not matter to a score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x))], [id_col, "score"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, trees: Trees, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores `least` or more; null and empty texts are scored by
    zero statistics, null and repeated ids do not matter."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(trees.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
