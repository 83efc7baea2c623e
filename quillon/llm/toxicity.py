"""Toxicity: a factorization machine over hashed terms.

Terms are words and their first four and five letters, lower-cased and hashed. Besides a weight, each term has a vector;
the product of two terms' vectors weighs their meeting in a document, so that two terms which are harmless alone can
speak for toxicity together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, materialize
from .labelled import sample

BITS = 20
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 150_000


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings."""
    made = {"=" + word, "4" + word[:4], "5" + word[:5]}
    return tuple(xxhash.xxh3_64_intdigest(x.encode()) >> (64 - BITS) for x in made)


def terms(text: str) -> np.ndarray:
    """The sorted distinct terms of a whole text."""
    found: set[int] = set()
    for w in set(_WORD.findall(text.lower())):
        found.update(word_terms(w))
    return np.array(sorted(found), np.int32)


@dataclass
class Machine:
    """terms: the hashes that have parameters, ascending."""

    bias: float
    terms: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def places(self) -> dict[int, int]:
        return {int(t): k for k, t in enumerate(self.terms)}

    def scores(self, texts: list[str], cache: dict[str, tuple[int, ...]], places: dict[int, int]) -> np.ndarray:
        """Probabilities of label 1; cache: the places of words' terms, kept from call to call."""
        get = cache.get
        out = np.empty(len(texts))
        for row, text in enumerate(texts):
            words = set(_WORD.findall(text.lower()))
            found: set[int] = set()
            for w in words:
                t = get(w)
                if t is None:
                    t = tuple(places[x] for x in word_terms(w) if x in places)
                    if len(cache) > _CACHE_WORDS:
                        cache.clear()
                    cache[w] = t
                if t:
                    found.update(t)
            total = self.bias
            if found:
                k = np.fromiter(found, np.int64, len(found))
                v = self.vector[k]
                s = v.sum(0)
                total += self.weight[k].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
            out[row] = total
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def learn(rows: list[np.ndarray], y: np.ndarray, size: int = 8, chosen: int = 8_192, common: int = 256, epochs: int = 12, rate: float = 0.2, ridge: float = 1e-3, seed: int = 7) -> Machine:
    """The machine from documents' terms and labels, by AdaGrad on the logistic loss, classes weighed alike.

    Parameters go to the `chosen` terms whose presence tells the classes apart best (chi-square over 3.84, in three
    documents or more), and to the `common` terms that most documents have, but not more than half of them: such a term
    may tell nothing alone and much beside another. Without rows, or with one class alone, the score is the class's share.
    """
    n = len(rows)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    none = Machine(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, size)))
    if not n or y.sum() in (0, n):
        return none
    flat = np.concatenate(rows).astype(np.int64) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    hit = np.bincount(flat, y[owner], 1 << BITS)
    seen = np.bincount(flat, minlength=1 << BITS)
    p, q = y.sum(), n - y.sum()
    miss = seen - hit
    top = (hit * (q - miss) - miss * (p - hit)) ** 2 * n
    chi = top / np.maximum(1e-9, p * q * seen * (n - seen))
    keep = np.flatnonzero((chi > 3.84) & (seen >= 3))
    keep = keep[np.argsort(-chi[keep], kind="stable")][:chosen]
    beside = np.flatnonzero((seen >= 3) & (2 * seen <= n))
    keep = np.union1d(keep, beside[np.argsort(-seen[beside], kind="stable")][:common])
    if not len(keep):
        return none
    at = np.searchsorted(keep, flat)
    good = (at < len(keep)) & (keep[np.minimum(at, len(keep) - 1)] == flat)
    term, owner = at[good], owner[good]
    starts = np.searchsorted(owner, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(keep)), rng.normal(0, 0.02, (len(keep), size)), 0.0
    gw, gv, gb = np.full(len(keep), 1e-2), np.full((len(keep), size), 1e-2), 1e-2
    heavy = np.where(y > 0, n / (2 * p), n / (2 * q))
    for _ in range(epochs):
        order = rng.permutation(n)
        for part in range(0, n, 256):
            rows_ = order[part : part + 256]
            counts = starts[rows_ + 1] - starts[rows_]
            t = term[np.repeat(starts[rows_] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())]
            o = np.repeat(np.arange(len(rows_)), counts)
            vt = v[t]
            s = np.zeros((len(rows_), size))
            np.add.at(s, o, vt)
            z = b + np.bincount(o, w[t], len(rows_)) + 0.5 * ((s * s).sum(1) - np.bincount(o, (vt * vt).sum(1), len(rows_)))
            e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows_]) * heavy[rows_]
            db = e.mean()
            gb += db * db
            b -= rate * db / np.sqrt(gb)
            used, back = np.unique(t, return_inverse=True)
            dw = np.bincount(back, e[o], len(used)) / len(rows_) * 16 + ridge * w[used]
            dv = np.zeros((len(used), size))
            np.add.at(dv, back, e[o][:, None] * (s[o] - vt))
            dv = dv / len(rows_) * 16 + ridge * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
    return Machine(float(b), keep, w, v)


def _termed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        made = [terms(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in made], pa.binary())], ["label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = 4_000, most_bytes: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """The machine learnt from at most `most` labelled rows of each class outside the held-out fold, and of these, in
    order of a hash of their terms, from as many as have `most_bytes` of term hashes (four bytes a term) together in each
    class; the driver gets no more. Rows without text have no terms and count as such."""
    rows = sample(docs, labels, label_col, most, id_col, text_col).select("label", "_q_text").mapInArrow(_termed, "label int, terms binary")
    rows = materialize(rows, "toxicity-terms")
    # at most 2 * most rows in two groups
    order = Window.partitionBy("label").orderBy(F.xxhash64("terms"), "terms").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.withColumn("so_far", F.sum(F.octet_length("terms").cast("long")).over(order))
    rows, made = sizes.where(F.col("so_far") <= most_bytes).select("label", "terms").collect(), rows
    discard(made)
    return learn([np.frombuffer(r["terms"], np.int32) for r in rows], np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to (id_col, score double), one row per input row: the probability of label 1 from the whole text. Null and
    empty texts get the score of a text without terms; ids, null or repeated, do not matter to a score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        places = machine.places()
        for batch in lean(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(texts, cache, places))], [id_col, "score"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
