"""BPE encoding and decoding in batched numpy merge rounds.

A batch's texts are normalised and cut into words as one array of bytes; each distinct word of the batch is looked up
once in a bounded cache, and the texts' ids are gathered by the words' codes. The symbols of the words missing from the
cache lie in one flat array. The rank of every adjacent pair is found by binary search in the sorted pair keys; each
round takes each word's lowest rank, merges that pair wherever the word has it, looks up only the pairs that the merges
made, and sets words without a known pair aside.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: The letters, numbers and white space among U+0000 to U+024F, lower-cased, as \p{L}, \p{N} and \s see them.
_LETTER = "a-zªµºß-öø-ÿĀ-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
#: Texts with other characters, or with one whose lower case is two or another, are cut by the library's own normaliser
#: and splitter.
_FAR = "".join(c for c in map(chr, range(0x250)) if len(c.lower()) > 1 or c.lower() > "\u024f")
_OTHER = re.compile(f"[^\x00-\u024f]|[{_FAR}]")
#: What a character of a lower-cased text is to the cutting. Runs of letters and of signs are words, digits each by itself.
_GAP, _LETTERS, _DIGIT, _SIGNS = range(4)
_KIND = np.full(0x250, _SIGNS, np.uint8)
for _k, _chars in ((_LETTERS, _LETTER), (_DIGIT, _NUMBER), (_GAP, _SPACE)):
    _KIND[[c for c in range(0x250) if re.match(f"[{_chars}]", chr(c))]] = _k
_BYTE_KIND = _KIND[:128].tobytes() + bytes(128)
#: Distinct words kept by one encoder, at most half of them new; when those are full, they take the place of the older.
CACHE_WORDS = 200_000
#: Longer words are encoded each time, so that the cache is bounded in bytes too.
CACHE_CHARS = 64
#: Words merged at once: arrays that stay small cost less than fewer rounds do.
_MERGE_WORDS = 4_000
_NONE = np.int64(1) << 60


def _plain(text: str) -> str | None:
    """The normalised text, or None where the library has to do it."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        try:
            text.encode("latin-1")  # faster than the search
        except UnicodeEncodeError:
            if _OTHER.search(text):
                return None
    return text.lower()


def _list(column: pa.Array) -> list[bytes]:
    """A large binary column without nulls as bytes; to_pylist() takes four times as long."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return [b""] * len(column)
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :].tolist()
    data = memoryview(data)[at[0] : at[-1]].tobytes()
    return [data[i - at[0] : j - at[0]] for i, j in zip(at[:-1], at[1:], strict=True)]


def _word_bytes(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts in order, which of them each text begins with) of texts from _plain()."""
    raw = [t.encode() for t in texts]
    joined = b" ".join([*raw, b"   "])
    data = np.frombuffer(joined, np.uint8)
    kind = np.frombuffer(bytearray(joined.translate(_BYTE_KIND)), np.uint8)
    lead = np.flatnonzero(data >= 0xC0)  # of characters of two bytes; there are no longer ones
    kind[lead] = kind[lead + 1] = _KIND[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
    start = np.empty(len(data), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _DIGIT
    start[lead + 1] = False
    keep = kind != _GAP
    start &= keep
    # 's 't 'm 'd 're 've 'll are words where the apostrophe is not inside a run of signs; letters after them are others
    at = np.flatnonzero(start & (data == 39))
    a, b = data[at + 1], data[at + 2]
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
    start[at[one | two] + 1] = False
    after = np.concatenate([at[one] + 2, at[two] + 3])
    start[after[kind[after] == _LETTERS]] = True
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    first = np.searchsorted(np.flatnonzero(start), np.r_[0, ends])
    kept = data[keep]
    offsets = np.append(np.flatnonzero(start[keep]), len(kept)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), first


def _byte_letters() -> dict[int, str]:
    """The usual one-to-one map from byte values to printable characters of byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + k) for k, b in enumerate(rest)}


class BpeTokenizer:
    """A reader of a tokenizers-format BPE file with word ends, lower-casing and NFC (word_bpe_49k.json).

    encode() gives what the tokenizers library gives with add_special_tokens=False; strings of the file's added tokens
    in a text become those tokens. A null text is an empty one and has no ids.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab: dict[str, int] = d["model"]["vocab"]
        self.suffix: str = d["model"]["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in d["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        letters = _byte_letters()
        base = np.array([*(vocab[letters[b]] for b in range(256)), *(vocab[letters[b] + self.suffix] for b in range(256))], np.int64)
        self._base = base
        n = len(d["model"]["merges"])
        a, b, made = (np.empty(n, np.int64) for _ in range(3))
        for k, pair in enumerate(d["model"]["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            a[k], b[k], made[k] = vocab[x], vocab[y], vocab[x + y]
        keys = (a << 32) | b
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank, self._made = keys[order], order.astype(np.int64), made
        #: ranks of pairs of single bytes, plain or at a word's end
        self._first = self._ranks(np.repeat(base, 512), np.tile(base, 512)).reshape(512, 512)
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self._splitter = pre_tokenizers.Split(Regex(split), "removed", invert=True)
        self._special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._mark = re.compile("|".join(sorted({re.escape(x[:2]) for x in self.added}))) if self.added else None
        self._added_bytes = {x.encode(): int(i).to_bytes(4, "little") for x, i in self.added.items()}
        self._cache: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], _NONE)

    def _cut(self, text: str) -> list[bytes]:
        """A text's words in order, by the library; a string of an added token stands for itself."""
        out: list[bytes] = []
        at = 0
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            end = m.start() if m else len(text)
            out += [w.encode() for w, _ in self._splitter.pre_tokenize_str(self._normalizer.normalize_str(text[at:end]))]
            if m:
                out.append(m[0].encode())
                at = m.end()
        return out

    def _merge(self, raw: list[bytes]) -> list[bytes]:
        """Each word's ids as bytes, by merge rounds over all of them."""
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths) - 1
        symbol[ends] += 256
        word = np.repeat(np.arange(len(raw)), lengths)
        rank = np.full(len(symbol), _NONE)  # of the pair that begins here
        rank[:-1] = self._first[symbol[:-1], symbol[1:]]
        rank[ends] = _NONE
        symbol = self._base[symbol]
        done_symbol, done_word = [], []
        while len(symbol):
            change = np.empty(len(symbol), bool)
            change[0] = True
            np.not_equal(word[1:], word[:-1], out=change[1:])
            starts = np.flatnonzero(change)
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(symbol))
            best = np.repeat(best, sizes)
            over = best == _NONE
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
                keep = ~over
                symbol, word, rank, best = symbol[keep], word[keep], rank[keep], best[keep]
            p = np.flatnonzero(rank == best)
            if not len(p):
                break
            # of overlapping choices (a pair of equal symbols in a row) every second one goes
            if (np.diff(p) == 1).any():
                run = np.cumsum(np.r_[True, np.diff(p) != 1])
                p = p[(p - p[np.searchsorted(run, run)]) % 2 == 0]
            symbol[p] = self._made[rank[p]]
            keep = np.ones(len(symbol), bool)
            keep[p + 1] = False
            at = p - np.arange(len(p))  # where the merged symbols are afterwards
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            rank[at] = _NONE
            look = np.concatenate([at, at[at > 0] - 1])
            look = look[look < len(symbol) - 1]
            look = look[word[look] == word[look + 1]]
            rank[look] = self._ranks(symbol[look], symbol[look + 1])
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        out = symbol[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=len(raw))) * 4).tolist()
        return [out[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Each distinct word's ids as bytes, from the cache or else by merges."""
        most = CACHE_WORDS // 2
        if len(self._cache) >= most:
            self._cache, self._older = {}, self._cache
        cache, older = self._cache, self._older
        out = list(map(cache.get, words))
        missing = []
        for k in [k for k, b in enumerate(out) if b is None]:
            w = words[k]
            b = older.get(w) or self._added_bytes.get(w)
            if b is None:
                missing.append(k)
            else:
                out[k] = b
                if len(cache) < most:
                    cache[w] = b
        for at in range(0, len(missing), _MERGE_WORDS):
            part = missing[at : at + _MERGE_WORDS]
            for k, b in zip(part, self._merge([words[k] for k in part]), strict=True):
                out[k] = b
                if len(words[k]) <= CACHE_CHARS and len(cache) < most:
                    cache[words[k]] = b
        return out

    def _gather(self, words: pa.Array, first: np.ndarray) -> list[bytes]:
        """The ids of each text, whose words are those from first[k] to first[k + 1]."""
        codes = words.dictionary_encode()
        ids = pa.array(self._ids(_list(codes.dictionary)), pa.large_binary()).take(codes.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64, len(ids) + 1)[first]
        return _list(pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(at), data]))

    def encode_bytes(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        plain: list[str] = []
        cut: list[list[bytes]] = []
        kinds: list[bool] = []  # whether a text is among the plain ones
        for t in texts:
            low = _plain(t or "") if not (t and self._mark and self._mark.search(t)) else None
            kinds.append(low is not None)
            if low is None:
                cut.append(self._cut(t))
            else:
                plain.append(low)
        made = iter(self._gather(*_word_bytes(plain)))
        first = np.cumsum([0, *map(len, cut)])
        rest = iter(self._gather(pa.array([w for words in cut for w in words], pa.large_binary()), first) if cut else ())
        return [next(made) if k else next(rest) for k in kinds]

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.encode_bytes(texts)]

    def decode(self, ids: Iterable[np.ndarray]) -> list[str]:
        """As the file's decoder has it (none: tokens joined by a space), special tokens kept. Unknown ids are skipped."""
        get, n = self.tokens.__getitem__, len(self.tokens)
        out = []
        for x in ids:
            x = np.asarray(x)
            if len(x) and (int(x.max()) >= n or int(x.min()) < 0):
                x = x[(x >= 0) & (x < n)]
            out.append(" ".join(map(get, x.tolist())))
        return out


_loaded: dict[str, BpeTokenizer] = {}


def tokenizer(path: str) -> BpeTokenizer:
    """One encoder for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = BpeTokenizer(path)
    return _loaded[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters encoded at once; a batch of Arrow rows is cut at it, a single text never is.
_PART_CHARS = 1_000_000


def text_parts(texts: list[str | None]) -> Iterator[slice]:
    start = total = 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= _PART_CHARS:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """docs to (id_col, ids array<int>[, decoded string]), one row per input row, in one pass without a shuffle.

    Null and empty texts have no ids and decode to an empty text; repeated rows and null ids stay as they are; other
    columns of docs do not matter. path: a tokenizers file that every executor can open (installed with the library).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in lean(batches):
            texts = batch.column(1).to_pylist()
            for part in text_parts(texts):
                raw = t.encode_bytes(texts[part])
                lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
                flat = np.frombuffer(b"".join(raw), "<i4")
                columns = [batch.column(0).slice(part.start, part.stop - part.start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decode:
                    columns.append(pa.array(t.decode(np.frombuffer(b, "<u4") for b in raw), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decode)


def decode_documents(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids array<int>) to (id_col, decoded string). Null lists decode to an empty text; null or unknown ids are skipped."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in lean(batches):
            ids = ([i for i in x if i is not None] if x else [] for x in batch.column(1).to_pylist())
            made = t.decode(np.array(x, np.int64) for x in ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [id_col, "decoded"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
