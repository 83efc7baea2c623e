"""External induced suffix sorting with common-prefix values.

Suffixes that are smaller than their left neighbour (S* suffixes) are sorted by recursion over the names of the
substrings between them. Two scans induce the rest: popping suffixes in order, each pushes the one that starts a place
earlier. Pushed tuples (first symbol, position, common prefix) wait in a priority queue that is monotone: symbols never
fall below the one being popped, so the queue is a row of blocks of symbols, each appended to in order of arrival and
kept on disk once memory is full. A symbol with many suffixes is a block of its own, read back piece by piece in order
of arrival; of the other blocks a scan pops as many tuples at a time as no newly pushed one can come before.

The common prefix of two suffixes pushed one after the other into a symbol's block is one more than the least value
popped between their sources; values are capped, so the minimum over any past stretch takes one search in a table of
`cap + 1` places.

Memory is bounded whatever the length of the text: text, runs, S* positions, names, their order, the sorted L suffixes
and the counts of each symbol are arrays that go to files where they do not fit (Store), worked on piece by piece; the
substrings are sorted by distribution into ranges that fit.
"""

from __future__ import annotations

import mmap
import os

import numpy as np

from .common import local_tmp, remove_tree

#: Bytes that one sort keeps in memory: half for arrays, a quarter for the queue, the rest for working pieces.
MEMORY_BYTES = 128_000_000
#: Tuples that one block of the queue has at least, and those of a piece of work.
BLOCK_TUPLES = 16_000
_PIECE = 1 << 17
_HEAD = 65_536
_FAR = np.int64(1) << 40


class Kept:
    """An array in memory or in a file. Pages of a file that were touched are let go once they are `memory` bytes."""

    def __init__(self, a: np.ndarray, path: str | None = None, memory: int = 0, pages: mmap.mmap | None = None):
        self.a, self.path, self.memory, self.pages, self.touched = a, path, memory, pages, 0

    def __len__(self) -> int:
        return len(self.a)

    def _touch(self, k: object) -> None:
        size = self.a.itemsize
        self.touched += (k.stop - k.start) * size if isinstance(k, slice) else min(len(k) * 4096, self.a.nbytes)
        if self.touched > self.memory:
            self.pages.madvise(mmap.MADV_DONTNEED)
            self.touched = 0

    def __getitem__(self, k: slice | np.ndarray) -> np.ndarray:
        """A slice with both ends given, to be read before it is written, or places."""
        if self.path:
            self._touch(k)
        return self.a[k]

    def __setitem__(self, k: slice | np.ndarray, v: np.ndarray | int) -> None:
        self.a[k] = v
        if self.path:
            self._touch(k)


class Store:
    """Arrays of one sort: in memory as long as `memory` lasts, then in files of the folder."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.left, self.on_disk = folder, memory, memory, 0

    def array(self, n: int, kind: type, fill: int | None = None) -> Kept:
        size = n * np.dtype(kind).itemsize
        if size <= min(self.left, self.memory // 4):
            self.left -= size
            out = Kept(np.empty(n, kind))
        else:
            self.on_disk += size
            path = os.path.join(self.folder, f"array{os.urandom(6).hex()}")
            with open(path, "w+b") as file:
                file.truncate(max(size, 1))
                pages = mmap.mmap(file.fileno(), max(size, 1))
            out = Kept(np.frombuffer(pages, kind, n), path, self.memory // 8, pages)
        if fill is not None:
            for a, b in pieces(n):
                out[a:b] = fill
        return out

    def free(self, *kept: Kept) -> None:
        for x in kept:
            if x.path:
                os.unlink(x.path)
            else:
                self.left += x.a.nbytes
            x.a = x.pages = None


class Writer:
    """Appends to what becomes one Kept."""

    def __init__(self, store: Store, kind: type):
        self.store, self.kind, self.n, self.held, self.waiting = store, kind, 0, [], 0
        self.path = os.path.join(store.folder, f"append{os.urandom(6).hex()}")
        self.file = None

    def add(self, x: np.ndarray) -> None:
        self.held.append(x.astype(self.kind))
        self.n += len(x)
        self.waiting += self.held[-1].nbytes
        if self.waiting > self.store.memory // 16:
            self.file = self.file or open(self.path, "wb")
            for h in self.held:
                self.file.write(h.data)
            self.held, self.waiting = [], 0

    def done(self) -> Kept:
        out = self.store.array(self.n, self.kind)
        at = 0
        if self.file:
            self.file.close()
            old = np.memmap(self.path, self.kind, "r")
            for a, b in pieces(len(old)):
                out[a:b] = old[a:b]
            at = len(old)
            del old
            os.unlink(self.path)
        for h in self.held:
            out[at : at + len(h)] = h
            at += len(h)
        self.held = []
        return out


def pieces(n: int, size: int = _PIECE):
    for a in range(0, n, size):
        yield a, min(n, a + size)


def _index(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


class BlockQueue:
    """Append-only blocks of (key, position, prefix) tuples; what does not fit in memory waits on disk.

    first: the first symbol of each block, and one past the last."""

    def __init__(self, folder: str, first: np.ndarray, sigma: int, kind: type, memory: int):
        self.first, self.n, self.kind = first, len(first) - 1, kind
        self.block_of = np.searchsorted(first, np.arange(sigma), "right") - 1 if sigma <= 1 << 16 else None
        self.held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.disk: dict[int, list[tuple[int, int]]] = {}
        self.path = os.path.join(folder, f"queue{os.urandom(6).hex()}")
        self.file = None
        self.bytes, self.memory = 0, memory
        self.late: list[tuple[np.ndarray, ...]] = []
        self.late_n = 0

    def push(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.late.append((key, pos.astype(self.kind), lcp))
        self.late_n += len(key)
        if 17 * self.late_n > min(1_400_000, self.memory // 4):
            self.settle()

    def settle(self) -> None:
        if not self.late_n:
            return
        key, pos, lcp = (np.concatenate(x) for x in zip(*self.late, strict=True))
        self.late, self.late_n = [], 0
        block = self.block_of[key] if self.block_of is not None else np.searchsorted(self.first, key, "right") - 1
        order = np.argsort(block, kind="stable")
        key, pos, lcp, block = key[order], pos[order], lcp[order], block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
            self.held.setdefault(int(block[a]), []).append((key[a:b], pos[a:b], lcp[a:b]))
        self.bytes += key.nbytes + pos.nbytes + lcp.nbytes
        if self.bytes > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or open(self.path, "w+b")
        self.file.seek(0, 2)
        for b, parts in self.held.items():
            key, pos, lcp = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.disk.setdefault(b, []).append((self.file.tell(), len(key)))
            self.file.write(key.astype(np.int64).tobytes() + pos.tobytes() + lcp.tobytes())
        self.held = {}
        self.bytes = 0

    def _read(self, at: int, n: int, a: int, b: int) -> tuple[np.ndarray, ...]:
        """The tuples a..b of a part of n tuples."""
        out, from_ = [], at
        for kind in (np.int64, self.kind, np.uint8):
            size = np.dtype(kind).itemsize
            self.file.seek(from_ + size * a)
            out.append(np.frombuffer(self.file.read(size * (b - a)), kind))
            from_ += size * n
        return tuple(out)

    def parts(self, b: int, most: int):
        """Block b's tuples in order of arrival, up to `most` at a time; what is pushed to it meanwhile comes last."""
        while True:
            self.settle()
            found = self.disk.pop(b, None)
            if found:
                for at, n in found:
                    for x, y in pieces(n, most):
                        yield self._read(at, n, x, y)
                continue
            held = self.held.pop(b, None)
            if not held:
                return
            self.bytes -= sum(x.nbytes for part in held for x in part)
            key, pos, lcp = (np.concatenate(x) for x in zip(*held, strict=True))
            for x, y in pieces(len(key), most):
                yield key[x:y], pos[x:y], lcp[x:y]

    def take(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block b's tuples in order of (key, arrival)."""
        found = list(self.parts(b, _PIECE))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.uint8)
        key, pos, lcp = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        return key[order], pos[order], lcp[order]

    def close(self) -> None:
        if self.file:
            self.file.close()
            os.unlink(self.path)


def _blocks(counts: Kept, seeds: Kept, down: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first symbol of each block and one past the last, seeds before each, whether a block is one symbol with many
    suffixes), symbols in order of the scan."""
    sigma = len(counts)
    first, before, many = [], [], []
    total, n_seeds, block, was = 0, 0, -1, False
    # some thousands of blocks at most: each has its own parts on disk
    size = max(BLOCK_TUPLES, sum(int((counts[a:b] + seeds[a:b]).sum()) for a, b in pieces(sigma)) >> 11)
    for a, b in pieces(sigma):
        x, y = (k[sigma - b : sigma - a][::-1] if down else k[a:b] for k in (counts, seeds))
        both = x + y
        heavy = both >= size
        own = (total + np.cumsum(both)) // size
        new = np.r_[own[0] != block, own[1:] != own[:-1]] | heavy | np.r_[was, heavy[:-1]]
        at = np.flatnonzero(new)
        first.append(a + at)
        before.append(n_seeds + (np.cumsum(y) - y)[at])
        many.append(heavy[at])
        total, n_seeds, block, was = total + int(both.sum()), n_seeds + int(y.sum()), own[-1], bool(heavy[-1])
    first, before, many = np.concatenate(first), np.concatenate(before), np.concatenate(many)
    if not len(first) or first[0]:
        first, before, many = np.r_[0, first], np.r_[0, before], np.r_[False, many]
    return np.r_[first, sigma], np.r_[before, n_seeds], many


def _least(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum over the places a..b of the batch that the doubling table is of."""
    size = b - a + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(a), np.uint8)
    for k in np.unique(level).tolist():
        m = level == k
        out[m] = np.minimum(table[k][a[m]], table[k][b[m] - (1 << k) + 1])
    return out


def _doubling(x: np.ndarray, most: int) -> list[np.ndarray]:
    out = [x]
    while (2 << (len(out) - 1)) <= most:
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _behind(x: np.ndarray, first) -> np.ndarray:
    """x one place later, with first at its head."""
    out = np.empty_like(x)
    out[0] = first
    out[1:] = x[:-1]
    return out


def _inserted(at: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Each pair's second array inserted into its first before the places at, which ascend."""
    n = len(pairs[0][0]) + len(at)
    to = at + np.arange(len(at))
    old = np.ones(n, bool)
    old[to] = False
    out = []
    for a, b in pairs:
        x = np.empty(n, a.dtype)
        x[old] = a
        x[to] = b
        out.append(x)
    return out


def _scan(store: Store, text: Kept, counts: Kept, seed_counts: Kept, seeds: Kept, seed_lcp: Kept, runs: Kept, cap: int, queue_memory: int, down: bool):
    """One scan. seeds: positions in order of the scan with the prefix each has in common with the one before it.
    down: from the largest symbol to the smallest; else upwards. Yields (positions, prefixes, is seed) in scan order."""
    sigma = len(counts)
    flip = sigma - 1
    first, bounds, many = _blocks(counts, seed_counts, down)
    queue = BlockQueue(store.folder, first, sigma, _index(len(text)), queue_memory)
    last = store.array(sigma, np.int64, -1)  # when the block of a symbol was last pushed to
    since = np.full(cap + 1, -1, np.int64)  # when a prefix of at most v was last popped
    time, before = 0, (-1, False, 0)  # the symbol, kind and run of what was popped last

    def sources(pos: np.ndarray, is_seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each pushes, the symbol pushed) in order of the scan."""
        here = text[pos].astype(np.int64)
        prev = text[np.maximum(pos - 1, 0)].astype(np.int64)
        if down:
            good = np.where(is_seed, prev < here, prev <= here)
            prev = flip - prev
        else:
            good = np.where(is_seed, prev > here, prev >= here)
        return good & (pos > 0), prev

    def popped(symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray, kind: np.ndarray, good: np.ndarray, prev: np.ndarray):
        """The prefixes of what is popped at once, and what it pushes: (symbols, positions, prefixes)."""
        nonlocal time, before, since
        n = len(pos)
        run = runs[pos]
        s0, q0, r0 = _behind(symbol, before[0]), _behind(kind, before[1]), _behind(run, before[2])
        lam = np.where(s0 != symbol, 0, np.where(kind & ~q0, np.minimum(r0, run), lcp)).astype(np.uint8)
        before = (int(symbol[-1]), bool(kind[-1]), int(run[-1]))
        g = np.flatnonzero(good)
        pushed = None
        if len(g):
            c = prev[g]
            o = np.argsort(c, kind="stable")
            g, c = g[o], c[o]
            opens = np.ones(len(c), bool)
            np.not_equal(c[1:], c[:-1], out=opens[1:])
            low_here = np.minimum.accumulate(lam)
            new = np.empty(len(g), np.int64)
            f = np.flatnonzero(opens)
            t0 = last[c[f]]
            past = np.searchsorted(since, t0, "right")  # cap + 1 where nothing came since
            new[f] = np.where(t0 < 0, 0, 1 + np.minimum(np.minimum(past, cap), low_here[g[f]]))
            r = np.flatnonzero(~opens)
            if len(r):
                a = g[r - 1] + 1
                new[r] = 1 + _least(_doubling(lam, int((g[r] - a).max()) + 1), a, g[r]).astype(np.int64)
            ends = np.append(f[1:], len(c)) - 1
            last[c[ends]] = time + g[ends]
            pushed = c, pos[g] - 1, np.minimum(new, cap).astype(np.uint8)
        seen = np.full(cap + 1, -1, np.int64)
        seen[lam] = np.arange(time, time + n)
        since = np.maximum(since, np.maximum.accumulate(seen))
        time += n
        return lam, pushed

    try:
        for b in range(queue.n):
            if many[b]:
                # one symbol: first what was pushed, in order of arrival, then its seeds
                for is_seed in (False, True):
                    own = ((None, seeds[x + bounds[b] : y + bounds[b]], seed_lcp[x + bounds[b] : y + bounds[b]]) for x, y in pieces(int(bounds[b + 1] - bounds[b]), _HEAD)) if is_seed else queue.parts(b, _HEAD)
                    for _, pos, lcp in own:
                        pos, kind = pos.astype(np.int64), np.full(len(pos), is_seed)
                        lam, pushed = popped(np.full(len(pos), first[b]), pos, lcp, kind, *sources(pos, kind))
                        yield pos, lam, kind
                        if pushed:
                            queue.push(*pushed)
                continue
            k1, p1, l1 = queue.take(b)
            s = slice(int(bounds[b]), int(bounds[b + 1]))
            own = seeds[s].astype(np.int64)
            seed_key = text[own].astype(np.int64) if len(own) else own
            # 2 * symbol, one more for a seed: the order of the front
            key = np.concatenate([2 * k1, 2 * (flip - seed_key if down else seed_key) + 1])
            order = np.argsort(key, kind="stable")
            key, pos, lcp = key[order], np.concatenate([p1.astype(np.int64), own])[order], np.concatenate([l1, seed_lcp[s]])[order]
            top, head = first[b + 1], _HEAD
            while len(key):
                h_key, h_pos = key[:head], pos[:head]
                is_seed = (h_key & 1).astype(bool)
                good, prev = sources(h_pos, is_seed)
                low = np.minimum.accumulate(np.where(good, prev, _FAR))
                stop = h_key[1:] > 2 * low[:-1]
                n = int(np.argmax(stop)) + 1 if stop.any() else len(h_key)
                head = min(_HEAD, max(128, 3 * n))
                b_pos, kind = h_pos[:n], is_seed[:n]
                lam, pushed = popped(h_key[:n] >> 1, b_pos, lcp[:n], kind, good[:n], prev[:n])
                yield b_pos, lam, kind
                key, pos, lcp = key[n:], pos[n:], lcp[n:]
                if pushed:
                    c, born, new = pushed
                    inside = int(np.searchsorted(c, top))
                    if inside:
                        at = np.searchsorted(key, 2 * c[:inside], "right")
                        key, pos, lcp = _inserted(at, [(key, 2 * c[:inside]), (pos, born[:inside]), (lcp, new[:inside])])
                    if inside < len(c):
                        queue.push(c[inside:], born[inside:], new[inside:])
    finally:
        queue.close()
        store.free(last)


def _direct(text: Kept, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of suffixes that are known to differ soon, symbol by symbol."""
    out = np.zeros(len(a), np.int64)
    on = np.arange(len(a))
    n = len(text)
    for k in range(cap):
        x, y = a[on] + k, b[on] + k
        same = (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        on = on[same]
        if not len(on):
            break
        out[on] += 1
    return out


class Names:
    """Sorts the substrings from each S* position to the next, both ends included, and names them in order. Where one is
    a prefix of another it is the larger: its last symbol is of the S kind there, the other's of the L kind.

    order: the substrings' numbers in order; name: each one's name; n: names. Ranges of substrings that are too many for
    memory are distributed by the next symbol until they fit; those that end there are equal."""

    def __init__(self, store: Store, text: Kept, sigma: int, stars: Kept):
        self.store, self.text, self.sigma, self.stars, self.m = store, text, sigma, stars, len(stars)
        kind = _index(self.m)
        self.order, self.name = store.array(self.m, kind), store.array(self.m, kind)
        self.n = self.at = 0
        self.most = max(8, store.memory // 128)
        if self.m <= self.most:
            self._in_memory(np.arange(self.m), 0)
        else:
            every = store.array(self.m, kind)
            for a, b in pieces(self.m):
                every[a:b] = np.arange(a, b)
            self._range(every, 0, self.m, 0, 0, sigma)
            store.free(every)

    def _ends(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of substrings; the last is one symbol."""
        start = self.stars[i].astype(np.int64)
        return start, np.where(i + 1 < self.m, self.stars[np.minimum(i + 1, self.m - 1)] - start + 1, 1)

    def _symbols(self, i: np.ndarray, depth: int) -> np.ndarray:
        """The symbol at a depth, sigma where the substring has ended."""
        start, size = self._ends(i)
        out = np.full(len(i), self.sigma, np.int64)
        inside = depth < size
        out[inside] = self.text[start[inside] + depth]
        return out

    def _emit(self, i: np.ndarray, new: np.ndarray) -> None:
        self.order[self.at : self.at + len(i)] = i
        self.name[i] = self.n - 1 + np.cumsum(new)
        self.at += len(i)
        self.n += int(new.sum())

    def _range(self, own: Kept, a: int, b: int, depth: int, low: int, high: int) -> None:
        """own[a:b]: substrings that agree before depth and whose symbol there is in [low, high)."""
        if b - a <= self.most:
            if b > a:
                self._in_memory(own[a:b].astype(np.int64), depth)
            return
        if high - low == 1 and low == self.sigma:  # all have ended: one name
            for x, y in pieces(b - a):
                self._emit(own[a + x : a + y], np.r_[x == 0, np.zeros(y - x - 1, bool)])
            return
        if high - low == 1:
            depth, low, high = depth + 1, 0, self.sigma + 1
        parts = min(high - low, 1024)
        edge = low + (high - low) * np.arange(parts + 1) // parts
        count = np.zeros(parts, np.int64)
        for x, y in pieces(b - a):
            count += np.bincount(np.searchsorted(edge, self._symbols(own[a + x : a + y].astype(np.int64), depth), "right") - 1, minlength=parts)
        ends = np.cumsum(count)
        fill = ends - count
        dealt = self.store.array(b - a, _index(self.m))
        for x, y in pieces(b - a):
            i = own[a + x : a + y]
            k = np.searchsorted(edge, self._symbols(i.astype(np.int64), depth), "right") - 1
            order = np.argsort(k, kind="stable")
            i, k = i[order], k[order]
            f = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            for p, q in zip(f.tolist(), [*f[1:].tolist(), len(k)], strict=True):
                at = int(fill[k[p]])
                dealt[at : at + q - p] = i[p:q]
                fill[k[p]] += q - p
        k = 0
        while k < parts:
            e = k + 1
            while e < parts and ends[e] - (ends[k] - count[k]) <= self.most:
                e += 1
            self._range(dealt, int(ends[k] - count[k]), int(ends[e - 1]), depth, int(edge[k]), int(edge[e]))
            k = e
        self.store.free(dealt)

    def _in_memory(self, i: np.ndarray, at: int) -> None:
        """Sort substrings that agree before symbol `at`, by words of several symbols."""
        m = len(i)
        begin, length = self._ends(i)
        bits = int(self.sigma + 1).bit_length()
        per = max(1, 63 // bits)
        end = (1 << bits) - 1
        rank = np.zeros(m, np.int64)
        active = np.arange(m)
        while len(active):
            word = np.zeros(len(active), np.int64)
            start, size = begin[active], length[active]
            for k in range(at, at + per):
                inside = k < size
                symbol = np.full(len(active), end, np.int64)
                symbol[inside] = self.text[start[inside] + k]
                word = word << bits | symbol
            order = np.lexsort((word, rank[active]))
            active, word = active[order], word[order]
            group = rank[active]
            new = np.r_[True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])]
            first = np.r_[True, group[1:] != group[:-1]]
            place = np.arange(len(active))
            base = place - np.maximum.accumulate(np.where(first, place, 0))  # place within the old group
            rank[active] = group + np.maximum.accumulate(np.where(new, place, 0)) - (place - base)
            at += per
            sub = np.cumsum(new) - 1
            many = np.bincount(sub)[sub] > 1
            active = active[many & (length[active] >= at)]  # one that ends just here has its end yet to compare
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        self._emit(i[order], np.r_[True, ordered[1:] != ordered[:-1]])


def _count(counts: Kept, symbols: np.ndarray) -> None:
    if len(counts) <= 1 << 16:
        counts[0 : len(counts)] = counts[0 : len(counts)] + np.bincount(symbols, minlength=len(counts))
    elif len(symbols):
        u, n = np.unique(symbols, return_counts=True)
        counts[u] = counts[u] + n


def _types(store: Store, text: Kept, sigma: int, cap: int) -> tuple[Kept, Kept, Kept, Kept, Kept]:
    """(S* positions, runs of one symbol from each place on, counts by symbol of L, S and S* places), right to left."""
    n = len(text)
    runs = store.array(n, np.uint8)
    large, small_n, star_n = (store.array(sigma, np.int64, 0) for _ in range(3))
    room = n // 2 + 1
    stars = store.array(room, _index(n))
    free = room
    is_small, run = True, 1  # of the last place, the end mark
    runs[n - 1 : n] = 1
    _count(small_n, text[n - 1 : n])
    for near, far in pieces(n - 1):
        a, b = n - 1 - far, n - 1 - near
        x = text[a : b + 1]
        size = b - a
        here = np.arange(size)
        # the next place where symbols differ decides between S and L
        nxt = np.minimum.accumulate(np.where(x[1:] != x[:-1], here, size)[::-1])[::-1]
        past = nxt == size
        small = np.where(past, is_small, (x[1:] > x[:-1])[np.minimum(nxt, size - 1)])
        length = np.minimum(np.where(past, size - here + run, nxt - here + 1), cap)
        runs[a:b] = length
        star = a + 1 + np.flatnonzero(np.r_[small[1:], is_small] & ~small)
        stars[free - len(star) : free] = star
        free -= len(star)
        _count(large, x[:-1][~small])
        _count(small_n, x[:-1][small])
        _count(star_n, x[star - a])
        is_small, run = bool(small[0]), int(length[0])
    out = store.array(room - free, _index(n))
    for a, b in pieces(room - free):
        out[a:b] = stars[free + a : free + b]
    store.free(stars)
    return out, runs, large, small_n, star_n


def _sorted(store: Store, text: Kept, sigma: int, cap: int, queue_memory: int):
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    stars, runs, large, small, star_n = _types(store, text, sigma, cap)
    m = len(stars)
    names = Names(store, text, sigma, stars)
    order = names.order
    equal = store.array(m, np.uint8, 0)  # names in common with the one before
    if names.n < m:
        at = 0
        for p, v in _sorted(store, names.name, names.n, cap // 2 + 1, queue_memory):
            order[m - at - len(p) : m - at] = p[::-1]
            v = v[1:] if at == 0 else v
            skip = max(at, 1)
            equal[m - skip - len(v) + 1 : m - skip + 1] = v[::-1]
            at += len(p)
    store.free(names.name)
    pos, seed_lcp = store.array(m, _index(n)), store.array(m, np.uint8, 0)
    for a, b in pieces(m):
        j = order[a:b].astype(np.int64)
        pos[a:b] = stars[j]
        if a == 0:
            i, j, e = j[:-1], j[1:], equal[1:b].astype(np.int64)
        else:
            i, e = np.r_[order[a - 1 : a], j[:-1]], equal[a:b].astype(np.int64)
        if not len(j):
            continue
        to = stars[np.minimum(j + e, m - 1)].astype(np.int64)
        ahead = to - stars[j]
        near = ahead < cap
        far = np.full(len(j), cap, np.int64)
        x, y = stars[np.minimum(i + e, m - 1)][near].astype(np.int64), to[near]
        far[near] = np.minimum(cap, ahead[near] + _direct(text, x, y, cap))
        seed_lcp[b - len(j) : b] = far
    store.free(order, equal, stars)
    n_large = int(sum(large[a:b].sum() for a, b in pieces(sigma)))
    l_pos, l_lcp = store.array(n_large, _index(n)), store.array(n_large + 1, np.uint8, 0)
    at = 0
    for p, v, seed in _scan(store, text, large, star_n, pos, seed_lcp, runs, cap, queue_memory, False):
        p, v = p[~seed], v[~seed]
        l_pos[n_large - at - len(p) : n_large - at] = p[::-1]
        # the prefix with the one that comes after it in the other direction
        l_lcp[n_large - at - len(v) + 1 : n_large - at + 1] = v[::-1]
        at += len(p)
    l_lcp[0:1] = 0
    store.free(pos, seed_lcp)
    for p, v, _ in _scan(store, text, small, large, l_pos, l_lcp, runs, cap, queue_memory, True):
        yield p, v
    yield np.array([n - 1]), np.zeros(1, np.uint8)
    store.free(l_pos, l_lcp, runs, large, small, star_n)


def suffix_sort(text: np.ndarray | Kept, sigma: int, cap: int, memory: int = MEMORY_BYTES, store: Store | None = None):
    """Yields (positions, prefixes) in descending suffix order, in parts: prefixes[i] is the common prefix, at most
    cap (at most 254), with the suffix yielded just before. text: unsigned or signed whole numbers below sigma, the
    last one 0 and no other 0. memory: bytes kept off the disk; store: where arrays go, else a scratch folder."""
    own = store is None
    store = store or Store(local_tmp(), memory // 2)
    try:
        yield from _sorted(store, text if isinstance(text, Kept) else Kept(text), sigma, cap, memory // 4)
    finally:
        if own:
            remove_tree(store.folder)
