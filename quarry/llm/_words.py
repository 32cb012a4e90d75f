"""Vectorised words of Arrow text columns: NumPy over bytes, no loop over words.

All word classes used here treat every byte of a non-ASCII character alike, so
splitting UTF-8 bytes equals splitting code points.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLOCK = 1 << 18
_LONG = 256
_pow: dict[int, np.ndarray] = {}

#: Words are runs of bytes other than blank and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Words are runs of digits, lower-case letters and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def new_key() -> int:
    """A key for the word hashes of one run: texts cannot be made to collide under a key that nobody knew before."""
    return secrets.randbits(64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, U64)
        steps[0] = 1
        _pow[base] = have = np.cumprod(steps, dtype=U64)
        if len(_pow) > 8 or n > 1 << 24:
            _pow.pop(next(iter(_pow)))
    return have[:n]


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text; a longer text is a range of its own."""
    offsets = _offsets(column)
    start, n = 0, len(column)
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def _offsets(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


class Words:
    """Words of a range of rows: hash, byte start and byte end of each, and the words' range of each row.

    Hashes depend on key; wide also gives hash2, a second hash that shares no state with
    the first. A null text has no words.
    """

    def __init__(self, column: pa.Array, table: np.ndarray, fold: np.ndarray = SAME, spans: bool = False, key: int = 0, wide: bool = False):
        offsets = _offsets(column)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
        self.lo = int(offsets[0]) if len(offsets) else 0
        raw = raw[self.lo : int(offsets[-1])] if len(offsets) else raw[:0]
        self.raw, self.offsets, self.fold = raw, offsets - self.lo, fold
        begins = np.zeros(len(raw) + 1, bool)
        begins[self.offsets] = True
        seeds = [mix(U64([key]))[0], mix(U64([key ^ 0xA5A5A5A5A5A5A5A5]))[0]][: 1 + wide]
        hashes, starts, ends = [[] for _ in seeds], [], []
        pos, n = 0, len(raw)
        while pos < n:
            end = self._cut(pos, min(n, pos + _BLOCK), table, fold, begins)
            h, s, e = _hashed(fold[raw[pos:end]], table, begins[pos : end + 1], seeds)
            for out, x in zip(hashes, h, strict=True):
                out.append(x)
            starts.append(s + pos)
            ends.append(e + pos)
            pos = end
        none = np.zeros(0, np.int64)
        self.hash, *rest = (np.concatenate(x) if x else np.zeros(0, U64) for x in hashes)
        self.hash2 = rest[0] if wide else None
        start = np.concatenate(starts) if starts else none
        self.row_start = np.searchsorted(start, self.offsets[:-1], "left")
        self.row_end = np.append(self.row_start[1:], len(start)) if len(self.row_start) else self.row_start
        self.start, self.end = (start, np.concatenate(ends) if ends else none) if spans else (None, None)

    def _cut(self, pos: int, end: int, table: np.ndarray, fold: np.ndarray, begins: np.ndarray) -> int:
        """The last place up to end where no word is cut, or the first one beyond."""
        n, raw = len(self.raw), self.raw
        if end >= n:
            return n
        size = 1 << 12
        while True:
            low = max(pos + 1, end - size)
            free = np.flatnonzero(~table[fold[raw[low:end]]] | begins[low:end])
            if len(free):
                return low + int(free[-1])
            if low == pos + 1:
                break
            size *= 16
        while end < n:
            free = np.flatnonzero(~table[fold[raw[end : end + _BLOCK]]] | begins[end : min(n, end + _BLOCK)])
            if len(free):
                return end + int(free[0])
            end += _BLOCK
        return n

    def counts(self) -> np.ndarray:
        return self.row_end - self.row_start

    def agree(self, at: np.ndarray, other: Words, there: np.ndarray) -> bool:
        """Whether words at these places are, byte by byte, the other's words there; both need spans."""
        at, there = np.unique(np.stack([at, there]), axis=1) if len(at) else (at, there)
        size = self.end[at] - self.start[at]
        if (size != other.end[there] - other.start[there]).any():
            return False
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mine, theirs = (x.fold[x.raw[np.repeat(x.start[y], size) + step]] for x, y in ((self, at), (other, there)))
        return bool((mine == theirs).all())

    def texts(self, row: int) -> list[bytes]:
        """The words of one row, as they stand; needs spans."""
        data = self.raw[self.offsets[row] : self.offsets[row + 1]].tobytes()
        base = self.offsets[row]
        a, b = self.row_start[row], self.row_end[row]
        return [data[s:e] for s, e in zip((self.start[a:b] - base).tolist(), (self.end[a:b] - base).tolist(), strict=True)]


def _hashed(data: np.ndarray, table: np.ndarray, begins: np.ndarray, seeds: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes by seed, start and end of each word; a word ends where a row begins.

    A word is read eight bytes at a time, each taken in by a full mix of the hash so far;
    words of up to eight bytes and one length never collide. A word of more than 256
    bytes is hashed by BLAKE2b.
    """
    inside = table[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return [np.zeros(0, U64) for _ in seeds], none, none
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | begins[:-1]))
    end = np.flatnonzero(inside & (~after | begins[1:])) + 1
    size = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = [mix(size.astype(U64) ^ seed) for seed in seeds]
    live, at = np.arange(len(start)), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        lane = eight[start[live] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(U64))
        for h, seed in zip(out, seeds, strict=True):
            h[live] = mix((h[live] + seed) ^ lane)
        at += 8
        live = live[(size[live] > at) & (size[live] <= _LONG)]
    for i in np.flatnonzero(size > _LONG).tolist():
        word = data[start[i] : end[i]].tobytes()
        for h, seed in zip(out, seeds, strict=True):
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=seed.tobytes()).digest(), "little")
    return out, start, end


def _joined(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    x = left * U64(seed | 1) + (right ^ (right >> U64(29))) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


def grams(h: np.ndarray, k: int, seed: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hashes of all runs of k consecutive entries, from those of runs half as long; rows are not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    size, run, out, done = 1, h, None, 0
    while True:
        if k & size:
            # the run of the lowest bits comes last
            part = run[k - done - size :][:n]
            out = part if out is None else _joined(part, out, seed)
            done += size
        if size * 2 > k:
            return mix(out ^ U64(k))
        run = _joined(run[:-size], run[size:], seed + size)
        size *= 2


def slide(f, x: np.ndarray, n: int) -> np.ndarray:
    """f (minimum or maximum) over each n consecutive entries, by doubling."""
    left = len(x) - n + 1
    if left <= 0:
        return x[:0]
    size, out = 1, x
    while size * 2 <= n:
        out = f(out[:-size], out[size:])
        size *= 2
    return out if size == n else f(out[:left], out[n - size : n - size + left])


def winnow(words: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: of each span consecutive words of a row, the smallest k-gram hashes are kept.

    Returns the k-gram hashes, the smallest hash of each span, whether a span lies
    within one row, and which k-grams are kept. Rows that share span consecutive
    words keep the same k-gram within them.
    """
    g = np.maximum(grams(words.hash, k), U64(1))
    least = slide(np.minimum, g, span - k + 1)
    if not len(least):
        return g, least, np.zeros(0, bool), np.zeros(len(g), bool)
    whole = np.arange(len(least)) + span <= np.repeat(words.row_end, words.counts())[: len(least)]
    pad = np.zeros(span - k, U64)
    most = slide(np.maximum, np.concatenate((pad, np.where(whole, least, U64(0)), pad)), span - k + 1)
    return g, least, whole, most == g
