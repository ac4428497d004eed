"""Vectorised text kernels shared by the operators that run in Arrow batches.

A batch of texts is laid out as one flat numpy array plus document bounds.  Segments (words, pre-tokens) are cut with
boolean masks and hashed with a multilinear hash over 64-bit lanes, so that Python touches distinct segments only.
Two different segments share a 64-bit hash with a chance of about 2**-60 each; the callers treat equal hashes as equal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

U64 = np.uint64
#: Characters handled at once; bounds the memory of a worker whatever the Arrow batch holds.
SLICE_CHARS = 400_000


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    z = x.astype(U64) + U64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


_lanes = splitmix(np.arange(256)) | U64(1)


def lanes(n: int) -> np.ndarray:
    """Odd multipliers for the positions 0..n-1 of a segment."""
    global _lanes
    if n > len(_lanes):
        _lanes = splitmix(np.arange(max(n, 2 * len(_lanes)))) | U64(1)
    return _lanes


_tables: dict[bool, np.ndarray] = {}


def word_table(digits: bool = True) -> np.ndarray:
    """By code point: its lower case where it is a letter, a mark or (with digits) a number, else 0."""
    if digits not in _tables:
        import unicodedata

        table = np.zeros(0x110000, np.uint32)
        for c in range(0x33480):
            kind = unicodedata.category(ch := chr(c))
            if kind[0] == "L" or kind in ("Mn", "Mc") or digits and kind[0] == "N":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables[digits] = table
    return _tables[digits]


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    global _letters
    if _letters is None:
        import unicodedata

        _letters = np.zeros(0x110000, bool)
        _letters[:0x33480] = [unicodedata.category(chr(c))[0] == "L" for c in range(0x33480)]
    return _letters


def slices(texts: Sequence[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters; a longer text stands alone."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def flat_codes(texts: Sequence[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points and the bounds of the texts (one more than there are texts)."""
    clean = [t or "" for t in texts]
    joined = "".join(clean)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(clean) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, clean), np.int64, len(clean)), out=bounds[1:])
    return joined, codes, bounds


def flat_bytes(texts: Sequence[str | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """As flat_codes, over UTF-8."""
    clean = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"".join(clean)
    bounds = np.zeros(len(clean) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, clean), np.int64, len(clean)), out=bounds[1:])
    return joined, np.frombuffer(joined, np.uint8), bounds


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a text's bound."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = bounds[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = bounds[1:]
    after[last[last > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each segment [start, end) of values; no segment may be empty."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    offs = np.cumsum(lens) - lens
    total = int(offs[-1] + lens[-1])
    at = np.arange(total, dtype=np.int64)
    within = at - np.repeat(offs, lens)
    if total == len(values):
        picked = values
    else:
        picked = values[at + np.repeat(starts - offs, lens)]
    prods = (picked.astype(U64) + U64(1)) * lanes(int(lens.max()))[within]
    return splitmix(np.add.reduceat(prods, offs) ^ lens.astype(U64))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hash its class; for each class its hash and the first place it stands at."""
    classes, values = pd.factorize(hashes)
    first = np.zeros(len(values), np.int64)
    first[classes[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return classes, values, first


def gather_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    offs = np.cumsum(lens) - lens
    return np.arange(int(lens.sum()), dtype=np.int64) + np.repeat(starts - offs, lens)


class SegmentStore:
    """Per-worker memo: segment hash -> a run of integers (token ids).

    Hashes lie in a sorted array, the latest in a dict that is merged in from time to time; 32 bytes a segment and its
    integers.  trim() starts afresh beyond ``most`` segments.
    """

    RECENT = 1 << 17

    def __init__(self, dtype: type, most: int = 1_000_000):
        self.dtype, self.most = dtype, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, U64), np.zeros(0, np.int64)
        self.recent: dict[int, int] = {}
        self.count = 0
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)

    def trim(self) -> None:
        if self.count > self.most:
            self.clear()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash's run, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            out[known] = self.places[at[known]]
        if self.recent:
            left = np.flatnonzero(out < 0)
            get = self.recent.get
            out[left] = np.fromiter((get(h, -1) for h in hashes[left].tolist()), np.int64, len(left))
        return out

    def add(self, hashes: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Append runs (concatenated in flat); gives their places."""
        n, k = self.count, len(hashes)
        while n + k > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + k] = self.used + np.cumsum(lens) - lens
        self.size[n : n + k] = lens
        self.used += len(flat)
        self.count += k
        self.recent.update(zip(hashes.tolist(), range(n, n + k), strict=True))
        if len(self.recent) > self.RECENT:
            keys = np.concatenate([self.keys, np.fromiter(self.recent, U64, len(self.recent))])
            places = np.concatenate([self.places, np.fromiter(self.recent.values(), np.int64, len(self.recent))])
            order = np.argsort(keys)
            self.keys, self.places, self.recent = keys[order], places[order], {}
        return np.arange(n, n + k)
