r"""Word hashes of whole Arrow batches, by array operations on the texts' bytes.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, after A-Z became a-z. A word's hash is a polynomial over its bytes modulo
2**64, from running sums, then mixed; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: What each byte adds to a word's polynomial: one more than its lower-case form.
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are looked at together; a longer text stands alone.
CHUNK = 1 << 17
_TABLE: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n. A worker keeps one table, for chunks; that of a longer text goes with it."""
    if _TABLE and len(_TABLE[0][0]) >= n:
        return _TABLE[0]
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    size = max(n, CHUNK + 1)
    with np.errstate(over="ignore"):
        made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_P, inverse))
    if size == CHUNK + 1:
        _TABLE[:] = [made]
    return made


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return h


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, their bytes, offsets of the rows in them) over a string column, some `size` bytes at a time; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word of the rows whose bytes start at `offsets`, in order."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    inside = ~_SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, back = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.multiply(_LOWER[raw], power[:n], out=sums[1:])
        np.cumsum(sums, out=sums)
        h = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    row = np.searchsorted(offsets, starts, "right") - 1
    return h, row, starts, ends


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct values, sorted: by a sort alone, which is faster here than what `np.unique` does."""
    out = np.sort(hashes)
    keep = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out if keep.all() else out[keep]


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    with np.errstate(over="ignore"):
        out = np.full(max(0, len(hashes) - width + 1), np.uint64(width))
        for k in range(width):
            out *= _P
            out += hashes[k : k + len(out)]
    return mix(out)


def shingles(hashes: np.ndarray, cuts: list[int], n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, whose words stand from its cut to the next; with fewer words, of the
    whole sequence; none without words."""
    whole = _windows(hashes, n)
    for first, last in zip(cuts, cuts[1:], strict=False):
        if last - first >= n:
            yield distinct(whole[first : last - n + 1])
        else:
            yield _windows(hashes[first:last], last - first) if last > first else np.zeros(0, np.uint64)
