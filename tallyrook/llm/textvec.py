"""Whole-column text kernels: words, word hashes and shingles as flat arrays.

An Arrow string column already is one UTF-8 buffer with offsets, so words are
found, hashed and compared for all documents of a batch at once, with no
Python object per word.  Work is cut into chunks of whole documents
(`chunks`), so memory is bounded by the chunk size or the longest document.

Null texts count as empty.  Every function accepts empty columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
#: Bytes hashed at once.
PIECE = 1 << 16
#: Spans above so many bytes are hashed one by one.
LONG = 256


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes, never fewer than one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return data + (((data - np.uint8(65)) < 26).astype(np.uint8) << np.uint8(5))


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes outside `gap` (a table of
    256 booleans), and for each document the index of its first word (n + 1).
    cut: whether a run also ends before a byte that is in one."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    border = np.ones(n + 1, bool)  # between bytes k - 1 and k
    np.logical_not(inside[:-1], out=border[1:-1])
    if cut is not None:
        border[1:-1] |= cut[1:]
    border[offsets] = True
    first = inside & border[:-1]
    border[1:-1] |= ~inside[1:]
    last = inside & border[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    with np.errstate(over="ignore"):
        out = [np.full(PIECE + LONG + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for x in out:
            x[0] = 1
            np.cumprod(x, out=x)
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of `data`, whose starts ascend.  Short spans:
    a polynomial modulo 2**64 by prefix sums, brought to power zero by the
    inverse of its odd base, mixed with the span's length; below LONG bytes no
    two texts agree in it by structure.  Longer spans: BLAKE2.  Sums are made
    piece by piece, so beside the result memory doesn't grow with the text."""
    up, down = _powers()
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    for p in range(0, len(data), PIECE):
        i, j = np.searchsorted(starts, (p, p + PIECE))
        if i == j:
            continue
        part = data[p : p + PIECE + LONG].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s = starts[i:j] - p
        h = sums.take(s + sizes[i:j], mode="clip")
        h -= sums.take(s)
        h *= down.take(s)
        out[i:j] = mix(h + sizes[i:j].astype(np.uint64) * _MUL)
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive word hashes, in order; len - size + 1 of them."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * _MUL + h[k : k + n]
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents and the document of each: `size`
    consecutive words; a document of fewer words gives all of them as one; one
    of none gives none.  Repeats stay."""
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, 0)
    doc = np.repeat(np.arange(len(n_words)), n)
    begin = np.cumsum(n) - n
    at = np.arange(len(doc)) - np.repeat(begin, n) + np.repeat(first[:-1], n)
    full = window_hashes(h, size)
    out = full[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n_words[short] > k
            word = np.where(has, h[np.minimum(first[short] + k, len(h) - 1)], np.uint64(0))
            extra = np.where(has, (extra ^ (extra >> np.uint64(29))) * _MUL + word, extra)
        extra = mix(extra ^ n_words[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        out, doc = np.concatenate([out, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def distinct_in_doc(h: np.ndarray, doc: np.ndarray, order_key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, ascending by `order_key` (a bijective
    function of the value; the value itself by default)."""
    if not len(h):
        return h, doc
    key = h if order_key is None else order_key
    by_key = np.argsort(key)
    small = doc[by_key]
    small = small.astype(np.uint16) if len(small) and doc[-1] < 65536 and doc.max() < 65536 else small
    order = by_key[np.argsort(small, kind="stable")]
    h, doc, key = h[order], doc[order], key[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


class Lookup:
    """Index of 64-bit hashes in a sorted table, by a bitmap and then a binary search."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.keys & np.uint64((1 << self.BITS) - 1)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Position in `keys` of each of `h`, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.seen[h & np.uint64((1 << self.BITS) - 1)])
            at = np.searchsorted(self.keys, h[maybe])
            at = np.minimum(at, len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out
