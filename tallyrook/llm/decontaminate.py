"""Benchmark decontamination by an FM-index per training shard.

Documents are read in shards of whole documents.  A shard's words become ids of
the benchmark vocabulary; a stretch of words outside it, or one shorter than
the shortest phrase, can hold no phrase and shrinks to one separator.  Over the
rest an FM-index is built; every phrase (window of benchmark words) is searched
backwards through wavelet ranks, its occurrences are located by sampled suffix
positions, and overlapping hits merge to removal spans.

No shuffle.  Benchmark phrases reach the workers in blocks made of some 1 MB of
text each, a dozen times that in memory; a worker holds one at a time.

Null texts have no words and stay null.  Null ids stay; rows that repeat an id
are searched one by one.  A text longer than a shard is a shard of its own.  A
null or wordless item has no window.  Repeated items each count.  An empty
benchmark hits nothing, an empty table gives no rows.  A column to keep that is
called like a result is an error, other columns may have any name.  Words are
told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import base, textvec
from tallyrook.llm.fmindex import FMIndex

#: Benchmark text per block, in characters.
BLOCK_CHARS = 1 << 20
#: Text per shard.
SHARD_BYTES = 4 << 20

GAP = np.ones(256, bool)
GAP[0x30:0x3A] = False
GAP[0x61:0x7B] = False
GAP[0x80:] = False


@dataclass
class Phrases:
    """Distinct windows of a set of items, over a vocabulary of word hashes."""

    vocabulary: textvec.Lookup
    ids: np.ndarray
    offsets: np.ndarray
    owner_offsets: np.ndarray  # phrase -> its items
    owners: np.ndarray
    names: list[str]
    shortest: int


def phrases(items: list[tuple[object, str | None]], window: int) -> Phrases:
    names = [str(k) for k, _ in items]
    data, offsets = textvec.text_buffer(pa.array([t for _, t in items], pa.string()))
    data = textvec.lower_ascii(data)
    starts, ends, first = textvec.words(data, offsets, GAP)
    with np.errstate(over="ignore"):
        h = textvec.span_hashes(data, starts, ends)
    vocabulary = textvec.Lookup(h)
    ids = (vocabulary(h) + 1).astype(np.int32)
    size = np.diff(first)
    parts, counts, lengths = [], [], []
    for n in range(1, window + 1):  # items shorter than a window are one window each
        own = np.flatnonzero(size == n) if n < window else np.flatnonzero(size >= n)
        at, which = _spread(first[own], first[own + 1] - n + 1)
        if len(at):
            rows, phrase = np.unique(ids[at[:, None] + np.arange(n)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([phrase.reshape(-1), own[which]]), axis=1)
            parts.append((rows.reshape(-1), pairs[1]))
            counts.append(np.bincount(pairs[0], minlength=len(rows)))
            lengths.append(np.full(len(rows), n, np.int64))
    none = np.zeros(0, np.int64)
    length, count = np.concatenate([none, *lengths]), np.concatenate([none, *counts])
    return Phrases(
        vocabulary,
        np.concatenate([np.zeros(0, np.int32), *[p[0] for p in parts]]),
        np.concatenate([[0], np.cumsum(length)]).astype(np.int64),
        np.concatenate([[0], np.cumsum(count)]).astype(np.int64),
        np.concatenate([none, *[p[1] for p in parts]]),
        names,
        int(length.min()) if len(length) else 1,
    )


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of each range [begin, end), and the range of each."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[which], which


def occurrences(h: np.ndarray, first: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word index, phrase) of every occurrence in a shard's words."""
    none = np.zeros(0, np.int64)
    if not len(h) or not len(p.ids):
        return none, none
    ids = p.vocabulary(h) + 1
    # maximal stretches of known words inside one document
    known = ids > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    cut = first[:-1][first[:-1] < len(h)]
    begins[cut] = known[cut]
    begins = np.flatnonzero(begins)
    if not len(begins):
        return none, none
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    cut = first[1:][first[1:] > 0] - 1
    stop[cut] = known[cut]
    stops = np.flatnonzero(stop) + 1
    long_ = stops - begins >= p.shortest
    begins, stops = begins[long_], stops[long_]
    if not len(begins):
        return none, none
    at, run = _spread(begins, stops + 1)  # one more each for the separator
    symbols = np.where(at < stops[run], ids[np.minimum(at, len(h) - 1)], 0)
    index = FMIndex(symbols, len(p.vocabulary.keys))
    low, high = index.search(p.ids, p.offsets)
    rows, phrase = _spread(low, high)
    return at[index.locate(rows)], phrase


def scan_shard(data: np.ndarray, offsets: np.ndarray, blocks: Iterable[Phrases]) -> dict[str, list]:
    """Per document: n_words, n_hit, items (sorted), spans (byte offsets of the
    merged hits: start, end, start, end, ...)."""
    n = len(offsets) - 1
    low = textvec.lower_ascii(data)
    starts, ends, first = textvec.words(low, offsets, GAP)
    h = textvec.span_hashes(low, starts, ends)
    word_doc = np.repeat(np.arange(n), np.diff(first))
    cover = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    for p in blocks:
        at, phrase = occurrences(h, first, p)
        if not len(at):
            continue
        end = at + np.diff(p.offsets)[phrase]
        cover += np.bincount(at, minlength=len(h) + 1) - np.bincount(end, minlength=len(h) + 1)
        pair = np.unique(np.stack([word_doc[at], phrase]), axis=1)
        own, which = _spread(p.owner_offsets[pair[1]], p.owner_offsets[pair[1] + 1])
        for d, k in np.unique(np.stack([pair[0][which], p.owners[own]]), axis=1).T.tolist():
            items[d].add(p.names[k])
    out: dict[str, list] = {"n_words": np.diff(first).tolist(), "items": [sorted(x) for x in items]}
    hit = np.cumsum(cover)[:-1] > 0
    docs = word_doc[hit]
    out["n_hit"] = np.bincount(docs, minlength=n).tolist()
    lists: list[list[int]] = [[] for _ in range(n)]
    where = np.flatnonzero(hit)
    if len(where):
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1] + 1) | (docs[1:] != docs[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)
        for d, a, b in zip(docs[new].tolist(), (starts[where[new]] - offsets[docs[new]]).tolist(), (ends[where[last]] - offsets[docs[new]]).tolist(), strict=True):
            lists[d] += [a, b]
    out["spans"] = lists
    return out


FIELDS = "n_words bigint, n_hit bigint, items array<string>, spans array<bigint>"
_TYPES = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.int64())}


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 8, key: str = "doc_id", text: str = "text", item: str = "item_id", keep: tuple[str, ...] = (), clean: bool = False) -> DataFrame:
    """key, `keep` and FIELDS of each row of `docs`.  clean: also `cleaned`, the
    text without occurrences of windows (of an item shorter than a window: of
    the whole item), cut until none is left."""
    blocks, block, size = [], [], 0
    for r in benchmark.select(item, "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= BLOCK_CHARS:
            blocks.append(docs.sparkSession.sparkContext.broadcast(phrases(block, window)))
            block, size = [], 0
    blocks.append(docs.sparkSession.sparkContext.broadcast(phrases(block, window)))
    own = [f.split()[0] for f in FIELDS.split(", ")]
    rows = base.packed(docs, [key, text], keep, [key, *own, *["cleaned"] * clean])

    def run(texts: pa.Array) -> list[pa.Array]:
        data, offsets = textvec.text_buffer(texts)
        parts: dict[str, list[pa.Array]] = {c: [] for c in [*_TYPES, *["cleaned"] * clean]}
        for i, j in textvec.chunks(offsets, SHARD_BYTES):
            got = scan_shard(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _one_by_one(blocks))
            for c, t in _TYPES.items():
                parts[c].append(pa.array(got[c], t))
            if clean:
                parts["cleaned"].append(_cleaned(texts.slice(i, j - i), got["spans"], blocks))
        types = [*_TYPES.values(), *[pa.string()] * clean]
        return [pa.concat_arrays([pa.array([], t), *p]) for t, p in zip(types, parts.values(), strict=True)]

    out = base.measured(rows, text, run, FIELDS + ", cleaned string" * clean, "__found")
    fields = [F.col(f"__found.{c}").alias(c) for c in own]
    if clean:  # only texts that changed come back
        fields.append(F.coalesce("__found.cleaned", F.col(f"`{text}`")).alias("cleaned"))
    return out.select(F.col(f"`{key}`"), *base.unpacked(keep), *fields)


def _one_by_one(shared: list) -> Iterator[Phrases]:
    """Blocks of a large benchmark are loaded from the worker's broadcast files and let go again."""
    for b in shared:
        yield b.value
        if len(shared) > 1:
            b.__dict__.pop("_value", None)


def _cleaned(texts: pa.Array, cuts: list[list[int]], shared: list) -> pa.Array:
    """The texts that hits are cut from; null for those without."""
    out: list[str | None] = [None] * len(cuts)
    for k, left in enumerate(cuts):
        raw = texts[k].as_py().encode() if left else b""
        while left:
            ends = [0, *left, len(raw)]
            raw = b" ".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            out[k] = raw.decode()
            data, offsets = textvec.text_buffer(pa.array([out[k]]))
            left = scan_shard(data, offsets, _one_by_one(shared))["spans"][0]
    return pa.array(out, pa.string())
