"""Token counts of documents under edits, for whole tables (see `retokenize`).

A document's tree lasts as long as its leaves are kept: `trees` counts a table
once, and `counts_under_edits` takes stored leaves, encodes edited regions only
and gives the new text and leaves back for the next edits.

Null texts are empty; null ids stay; rows that repeat an id are counted one by
one; an empty table gives no rows; a long text is counted whole.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import base
from tallyrook.llm.retokenize import CountTree, cut
from tallyrook.llm.wordids import chunk_encoder

#: Characters whose leaves are counted together.
TOGETHER = 1 << 20


def _grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars < TOGETHER):
            chars += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def _leaves(texts: list[str], encoder) -> list[tuple[list[int], list[int]]]:
    """Characters and tokens of each text's blocks, counted together."""
    blocks = [cut(t) for t in texts]
    counts = iter(encoder.counts([b for own in blocks for b in own]))
    return [([len(b) for b in own], [next(counts) for _ in own]) for own in blocks]


def trees(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` with `tree`: a struct of leaf_chars and leaf_tokens."""

    def run(texts: pa.Array) -> list[pa.Array]:
        encoder, all_ = chunk_encoder(vocabulary), [t or "" for t in texts.to_pylist()]
        found = [x for i, j in _grouped(all_) for x in _leaves(all_[i:j], encoder)]
        return [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (0, 1)]

    return base.measured(docs, text, run, "leaf_chars array<int>, leaf_tokens array<int>", "tree")


def counts_under_edits(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", edits: str = "edits", tree: str | None = None, after: bool = False) -> DataFrame:
    """key, n_tokens, counts (after each edit, applied one after another),
    n_chars (at the end) and encoded_chars (encoded again for the edits).

    `edits` is an array of structs (start, end, new): replace the characters
    start..end by new; bounds outside the text are cut to it, a null new
    deletes, a null array or bound changes nothing.  tree: the column that
    `trees` made of this text; without it, or where it is null, the text is
    counted first.  after: also `text` and `tree` as they are at the end."""
    base.ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    given = F.col(f"`{tree}`") if tree else F.lit(None).cast("struct<leaf_chars:array<int>,leaf_tokens:array<int>>")
    out_names = [key, "n_tokens", "counts", "n_chars", "encoded_chars", *["text", "tree"] * after]
    list_ = pa.list_(pa.int32())

    def group(texts: list[str], todo: list[list], leaves: list[dict | None], encoder) -> list[tuple]:
        new = iter(_leaves([t for t, x in zip(texts, leaves, strict=True) if x is None], encoder))
        made = [CountTree(t, None, next(new) if x is None else (x["leaf_chars"], x["leaf_tokens"])) for t, x in zip(texts, leaves, strict=True)]
        first, counts = [m.total for m in made], [[] for _ in made]
        for step in range(max(map(len, todo), default=0)):  # the same step of all documents at once
            regions: list[tuple | None] = []
            for m, own in zip(made, todo, strict=True):
                e = own[step] if step < len(own) else None
                regions.append(None if e is None or e["start"] is None or e["end"] is None else m.region(e["start"], e["end"], e["new"] or ""))
            found = iter(encoder.counts([b for r in regions if r for b in r[2]]))
            for m, own, r, out in zip(made, todo, regions, counts, strict=True):
                if r:
                    m.put(r, [next(found) for _ in r[2]])
                if step < len(own):
                    out.append(m.total)
        return [(n, c, m.length, m.encoded_chars, *([m.text, dict(zip(("leaf_chars", "leaf_tokens"), m.leaves, strict=True))] if after else [])) for n, c, m in zip(first, counts, made, strict=True)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(vocabulary)
        types = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.struct([("leaf_chars", list_), ("leaf_tokens", list_)]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            todo = [x or [] for x in batch.column(2).to_pylist()]
            leaves = batch.column(3).to_pylist()
            rows = [r for i, j in _grouped(texts) for r in group(texts[i:j], todo[i:j], leaves[i:j], encoder)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in zip(range(len(out_names) - 1), types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=out_names)

    schema = f"`{key}` {kind}, n_tokens long, counts array<long>, n_chars long, encoded_chars long" + ", text string, tree struct<leaf_chars:array<int>,leaf_tokens:array<int>>" * after
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"), F.col(f"`{edits}`").alias("__edits"), given.alias("__tree")).mapInArrow(run, schema)
