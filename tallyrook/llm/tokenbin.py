"""Token-id files: documents in ascending id order, coded by `mixcoder`.

Writing sorts the documents over range partitions, encodes whole texts, appends
an end id to each and writes segments of whole documents.  A file is Parquet
(any store Spark writes to) with one row per segment: the partition, the number
of ids before the segment in it, the documents' ids and lengths (deflated) and
the coded body of `mixcoder`, whose blocks are reset and checksummed one by one.
Reading decodes segments independently; only the partitions' totals, one number
each, pass through the driver.  A damaged block is an error, or with `recover`
costs only the documents that touch it.

Null and empty texts are the end id alone.  Null document ids come first.  Rows
that repeat an id are ordered by text; an id that very many rows repeat is
split over partitions by the beginnings of the texts.  No rows give no segment.
Other columns are ignored, whatever their names.  A text is encoded in whole,
however long it is, and never split over segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.llm import base, mixcoder, textvec
from tallyrook.llm.wordids import chunk_encoder

#: Ids per segment, about; one document is never split.
SEGMENT_IDS = 4 << 20
_NO_ID = -(1 << 63)
SCHEMA = "part int, segment int, first long, n_docs int, n_ids long, doc_ids binary, lengths binary, body binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    base.ship(docs.sparkSession)
    ordered = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = chunk_encoder(vocabulary)
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        keys: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        coded: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            nonlocal segment, before
            flat, ids, sizes = np.concatenate(coded), np.concatenate(keys), np.concatenate(lengths)
            values = [part, segment, before, len(ids), len(flat), zlib.compress(ids.astype("<i8").tobytes()), zlib.compress(sizes.astype("<u8").tobytes()), mixcoder.encode(flat)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            segment, before = segment + 1, before + len(flat)
            for x in (keys, lengths, coded):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        with np.errstate(over="ignore"):
            for batch in batches:
                own = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                data, offsets = textvec.text_buffer(batch.column(1))
                for i, j in textvec.chunks(offsets):
                    ids, ends = encoder.encode_buffer(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    ends = ends + np.arange(1, j - i + 1)  # each text's end id included
                    flat = np.empty(len(ids) + j - i, np.uint32)
                    is_end = np.zeros(len(flat), bool)
                    is_end[ends - 1] = True
                    flat[is_end], flat[~is_end] = end_id, ids
                    keys.append(own[i:j])
                    lengths.append(np.diff(ends, prepend=0))
                    coded.append(flat)
                    if sum(map(len, coded)) >= SEGMENT_IDS:
                        yield row()
            if coded:
                yield row()

    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = False, recover: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, the ids themselves.  recover: documents that touch a damaged
    block have a null ids_crc32 (and ids) instead of failing the read."""
    base.ship(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a number per partition
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part] = total
        total += totals[part]
    shared = spark.sparkContext.broadcast(starts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for k in range(batch.num_rows):
                    part, first, keys, lengths, body = (batch.column(c)[k].as_py() for c in range(5))
                    n = np.frombuffer(zlib.decompress(lengths), "<u8").astype(np.int64)
                    keys = np.frombuffer(zlib.decompress(keys), "<i8")
                    ends = np.cumsum(n)
                    try:
                        flat, good = mixcoder.decode_blocks(body)
                    except (ValueError, zlib.error):
                        if not recover:
                            raise
                        flat, good = np.zeros(n.sum(), np.uint32), np.zeros(n.sum(), bool)
                    if not recover and not good.all():
                        raise ValueError(f"damaged blocks in part {part}")
                    lost = np.add.reduceat(~good, ends - n) > 0
                    data = memoryview(flat.astype("<u4").tobytes())
                    sums = [zlib.crc32(data[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                    columns = [pa.array(keys, mask=keys == _NO_ID), pa.array(ends - n + first + shared.value[part]), pa.array(n), pa.array(np.array(sums, np.int64), mask=lost)]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat.astype(np.int64)), mask=pa.array(lost)))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select("part", "first", "doc_ids", "lengths", "body").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))
