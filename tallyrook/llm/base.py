"""What the operators share: reading tables, shared storage, shipping the package."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest number of rows of narrow keys that may be broadcast; beyond it the
#: operators join by shuffle instead.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that go to a Python worker at once: texts can be long, and an
#: executor's memory holds a batch several times.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run, and
    bound their batches unless the session already does."""
    sc = spark.sparkContext
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if getattr(sc, "_tallyrook_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    to = tempfile.mkdtemp()
    stage = Path(to) / "stage"
    shutil.copytree(root / "tallyrook", stage / "tallyrook", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(to, "tallyrook_pkg"), "zip", stage))
    shutil.rmtree(stage)
    atexit.register(shutil.rmtree, to, ignore_errors=True)
    sc._tallyrook_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one
    of our own where that is unset and everything runs on one machine; on a
    cluster a local folder would lose rows, so there it must be set."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="tallyrook-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Removes a query's shuffle files when the query ends, instead of when the
#: driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives
    lost executors."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyrook_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by `saved` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tallyrook_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Hand memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def trimming(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """`run`, and at the end of a task what it freed goes back: workers stay for
    later stages and would hold what their largest kernel took."""

    def whole(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def measured(docs: DataFrame, text: str, kernel: Callable[[pa.Array], list[pa.Array]], ddl: str, name: str) -> DataFrame:
    """`docs` with the struct column `name`, whose fields (`ddl`) `kernel` makes
    of the text column, an Arrow batch at a time.  Only the texts go to Python
    and only the struct comes back; all other columns stay in the JVM.  The
    kernel runs once per row, whatever is selected or filtered later."""
    if name in docs.columns:
        raise ValueError(f"the column name {name} is taken")
    ship(docs.sparkSession)
    fields = [f.name for f in T.StructType.fromDDL(ddl)]

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with np.errstate(over="ignore"):
            for batch in texts:
                yield pa.StructArray.from_arrays(kernel(batch), names=fields)

    def task(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:  # arrow_udf goes by the types
        yield from trimming(run)(texts)

    made = F.arrow_udf(task, ddl).asNondeterministic()  # so that no filter repeats it
    return docs.withColumn(name, made(F.col(f"`{text}`").cast("string")))


def packed(docs: DataFrame, names: Sequence[str], keep: Sequence[str], own: Iterable[str]) -> DataFrame:
    """`docs` with `names` and, out of the way of any other name, the columns
    of `keep` in one struct.  own: columns of the result; a column to keep that
    is called like one of them is an error."""
    clash = sorted(set(keep) & set(own)) or sorted({c for c in keep if list(keep).count(c) > 1})
    if clash:
        raise ValueError(f"columns to keep clash with those of the result: {', '.join(clash)}")
    return docs.select(*[F.col(f"`{c}`") for c in names], F.struct(F.lit(None).cast("int").alias("__none"), *[F.col(f"`{c}`") for c in keep]).alias("__keep"))


def unpacked(keep: Sequence[str]) -> list[Column]:
    return [F.col(f"__keep.`{c}`").alias(c) for c in keep]


def fold(key: Column, mod: int) -> Column:
    return F.crc32(key.cast("string")) % mod


def labelled_sample(labels: DataFrame, label: str, training: Column, limit: int) -> DataFrame:
    """(doc_id, y) of at most `limit` labelled training rows, chosen by a hash
    of doc_id, so the same at every run; rows with a null id or label go, of
    rows that repeat an id the largest label stays."""
    rows = labels.where(training & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    kind = labels.schema["doc_id"].dataType.simpleString()
    return labels.sparkSession.createDataFrame([(r[0], r[1]) for r in ids], f"doc_id {kind}, y int")


def restricted_rows(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """`docs` whose id is (left_semi) or isn't (left_anti) in `ids`; the ids are
    broadcast if they are few, else both sides shuffle.  Null ids are in none."""
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)
