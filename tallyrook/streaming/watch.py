"""The scan over files as they arrive.

Findings need no state: every file is judged alone, so there is no watermark
and a restart only repeats the files of its last batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyrook.functions.text import decode_utf8
from tallyrook.operators.verdict import analyze
from tallyrook.sources.files import SUFFIXES


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """code_id (the path) and code of files arriving in `folder`."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    kept = raw.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES))
    return kept.select(F.col("path").alias("code_id"), decode_utf8(F.col("content")).alias("code"))


def watch(spark: SparkSession, folder: str, scorer: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `analyze` on every batch and gives the results to `sink`."""
    return (
        stream(spark, folder)
        .writeStream.foreachBatch(lambda df, n: sink(analyze(df, scorer), n))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
