"""Source files of a folder tree as a DataFrame.

Spark's own file sources skip names that start with a dot or underscore, so a
folder on a local or mounted path is listed on the driver (names only) and read
by the executors; any other store goes through Spark's binary reader.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.functions.text import decode_utf8

# Scanned suffixes and folders that are left out.
SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".hxx")
EXCLUDED = (".venv", "venv", ".git", "node_modules", "__pycache__", "build", "dist")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of every source file below `folder`, in path-part order."""
    root = Path(folder)
    found = []
    for at, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d not in EXCLUDED]
        found += [str(Path(at) / n) for n in names if Path(n).suffix.lower() in SUFFIXES]
    if set(root.parts) & set(EXCLUDED):
        found = []
    found.sort(key=lambda p: Path(p).parts)
    return spark.createDataFrame([(p,) for p in found], "path string")


def read_files(paths: DataFrame) -> DataFrame:
    """path, code, error: text with undecodable bytes replaced and line ends
    made \\n; an unreadable file has a null code and the error's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    content, error = Path(path).read_bytes(), None
                except OSError as e:
                    content, error = None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    return paths.select("path").mapInArrow(run, "path string, content binary, error string").select("path", decode_utf8(F.col("content")).alias("code"), "error")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """path, code, error of a folder in any store Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kept = raw.where(suffix.isin(*SUFFIXES) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED])))
    return kept.select("path", decode_utf8(F.col("content")).alias("code"), F.lit(None).cast("string").alias("error")).orderBy(F.split("path", "/"))


def literal(spark: SparkSession, codes: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(codes)), "code_id long, code string")
