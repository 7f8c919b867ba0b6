"""Labelled data sets: splits in, prepared splits and weights out."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a prepared split, in order.
KEPT = ("project", "commit_id", "CWE ID", "lang", "func_before", "func_after", "vul")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_splits(splits: list[DataFrame]) -> DataFrame:
    """All rows with split_ord, the place of their split, and row_ord, a number
    that grows with a row's place in it."""
    return reduce(DataFrame.unionByName, [s.withColumns({"split_ord": F.lit(k), "row_ord": F.monotonically_increasing_id()}) for k, s in enumerate(splits)])


def write_splits(df: DataFrame, folder: str, columns: tuple[str, ...] = KEPT) -> None:
    """One folder per value of `split`, the given columns only."""
    df.select(*[F.col(f"`{c}`") for c in columns], "split").write.mode("overwrite").partitionBy("split").parquet(folder)


def read_back(spark: SparkSession, folder: str, label: str = "vul") -> DataFrame:
    """(split, label, n) of written splits, counted from the files."""
    return spark.read.parquet(folder).groupBy("split", label).agg(F.count("*").alias("n"))


def check_written(df: DataFrame, folder: str, label: str = "vul") -> None:
    """Raises if the files' counts by split and label aren't those of `df`."""
    want = {(r["split"], r[label]): r["count"] for r in df.groupBy("split", label).count().collect()}  # a row per split and label
    got = {(r["split"], r[label]): r["n"] for r in read_back(df.sparkSession, folder, label).collect()}
    if want != got:
        raise AssertionError(f"written splits differ: {got} instead of {want}")


def weights_json(weights: DataFrame) -> str:
    """{"0": w0, "1": w1} from rows (vul, weight)."""
    rows = weights.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("vul").cast("string"), "weight"))))).alias("j"))
    return json.dumps(json.loads(rows.first()["j"] or "{}"), indent=2)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(vul, weight) from such a file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("vul", "weight")).select(F.col("vul").cast("int"), "weight")
