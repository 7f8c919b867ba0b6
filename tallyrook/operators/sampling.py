"""Samples of exact sizes, repeatable by a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrook.operators.prep import numbered, seeded


def subset(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer."""
    return df.orderBy(seeded(seed, F.col(key)), key).limit(n)


def per_class(df: DataFrame, n: int, key: str, label: str = "vul", seed: int = 7) -> DataFrame:
    """n rows of each class, the larger label first; each partition passes on
    its first n of a class only."""
    place = F.row_number().over(W.partitionBy(label).orderBy(seeded(seed, F.col(key)), key))
    return df.withColumn("rank", place).where(F.col("rank") <= n).orderBy(F.desc(label), "rank")


def _uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that any engine can repeat."""
    return F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def weighted_draw(df: DataFrame, key: str, label: str = "vul", n: int | None = None, seed: int = 42) -> DataFrame:
    """n rows (as many as `df` has) drawn with replacement, each class equally
    likely: a class per draw, a place in the class, an equi join on both."""
    counts = df.groupBy(label).agg(F.count("*").alias("size"))
    classes = counts.withColumn("k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(label)) - 1)  # a row per class
    sizes = counts.agg(F.count("*").alias("many"), F.sum("size").alias("rows")).first()
    rows = (sizes["rows"] or 0) if n is None else n
    draws = df.sparkSession.range(rows).select(
        F.col("id").alias("draw"), F.floor(_uniform(seed, F.col("id")) * sizes["many"]).cast("int").alias("k"), _uniform(seed + 1, F.col("id")).alias("u")
    )
    placed = draws.join(F.broadcast(classes), "k").select("draw", label, (F.floor(F.col("u") * F.col("size")) + 1).cast("long").alias("rank"))
    return placed.join(numbered(df, label, seeded(seed, F.col(key))), [label, "rank"]).drop("rank")
