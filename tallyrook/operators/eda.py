"""Aggregates that describe a labelled data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLIP = 5000


def value_counts(df: DataFrame, column: str, share: bool = False) -> DataFrame:
    """Non-null values with n, most frequent first; share: also the part of all."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if share:
        out = out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))
    return out.orderBy(F.desc("n"), column)


def class_balance(df: DataFrame, label: str = "vul") -> DataFrame:
    named = F.when(F.col(label) == 1, "vulnerable").when(F.col(label) == 0, "not vulnerable")
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("name", named).orderBy(label)


def imbalance(df: DataFrame, label: str = "vul") -> DataFrame:
    zero, one = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(zero.alias("n0"), one.alias("n1"), F.try_divide(zero, one).alias("ratio"))


def describe(df: DataFrame, value: Column) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return out.select("count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def histogram(df: DataFrame, value: Column, bins: int = 60, clip: int = CLIP) -> DataFrame:
    """(bin from 1, n) over equal widths from the least to the largest clipped
    value; the last bin is closed.  Empty bins have no row."""
    rows = df.select(F.least(value, F.lit(clip)).cast("double").alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2 + 1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)))
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


def top_cwe(df: DataFrame, k: int = 15) -> DataFrame:
    return df.where((F.col("vul") == 1) & F.col("cwe_id").isNotNull()).groupBy("cwe_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cwe_id").limit(k)


def split_balance(df: DataFrame, label: str = "vul") -> DataFrame:
    zero, one = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.groupBy("split").agg(zero.alias("n0"), one.alias("n1"), F.try_divide(zero, one).alias("ratio"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def head(df: DataFrame, order: tuple[str, ...], n: int = 5) -> DataFrame:
    """The first n rows by `order`."""
    return df.orderBy(*order).limit(n)


#: Ranges that a running mean is cut into.
RANGES = 200


def running_mean(df: DataFrame, value: str, order: str, group: str) -> DataFrame:
    """`df` with the mean of `value` over the group's rows up to this one by
    the numeric column `order`.  Rows are cut into ranges of `order`; what lies
    before a range comes from sums per range, so no task holds a whole group."""
    bounds = sorted(set(df.approxQuantile(order, [k / RANGES for k in range(1, RANGES)], 0.002)))
    rows = df.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>"), lambda x: x < F.col(order))))
    sums = rows.groupBy(group, "__b").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    before = W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # RANGES rows a group
    starts = sums.select(group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"))
    inside = W.partitionBy(group, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumns({"__s": F.sum(value).over(inside), "__n": F.count(value).over(inside)}).join(starts, [group, "__b"])
    mean = F.try_divide(F.coalesce("__s", F.lit(0.0)) + F.col("__s0"), F.col("__n") + F.col("__n0"))
    return out.select(*df.columns, mean.alias("running_mean"))
