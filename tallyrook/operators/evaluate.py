"""Metrics of binary predictions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(scores: DataFrame, by: tuple[str, ...] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """accuracy, precision, recall and f1 of class 1, 0 where undefined."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    sums = scores.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(*by, "accuracy", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(scores: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Area under the curve by ranks of distinct probabilities (ties share a
    rank); NaN with one class only.

    The running count is over distinct probabilities in ranges, each range's
    start from range totals, so that no task orders all of them."""
    per = scores.groupBy(probability).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    per = per.withColumn("range", F.floor(F.col(probability) * 4096).cast("int"))
    ranges = per.groupBy("range").agg(F.sum("n").alias("m"))
    starts = ranges.select("range", F.coalesce(F.sum("m").over(W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # 4097 rows at most
    inside = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy(probability).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = per.withColumn("inside", inside).join(F.broadcast(starts), "range")
    total = rows.agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * (F.col("start") + F.col("inside") + (F.col("n") + 1) / 2)).alias("r"))
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return total.select(F.when(p * q > 0, (F.col("r") - p * (p + 1) / 2) / (p * q)).otherwise(F.lit(float("nan"))).alias("roc_auc"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch with the largest f1."""
    return history.orderBy(F.desc("f1"), "epoch").limit(1)


def agreement(a: Column, b: Column) -> Column:
    return F.avg((a == b).cast("double"))


def check_agreement(pairs: DataFrame, least: float = 0.9) -> float:
    rate = pairs.agg(agreement(F.col("a"), F.col("b"))).first()[0]
    if rate is None or rate < least:
        raise AssertionError(f"labels agree on {rate} of the rows; {least} is needed")
    return rate


def mean_ms(run: Callable[[], object], n: int = 30) -> float:
    """Mean milliseconds of `run` after one warm-up."""
    run()
    began = time.perf_counter()
    for _ in range(n):
        run()
    return (time.perf_counter() - began) * 1000 / n


def learning_rate(step: Column, total: int, peak: float = 2e-5, warm: float = 0.1) -> Column:
    """Linear rise over the first part of the steps, then linear fall to 0."""
    rise = int(total * warm)
    up = F.lit(peak) * step / F.lit(float(max(1, rise)))
    down = F.lit(peak) * F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(float(max(1, total - rise))))
    return F.when(step < rise, up).otherwise(down)
