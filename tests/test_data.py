"""Preparation, sampling, metrics, and the queries against DuckDB."""

import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyrook.operators import eda, evaluate, prep, sampling
from tallyrook.plans import catalog

DATA = "/root/testdata/sf0.001"


def comparable(rows, names):
    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE:
        assert rows
        return
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = db.sql(catalog.ORACLE[name])
    assert sorted(expected.columns) == sorted(df.columns)
    assert comparable(rows, df.columns) == comparable(expected.fetchall(), expected.columns)


def test_dedupe_keeps_first_and_null_differs_from_empty(spark):
    rows = [(1, 0, "a"), (0, 5, "a"), (0, 4, "a"), (2, 0, ""), (2, 1, None), (2, 2, None)]
    df = spark.createDataFrame(rows, "split_ord int, row_ord long, func_before string")
    got = {tuple(r) for r in prep.dedupe_first(df).collect()}
    assert got == {(0, 4, "a"), (2, 0, ""), (2, 1, None)}


def test_running_mean_over_ranges(spark):
    rng = random.Random(2)
    rows = [(k, k % 3, rng.random() if k % 7 else None) for k in range(900)]
    got = {(r["k"]): r["running_mean"] for r in eda.running_mean(spark.createDataFrame(rows, "k long, g int, v double"), "v", "k", "g").collect()}
    for g in range(3):
        seen = []
        for k, own, v in rows:
            if own == g:
                seen += [v] if v is not None else []
                assert (got[k] is None and not seen) or abs(got[k] - sum(seen) / len(seen)) < 1e-12


def test_union_numbers_rows(spark):
    from tallyrook.sources import datasets

    out = datasets.union_splits([spark.range(5), spark.range(7)])
    assert out.select("split_ord", "row_ord").distinct().count() == 12 and out.columns == ["id", "split_ord", "row_ord"]


def test_latency_counts_after_a_warm_up():
    calls = []
    assert evaluate.mean_ms(lambda: calls.append(1), 5) >= 0 and len(calls) == 6


def test_split_is_exact_disjoint_and_repeatable(spark):
    df = spark.range(997).select(F.col("id").alias("k"), F.when(F.col("id") % 13 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise("c").alias("strata"))
    out = prep.split(df, "k").cache()
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 797, "validation": 100, "test": 100}
    assert out.select("k").distinct().count() == 997
    assert out.exceptAll(prep.split(df.repartition(3), "k")).count() == 0


def test_weighted_draw_is_exact_and_balanced(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 20 == 0).cast("int").alias("vul"))
    out = sampling.weighted_draw(df, "k")
    assert out.count() == 1000
    assert 400 < out.where("vul = 1").count() < 600


def test_auc_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    got = evaluate.roc_auc(spark.createDataFrame(rows, "label int, probability double")).first()[0]
    assert abs(got - want) < 1e-12
    assert math.isnan(evaluate.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, probability double")).first()[0])


def test_metrics_without_positives(spark):
    r = evaluate.metrics(spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_agreement_gate(spark):
    with pytest.raises(AssertionError):
        evaluate.check_agreement(spark.createDataFrame([(0, 1), (1, 1)], "a int, b int"))


def test_histogram_of_one_value(spark):
    got = eda.histogram(spark.createDataFrame([(3,), (3,)], "x int"), F.col("x")).collect()
    assert [(r["bin"], r["n"]) for r in got] == [(31, 2)]


def test_missing_text_reads_as_text(spark):
    df = spark.createDataFrame([(None,), ("  ",), (" a ",)], "func_before string")
    assert sorted(r[0] for r in prep.nonempty(df).collect()) == ["None", "a"]
