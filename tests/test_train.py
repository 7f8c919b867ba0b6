"""How often the substitute classifier computes what it reads."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tallyrook.operators import prep, train


def counted(spark, rows, column):
    """`rows` with `column` passed through a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return rows.withColumn(column, F.udf(same, "string")(F.col(column))), calls


def test_fit_computes_each_text_once(spark):
    rows = spark.createDataFrame([(k % 2, f"{'strcpy' if k % 2 else 'return'} a{k % 5}") for k in range(40)], "vul int, func_before string")
    once, calls = counted(spark, rows, "func_before")
    model = train.fit(once, features=64, iterations=5)
    assert calls.value == 40
    assert isinstance(model, PipelineModel) and len(model.stages) == 4
    scored = train.scorer(model, key="k", code="c")(spark.createDataFrame([(1, "strcpy a1"), (2, "return a1")], "k int, c string"))
    assert {r["k"]: r["label"] for r in scored.collect()} == {1: 1, 2: 0}


def test_kept_tables_are_computed_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prep, "_folder", lambda _: f"file://{tmp_path}")
    once, calls = counted(spark, spark.range(30).select("id", F.col("id").cast("string").alias("name")), "name")
    kept = prep.kept(once)
    assert kept.count() == 30 and kept.where("name = id").count() == 30 and kept.dtypes == once.dtypes
    assert calls.value == 30
    assert list(tmp_path.iterdir())
    prep.released(kept)
    assert not list(tmp_path.iterdir())
