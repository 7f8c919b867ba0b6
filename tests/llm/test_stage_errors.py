"""Errors that the classifier's code and odd rows of the join would end a stage with."""

import pytest
from pyspark.sql import functions as F

from tallyrook.llm import jaccard, quality

WORDS = " ".join(f"w{k}" for k in range(60))


def test_code_of_a_filter_on_the_score_compiles(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(WORDS), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int"))).alias("text"))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    key = "spark.sql.codegen.fallback"
    spark.conf.set(key, "false")
    try:
        scored = quality.classify(docs, labels, F.lit(True), keep=("text",))
        assert scored.where(F.col("score") >= 0.0).select("text").count() == len(scored.where(F.col("score") >= 0.0).collect()) == 40
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("empty", [None, "", " "])
def test_a_repeated_id_with_an_empty_text(spark, empty):
    other = WORDS.upper() + " end"
    docs = spark.createDataFrame([(1, WORDS), (2, other), (2, empty), (1, empty), (3, "nothing like the others at all")], "doc_id long, text string")
    got = {(r[0], r[2]) for r in jaccard.join(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


def test_empty_texts_link_nothing(spark):
    texts = [(1, WORDS + " a b c d e f g"), (2, WORDS + " q r s t u v w"), (1, None), (2, None)]  # 57 of 71 shingles
    got = {(r[0], r[2]) for r in jaccard.join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2)}
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    assert jaccard.verified(pair, spark.createDataFrame(texts, "doc_id long, text string"), jaccard.Likeness()).count() == 0


def test_sizes_of_very_long_texts(spark):
    rows = spark.createDataFrame([(7, 1, 30_000_000), (7, 2, 28_000_000), (7, 3, 20_000_000)], "token long, doc_id long, n int")
    assert [tuple(r) for r in jaccard.small_group_pairs(rows, jaccard.Likeness()).collect()] == [(1, 2)]
