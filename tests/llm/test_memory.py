"""What workers hand back when a task ends."""

import pytest
from pyspark.sql import functions as F

from tallyrook.llm import base, docstats, jaccard


def test_trimming_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(base, "trim", lambda: calls.append(1))
    double = base.trimming(lambda batches: (2 * b for b in batches))
    assert list(double([1, 2])) == [2, 4] and calls == [1]
    begun = double([1, 2])
    next(begun)
    begun.close()  # a limit ends a task early
    assert calls == [1, 1]

    def fails(batches):
        yield from batches
        raise ValueError

    with pytest.raises(ValueError):
        list(base.trimming(fails)([1]))
    assert calls == [1, 1, 1]
    monkeypatch.undo()
    base.trim()


def test_kernels_give_the_same_rows(spark):
    docs = spark.range(2500, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d e f"), (F.col("id") % 7).cast("string")).alias("text"))
    got = docstats.counted(docs).groupBy("n_words").count().collect()
    assert [tuple(r) for r in got] == [(7, 2500)]
    prints = jaccard.fingerprints(docs, jaccard.Likeness())
    assert prints.count() == 2500 and prints.select("fa", "fb").distinct().count() == 7
