"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns the columns of `documents` (the last: token ids); its decisions take
effect.  Columns beside doc_id, text and lang are carried along untouched,
whatever their names; n_chars follows the text.

Empty tables give empty results.  Null texts have no words, so the rules reject
them; null ids stay until a rule or the classifier rejects their text.  Texts
are read whole in every stage, however long they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.llm import decontaminate, jaccard, pieces, quality, rules
from tallyrook.llm.base import dropped, fold, restricted_rows, saved, table
from tallyrook.llm.queries import THRESHOLD, vocabulary

#: Near copies: five-word shingles, similarity 0.8 or more.
LIKE = jaccard.Likeness(size=5, num=80, den=100)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and, out of the way of any name, the whole row."""
    return docs.select("doc_id", "lang", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def _rows(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = rules.apply(_named(docs), table(spark, sf_dir, "labels"), keep=("__row",))
    return _rows(judged.where("kept"), docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from all labelled documents: the rules before may have taken every
    document of one class."""
    documents = table(spark, sf_dir, "documents")
    scored = quality.classify(_named(docs), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0, keep=("__row",), learn_from=documents)
    return _rows(scored.where(F.col("score") >= THRESHOLD), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest id stays.  Rows
    that repeat an id are judged each by its own text; of equal rows one stays."""
    known = docs.where("doc_id is not null")
    twice = saved(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        groups = jaccard.join(docs, LIKE)
        gone = saved(groups.where("doc_id != component_id").select("doc_id").distinct(), "gone")
        return restricted_rows(docs, gone, "left_anti")
    key = "__key"
    while key in docs.columns:
        key += "_"
    rows = saved(known.withColumn(key, F.monotonically_increasing_id()), "keyed")
    groups = jaccard.join(rows.select(F.col(key).alias("doc_id"), "text"), LIKE).select(F.col("doc_id").alias(key), "component_id")
    order = rows.select(key, F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"))
    first = groups.join(order, key).groupBy("component_id").agg(F.min(F.struct("__id", "__text", key)).alias("__first"))
    first = saved(first.select(F.col(f"__first.{key}").alias(key)), "first")
    return rows.join(first, key, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark windows, and of items shorter than a window, are
    cut out of the texts."""
    found = decontaminate.scan(_named(docs), table(spark, sf_dir, "benchmark"), window=8, keep=("__row",), clean=True)
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"), keep=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_ids),
]

#: The classifier's fit and the token ids can't be written in SQL; the tests
#: compare each stage's rows with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, saved(stage(spark, docs, sf_dir), name)
        dropped(last)  # but for the given table
    return STAGES[-1][1](spark, docs, sf_dir)
