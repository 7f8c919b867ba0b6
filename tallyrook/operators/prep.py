"""Cleaning, first-row dedupe, exact splits and class weights."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrook.functions import text

# Language names, as found and as kept.
LANGUAGES = {"C": "C", "CPP": "C++", "C++": "C++"}
#: What a missing function reads as.
MISSING = "None"


def normal_language(lang: Column) -> Column:
    """The language's common name; null if it has none here."""
    pairs = [F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)]
    return F.create_map(*pairs)[lang]


def keep_languages(df: DataFrame, column: str = "lang") -> DataFrame:
    raw = df.where(F.col(column).isin(*LANGUAGES))  # on the raw column, so that it reaches the scan
    return raw.withColumn(column, normal_language(F.col(column)))


def clean_text(column: Column, missing: str | None = MISSING) -> Column:
    """Stripped; null becomes the text `missing` (None: stays null)."""
    return text.strip(column if missing is None else F.coalesce(column, F.lit(missing)))


def nonempty(df: DataFrame, column: str = "func_before") -> DataFrame:
    return df.withColumn(column, clean_text(F.col(column))).where(F.length(column) > 0)


def digest(column: str) -> Column:
    """Tells texts apart, null from empty, in 64 characters."""
    return F.concat(F.sha2(F.coalesce(column, F.lit("")), 256), F.col(column).isNull().cast("int").cast("string"))


def dedupe_first(df: DataFrame, column: str = "func_before", order: tuple[str, ...] = ("split_ord", "row_ord")) -> DataFrame:
    """The first row, by `order`, of each text; `order` must tell rows apart.
    A minimum per digest, combined before the shuffle, so a text of very many
    rows stays cheap; rows meet the minima by a semi join."""
    rows = df.withColumn("__digest", digest(column))
    first = rows.groupBy("__digest").agg(F.min(F.struct(*order)).alias("__first")).select("__digest", *[F.col(f"__first.`{c}`").alias(c) for c in order])
    return rows.join(first, ["__digest", *order], "left_semi").select(*df.columns)


def duplicates(df: DataFrame, column: str = "func_before") -> DataFrame:
    n, unique = F.count("*"), F.count_distinct(F.sha2(column, 256))
    return df.agg(n.alias("n"), unique.alias("n_unique"), (n - unique).alias("n_duplicates"), F.try_divide((n - unique) * 100.0, n).alias("percent"))


def strata(vul: Column, lang: Column) -> Column:
    return F.concat_ws("_", vul.cast("string"), lang)


def seeded(seed: int, key: Column) -> Column:
    """A shuffled order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def numbered(df: DataFrame, group: str, order: Column, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 by `order` (a hex hash) inside each group.  Groups
    are cut into ranges of the hash; a range's first number comes from counts,
    so no task holds a whole group."""
    rows = df.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, 3))
    sizes = rows.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(group, "__b", before.alias("__before"))
    inside = F.row_number().over(W.partitionBy(group, "__b").orderBy("__o"))
    return rows.withColumn("__r", inside).join(starts, [group, "__b"]).withColumn(name, F.col("__r") + F.col("__before")).drop("__o", "__b", "__r", "__before", "__n")


def quotas(counts: DataFrame, fraction: float, group: str = "strata", n: str = "n") -> DataFrame:
    """Rows of each group that stay when `fraction` of all is taken away:
    shares rounded down, the rest to the largest remainders (ties by name).
    `counts` has a row per group."""
    everything = W.partitionBy(F.lit(0))
    total = F.sum(n).over(everything)
    rows = counts.withColumn("__keep", (total - F.ceil(total * fraction)).cast("long")).withColumn("__total", total)
    rows = rows.withColumn("__base", F.expr(f"(`__keep` * `{n}`) div `__total`")).withColumn("__rest", F.expr(f"(`__keep` * `{n}`) % `__total`"))
    rows = rows.withColumn("__need", F.col("__keep") - F.sum("__base").over(everything))
    rows = rows.withColumn("__place", F.row_number().over(everything.orderBy(F.desc("__rest"), group)))
    return rows.withColumn("quota", (F.col("__base") + (F.col("__place") <= F.col("__need")).cast("long"))).drop("__keep", "__total", "__base", "__rest", "__need", "__place")


def _folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, if one is set."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return given.rstrip("/") if given else None


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """A table that is read several times, computed once: written to the folder
    for checkpoints where one is set (a checkpoint itself would compute it
    twice), else persisted (recomputed if an executor is lost)."""
    spark = df.sparkSession
    folder = _folder(spark)
    if not folder:
        return df.persist()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyrook_path = path
    return out


def released(df: DataFrame) -> None:
    """Let go of a table made by `kept` that nothing reads any more."""
    path = getattr(df, "_tallyrook_path", None)
    if path is None:
        df.unpersist()
        return
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def split(df: DataFrame, key: str, group: str = "strata", test: float = 0.2, seed: int = 42) -> DataFrame:
    """`df` with split: train, then validation and test as halves of the rest,
    each with its exact share of every group.  Only keys and groups are counted
    and numbered; whole rows join once."""
    ids = kept(df.select(key, group))
    counts = ids.groupBy(group).agg(F.count("*").alias("n"))
    first = quotas(counts, test, group).withColumnRenamed("quota", "n_train")
    second = quotas(first.select(group, "n_train", (F.col("n") - F.col("n_train")).alias("n")), 0.5, group)
    cut = F.broadcast(second.select(group, "n_train", (F.col("n_train") + F.col("quota")).alias("n_upto")))  # a row per group
    rows = numbered(ids, group, seeded(seed, F.col(key))).join(cut, group)
    said = F.when(F.col("rank") <= F.col("n_train"), "train").when(F.col("rank") <= F.col("n_upto"), "validation").otherwise("test")
    return df.join(rows.select(key, said.alias("split")), key)


def class_weights(df: DataFrame, label: str = "vul") -> DataFrame:
    """(vul, weight): all rows over twice the class's."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return counts.select(label, (total / (F.lit(2.0) * F.col("n"))).alias("weight"))


def leaks(splits: DataFrame, column: str = "func_before") -> DataFrame:
    """Number of texts that stand in more than one split."""
    per_text = splits.groupBy(F.sha2(column, 256).alias("h")).agg(F.count_distinct("split").alias("k"))
    return per_text.agg(F.count_if(F.col("k") > 1).alias("n_leaks"))
