"""Quality classifier: regularised quadratic discriminant analysis.

Transformed whole-text statistics are modelled by one Gaussian per class with a
shrunk covariance.  The fit needs only sums and sums of products per class, so
Spark aggregates it; the driver factors two small matrices once (Cholesky) and
the score, a difference of Mahalanobis log densities, is a plain column
expression in Spark's generated code.

Null or empty texts have zero counts and get an ordinary score.  Null ids stay
and are scored but never train.  Rows that repeat an id are scored one by one
(and train one by one); of labels that repeat an id the largest holds.  Long
texts: see docstats.  An empty table gives no rows.  A column to keep that is
called like a result is an error, other columns may have any name.  If a class has fewer than two training rows,
every score is the share of label 1 (0.5 with no rows at all).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import base, docstats

#: Most labelled rows that a fit reads (a hash of doc_id chooses them).
TRAINING_ROWS = 20_000
SHRINKAGE = 0.05
RIDGE = 1e-3
#: Pseudo-count below every ratio: very short texts say little.
PRIOR = 20.0


def features() -> dict[str, Column]:
    c = F.col

    def share(part: Column, whole: Column) -> Column:
        return F.sqrt(part / (whole + PRIOR))

    return {
        "x_words": F.log1p(c("n_words") + PRIOR),
        "x_word_length": F.log1p((c("word_chars") + 5 * PRIOR) / (c("n_words") + PRIOR)),
        "x_symbols": share(c("n_symbols"), c("word_chars")),
        "x_dup_lines": share(c("n_dup_lines"), c("n_lines")),
        "x_repeats": share(c("n_repeat_words"), c("n_words")),
        "x_same": share(c("n_same_as_previous"), c("n_words")),
        "x_upper": share(c("n_upper"), c("n_letters")),
        "x_digits": share(c("n_digits"), c("word_chars")),
        "x_marks": share(c("n_marks"), c("word_chars")),
        "x_variety": share(c("n_words") - c("n_distinct_words"), c("n_words")),
        "x_line_words": F.log1p(c("n_words") / (c("n_lines") + 1.0)),
    }


@dataclass
class Gaussian:
    n: float
    mean: np.ndarray
    factor: np.ndarray  # inverse of the Cholesky factor of the covariance
    log_det: float  # of half the covariance, i.e. the sum of the factor's logs


@dataclass
class Model:
    names: list[str]
    classes: list[Gaussian] | None
    share: float

    def log_odds(self) -> Column:
        """log P(label 1) - log P(label 0), from the named feature columns."""
        if self.classes is None:
            p = min(max(self.share, 1e-6), 1 - 1e-6)
            return F.lit(float(np.log(p / (1 - p))))
        sides = []
        for g in self.classes:
            centred = [F.col(x) - F.lit(float(m)) for x, m in zip(self.names, g.mean, strict=True)]
            square = F.lit(0.0)
            for i in range(len(centred)):
                z = sum((F.lit(float(g.factor[i, j])) * centred[j] for j in range(1, i + 1)), F.lit(float(g.factor[i, 0])) * centred[0])
                square = square + z * z
            sides.append(F.lit(float(np.log(g.n) - g.log_det)) - square / 2)
        return sides[1] - sides[0]


def fit(stats: DataFrame, sample: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """`stats` has the counts of docstats, `sample` (doc_id, y) is bounded."""
    columns = features()
    names = list(columns)
    rows = stats.join(F.broadcast(sample), "doc_id").select("y", *[v.alias(k) for k, v in columns.items()])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = rows.groupBy("y").agg(
        F.count("*").alias("n"),
        *[F.sum(x).alias(x) for x in names],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs],
    )
    got = {r["y"]: r for r in sums.collect()}
    total = sum(r["n"] for r in got.values())
    share = got[1]["n"] / total if 1 in got else 0.0 if total else 0.5
    if any(k not in got or got[k]["n"] < 2 for k in (0, 1)):
        return Model(names, None, share)
    classes = []
    for k in (0, 1):
        r = got[k]
        n, mean = r["n"], np.array([r[x] for x in names]) / r["n"]
        second = np.zeros((len(names), len(names)))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / n
        cov = (second - np.outer(mean, mean)) * n / (n - 1)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + RIDGE * np.eye(len(names))
        low = np.linalg.cholesky(cov)
        classes.append(Gaussian(n, mean, np.linalg.inv(low), float(np.log(np.diag(low)).sum())))
    return Model(names, classes, share)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """`stats` with `score` in 0..1: the posterior of label 1.

    The features come from a generator of one row: a filter on the score stops
    there.  Pushed below plain columns it takes a copy of a feature for each of
    its uses, and such code does not compile (over 64 KB)."""
    out = stats.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in features().items()]))))
    odds = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), model.log_odds()))
    return out.withColumn("score", 1 / (1 + F.exp(-odds))).drop(*model.names)


def classify(docs: DataFrame, labels: DataFrame, training: Column, keep: tuple[str, ...] = (), limit: int = TRAINING_ROWS, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, `keep` and score of every row of `docs`; labels count only where
    `training` (over doc_id) holds.  learn_from: the documents that are labelled,
    if `docs` are what an earlier stage left of them."""
    sample = base.labelled_sample(labels, "quality", training, limit)
    known = (docs if learn_from is None else learn_from).select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    model = fit(docstats.counted(known), sample)
    rows = docstats.counted(base.packed(docs, ["doc_id", "text"], keep, ["doc_id", "score"]), keep=("__keep",))
    return scored(rows, model).select("doc_id", *base.unpacked(keep), "score")
