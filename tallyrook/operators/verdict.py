"""Fusion of the layers, and the whole analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.operators.syntax import validated

THRESHOLD = 0.5


def verdict(confirmed: Column, p: Column, threshold: float = THRESHOLD) -> Column:
    likely = p >= threshold
    return F.when(confirmed & likely, "vulnerable").when(confirmed | likely, "needs_review").otherwise("likely_safe")


def analyze(code: DataFrame, scorer: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD, key: str = "code_id", column: str = "code", texts: bool = True) -> DataFrame:
    """key, code, regex_findings, confirmed_findings (arrays in scan order),
    model_prediction and verdict, for every row of `code`, also without findings.
    Nothing is shuffled but for what the scorer joins; a null text has none.
    texts: findings with match_text, the whole line for each of its matches."""
    rows = validated(code.select(key, F.col(column).alias("code")), key, "code", keep=("code",), texts=texts)
    rows = rows.withColumn("findings", F.coalesce("findings", F.array()))

    def shaped(found: Column) -> Column:
        return F.transform(found, lambda f: F.struct(*[f[c].alias(c) for c in ("rule_id", "cwe", "severity", "message", "line", "col", "match_text", "func_name") if texts or c != "match_text"]))

    scores = scorer(code).select(key, F.struct("label", "probability", "model_source").alias("model_prediction"))
    rows = rows.join(scores, key, "left")
    confirmed = F.filter("findings", lambda f: f["confirmed"])
    said = verdict(F.size(confirmed) > 0, F.col("model_prediction.probability"), threshold)
    return rows.select(key, "code", shaped(F.col("findings")).alias("regex_findings"), shaped(confirmed).alias("confirmed_findings"), "model_prediction", said.alias("verdict"))


def confirmed_rules(findings: Column) -> Column:
    return F.transform(findings, lambda f: f["rule_id"])
