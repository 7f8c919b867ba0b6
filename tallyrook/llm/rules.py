"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose statistic lies above a cutoff.  For each
stratum and rule the cutoffs are tried from the most lenient on a labelled
holdout; a cutoff is valid while the exact (Clopper-Pearson) upper bound of the
share of good documents it would reject stays below the limit.  Testing in
this fixed order needs no correction among cutoffs; the confidence is split
over rules and strata (Bonferroni).  A stratum with too little evidence
rejects nothing.

Null or empty texts have zero counts; they fail the base rule.  Null ids are
judged but are no evidence.  A null stratum is a stratum of its own.  Repeated
labels of one id count once (the largest); rows that repeat an id are judged
one by one, and each is evidence if the id is labelled.  A value on the cutoff
passes.  An empty table gives no rows.  A column to keep that is called like a
result is an error, other columns may have any name.  Long texts: see docstats.
Equal words, lines and windows are told by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import base, docstats

BINS = 64


@dataclass(frozen=True)
class Rule:
    name: str
    part: str
    whole: str

    def step(self, prior: float = 10.0) -> Column:
        """The statistic on a grid of BINS + 1 steps, finer near zero; `prior`
        words or characters soften the ratios of short texts."""
        ratio = F.col(self.part) / (F.col(self.whole) + prior)
        return F.least(F.lit(BINS), F.floor(F.sqrt(ratio) * BINS).cast("int"))


RULES = (
    Rule("symbols", "n_symbols", "word_chars"),
    Rule("dup_lines", "n_dup_lines", "n_lines"),
    Rule("repeats", "n_repeat_words", "n_words"),
    Rule("same_word", "n_same_as_previous", "n_words"),
    Rule("upper", "n_upper", "n_letters"),
    Rule("marks", "n_marks", "word_chars"),
)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact binomial upper bound: the largest p for which k or fewer of n have
    at least the probability delta."""
    if n == 0 or k >= n:
        return 1.0

    def cdf(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid >= 1.0:
            break
        low, high = (mid, high) if cdf(mid) > delta else (low, mid)
    return high


def choose(steps: dict[str, dict[int, int]], n: int, limit: float, share: float) -> dict[str, int]:
    """The strictest valid cutoff of each rule in one stratum; absent where
    none is.  steps: by rule, good holdout documents at each step, n in all;
    share: the chance of a wrong choice that one rule may have."""
    each, found = limit / len(RULES), {}
    for rule in RULES:
        at, above = steps.get(rule.name, {}), 0
        for cut in range(BINS - 1, -1, -1):
            above += at.get(cut + 1, 0)
            if above > n * each or upper_bound(above, n, share) > each:
                break
            found[rule.name] = cut
    return found


def thresholds(stats: DataFrame, labels: DataFrame, stratum: str, limit: float, delta: float) -> DataFrame:
    """(stratum, cuts): a cutoff or null for each of RULES, from all labelled
    good documents of `stats`.  The holdout shrinks to counts by stratum, rule
    and step before any stratum is looked at, so a stratum's row is bounded."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = stats.join(good, "doc_id", "left_semi").select(F.col(f"`{stratum}`").alias("stratum"), *docstats.COUNTS)
    steps = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), r.step().alias("step")) for r in RULES])).alias("s")
    counts = rows.select("stratum", steps).groupBy("stratum", "s.rule", "s.step").agg(F.count("*").alias("n"))
    table = base.saved(counts.groupBy("stratum").agg(F.collect_list(F.struct("rule", "step", "n")).alias("steps")), "rule-steps")
    share = delta / max(1, table.count() * len(RULES))

    def cuts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for cells in batch.to_pylist():
                by_rule: dict[str, dict[int, int]] = {r.name: {} for r in RULES}
                for c in cells:
                    by_rule[c["rule"]][c["step"]] = c["n"]
                found = choose(by_rule, sum(by_rule[RULES[0].name].values()), limit, share)
                out.append([found.get(r.name) for r in RULES])
            yield pa.array(out, pa.list_(pa.int32()))

    made = F.arrow_udf(cuts, "array<int>")
    return base.saved(table.select("stratum", made("steps").alias("cuts")), "rule-cuts")


def verdict(cuts: Column) -> Column:
    """True if a rule rejects; without cutoffs none does."""
    out = F.lit(False)
    for k, rule in enumerate(RULES):
        out = out | F.coalesce(rule.step() > F.get(cuts, k), F.lit(False))
    return out


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def apply(docs: DataFrame, labels: DataFrame, limit: float = 0.03, delta: float = 0.05, stratum: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, `keep`, the counts of docstats, base_failed and kept,
    one row per row of `docs`.  limit: the largest share of good documents of a
    stratum that all rules together may reject, with confidence 1 - delta over
    all strata."""
    own = ["doc_id", stratum, *docstats.COUNTS, "base_failed", "kept"]
    rows = base.packed(docs, ["doc_id", stratum, "text"], keep, own)
    stats = base.saved(docstats.counted(rows, keep=(stratum,)), "rule-stats")
    cuts = thresholds(stats, labels, stratum, limit, delta)
    if keep:
        base.dropped(stats)
        stats = docstats.counted(rows, keep=(stratum, "__keep"))
    few = cuts.count() <= base.BROADCAST_ROWS
    cuts = cuts.select(F.col("stratum").alias("__stratum"), F.col("cuts").alias("__cuts"))
    out = stats.join(F.broadcast(cuts) if few else cuts, F.col(f"`{stratum}`").eqNullSafe(F.col("__stratum")), "left")
    out = out.withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & ~verdict(F.col("__cuts"))
    return out.select("doc_id", F.col(f"`{stratum}`"), *base.unpacked(keep), *docstats.COUNTS, "base_failed", kept.alias("kept"))
