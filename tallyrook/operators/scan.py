"""Layer 1: every line against every rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.functions import text
from tallyrook.operators.rules import RULES, Rule, java


#: Fields of a finding, in output order.
FIELDS = ("line", "rule_ord", "col", "rule_id", "cwe", "severity", "message", "match_text", "func_name")


def _matches(place: int, rule: Rule, line: Column, texts: bool) -> Column:
    """A struct per match of one rule in a struct (line, text, stripped)."""
    constants = {"rule_id": rule.rule_id, "cwe": rule.cwe, "severity": rule.severity, "message": rule.message}

    def finding(col: Column) -> Column:
        return F.struct(
            line["line"].alias("line"),
            F.lit(place).alias("rule_ord"),
            col.cast("int").alias("col"),
            *[F.lit(v).alias(k) for k, v in constants.items()],
            *[line["stripped"].alias("match_text")] * texts,
            F.lit(rule.func_name).cast("string").alias("func_name"),
        )

    return F.transform(text.match_starts(line["text"], java(rule.pattern)), finding)


def _hit_lines(code: Column, rules: Sequence[Rule]) -> Column:
    """struct (line, text, stripped) of each line that a rule matches."""
    any_rule = "|".join(f"(?:{java(r.pattern)})" for r in rules)
    numbered = F.transform(text.lines(code), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    hit = F.filter(numbered, lambda s: s["text"].rlike(any_rule))
    return F.transform(hit, lambda s: F.struct(s["line"].alias("line"), s["text"].alias("text"), text.strip(s["text"]).alias("stripped")))


def _of_line(line: Column, rules: Sequence[Rule], texts: bool) -> Column:
    return F.flatten(F.array(*[_matches(k, r, line, texts) for k, r in enumerate(rules)]))


def findings(code: Column, rules: Sequence[Rule] = RULES, texts: bool = True) -> Column:
    """All findings of a text as an array, ordered by line, rule and place.
    Lines that no rule matches are dropped before anything is built.  texts:
    with match_text, the whole line for each of its matches."""
    if not rules:
        return F.array()
    return F.flatten(F.transform(_hit_lines(code, rules), lambda s: _of_line(s, rules, texts)))


def scan(code: DataFrame, rules: Sequence[Rule] = RULES, key: str = "code_id", column: str = "code") -> DataFrame:
    """One row per match: key, line (from 1), rule_ord, col (from 0), rule_id,
    cwe, severity, message, match_text (the whole line, stripped), func_name.

    Map-only.  Null code has no lines."""
    if not rules:
        raise ValueError("no rules")
    any_rule = "|".join(f"(?:{java(r.pattern)})" for r in rules)
    lines = code.where(F.col(column).rlike(any_rule)).select(key, F.explode(_hit_lines(F.col(column), rules)).alias("l"))
    rows = lines.select(key, F.col("l.stripped").alias("match_text"), F.explode(_of_line(F.col("l"), rules, False)).alias("f"))
    return rows.select(key, *[F.col(c) if c == "match_text" else F.col(f"f.{c}").alias(c) for c in FIELDS])


def counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("n"))
