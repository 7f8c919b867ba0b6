"""The weakness rules of the line scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    rule_id: str
    cwe: str
    severity: str
    pattern: str  # portable form: \b, \s and \w as a scripting language reads them
    func_name: str | None
    message: str


# Identifiers, classes, severities and patterns of the ten rules.
RULES = (
    Rule("R001", "CWE-120", "high", r"\bgets\s*\(", "gets", "gets has no bound on what it reads"),
    Rule("R002", "CWE-120", "high", r"\bstrcpy\s*\(", "strcpy", "strcpy copies without a bound"),
    Rule("R003", "CWE-120", "high", r"\bstrcat\s*\(", "strcat", "strcat appends without a bound"),
    Rule("R004", "CWE-134", "high", r"\bsprintf\s*\(", "sprintf", "sprintf formats without a bound"),
    Rule("R005", "CWE-134", "medium", r"\bprintf\s*\(\s*[a-zA-Z_]\w*\s*\)", "printf", "the format is a variable"),
    Rule("R006", "CWE-78", "high", r"\bsystem\s*\(", "system", "system runs a shell command"),
    Rule("R007", "CWE-676", "medium", r"\bscanf\s*\([^)]*%s", "scanf", "scanf reads a word of any length"),
    Rule("R008", "CWE-190", "medium", r"\bmalloc\s*\(\s*\w+\s*\*\s*\w+", "malloc", "the size product may overflow"),
    Rule("R009", "CWE-416", "low", r"\bfree\s*\(", "free", "freed memory may be used later"),
    Rule("R010", "CWE-120", "medium", r"\b(memcpy|memmove)\s*\(", None, "the copied size is unchecked"),
)

WORD = r"[\p{L}\p{N}_]"
#: White space as Unicode has it, and the four separators before the space.
SPACE = r"[\s\x{85}\p{Z}\x1c-\x1f]"


def java(pattern: str) -> str:
    """The same pattern for the JVM, whose classes are ASCII unless told otherwise."""
    out = pattern.replace(r"\b", f"(?<!{WORD})").replace(r"\w", WORD)
    return out.replace(r"\s", SPACE)


def rules_table(spark: SparkSession) -> DataFrame:
    """Ten rows, in scan order."""
    rows = [(k, r.rule_id, r.cwe, r.severity, r.message, r.pattern, r.func_name) for k, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, cwe string, severity string, message string, pattern string, func_name string")
