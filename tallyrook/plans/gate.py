"""The folder gate: scan, report, export, exit code."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators.verdict import THRESHOLD, analyze, confirmed_rules
from tallyrook.sources.files import list_files, read_files

ROOT = Path(__file__).resolve().parents[2]


def scan_results(files: DataFrame, scorer: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """path, error, verdict, confirmed, model_label, model_probability,
    model_source of each row (path, code, error)."""
    readable = files.where("error is null").select(F.col("path").alias("code_id"), "code")
    done = analyze(readable, scorer, threshold, texts=False)
    p = F.col("model_prediction")
    ok = done.select(
        F.col("code_id").alias("path"),
        F.lit(None).cast("string").alias("error"),
        "verdict",
        confirmed_rules(F.col("confirmed_findings")).alias("confirmed"),
        p["label"].alias("model_label"),
        F.round(p["probability"], 4).alias("model_probability"),
        p["model_source"].alias("model_source"),
    )
    return ok.unionByName(files.where("error is not null").select("path", "error"), allowMissingColumns=True)


def _plain(x: Column) -> Column:
    """A number of at most four decimals, without zeros that say nothing."""
    return F.regexp_replace(F.format_string("%.4f", x), r"(\.\d+?)0+$", "$1")


def report_lines(results: DataFrame) -> DataFrame:
    """path and its line of the report."""
    rules = F.when(F.size("confirmed") > 0, F.concat(F.lit("['"), F.array_join("confirmed", "', '"), F.lit("']"))).otherwise("[]")
    said = F.format_string("[%-12s] %s  (confirmed=%s model=%s P=%s)", F.upper("verdict"), F.col("path"), rules, F.col("model_label").cast("string"), _plain(F.col("model_probability")))
    return results.select("path", F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR] "), "path", F.lit(": "), "error")).otherwise(said).alias("line"))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n_files"), F.count_if(F.col("verdict") == "vulnerable").alias("n_flagged"))


def export_rows(results: DataFrame) -> DataFrame:
    """path and its result as JSON."""
    p = F.col("model_probability").cast("decimal(5,4)").alias("model_probability")
    value = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.to_json(F.struct("verdict", "confirmed", "model_label", p, "model_source")))
    return results.select("path", value.alias("json"))


def main(spark: SparkSession, argv: list[str], scorer: Callable[[DataFrame], DataFrame], say: Callable[[str], None] = print, complain: Callable[[str], None] | None = None) -> int:
    """list|export|scan [folder]: 2 if the folder is missing, 0 for list and
    export, 1 if anything is vulnerable, else 0.  Other commands scan."""
    command, folder = (argv[0] if argv else "scan"), Path(argv[1] if len(argv) > 1 else "samples")
    folder = folder if folder.is_absolute() else ROOT / folder
    if not folder.exists():
        (complain or say)(f"Directory not found: {folder}")
        return 2
    files = list_files(spark, str(folder))
    if command == "list":
        for r in files.toLocalIterator():
            say(r["path"])
        return 0
    results = scan_results(read_files(files), scorer).persist()
    try:
        ordered = results.orderBy(F.split("path", "/"))
        if command == "export":
            say(json.dumps({r["path"]: json.loads(r["json"]) for r in export_rows(ordered).toLocalIterator()}, indent=2, default=str))
            return 0
        for r in report_lines(ordered).toLocalIterator():
            say(r["line"])
        total = summary(results).first()
        say(f"\nScanned {total['n_files']} file(s); {total['n_flagged']} flagged 'vulnerable'.")
        return 1 if total["n_flagged"] else 0
    finally:
        results.unpersist()
