"""Named queries over the tables, and the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators import eda, evaluate, prep, sampling, scan, score, syntax, train, verdict
from tallyrook.operators.rules import RULES
from tallyrook.plans import fixtures as fx
from tallyrook.plans import gate
from tallyrook.sources import datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Layer 1

_RULES_SQL = "rules(rule_ord, rule_id, cwe, severity, func_name, pattern) AS (VALUES " + ", ".join(
    f"({k}, '{r.rule_id}', '{r.cwe}', '{r.severity}', " + (f"'{r.func_name}'" if r.func_name else "CAST(NULL AS VARCHAR)") + f", '{r.pattern}')" for k, r in enumerate(RULES)
) + ")"
_FOUND_SQL = f"""WITH {fx.CODE_SQL}, {_RULES_SQL},
lines AS (SELECT code_id, unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM code),
hits AS (SELECT code_id, line, text, r.*, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS pc FROM lines, rules r WHERE regexp_matches(text, pattern)),
findings AS (SELECT *, coalesce(list_sum(list_transform(pc[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS col
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hits))"""


@query(_FOUND_SQL + " SELECT code_id, CAST(line AS INT) AS line, CAST(rule_ord AS INT) AS rule_ord, CAST(col AS INT) AS col, rule_id, cwe, severity, func_name FROM findings")
def l1_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(fx.code(spark, sf_dir)).drop("message", "match_text")


@query(_FOUND_SQL + " SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id")
def l1_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.counts(scan.scan(fx.code(spark, sf_dir)), "rule_id")


@query(_FOUND_SQL + " SELECT cwe, severity, count(*) AS n FROM findings GROUP BY cwe, severity")
def l1_by_cwe_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.counts(scan.scan(fx.code(spark, sf_dir)), "cwe", "severity")


@query(_FOUND_SQL + " SELECT code_id, CAST(line AS INT) AS line, rule_id, CAST(col AS INT) AS col FROM findings")
def l1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(fx.code(spark, sf_dir)).select("code_id", "line", "rule_id", "col")


@query(_FOUND_SQL + " SELECT code_id, rule_id, trim(text) AS match_text, count(*) AS n FROM findings GROUP BY ALL")
def l1_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.counts(scan.scan(fx.code(spark, sf_dir)), "code_id", "rule_id", "match_text")


# Layer 2

_JUDGED_SQL = _FOUND_SQL + f""", {fx.TRUTH_SQL}, judged AS (SELECT f.*, t.confirmed,
  CASE WHEN t.odd THEN '{syntax.PARSE_ERROR}' WHEN func_name IS NOT NULL AND t.confirmed THEN 'confirmed: ' || func_name || ' is called on this line'
       WHEN func_name IS NOT NULL THEN 'rejected: no call of ' || func_name || ' on this line'
       WHEN t.confirmed THEN '{syntax.IN_CODE}' ELSE '{syntax.IN_SKIP}' END AS reason
  FROM findings f JOIN truth t ON t.k = f.code_id % {len(fx.STATEMENTS)} AND t.rule_id = f.rule_id)"""
_JUDGED_COLUMNS = "code_id, CAST(line AS INT) AS line, CAST(col AS INT) AS col, rule_id"


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = fx.code(spark, sf_dir)
    return syntax.validate(scan.scan(code), code)


@query(_JUDGED_SQL + f" SELECT {_JUDGED_COLUMNS}, confirmed, reason FROM judged")
def l2_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("code_id", "line", "col", "rule_id", "confirmed", "reason")


@query(_JUDGED_SQL + f" SELECT {_JUDGED_COLUMNS} FROM judged WHERE confirmed")
def l2_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).where("confirmed").select("code_id", "line", "col", "rule_id")


@query(_JUDGED_SQL + f" SELECT {_JUDGED_COLUMNS} FROM judged WHERE NOT confirmed")
def l2_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).where("not confirmed").select("code_id", "line", "col", "rule_id")


@query(_FOUND_SQL + """ SELECT code_id, CAST(line AS INT) AS line,
  CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY code_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_byte FROM lines""")
def line_start_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.line_start_bytes(fx.code(spark, sf_dir))


@query(_JUDGED_SQL + " SELECT code_id, rule_id, count(*) AS n FROM judged WHERE func_name IS NULL AND NOT confirmed GROUP BY ALL")
def skip_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = fx.code(spark, sf_dir)
    found = scan.scan(code).where("func_name is null")
    return scan.counts(syntax.in_skip(syntax.offsets(found, code), syntax.skip_ranges(code)), "code_id", "rule_id")


# Layer 3 and fusion


@query(f"WITH {fx.SCORES_SQL} SELECT code_id, label, round(probability, 6) AS probability FROM scores")
def softmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.from_logits(fx.logits(spark, sf_dir), "table").select("code_id", "label", F.round("probability", 6).alias("probability"))


@query("""WITH ids AS (SELECT doc_id, [CAST((doc_id * 7 + i) % 1000 AS INT) for i in range(0, doc_id % 700)] AS ids FROM documents)
SELECT doc_id, coalesce(CAST(list_sum(ids[1:512]) AS BIGINT), 0) + 1 * greatest(512 - len(ids), 0) AS id_sum, CAST(512 AS BIGINT) AS length, CAST(least(len(ids), 512) AS BIGINT) AS mask_sum
FROM ids""")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    n = (d % 700).cast("int")
    ids = F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), lambda i: ((d * 7 + i) % 1000).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut, mask = score.padded(F.col("ids"), 1)
    add = lambda s, x: s + x
    rows = docs.select("doc_id", ids.alias("ids")).select("doc_id", cut.alias("cut"), mask.alias("mask"))
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", F.aggregate("cut", zero, add).alias("id_sum"), F.size("cut").cast("long").alias("length"), F.aggregate("mask", zero, add).alias("mask_sum"))


_VERDICT_SQL = _JUDGED_SQL + f""", {fx.SCORES_SQL}, per AS (SELECT code_id, count(*) AS n_raw, count(*) FILTER (WHERE confirmed) AS n_confirmed,
  list(rule_id ORDER BY line, rule_ord, col) FILTER (WHERE confirmed) AS confirmed FROM judged GROUP BY code_id),
said AS (SELECT code.code_id, coalesce(n_raw, 0) AS n_raw, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(array_to_string(confirmed, ','), '') AS confirmed, s.label, s.probability,
  CASE WHEN coalesce(n_confirmed, 0) > 0 AND probability >= 0.5 THEN 'vulnerable' WHEN coalesce(n_confirmed, 0) > 0 OR probability >= 0.5 THEN 'needs_review' ELSE 'likely_safe' END AS verdict
  FROM code JOIN scores s USING (code_id) LEFT JOIN per USING (code_id))"""


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.analyze(fx.code(spark, sf_dir), score.table_scorer(fx.logits(spark, sf_dir)))


@query(_VERDICT_SQL + " SELECT code_id, verdict, n_raw, n_confirmed, confirmed, round(probability, 6) AS probability FROM said")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzed(spark, sf_dir).select(
        "code_id",
        "verdict",
        F.size("regex_findings").cast("long").alias("n_raw"),
        F.size("confirmed_findings").cast("long").alias("n_confirmed"),
        F.array_join(verdict.confirmed_rules(F.col("confirmed_findings")), ",").alias("confirmed"),
        F.round("model_prediction.probability", 6).alias("probability"),
    )


@query(_VERDICT_SQL + " SELECT verdict, count(*) AS n FROM said GROUP BY verdict")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzed(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan results with a path per document; every 97th can't be read."""
    d = F.col("code_id")
    code = fx.code(spark, sf_dir).withColumn("path", F.format_string("src/%d.c", d))
    logits = fx.logits(spark, sf_dir).select(F.format_string("src/%d.c", d).alias("code_id"), "logit0", "logit1")
    files = code.select("path", F.when(d % 97 != 5, F.col("code")).alias("code"), F.when(d % 97 == 5, "unreadable").alias("error"))
    return gate.scan_results(files, score.table_scorer(logits))


@query(_VERDICT_SQL + " SELECT count(*) AS n_files, count(*) FILTER (WHERE verdict = 'vulnerable' AND code_id % 97 <> 5) AS n_flagged FROM said")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.summary(_results(spark, sf_dir))


_SAID_SQL = _VERDICT_SQL + """, reported AS (SELECT 'src/' || code_id || '.c' AS path, code_id % 97 = 5 AS failed, verdict, label,
  string_split(confirmed, ',') AS rules, confirmed = '' AS none, CAST(round(probability, 4) AS DECIMAL(5, 4))::VARCHAR AS p FROM said)"""


@query(_SAID_SQL + r""" SELECT path, CASE WHEN failed THEN '[ERROR] ' || path || ': unreadable' ELSE '[' || rpad(upper(verdict), 12, ' ') || '] ' || path || '  (confirmed=' ||
  CASE WHEN none THEN '[]' ELSE '[' || chr(39) || array_to_string(rules, chr(39) || ', ' || chr(39)) || chr(39) || ']' END || ' model=' || label || ' P=' || regexp_replace(p, '([.][0-9]+?)0+$', '\1') || ')' END AS line FROM reported""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.report_lines(_results(spark, sf_dir))


@query(_SAID_SQL + """ SELECT path, CASE WHEN failed THEN '{"error":"unreadable"}' ELSE '{"verdict":"' || verdict || '","confirmed":[' ||
  CASE WHEN none THEN '' ELSE '"' || array_to_string(rules, '","') || '"' END || '],"model_label":' || label || ',"model_probability":' || p || ',"model_source":"table"}' END AS json FROM reported""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.export_rows(_results(spark, sf_dir))


# Data set


@query(f"WITH {fx.RAW_SQL} SELECT row_ord, CASE lang WHEN 'CPP' THEN 'C++' ELSE lang END AS lang FROM raw WHERE lang IN ('C', 'CPP', 'C++')")
def lang_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.keep_languages(fx.raw(spark, sf_dir)).select("row_ord", "lang")


@query(f"WITH {fx.RAW_SQL} SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM raw GROUP BY lang")
def lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.value_counts(fx.raw(spark, sf_dir), "lang", share=True).withColumn("share", F.round("share", 6))


@query(f"WITH {fx.CLEAN_SQL} SELECT row_ord, length(func_before) AS n_chars, md5(func_before) AS digest FROM clean")
def clean_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.nonempty(prep.keep_languages(fx.raw(spark, sf_dir))).select("row_ord", F.length("func_before").cast("long").alias("n_chars"), F.md5("func_before").alias("digest"))


@query(f"WITH {fx.PREPARED_SQL} SELECT split_ord, row_ord, strata FROM prepared")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.prepared(spark, sf_dir).select("split_ord", "row_ord", "strata")


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_duplicates, round((count(*) - count(DISTINCT text)) * 100.0 / count(*), 6) AS percent FROM documents")
def dup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text").withColumn("percent", F.round("percent", 6))


@query(f"WITH {fx.RAW_SQL} SELECT vul, count(*) AS n, CASE vul WHEN 1 THEN 'vulnerable' ELSE 'not vulnerable' END AS name FROM raw GROUP BY vul")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.class_balance(fx.raw(spark, sf_dir))


@query(f"WITH {fx.RAW_SQL} SELECT sum(1 - vul)::BIGINT AS n0, sum(vul)::BIGINT AS n1, round(sum(1 - vul) / sum(vul), 6) AS ratio FROM raw")
def imbalance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.imbalance(fx.raw(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {fx.PREPARED_SQL} SELECT vul, round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS weight FROM prepared GROUP BY vul")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.class_weights(fx.prepared(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("""SELECT count(*) AS "count", round(avg(length(text)), 4) AS mean, round(stddev_samp(length(text)), 4) AS std, min(length(text)) AS "min", quantile_cont(length(text), 0.25) AS q25,
quantile_cont(length(text), 0.5) AS q50, quantile_cont(length(text), 0.75) AS q75, max(length(text)) AS "max" FROM documents""")
def length_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = eda.describe(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.length("text").cast("long"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("""WITH x AS (SELECT least(length(text), 5000)::DOUBLE AS x FROM documents), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT CAST(CASE WHEN hi = lo THEN 31 ELSE least(floor((x - lo) / (hi - lo) * 60) + 1, 60) END AS INT) AS bin, count(*) AS n FROM x, e GROUP BY bin""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.length("text"))


@query(f"WITH {fx.RAW_SQL} SELECT cwe_id, count(*) AS n FROM raw WHERE vul = 1 GROUP BY cwe_id ORDER BY n DESC, cwe_id LIMIT 15")
def top_cwe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.top_cwe(fx.raw(spark, sf_dir))


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5")
def dataset_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.head(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("doc_id",)).select("doc_id", "lang", "source")


@query("SELECT count(*) AS n_rows, CAST(5 AS INT) AS n_columns FROM documents")
def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.shape(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query(f"WITH {fx.PREPARED_SQL} SELECT strata, count(*) AS n FROM prepared GROUP BY strata")
def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.prepared(spark, sf_dir).groupBy("strata").agg(F.count("*").alias("n"))


_QUOTA_SQL = """, sizes AS (SELECT strata, count(*) AS n FROM prepared GROUP BY strata),
a AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER () - ceil(sum(n) OVER () * 0.2)::BIGINT AS keep FROM sizes),
b AS (SELECT *, (keep * n) // total AS base, (keep * n) % total AS rest FROM a),
c AS (SELECT *, keep - sum(base) OVER () AS need, row_number() OVER (ORDER BY rest DESC, strata) AS place FROM b),
q1 AS (SELECT strata, n, CAST(base + CASE WHEN place <= need THEN 1 ELSE 0 END AS BIGINT) AS n_train FROM c),
a2 AS (SELECT strata, n_train, n - n_train AS n FROM q1),
a3 AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER () - ceil(sum(n) OVER () * 0.5)::BIGINT AS keep FROM a2),
b2 AS (SELECT *, (keep * n) // total AS base, (keep * n) % total AS rest FROM a3),
c2 AS (SELECT *, keep - sum(base) OVER () AS need, row_number() OVER (ORDER BY rest DESC, strata) AS place FROM b2),
q AS (SELECT strata, n_train, CAST(n_train + base + CASE WHEN place <= need THEN 1 ELSE 0 END AS BIGINT) AS n_upto FROM c2),
splits AS (SELECT p.*, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_upto THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY strata ORDER BY md5('42|' || row_ord)) AS rk FROM prepared) p JOIN q USING (strata))"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split(fx.prepared(spark, sf_dir), "row_ord")


@query(f"WITH {fx.PREPARED_SQL}{_QUOTA_SQL} SELECT strata, n, n_train AS quota FROM q1")
def split_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.quotas(fx.prepared(spark, sf_dir).groupBy("strata").agg(F.count("*").alias("n")), 0.2)


@query(f"WITH {fx.PREPARED_SQL}{_QUOTA_SQL} SELECT row_ord, split FROM splits")
def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("row_ord", "split")


@query(f"WITH {fx.PREPARED_SQL}{_QUOTA_SQL} SELECT split, sum(1 - vul)::BIGINT AS n0, sum(vul)::BIGINT AS n1, round(sum(1 - vul) / nullif(sum(vul), 0), 6) AS ratio FROM splits GROUP BY split")
def split_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.split_balance(_split(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {fx.PREPARED_SQL}{_QUOTA_SQL} SELECT count(*) AS n_leaks FROM (SELECT func_before FROM splits GROUP BY func_before HAVING count(DISTINCT split) > 1)")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.leaks(_split(spark, sf_dir))


@query(f"""WITH {fx.PREPARED_SQL}, sizes AS (SELECT vul, count(*) AS size, row_number() OVER (ORDER BY vul) - 1 AS k FROM prepared GROUP BY vul),
u AS (SELECT i AS draw, CAST(floor(('0x' || substr(md5('42|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT count(*) FROM sizes)) AS BIGINT) AS k,
  ('0x' || substr(md5('43|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(0, (SELECT sum(size)::BIGINT FROM sizes)) t(i)),
ranked AS (SELECT vul, row_ord, row_number() OVER (PARTITION BY vul ORDER BY md5('42|' || row_ord)) AS rank FROM prepared)
SELECT draw, row_ord, vul FROM u JOIN sizes USING (k) JOIN ranked USING (vul) WHERE rank = CAST(floor(u * size) AS BIGINT) + 1""")
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_draw(fx.prepared(spark, sf_dir), "row_ord").select("draw", "row_ord", "vul")


@query(f"WITH {fx.PREPARED_SQL} SELECT row_ord FROM prepared ORDER BY md5('42|' || row_ord), row_ord LIMIT 200")
def subset_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.subset(fx.prepared(spark, sf_dir), 200, "row_ord").select("row_ord")


@query(f"WITH {fx.PREPARED_SQL} SELECT vul, row_ord FROM (SELECT *, row_number() OVER (PARTITION BY vul ORDER BY md5('7|' || row_ord)) AS rk FROM prepared) WHERE rk <= 10")
def sample_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.per_class(fx.prepared(spark, sf_dir), 10, "row_ord").select("vul", "row_ord")


@query("SELECT split_ord, count(*) AS n FROM (SELECT 0 AS split_ord FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 1 FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 2 FROM documents WHERE doc_id % 3 = 2) GROUP BY split_ord")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return datasets.union_splits([docs.where(F.col("doc_id") % 3 == k) for k in range(3)]).groupBy("split_ord").agg(F.count("*").alias("n"))


# Evaluation

_COUNTS_SQL = """per AS (SELECT epoch, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM evaluated GROUP BY epoch),
history AS (SELECT epoch, round(accuracy, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM per)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.metrics(fx.evaluated(spark, sf_dir), ("epoch",))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(f"WITH {fx.EVALUATED_SQL}, {_COUNTS_SQL} SELECT * FROM history")
def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@query(f"WITH {fx.EVALUATED_SQL} SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM evaluated")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(fx.evaluated(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {fx.EVALUATED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2 AS rk FROM evaluated)
SELECT round((sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS roc_auc FROM r""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(fx.evaluated(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"WITH {fx.EVALUATED_SQL}, {_COUNTS_SQL} SELECT * FROM history ORDER BY f1 DESC, epoch LIMIT 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_epoch(_history(spark, sf_dir))


@query(f"WITH {fx.SCORES_SQL} SELECT round(avg(CASE WHEN label = CASE WHEN round(logit1, 1) > round(logit0, 1) THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6) AS rate FROM scores JOIN logits USING (code_id)")
def agreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.logits(spark, sf_dir)
    full = score.label(F.col("logit0"), F.col("logit1"))
    coarse = score.label(F.round("logit0", 1), F.round("logit1", 1))
    return rows.agg(F.round(evaluate.agreement(full, coarse), 6).alias("rate"))


@query("""SELECT i AS step, round(1e9 * CASE WHEN i < 100 THEN 2e-5 * i / 100.0 ELSE 2e-5 * greatest(0.0, (1000 - i) / 900.0) END, 3) AS rate_e9 FROM range(0, 1001) t(i)""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(0, 1001).withColumnRenamed("id", "step")
    return rows.select("step", F.round(evaluate.learning_rate(F.col("step"), 1000) * 1e9, 3).alias("rate_e9"))


@query(f"WITH {fx.EVALUATED_SQL} SELECT row_id, epoch, round(avg(1 - probability) OVER (PARTITION BY epoch ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean FROM evaluated")
def running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.evaluated(spark, sf_dir).withColumn("loss", 1 - F.col("probability"))
    return eda.running_mean(rows, "loss", "row_id", "epoch").select("row_id", "epoch", F.round("running_mean", 6).alias("running_mean"))


@query()
def ml_substitute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.split(prep.kept(fx.prepared(spark, sf_dir), "prepared"), "row_ord")  # cleaned and deduped once
    model = train.fit(rows.where("split = 'train'"))
    held = rows.where("split != 'train'").select(F.col("row_ord").alias("code_id"), F.col("func_before").alias("code"))
    return train.scorer(model)(held)
