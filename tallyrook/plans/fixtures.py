"""Views that the queries read, derived from the tables; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators import prep, score

# Statements and, per rule, whether its matches are confirmed.
STATEMENTS: list[tuple[str, dict[str, bool]]] = [
    ("strcpy(dst, src);", {"R002": True}),
    ("/* strcpy(a) */ int x;", {"R002": False}),
    ("gets (buf); gets(buf2);", {"R001": True}),
    ("printf(fmt);", {"R005": True}),
    ('printf("%s", p);', {}),
    ('scanf("%s", b);', {"R007": True}),
    ("p = malloc(n * 4);", {"R008": True}),
    ("p = malloc(sizeof(int) * n);", {}),
    ("free(p); // free(q)", {"R009": True}),
    ("memcpy(a, b, n); memmove(c, d, n);", {"R010": True}),
    ("// memcpy(a, b, n)", {"R010": False}),
    ('char *s = "system(ls)";', {"R006": False}),
    ('sprintf(b, "%d", i); strcat(b, c);', {"R003": True, "R004": True}),
    ('sprintf(b, "/* memcpy(x) */");', {"R004": True, "R010": False}),
    ("std::strcpy(a, b);", {"R002": False}),
    ("p->free(x);", {"R009": False}),
    ("snprintf(b, n, f); fgets(a, n, f);", {}),
    ('strcpy(d, "system(x)");', {"R002": True, "R006": False}),
    ("return 0;", {}),
    ("strcpy(\n        d,\n        s); free\n        (p);", {"R002": True}),
    ("r(); }\nstatic int q = system(cmd);\nvoid g(void) { r();", {"R006": True}),
    ("r(); }\nchar *gets(char *s);\nvoid free(void *p);\nvoid g(void) { r();", {"R001": False, "R009": False}),
    ("char *strcpy(char *, const char *);", {"R002": False}),
    ("r(); }\nstruct A { A(int n) : p(malloc(n * m)) {} char *p; };\nvoid g(void) { r();", {"R008": True}),
    ('r(); }\nextern "C" { char *gets(char *s); }\nvoid g(void) { r();', {"R001": False}),
    ("r(); }\nchar *gets(char *s) { return s; }\nvoid g(void) { r();", {"R001": False}),
    ("n = sizeof free(p);", {"R009": True}),
    ("return a * malloc(n * m);", {"R008": True}),
    ("std::vector<char *> free(3);", {"R009": False}),
    ("if (a { strcpy(d, s); /* gets(x) */", {"R001": True, "R002": True}),
    ('s = "not closed; system(x);', {"R006": True}),
    ('s = "joined \\\n strcpy(a, b)"; memmove(a, b, n);', {"R002": False, "R010": True}),
    ("#define CP(a, b) \\\n    strcpy(a, b)", {"R002": False}),
    ('s = R"x(\ngets(a); )" )x"; (void) free(s);', {"R001": False, "R009": True}),
]
#: Those that don't parse.
ODD = [k for k, (s, _) in enumerate(STATEMENTS) if s.startswith(("if (a {", 's = "not'))]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C function per document, around one of the statements."""
    body = F.element_at(F.array(*[F.lit(s) for s, _ in STATEMENTS]), (F.col("doc_id") % len(STATEMENTS) + 1).cast("int"))
    text = F.concat(F.lit("void f"), F.col("doc_id").cast("string"), F.lit("(void) {\n    "), body, F.lit("\n}"))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code_id"), text.alias("code"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return _table(spark, sf_dir, "documents").select(
        d.alias("code_id"), ((d * 37) % 101 / F.lit(20.0) - 2.5).alias("logit0"), ((d * 53) % 97 / F.lit(20.0) - 2.4).alias("logit1")
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled data set with empty and missing texts and unknown languages."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    d, vul = F.col("doc_id"), 1 - F.col("quality")
    lang = F.when(d % 10 == 0, "CPP").when(d % 10 == 1, "C++").when(d % 10 == 2, "JAVA").otherwise("C")
    text = F.when(d % 50 == 7, "   ").when(d % 50 == 13, F.lit(None)).otherwise(F.col("text"))
    cwe = F.when(vul == 1, F.concat(F.lit("CWE-"), (d % 17).cast("string")))
    return rows.select((d % 3).cast("int").alias("split_ord"), d.alias("row_ord"), cwe.alias("cwe_id"), lang.alias("lang"), text.alias("func_before"), vul.cast("int").alias("vul"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data set after language, emptiness and duplicates are dealt with."""
    return prep.dedupe_first(prep.nonempty(prep.keep_languages(raw(spark, sf_dir)))).withColumn("strata", prep.strata(F.col("vul"), F.col("lang")))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.from_logits(logits(spark, sf_dir), "table")
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("code_id"), (1 - F.col("quality")).cast("int").alias("label"))
    return rows.join(scores.withColumnRenamed("label", "pred"), "code_id").select((F.col("code_id") % 3 + 1).cast("int").alias("epoch"), F.col("code_id").alias("row_id"), "label", "pred", F.round("probability", 9).alias("probability"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_K = len(STATEMENTS)
CODE_SQL = f"""code AS (SELECT doc_id AS code_id, 'void f' || doc_id || '(void) {{' || chr(10) || '    ' ||
  ([{", ".join(_quoted(s) for s, _ in STATEMENTS)}])[CAST(doc_id % {_K} AS INT) + 1] || chr(10) || '}}' AS code FROM documents)"""
TRUTH_SQL = "truth(k, rule_id, confirmed, odd) AS (VALUES " + ", ".join(f"({k}, '{r}', {str(c).lower()}, {str(k in ODD).lower()})" for k, (_, t) in enumerate(STATEMENTS) for r, c in t.items()) + ")"
LOGITS_SQL = """logits AS (SELECT doc_id AS code_id, CAST((doc_id * 37) % 101 AS DOUBLE) / 20.0::DOUBLE - 2.5::DOUBLE AS logit0,
  CAST((doc_id * 53) % 97 AS DOUBLE) / 20.0::DOUBLE - 2.4::DOUBLE AS logit1 FROM documents)"""
SCORES_SQL = LOGITS_SQL + """, scores AS (SELECT code_id, CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS label,
  exp(logit1 - greatest(logit0, logit1)) / (exp(logit0 - greatest(logit0, logit1)) + exp(logit1 - greatest(logit0, logit1))) AS probability FROM logits)"""
RAW_SQL = """raw AS (SELECT CAST(doc_id % 3 AS INT) AS split_ord, doc_id AS row_ord, CASE WHEN quality = 0 THEN 'CWE-' || (doc_id % 17) END AS cwe_id,
  CASE doc_id % 10 WHEN 0 THEN 'CPP' WHEN 1 THEN 'C++' WHEN 2 THEN 'JAVA' ELSE 'C' END AS lang,
  CASE WHEN doc_id % 50 = 7 THEN '   ' WHEN doc_id % 50 = 13 THEN NULL ELSE text END AS func_before, CAST(1 - quality AS INT) AS vul
  FROM documents JOIN labels USING (doc_id))"""
CLEAN_SQL = RAW_SQL + """, kept AS (SELECT * REPLACE (CASE lang WHEN 'CPP' THEN 'C++' ELSE lang END AS lang) FROM raw WHERE lang IN ('C', 'CPP', 'C++')),
  clean AS (SELECT * FROM (SELECT * REPLACE (regexp_replace(coalesce(func_before, 'None'), '^\\s+|\\s+$', '', 'g') AS func_before) FROM kept) WHERE length(func_before) > 0)"""
PREPARED_SQL = CLEAN_SQL + """, prepared AS (SELECT *, vul || '_' || lang AS strata FROM
  (SELECT *, row_number() OVER (PARTITION BY func_before ORDER BY split_ord, row_ord) AS rn FROM clean) WHERE rn = 1)"""
EVALUATED_SQL = SCORES_SQL + """, evaluated AS (SELECT CAST(l.doc_id % 3 + 1 AS INT) AS epoch, l.doc_id AS row_id, CAST(1 - l.quality AS INT) AS label,
  s.label AS pred, round(s.probability, 9) AS probability FROM labels l JOIN scores s ON s.code_id = l.doc_id)"""
