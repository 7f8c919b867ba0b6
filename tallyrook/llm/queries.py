"""The queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.llm import decontaminate, jaccard, licences, pieces, quality, rules, tokenbin, tokencounts, toxicity, urls
from tallyrook.llm.base import fold, new_path, table

THRESHOLD = 0.3

URL_RULES = (
    urls.UrlRule("block", "com/en/"),
    urls.UrlRule("allow", "example.com/en/7"),
    urls.UrlRule("allow", "net/de/"),
    urls.UrlRule("block", "example.net/de/8"),
    urls.UrlRule("block", "org/es/"),
)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


#: Vocabulary files are a parameter; this is where the box has them.
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    tokenbin.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return tokenbin.read(spark, path)


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_paragraphs", "n_licence", "families")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Likeness(size=4, num=85, den=100))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: cut a word's worth from the middle, insert a
    sentence at a third, replace the end."""
    docs = table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))

    def edit(start, end, new):
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("new"))

    edits = F.array(
        edit(F.floor(n / 2), F.floor(n / 2) + 7, ""),
        edit(F.floor(n / 3), F.floor(n / 3), " An added sentence, 2 numbers. "),
        edit(F.greatest(n - 24, F.lit(0)), n, "end"),
    )
    out = tokencounts.counts_under_edits(docs.withColumn("edits", edits), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", *[F.get("counts", k).alias(f"after_edit_{k + 1}") for k in range(3)], "n_chars", "encoded_chars")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ids=False)


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_binary": op2_token_binary,
    "op3_quality_qda": op3_quality_qda,
    "op4_licence_scan": op4_licence_scan,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_quality_rules": op6_quality_rules,
    "op7_edit_counts": op7_edit_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity_grammar": op9_toxicity_grammar,
    "op10_url_filter": op10_url_filter,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _rules_sql(limit: float, delta: float) -> str:
    """The counts, the cutoffs by exact binomial tails, and both verdicts."""
    n = len(rules.RULES)
    steps = ", ".join(f"{{'rule': '{r.name}', 'step': least({rules.BINS}, CAST(floor(sqrt({r.part} / ({r.whole} + 10.0::DOUBLE)) * {rules.BINS}) AS INT))}}" for r in rules.RULES)
    return rf"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, p) AS k FROM win) WHERE k > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same_as_previous, len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
  len(regexp_extract_all(t, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]')) AS n_letters, len(regexp_extract_all(t, '[!?=_~^+/\\{{}}\[\]]')) AS n_marks FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT doc_id, lang, unnest([{steps}], recursive := true) FROM c),
good AS (SELECT s.* FROM s SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) g USING (doc_id)),
sizes AS (SELECT lang, count(*) // {n} AS n FROM good GROUP BY lang),
above AS (SELECT lang, rule, cut, n, count(*) FILTER (WHERE step > cut) AS k FROM good JOIN sizes USING (lang), range(0, {rules.BINS}) r(cut) GROUP BY ALL),
tails AS (SELECT *, k <= n * {limit / n!r} AND k < n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit / n!r}::DOUBLE) + (n - i) * ln(1 - {limit / n!r}::DOUBLE))))
  <= {delta}::DOUBLE / ({n} * (SELECT count(*) FROM sizes)) AS valid FROM above),
cuts AS (SELECT lang, rule, coalesce(max(cut) FILTER (WHERE NOT valid) + 1, 0) AS cut FROM tails GROUP BY ALL HAVING coalesce(max(cut) FILTER (WHERE NOT valid) + 1, 0) < {rules.BINS}),
out AS (SELECT DISTINCT doc_id FROM s JOIN cuts USING (lang, rule) WHERE step > cut),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out) AS kept FROM b"""


ORACLE: dict[str, str] = {
    "op1_decontaminate": rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 7], ' ') AS p, least(len(ws), 8) AS n FROM (SELECT *, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN win USING (p, n)),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_ngram_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
r(u, v) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) m USING (doc_id)""",
    "op6_quality_rules": _rules_sql(0.03, 0.05),
    # the pages name no canonical address and no refresh target, so the rules decide alone
    "op10_url_filter": r"""WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rule, h, pre) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('block', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
f AS (SELECT page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC, r.verdict) AS k
  FROM q JOIN rules r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.pre))
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM q LEFT JOIN f ON f.page_id = q.page_id AND f.k = 1""",
}
