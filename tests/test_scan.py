"""Layers 1 to 3 against plain versions and golden cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyrook.functions import text
from tallyrook.operators import scan, score, syntax, verdict
from tallyrook.operators.rules import RULES
from tallyrook.plans.fixtures import STATEMENTS


def plain_scan(code):
    return [
        (line, rule.rule_id, m.start(), body.strip())
        for line, body in enumerate(code.splitlines(), 1)
        for rule in RULES
        for m in re.finditer(rule.pattern, body)
    ]


def spark_scan(spark, codes):
    df = spark.createDataFrame(list(enumerate(codes)), "code_id long, code string")
    rows = scan.scan(df).orderBy("code_id", "line", "rule_ord", "col").collect()
    out = [[] for _ in codes]
    for r in rows:
        out[r["code_id"]].append((r["line"], r["rule_id"], r["col"], r["match_text"]))
    return out


def test_scan_equals_plain_version(spark):
    parts = ["gets", "strcpy", "printf", "scanf", "malloc", "free", "memcpy", "x", "(", ")", "*", "%s", " ", "\t", '"', "//", "/*", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "é", "😀", "_", "1"]
    rng = random.Random(3)
    codes = ["", "\n", "\r\n\r\n"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    assert spark_scan(spark, codes) == [plain_scan(c) for c in codes]


def test_lines_and_strip(spark):
    codes = ["", "\n", "a", "a\n", "a\r\nb\x0cc ", "\r\n\r\n", " \x1c a 　"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    got = df.select("code", text.lines(F.col("code")).alias("l"), text.strip(F.col("code")).alias("s")).collect()
    assert [(r["l"], r["s"]) for r in got] == [(r["code"].splitlines(), r["code"].strip()) for r in got]


def wrapped(statement):
    return f"void f(void) {{\n    {statement}\n}}"


def judged(spark, code):
    df = spark.createDataFrame([(0, code)], "code_id long, code string")
    rows = syntax.validate(scan.scan(df), df).orderBy("line", "rule_ord", "col").collect()
    return [(r["rule_id"], r["confirmed"]) for r in rows]


def test_statements(spark):
    df = spark.createDataFrame([(k, wrapped(s)) for k, (s, _) in enumerate(STATEMENTS)], "code_id long, code string")
    rows = syntax.validate(scan.scan(df), df).collect()
    got = {}
    for r in rows:
        got.setdefault(r["code_id"], {})[r["rule_id"]] = r["confirmed"]
    assert got == {k: t for k, (_, t) in enumerate(STATEMENTS) if t}


@pytest.mark.parametrize(
    ("code", "expected"),
    [
        ("void free(void *p);", [("R009", False)]),
        ("#define CP(a,b) strcpy(a,b)", [("R002", False)]),
        ("void f( { strcpy(a); /* gets(x) */", [("R001", True), ("R002", True)]),
        ("void f(void) {\n\f\n    strcpy(a,b);\n}", [("R002", False)]),
        ("void f(void) { return system(x); }", [("R006", True)]),
        ("", []),
    ],
)
def test_structure(spark, code, expected):
    assert judged(spark, code) == expected


def test_many_matches_and_lines_take_seconds(spark):
    import time

    from tallyrook.functions.text import running_sums

    began = time.perf_counter()
    df = spark.createDataFrame([(0, "void f(void) {" + "free(p);" * 32_000 + "}")], "code_id long, code string")
    assert scan.scan(df).agg(F.sum("col")).first()[0] == sum(14 + 8 * k for k in range(32_000))
    assert syntax.validated(df, texts=False).select(F.size(F.filter("findings", lambda f: f["confirmed"]))).first()[0] == 32_000
    df = spark.createDataFrame([(0, "x = 1; // c\n" * 100_000)], "code_id long, code string")
    assert syntax.line_start_bytes(df).agg(F.max("start_byte")).first()[0] == 12 * 99_999
    assert syntax.skip_ranges(df).count() == 100_000
    assert time.perf_counter() - began < 120
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 200)], "x array<int>").select("x", running_sums(F.col("x")).alias("s")).collect()
    assert all(r["s"] == [sum(r["x"][:k]) for k in range(len(r["x"]))] for r in rows)


class Node:
    """A stand-in for a parser's node."""

    def __init__(self, type, start, end, children=(), line=0, function=None, has_error=False):
        self.type, self.start_byte, self.end_byte, self.children = type, start, end, list(children)
        self.start_point, self.function, self.has_error = (line, 0), function, has_error

    def child_by_field_name(self, name):
        return self.function if name == "function" else None


def test_structure_by_a_parser():
    from tallyrook.operators import exact

    code = 'x; /* é\n gets(a) */ free(p); s.free("q");'
    raw = code.encode()
    at = raw.index(b"free")
    name = Node("identifier", at, at + 4, line=1)
    member = Node("field_expression", raw.index(b"s.free"), raw.index(b"s.free") + 6, line=1)
    text_ = Node("string_literal", raw.index(b'"q"'), raw.index(b'"q"') + 3, line=1)
    root = Node("translation_unit", 0, len(raw), [Node("comment", 3, raw.index(b"*/") + 2), Node("call_expression", at, at + 7, [name], 1, name), Node("call_expression", 0, len(raw), [member, text_], 1, member)])
    masked, odd, calls = exact.shape(code, frozenset({"free", "gets"}), lambda _: root)
    assert not odd and calls == [(2, "free")] and len(masked) == len(code)
    assert masked == "x;     " + "\n" + " " * 11 + " free(p); s.free(   );"
    assert exact.by_line(code, calls) == [",,", ",free,"]


def test_long_literals_do_not_overflow(spark):
    code = wrapped('s = "' + 'a\\"' * 60000 + '"; /*' + "x*" * 60000 + "*/ strcpy(a, b);")
    assert judged(spark, code) == [("R002", True)]


def test_offsets_and_ranges_agree_with_bytes(spark):
    code = 'é();\r\n/* memcpy(é) */ memcpy(a);\n"memmove(x)"'
    df = spark.createDataFrame([(0, code)], "code_id long, code string")
    rows = syntax.offsets(scan.scan(df), df)
    at = sorted(r["offset"] for r in rows.collect())
    raw = code.encode()
    assert at == sorted([raw.index(b"memcpy"), raw.index(b"memcpy", 15), raw.index(b"memmove")])
    inside = syntax.in_skip(rows, syntax.skip_ranges(df)).collect()
    assert sorted(r["offset"] for r in inside) == [raw.index(b"memcpy"), raw.index(b"memmove")]


def test_verdict_grid(spark):
    cases = [(True, 0.9, "vulnerable"), (True, 0.1, "needs_review"), (False, 0.9, "needs_review"), (False, 0.1, "likely_safe"), (True, 0.5, "vulnerable")]
    df = spark.createDataFrame(cases, "c boolean, p double, v string")
    assert df.where(verdict.verdict(F.col("c"), F.col("p")) != F.col("v")).count() == 0


def test_tie_has_label_zero_and_passes_threshold(spark):
    code = spark.createDataFrame([(0, wrapped("gets(b);")), (1, "int x;")], "code_id long, code string")
    logits = spark.createDataFrame([(0, 1.0, 1.0), (1, 800.0, -800.0)], "code_id long, logit0 double, logit1 double")
    rows = {r["code_id"]: r for r in verdict.analyze(code, score.table_scorer(logits)).collect()}
    assert rows[0]["model_prediction"]["label"] == 0 and rows[0]["verdict"] == "vulnerable"
    assert rows[1]["regex_findings"] == [] and rows[1]["verdict"] == "likely_safe"


def test_missing_model_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        score.onnx_scorer(str(tmp_path / "m.onnx"), str(tmp_path / "t.json"))
