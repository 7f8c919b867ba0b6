"""Layer 2: does the structure of the code confirm a match?

Where a parser for the language can be imported, it reads the structure (see
`exact`).  Else it is read lexically, by built-in expressions: literals and
comments are blanked, directives too, and calls are told from declarations by
what stands around the name.  `validator` says which reading was used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.functions import text
from tallyrook.operators import exact, scan
from tallyrook.operators.rules import RULES, SPACE, WORD

VALIDATOR = "lexical"

_REST = r"(?:\\[\s\S][^%s\\\n]*+)*+"
#: One literal or comment: line comment, block comment, raw string, string, character.
TOKEN = "|".join(
    (
        r"//[^\n\\]*+(?:\\[\s\S][^\n\\]*+)*+",
        r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/",
        r'(?:u8|[uUL])?R"([^ ()\\\t\x0b\f\n]{0,16})\([\s\S]*?\)\1"',
        r'(?:u8|[uUL])?"[^"\\\n]*+' + _REST % '"' + '"',
        r"(?:u8|[uUL])?'[^'\\\n]*+" + _REST % "'" + "'",
    )
)
DIRECTIVE = r"(?m)^[ \t]*#[^\n\\]*+(?:\\[\s\S][^\n\\]*+)*+"
#: Words that may stand before a call though they look like a type.
LEADING = rf"(?<!{WORD})(?:return|else|do|case|throw|co_return|co_await|co_yield|and|or|not|xor|compl|bitand|bitor|sizeof|delete|noexcept)(?!{WORD})"
NAMES = tuple(r.func_name for r in RULES if r.func_name)
_ARGUMENTS = r"[^()]*+(?:\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)[^()]*+)*+\)"
#: A name before arguments that no body follows.
CALL = rf"(?<!{WORD})({'|'.join(NAMES)}){SPACE}*\((?!{_ARGUMENTS}{SPACE}*+\{{)"
#: What stands before a name that is declared, or that is no plain name: a word
#: (its type); a member, scope or destructor sign; a statement that so far is
#: words, with or without angle brackets, and pointer or reference signs.
NOT_CALLED = (
    rf"(?:{WORD}{SPACE}++|\.{SPACE}*+|->{SPACE}*+|::{SPACE}*+|~{SPACE}*+"
    rf"|[;{{}}]{SPACE}*+(?:(?:{WORD}|::)++{SPACE}*+)++(?:<(?:[^;{{}}()=<>]|<[^;{{}}()=<>]*+>)*+>{SPACE}*+(?:[*&]{SPACE}*+)*+|(?:[*&]{SPACE}*+)++))\z"
)

PARSE_ERROR = "parse error: the match is kept as it is"
IN_SKIP = "rejected: inside a comment or literal"
IN_CODE = "confirmed: outside comments and literals"


def _balance(masked: Column, opening: str, closing: str) -> Column:
    return F.length(F.regexp_replace(masked, f"[^{opening}]", "")) - F.length(F.regexp_replace(masked, f"[^{closing}]", ""))


def parse_error(masked: Column) -> Column:
    """Brackets don't pair up, or a literal or comment doesn't end."""
    odd = (_balance(masked, r"\(", r"\)") != 0) | (_balance(masked, r"\[", r"\]") != 0) | (_balance(masked, r"\{", r"\}") != 0)
    return odd | masked.rlike(r"""["']|/\*""")


#: Stands before a called name in marked text; a noncharacter.
_MARK = "\uffff"


def called(plain: Column) -> Column:
    """array<string>: for each line of text without literals, comments and
    directives, the known names called on it, each between commas; lines end at
    \\n only."""
    code = F.concat(F.lit(";"), F.regexp_replace(F.translate(plain, _MARK, " "), LEADING, "="))

    def marked(text_: Column) -> Column:
        whole = F.regexp_extract_all(text_, F.lit(CALL), F.lit(0))
        before = F.slice(F.split(text_, CALL, -1), F.lit(1), F.size(whole))
        return F.array_join(F.zip_with(before, whole, lambda a, b: F.concat(a, F.when(a.rlike(NOT_CALLED), b).otherwise(F.concat(F.lit(_MARK), b)))), "")

    name = f"{_MARK}({'|'.join(NAMES)})"
    ends = F.split(text.let(code, marked), "\n", -1)
    return F.transform(ends, lambda x: F.concat(F.lit(","), F.array_join(F.regexp_extract_all(x, F.lit(name), F.lit(1)), ","), F.lit(",")))


def calls(named: Column) -> Column:
    """array<struct<line, name>> of such an array."""
    return F.flatten(F.transform(named, lambda x, k: F.transform(F.filter(F.split(x, ","), lambda n: n != ""), lambda n: F.struct((k + 1).alias("line"), n.alias("name")))))


def _read(code: DataFrame, column: str) -> DataFrame:
    """`code` with masked (literals and comments blank), odd (a parse error)
    and called."""
    if exact.available():
        return exact.read(code, column, NAMES)
    rows = code.withColumn("masked", text.blanked(F.col(column), TOKEN))
    return rows.withColumns({"called": called(text.blanked(F.col("masked"), DIRECTIVE)), "odd": parse_error(F.col("masked"))})


def validator() -> str:
    return exact.VALIDATOR if exact.available() else VALIDATOR


def structure(code: DataFrame, key: str = "code_id", column: str = "code") -> DataFrame:
    """key, masked (literals and comments blank), parse_error, calls."""
    return _read(code.select(key, column), column).select(key, "masked", F.col("odd").alias("parse_error"), "called", calls(F.col("called")).alias("calls"))


def skip_ranges(code: DataFrame, key: str = "code_id", column: str = "code") -> DataFrame:
    """key, start, end: byte ranges of literals and comments."""
    return code.select(key, F.explode(text.places(F.col(column), TOKEN, F.octet_length)).alias("r")).select(key, "r.start", "r.end")


def line_start_bytes(code: DataFrame, key: str = "code_id", column: str = "code") -> DataFrame:
    """key, line (from 1), start_byte."""
    return code.select(key, F.posexplode(text.newline_offsets(F.col(column))).alias("line", "start_byte")).withColumn("line", F.col("line") + 1)


def offsets(findings: DataFrame, code: DataFrame, key: str = "code_id", column: str = "code") -> DataFrame:
    """`findings` with the byte offset of each match."""
    starts = code.select(key, F.posexplode(F.arrays_zip(text.lines(F.col(column)).alias("text"), text.newline_offsets(F.col(column)).alias("start"))).alias("line", "l"))
    starts = starts.select(key, (F.col("line") + 1).alias("line"), F.col("l.text").alias("__text"), F.col("l.start").alias("__start"))
    out = findings.join(starts, [key, "line"])
    return out.withColumn("offset", F.col("__start") + F.octet_length(F.substring("__text", 1, F.col("col")))).drop("__text", "__start")


def in_skip(findings: DataFrame, ranges: DataFrame, key: str = "code_id") -> DataFrame:
    """Findings (with `offset`) inside a skip range: a range semi join on key."""
    inside = (F.col("f.offset") >= F.col("r.start")) & (F.col("f.offset") < F.col("r.end"))
    return findings.alias("f").join(ranges.alias("r"), (F.col(f"f.{key}") == F.col(f"r.{key}")) & inside, "left_semi")


def _judged(f: Column, parse_error_: Column, called_: Column, masked_lines: Column) -> tuple[Column, Column]:
    """confirmed and reason of a finding.  A named finding holds if that name is
    called on its line (lines ending at \\n), whatever the match; one without a
    name holds outside literals and comments; where the code doesn't parse, all
    hold."""
    name = f["func_name"]
    called = F.coalesce(F.get(called_, f["line"] - 1).contains(F.concat(F.lit(","), name, F.lit(","))), F.lit(False))
    plain = F.substring(F.element_at(masked_lines, f["line"]), f["col"] + 1, F.lit(1)) != " "
    confirmed = F.when(parse_error_, True).when(name.isNotNull(), called).otherwise(plain)
    reason = (
        F.when(parse_error_, PARSE_ERROR)
        .when(name.isNotNull() & called, F.concat(F.lit("confirmed: "), name, F.lit(" is called on this line")))
        .when(name.isNotNull(), F.concat(F.lit("rejected: no call of "), name, F.lit(" on this line")))
        .when(plain, IN_CODE)
        .otherwise(IN_SKIP)
    )
    return confirmed, reason


def validated(code: DataFrame, key: str = "code_id", column: str = "code", keep: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """key, `keep` and findings with confirmed and reason, one array per row of
    `code`: scan and structure of a text meet in its own row, without a join.
    texts: with match_text, the whole line for each of its matches."""
    rows = _read(code.select(key, *keep, F.col(column).alias("__code"), scan.findings(F.col(column), texts=texts).alias("f")), "__code")
    rows = rows.withColumn("lines", text.lines(F.col("masked")))

    def judged(f: Column) -> Column:
        confirmed, reason = _judged(f, F.col("odd"), F.col("called"), F.col("lines"))
        return F.struct(*[f[c].alias(c) for c in scan.FIELDS if texts or c != "match_text"], confirmed.alias("confirmed"), reason.alias("reason"))

    return rows.select(key, *keep, F.transform("f", judged).alias("findings"))


def validate(findings: DataFrame, code: DataFrame, key: str = "code_id", column: str = "code") -> DataFrame:
    """`findings` (rows, from anywhere) with confirmed, reason and validator: one
    equi join on the key.  `validated` needs none."""
    shape = structure(code, key, column).withColumn("lines", text.lines(F.col("masked"))).drop("masked", "calls")
    rows = findings.join(shape, key)
    f = {c: F.col(c) for c in ("line", "col", "func_name")}
    confirmed, reason = _judged(f, F.col("parse_error"), F.col("called"), F.col("lines"))
    return rows.select(*findings.columns, confirmed.alias("confirmed"), reason.alias("reason"), F.lit(validator()).alias("validator"))
