"""Column functions over lines, matches and byte positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a line for the scan; \r\n is one end.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_NOT_END = r"[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_BLANK = r"[\s\x{85}\p{Z}\x1c-\x1f]"


def lines(code: Column) -> Column:
    """Lines without their ends; no last empty line; "" has none."""
    parts = F.split(code, LINE_END, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_BLANK}+|{_BLANK}+\z", "")


#: Numbers added up at a time by `running_sums`.
_RUN = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: inside a higher-order function
    an outer expression is computed again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(numbers: Column) -> Column:
    """For each element of an array of integers the sum of those before it.
    Sums are made in runs, so the work hardly grows faster than the array."""
    zero = F.lit(0)

    def before(xs: Column) -> Column:
        return let(xs, lambda v: F.transform(v, lambda x, k: F.aggregate(F.slice(v, F.lit(1), k), zero, lambda s, y: s + y)))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int"))
        return F.transform(starts, lambda b: F.slice(v, b * _RUN + 1, F.lit(_RUN)))

    def joined(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, zero, lambda s, y: s + y))
        return F.flatten(F.zip_with(runs, before(totals), lambda r, s: F.transform(before(r), lambda x: x + s)))

    return let(numbers, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(F.array().cast("array<int>")))


def places(text: Column, pattern: str, size: Callable[[Column], Column] = F.length) -> Column:
    """array<struct<start, end>> of all matches of `pattern`, from 0; `size`
    measures text (in characters, or in bytes)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda a, b: F.struct(size(a).alias("gap"), size(b).alias("own")))

    def placed(p: Column) -> Column:
        sums = running_sums(F.transform(p, lambda x: x["gap"] + x["own"]))
        return F.zip_with(p, sums, lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["own"]).alias("end")))

    return let(pairs, placed)


def match_starts(text: Column, pattern: str) -> Column:
    """0-based positions (characters) of all matches of `pattern`."""
    return F.transform(places(text, pattern), lambda x: x["start"])


def blanked(text: Column, pattern: str) -> Column:
    """`text` with matches of `pattern` turned to spaces; line ends and length stay."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        F.split(text, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(F.regexp_replace(b, _NOT_END, " "), F.lit("")))
    )
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)


def newline_offsets(code: Column) -> Column:
    """Byte offset at which each line of `lines` starts, ends counted in."""
    body = F.split(code, LINE_END, -1)
    ends = F.regexp_extract_all(code, F.lit(LINE_END), F.lit(0))
    size = F.zip_with(body, ends, lambda a, b: F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0)))
    return F.slice(running_sums(size), F.lit(1), F.size(lines(code)))


def decode_utf8(content: Column) -> Column:
    """Bytes as text: undecodable ones become U+FFFD, line ends \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")
