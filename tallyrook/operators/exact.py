"""The structure of code by a real parser, where one can be imported.

A kernel parses each text once and gives what the lexical reading gives: the
text with literals and comments blank, whether it doesn't parse, and the calls
of known names by line.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALIDATOR = "parser"
# Node types of the grammar that hold no code.
SKIPPED = ("comment", "string_literal", "char_literal", "raw_string_literal")


def available() -> bool:
    return all(importlib.util.find_spec(m) is not None for m in ("tree_sitter", "tree_sitter_cpp"))


@lru_cache(maxsize=1)
def _parser() -> Callable[[bytes], object]:
    import tree_sitter
    import tree_sitter_cpp

    parser = tree_sitter.Parser(tree_sitter.Language(tree_sitter_cpp.language()))
    return lambda code: parser.parse(code).root_node


def shape(code: str, names: frozenset[str], parse: Callable[[bytes], object]) -> tuple[str, bool, list[tuple[int, str]]]:
    """masked, whether there is a parse error, (line, name) of calls in order."""
    raw = code.encode()
    root = parse(raw)
    masked, found, todo = bytearray(raw), [], [root]
    while todo:  # in text order, without recursion: nesting can be deep
        node = todo.pop()
        if node.type in SKIPPED:
            kept = "".join(c if c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029" else " " * len(c.encode()) for c in raw[node.start_byte : node.end_byte].decode("utf-8", "replace"))
            masked[node.start_byte : node.end_byte] = kept.encode()[: node.end_byte - node.start_byte]
            continue
        if node.type == "call_expression":
            name = node.child_by_field_name("function")
            if name is not None and name.type == "identifier" and (word := raw[name.start_byte : name.end_byte].decode("utf-8", "replace")) in names:
                found.append((name.start_point[0] + 1, word))
        todo.extend(reversed(node.children))
    return _same_length(code, raw, bytes(masked)), bool(root.has_error), found


def by_line(code: str | None, calls: list[tuple[int, str]] | None) -> list[str] | None:
    """For each line the names called on it, each between commas."""
    if code is None:
        return None
    out: list[list[str]] = [[] for _ in range(code.count("\n") + 1)]
    for line, name in calls or []:
        out[line - 1].append(name)
    return [",".join(["", *names, ""]) if names else ",," for names in out]


def _same_length(code: str, raw: bytes, masked: bytes) -> str:
    """One character for each of `code`: a blank for those that were blanked."""
    if len(code) == len(raw):
        return masked.decode()
    out, at = [], 0
    for c in code:
        n = len(c.encode())
        out.append(c if masked[at : at + n] == raw[at : at + n] else " ")
        at += n
    return "".join(out)


def read(code: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """`code` with masked, odd and called."""
    known = frozenset(names)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [(None, None, None) if t is None else shape(t, known, _parser()) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([by_line(t, r[2]) for t, r in zip(batch.to_pylist(), rows, strict=True)], pa.list_(pa.string()))], names=["masked", "odd", "called"])

    made = F.arrow_udf(run, "masked string, odd boolean, called array<string>").asNondeterministic()
    return code.withColumn("__shape", made(F.col(column))).select("*", "__shape.*").drop("__shape")
