"""Token ids of whole texts by the tokenizers library, one word at a time.

Vocabularies that normalise and split without looking across spaces and line
feeds (their pattern never joins white space with what follows, and no
white-space character composes with a mark) are encoded word by word: the ids
of a text are those of its words one after another, and every distinct word is
encoded by the library once (see `wordtable`).  Their pattern also always ends
a match between a letter, a digit and another printable character of ASCII, but
for an apostrophe before letters, so words are cut there too.  Whether a
vocabulary is of this kind is read from its file; of any other one whole texts
are encoded.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tallyrook.llm import textvec
from tallyrook.llm.wordtable import WordTable

GAP = np.zeros(256, bool)
GAP[[0x20, 0x0A]] = True
#: Words that the library encodes as one text.
JOINED = 200
#: ASCII by what the pattern sees in it; 0: never cut beside it.
_LETTER, _DIGIT, _SIGN, _APOSTROPHE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x27] = _APOSTROPHE
#: By 8 * kind + next kind, whether a match always ends between the two.
_CUT = np.zeros(64, bool)
for _a, _b in ("12", "21", "22", "13", "31", "23", "32", "14", "24", "42"):
    _CUT[8 * int(_a) + int(_b)] = True
#: Normalisers that look at one character or at white space only, or compose marks.
_LOCAL = {"NFC", "Lowercase"}
#: A splitting pattern whose matches hold no white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_words(path: str) -> bool:
    """Whether ids of a text are those of its words, as far as the file tells."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    def local(n: dict) -> bool:
        return n["type"] in _LOCAL or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ")

    splits = steps(spec.get("pre_tokenizer"), "pretokenizers")
    return (
        all(map(local, steps(spec.get("normalizer"), "normalizers")))
        and bool(splits)
        and splits[0].get("type") == "Split"
        and splits[0]["pattern"] == {"Regex": _PATTERN}
        and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"] is True
        and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in splits[1:])
        and {"type": "Lowercase"} in steps(spec.get("normalizer"), "normalizers")
        and not any(set(t["content"]) & set(" \n\t\r") or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )


class ChunkEncoder:
    """Ids as unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.by_words = by_words(path)
        self.model = self.tokenizer.model
        self.table = WordTable(self._learn)
        self.tokens = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, words: list[tuple[bytes, int]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        plain: list[int] = []  # of small ASCII letters: nothing to normalise or split
        rest: list[int] = []
        for k, (w, _) in enumerate(words):
            (plain if w.isalpha() and w.islower() else rest).append(k)
        flat: list[int] = []
        size: list[int] = []
        for k in plain:
            got = self.model.tokenize(words[k][0].decode())
            flat += [t.id for t in got]
            size.append(len(got))
        for k in range(0, len(rest), JOINED):
            some = [words[i][0].decode() for i in rest[k : k + JOINED]]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begin = np.cumsum([0] + [len(c) + 1 for c in some])
            flat += e.ids
            size += np.diff(np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), begin)).tolist()
        return plain + rest, np.array(flat, np.uint32), np.array(size, np.int32)

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, and the text in lower case, which gives the same ids.  Words
        that may hold an added token stay whole and as they are."""
        low = textvec.lower_ascii(data)
        kind = _KIND[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = _CUT[(kind[:-1] << np.uint8(3)) + kind[1:]]
        raw = data.tobytes()
        held = [m.start() for t in self.tokens for m in re.finditer(re.escape(t), raw)]
        if held:
            starts, ends, _ = textvec.words(data, offsets, GAP)
            for k in np.unique(np.searchsorted(starts, held, "right") - 1).tolist():
                a, b = starts[k], ends[k]
                cut[a:b], low[a:b] = False, data[a:b]
        return *textvec.words(low, offsets, GAP, cut), low

    def encode_buffer(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end."""
        if not self.by_words:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ids = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)
        starts, ends, first, data = self._cut(data, offsets)
        ids, size = self.table.encode(data, starts, ends)
        return ids, np.concatenate([[0], np.cumsum(size)])[first[1:]].astype(np.int64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            ids, ends = self.encode_buffer(*textvec.text_buffer(pa.array(texts, pa.string())))
        return np.split(ids, ends[:-1]) if len(ends) else []

    def counts(self, texts: list[str]) -> list[int]:
        with np.errstate(over="ignore"):
            _, ends = self.encode_buffer(*textvec.text_buffer(pa.array(texts, pa.string())))
        return np.diff(ends, prepend=0).tolist()


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
