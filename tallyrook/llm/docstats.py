"""Counts over whole texts, for all documents of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import base, textvec

#: Symbols that rules count.
SYMBOLS = b"#*$%&|<>"

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_same_as_previous", "n_upper", "n_letters", "n_digits", "n_marks",
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?=_~^+/\\{}[]")] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, offsets))


def _repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the same value stands elsewhere in the same document."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(h), bool)
    flag = np.zeros(len(h), bool)
    flag[1:] |= same
    flag[:-1] |= same
    out[order] = flag
    return out


def count(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The columns COUNTS of a chunk of documents."""
    n = len(offsets) - 1
    starts, ends, first = textvec.words(data, offsets, textvec.SPACE)
    n_words = np.diff(first)
    word_doc = np.repeat(np.arange(n), n_words)
    h = textvec.span_hashes(data, starts, ends)
    out = {"n_words": n_words}
    lead = (data & 0xC0) != 0x80
    out["word_chars"] = _per_doc(lead & ~textvec.SPACE[data], offsets)
    out["n_symbols"] = _per_doc(_SYMBOL[data], offsets)

    from_, to, _ = textvec.words(data, offsets, _NEWLINE)
    has_word = np.searchsorted(starts, to) > np.searchsorted(starts, from_)
    from_, to = from_[has_word], to[has_word]
    line_doc = np.searchsorted(offsets, from_, "right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    _, kept = textvec.distinct_in_doc(textvec.span_hashes(data, from_, to), line_doc)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(kept, minlength=n)

    in_window = np.zeros(len(h) + 1, np.int64)
    if len(h) >= window:
        whole = np.flatnonzero(word_doc[: len(h) - window + 1] == word_doc[window - 1 :])
        hits = whole[_repeated(textvec.window_hashes(h, window)[whole], word_doc[whole])]
        in_window += np.bincount(hits, minlength=len(h) + 1) - np.bincount(hits + window, minlength=len(h) + 1)
    covered = np.cumsum(in_window)[:-1] > 0
    out["n_repeat_words"] = np.bincount(word_doc[covered], minlength=n)
    _, kept = textvec.distinct_in_doc(h, word_doc)
    out["n_distinct_words"] = np.bincount(kept, minlength=n)
    again = np.flatnonzero((h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])) + 1 if len(h) else np.zeros(0, int)
    out["n_same_as_previous"] = np.bincount(word_doc[again], minlength=n)
    upper = (data - np.uint8(65)) < 26
    out["n_upper"] = _per_doc(upper, offsets)
    out["n_letters"] = _per_doc(upper | ((data - np.uint8(97)) < 26) | ((data >= 0xC3) & lead), offsets)
    out["n_digits"] = _per_doc((data - np.uint8(48)) < 10, offsets)
    out["n_marks"] = _per_doc(_MARK[data], offsets)
    return out


def _counts(texts: pa.Array) -> list[pa.Array]:
    data, offsets = textvec.text_buffer(texts)
    parts = [count(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in textvec.chunks(offsets)]
    return [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of `keep` and COUNTS (long) of each row of `docs`, in
    one pass without a shuffle.

    Null and empty texts count zero everywhere; rows with a null key stay; rows
    that repeat an id are counted one by one; an empty table gives no rows.
    Columns of `docs` that are not in `keep` are ignored, whatever their names;
    one of `keep` that is called like a result is an error.  Texts are counted in chunks of 1 MB;
    a longer text is a chunk of its own and takes some 25 bytes of memory for
    each of its bytes."""
    rows = base.packed(docs.withColumn("__text", F.col(f"`{text}`")), [key, "__text"], keep, [key, *COUNTS])
    out = base.measured(rows, "__text", _counts, ", ".join(f"{c} long" for c in COUNTS), "__counts")
    return out.select(F.col(f"`{key}`"), *base.unpacked(keep), "__counts.*")
