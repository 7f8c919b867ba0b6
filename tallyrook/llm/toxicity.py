"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult (with a weight), threat verb, target,
negation, reporting verb, anything else.  Small weighted transducers for
insult, threat, target, negation and reported speech run side by side; their
composition reads a clause once and gives the weight of the clause's best
match.  A document's score is a logistic function of its matched clauses, not
of isolated words.

The insult transducer's arcs are a fixed public vocabulary and words and word
beginnings that labelled training rows mark (log odds over documents); the
logistic is fitted on the same bounded sample, on scores by arcs that were
learned without the scored rows.

Null and empty texts have no clause and get the score of no match.  Rows with a
null id are scored but never train; rows that repeat an id are scored one by
one, of labels that repeat one the largest holds.  Without labels of both kinds
the fixed weights hold.  Equal odds are ordered by documents, then by hash.  A
text of over 1 MB is a chunk of its own.  An empty table gives no rows.  A
column to keep that is called like a result is an error, other columns may have
any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import base, textvec

#: Most labelled rows that a fit reads.
TRAINING_ROWS = 20_000
#: Most learned arcs, and what an arc needs: toxic documents, log odds.
ARCS, ARC_DOCS, ARC_ODDS = 20_000, 4, 3.0
#: Lengths in bytes of the word beginnings that may become arcs.
STEMS = (5, 6, 7, 8)
#: Parts of the sample that take turns in being scored but not learned from.
FOLDS = 3

# Fixed vocabularies.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile fool dumb garbage filth vermin".split()
THREATS = "kill hurt destroy beat smash attack stab shoot burn punch".split()
TARGETS = "you your he she they them him her his their ihr du ihn sie tu vous ils elle usted ustedes ellos vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine pas jamais nunca".split()
REPORTS = "said says called calls quoted claimed wrote reported alleged according sagte dit dijo".split()

INSULT, THREAT, TARGET, NEGATION, REPORT = 1, 2, 3, 4, 5

GAP = np.ones(256, bool)
GAP[[0x27, *range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_END = np.zeros(256, bool)
_END[list(b".!?;\n")] = True


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, class) -> (state, factor, add); a class without an arc keeps
    the state.  All states accept; weight starts at 0."""

    name: str
    arcs: dict[tuple[int, int], tuple[int, float, float]] = field(default_factory=dict)

    def step(self, state: int, kind: int) -> tuple[int, float, float]:
        return self.arcs.get((state, kind), (state, 1.0, 0.0))


#: insult: each insult adds its weight; threat: a threat verb counts with a
#: target only; target: a target beside an insult strengthens it; negation and
#: report: what follows counts less, until an insult or threat used it up.
GRAMMAR = (
    Transducer("insult", {(0, INSULT): (0, 1.0, 1.0)}),
    Transducer("threat", {(0, THREAT): (1, 1.0, 0.2), (1, TARGET): (0, 1.0, 1.3), (0, TARGET): (2, 1.0, 0.0), (2, THREAT): (0, 1.0, 0.6)}),
    Transducer("target", {(0, TARGET): (1, 1.0, 0.0), (1, INSULT): (1, 1.5, 0.0)}),
    Transducer("negation", {(0, NEGATION): (1, 1.0, 0.0), (1, INSULT): (0, 0.5, 0.0), (1, THREAT): (0, 0.5, 0.0)}),
    Transducer("report", {(0, REPORT): (1, 1.0, 0.0), (1, INSULT): (1, 0.6, 0.0), (1, THREAT): (1, 0.6, 0.0)}),
)


def composed(grammar: tuple[Transducer, ...] = GRAMMAR) -> dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], float, float]]:
    """The product machine: factors multiply, additions add."""
    start = tuple(0 for _ in grammar)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for kind in (INSULT, THREAT, TARGET, NEGATION, REPORT):
            steps = [t.step(s, kind) for t, s in zip(grammar, state, strict=True)]
            to = tuple(s for s, _, _ in steps)
            arcs[state, kind] = (to, math.prod(f for _, f, _ in steps), sum(a for _, _, a in steps))
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return arcs


@dataclass
class Lexicon:
    """Word and stem hashes with class and weight."""

    keys: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(entries: dict[int, tuple[int, float]]) -> Lexicon:
        keys = np.array(sorted(entries), np.uint64)
        return Lexicon(keys, np.array([entries[int(k)][0] for k in keys], np.int64), np.array([entries[int(k)][1] for k in keys], float))


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    with np.errstate(over="ignore"):
        return int(textvec.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


_STEM = np.uint64(0x5851F42D4C957F2D)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the whole words, then of their beginnings (0 for words that
    are not longer)."""
    out = [textvec.span_hashes(data, starts, ends)]
    for k in STEMS:
        h = textvec.span_hashes(data, starts, np.minimum(starts + k, ends)) ^ _STEM
        out.append(np.where(ends - starts > k, h, np.uint64(0)))
    return out


def fixed_lexicon() -> dict[int, tuple[int, float]]:
    out = {}
    for kind, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)):
        out |= {hash_of(w): (kind, 1.0) for w in words}
    return out


def clause_scores(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, machine: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: matched clauses, sum of log1p of their weights, largest weight."""
    n = len(offsets) - 1
    matched, total, most = np.zeros(n), np.zeros(n), np.zeros(n)
    data = textvec.lower_ascii(data)
    starts, ends, first = textvec.words(data, offsets, GAP)
    look = textvec.Lookup(lexicon.keys)
    kinds, weights = np.zeros(len(starts), np.int64), np.zeros(len(starts))
    for h in reversed(_features(data, starts, ends)):
        at = look(h)
        hit = np.flatnonzero(at >= 0)
        kinds[hit], weights[hit] = lexicon.kinds[at[hit]], lexicon.weights[at[hit]]
    core = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    if not len(core):
        return matched, total, most
    doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    clause = np.searchsorted(np.flatnonzero(_END[data]), starts) + doc  # also a document's end ends a clause
    use = np.flatnonzero((kinds > 0) & np.isin(clause, clause[core]))
    start = tuple(0 for _ in GRAMMAR)
    state, score, at = start, 0.0, -1

    def close(d: int) -> None:
        if score > 0:
            matched[d] += 1
            total[d] += math.log1p(score)
            most[d] = max(most[d], score)

    last = -1
    for c, k, w, d in zip(clause[use].tolist(), kinds[use].tolist(), weights[use].tolist(), doc[use].tolist(), strict=True):
        if c != at:
            if at >= 0:
                close(last)
            state, score, at, last = start, 0.0, c, d
        state, factor, add = machine[state, k]
        score += add * factor * (w if k == INSULT else 1.0)
    close(last)
    return matched, total, most


def _scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`docs` with the struct __s: matched, total, most, size."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(texts: pa.Array) -> list[pa.Array]:
        machine, parts = composed(), [[np.zeros(0)] * 4]
        data, offsets = textvec.text_buffer(texts)
        for i, j in textvec.chunks(offsets):
            got = clause_scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value, machine)
            parts.append([*got, np.diff(offsets[i : j + 1]).astype(float)])
        return [pa.array(np.concatenate([p[k] for p in parts])) for k in range(4)]

    return base.measured(docs, "text", run, "matched double, total double, most double, size double", "__s")


def folded(sample: DataFrame) -> DataFrame:
    return sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))


def learned(docs: DataFrame, sample: DataFrame) -> list[dict[int, tuple[int, float]]]:
    """Insult arcs from the labelled sample (doc_id, y, fold): hashes of words
    and stems that toxic documents have and others hardly do.  One lexicon for
    each fold, learned without it, and at the end that of the whole sample."""
    base.ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select((F.col("y") * FOLDS + F.col("fold")).cast("int").alias("cell"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                cell = batch.column(0).to_numpy(zero_copy_only=False)
                data, offsets = textvec.text_buffer(batch.column(1))
                for i, j in textvec.chunks(offsets):
                    part, off = textvec.lower_ascii(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                    starts, ends, first = textvec.words(part, off, GAP)
                    doc = np.repeat(np.arange(j - i), np.diff(first))
                    seen = _features(part, starts, ends)
                    h, doc = np.concatenate(seen), np.concatenate([doc] * len(seen))
                    h, doc = textvec.distinct_in_doc(h[h != 0], doc[h != 0])
                    keys, at = np.unique(h, return_inverse=True)
                    where, counts = np.unique(at * 2 * FOLDS + cell[i:j][doc], return_counts=True)
                    columns = [pa.array(keys[where // (2 * FOLDS)].view(np.int64)), pa.array((where % (2 * FOLDS)).astype(np.int32)), pa.array(counts.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "cell", "n"])

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    counts = rows.mapInArrow(run, "key long, cell int, n long").groupBy("key").agg(*cells)
    sizes = {(r["y"], r["fold"]): r["count"] for r in sample.groupBy("y", "fold").count().collect()}
    out = []
    for left_out in range(FOLDS + 1):
        use = [f for f in range(FOLDS) if f != left_out]
        total = [sum(sizes.get((y, f), 0) for f in use) for y in (0, 1)]
        clean, toxic = (sum((F.col(f"c{y * FOLDS + f}") for f in use), F.lit(0)) for y in (0, 1))
        odds = F.log((toxic + 0.5) / (total[1] + 1.0)) - F.log((clean + 0.5) / (total[0] + 1.0))
        out.append((total, toxic.alias("toxic"), odds.alias("odds")))
    able = F.lit(False)
    for _, toxic, odds in out:
        able = able | ((toxic >= ARC_DOCS) & (odds >= ARC_ODDS))
    counts = base.saved(counts.where(able), "arcs")
    found = []
    for total, toxic, odds in out:
        top = counts.select("key", toxic, odds).where((F.col("toxic") >= ARC_DOCS) & (F.col("odds") >= ARC_ODDS))
        rows = top.orderBy(F.desc("odds"), F.desc("toxic"), "key").limit(ARCS).collect() if all(total) else []
        found.append({int(np.int64(r["key"]).view(np.uint64)): (INSULT, r["odds"] / 6.0) for r in rows})
    base.dropped(counts)
    return found


def _terms() -> list[Column]:
    words = F.col("__s.size") / 600.0
    return [F.lit(1.0), F.log1p("__s.total"), F.least(F.col("__s.most"), F.lit(3.0)), F.log1p(F.col("__s.total") / (words + 1.0) * 4.0)]


#: Weights of the logistic without labels.
DEFAULT = np.array([-3.0, 1.5, 1.5, 0.5])


def calibrated(scores: DataFrame) -> np.ndarray:
    """Ridge logistic regression by Newton steps over the bounded sample's
    scores (y, __s)."""
    rows = scores.select("y", *[t.alias(f"t{i}") for i, t in enumerate(_terms())]).toPandas()
    if rows["y"].nunique() < 2:
        return DEFAULT
    x, y = rows.drop(columns="y").to_numpy(float), rows["y"].to_numpy(float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1)) * len(y) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def classify(docs: DataFrame, labels: DataFrame, training: Column, keep: tuple[str, ...] = (), limit: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, `keep`, score of every row of `docs`.  The logistic is fitted on
    scores by arcs that were learned without the scored fold."""
    sample = folded(base.labelled_sample(labels, "toxic", training, limit))
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    arcs = learned(docs, sample)
    lexicons = [Lexicon.of(a | fixed_lexicon()) for a in arcs]
    held = [_scores(known.where(F.col("fold") == k), lexicons[k]) for k in range(FOLDS)]
    weights = calibrated(reduce(DataFrame.union, held))
    odds = sum((F.lit(float(w)) * t for w, t in zip(weights[1:], _terms()[1:], strict=True)), F.lit(float(weights[0])))
    out = _scores(base.packed(docs, ["doc_id", "text"], keep, ["doc_id", "score"]), lexicons[FOLDS])
    return out.select("doc_id", *base.unpacked(keep), (1 / (1 + F.exp(-odds))).alias("score"))
