"""N-gram Jaccard join by prefix filters under several global token orders.

Two documents link when den * |A & B| >= num * |A | B| over their sets of
distinct word shingles.  Under any global order of tokens, linked sets share a
token among the first n - ceil(num * n / den) + 1 of each (its prefix).

1. Equal sets collapse to their smallest id (a sum fingerprint of 128 bits).
2. Order A is a hash order with tokens of many documents moved to the end.
   Which those are is counted over all prefixes, again after each move, so that
   any order results is valid and a passage that many documents share leaves
   the prefixes.  Documents that share a prefix token of at most GROUP members
   become candidate pairs.
3. A pair must pass orders A, B and C: in each, the tokens up to the smaller of
   the two prefixes' ends are known on both sides; those not shared bound the
   overlap from above.  Only pairs that all three let through are verified on
   whole sets.
4. Tokens of more than GROUP members (large groups of near copies): members are
   compared with the group's most central document, links contracted to
   components, and only pairs that could still join two components are looked
   at: by exact document frequencies among the members left, a prefix in
   ascending frequency, the sizes that the tokens shared with anyone allow, and
   different components.  No pair is dropped for a group's size.

The result needs links only up to connectivity, so pairs inside a component
are never listed.  Nulls: a null or wordless text has an empty set and links
with nothing; a null id links with nothing and has a null component.  Rows that
repeat an id count as one node with several sets.  Ties in any order are broken
by hash or id.  An empty table gives no rows; other columns are ignored,
whatever their names; a long text's set is held whole by one worker.  Shingles
are told by 64-bit hashes, equal sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import base, textvec
from tallyrook.llm.components import components

#: Members up to which a token's documents are paired directly.
GROUP = 16
#: Most tokens that the order moves to the end (8 bytes each are broadcast);
#: others of many documents go through step 4.
MOVED = 1_000_000
ROUNDS = 3

_SEEDS = tuple(np.uint64(x) for x in (0x8F1BBCDCBFA53E0B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TOP = np.uint64(1 << 63)


@dataclass(frozen=True)
class Likeness:
    size: int = 4
    num: int = 85
    den: int = 100
    gap: tuple[bool, ...] = tuple(textvec.SPACE.tolist())

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (self.num * n + self.den - 1) // self.den + 1

    def needed(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.den + self.num))


def sets(data: np.ndarray, offsets: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, repeats included, and their documents."""
    data = textvec.lower_ascii(data)
    starts, ends, first = textvec.words(data, offsets, np.array(like.gap))
    return textvec.shingles(textvec.span_hashes(data, starts, ends), first, like.size)


def _sets_of(batch: pa.RecordBatch, like: Likeness) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = textvec.text_buffer(batch.column(1))
    for i, j in textvec.chunks(offsets):
        h, doc = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], like)
        yield i, j, h, doc


def order(h: np.ndarray, k: int) -> np.ndarray:
    return textvec.mix(h ^ _SEEDS[k])


def fingerprints(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, n (size of the set), fa, fb (fingerprint of the set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, h, doc in _sets_of(batch, like):
                    h, doc = textvec.distinct_in_doc(h, doc)
                    n = np.bincount(doc, minlength=j - i)
                    first = np.cumsum(n) - n
                    sums = []
                    for k in (0, 1):
                        s = np.zeros(j - i, np.uint64)
                        s[n > 0] = np.add.reduceat(order(h, k), first[n > 0]) if len(h) else 0
                        sums.append(pa.array(s.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), *sums], names=["doc_id", "n", "fa", "fb"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(base.trimming(run), "doc_id long, n long, fa long, fb long")


def _prefixes(docs: DataFrame, like: Likeness, moved: np.ndarray, ahead: bool) -> DataFrame:
    """Prefix tokens under order A with `moved` last: token, doc_id, n, moved
    (of the token), own (other tokens in the prefix).  ahead: instead, of
    documents with a moved token in their prefix before the move, the tokens
    that come in, and as many again."""
    shared = docs.sparkSession.sparkContext.broadcast(moved)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = textvec.Lookup(shared.value)
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for i, j, h, doc in _sets_of(batch, like):
                    key = order(h, 0) >> np.uint64(1)
                    is_late = late(h) >= 0
                    h, doc = textvec.distinct_in_doc(h, doc, np.where(is_late, key | _TOP, key))
                    is_late = late(h) >= 0
                    n = np.bincount(doc, minlength=j - i)
                    at = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
                    p = like.prefix(n)
                    if ahead:
                        # tokens before the move: those whose key is below the p-th smallest
                        plain = order(h, 0) >> np.uint64(1)
                        by = np.lexsort((plain, doc))
                        was = np.empty(len(h), np.int64)
                        was[by] = np.arange(len(h)) - (np.cumsum(n) - n)[doc[by]]
                        gone = np.bincount(doc[is_late & (was < p[doc])], minlength=j - i)
                        use = (at < p[doc] + gone[doc]) & (was >= p[doc]) & ~is_late & (gone[doc] > 0)
                    else:
                        use = at < p[doc]
                    own = np.bincount(doc[use & ~is_late], minlength=j - i)
                    d = doc[use]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[use].view(np.int64)), pa.array(ids[i:j][d], pa.int64()), pa.array(n[d], pa.int32()), pa.array(is_late[use]), pa.array(own[d], pa.int32())],
                        names=["token", "doc_id", "n", "moved", "own"],
                    )

    return docs.select("doc_id", "text").mapInArrow(base.trimming(run), "token long, doc_id long, n int, moved boolean, own int")


def _heavy(tokens: DataFrame, limit: int) -> np.ndarray:
    top = tokens.groupBy("token").count().where(F.col("count") > GROUP).orderBy(F.desc("count"), "token").limit(limit).select("token")
    top = base.saved(top, "heavy")
    rows = top.toPandas()
    base.dropped(top)
    return rows["token"].to_numpy(np.int64).view(np.uint64)


def moved_tokens(docs: DataFrame, like: Likeness) -> np.ndarray:
    found = _heavy(_prefixes(docs, like, np.zeros(0, np.uint64), False).select("token"), MOVED)
    for _ in range(ROUNDS):
        if not len(found) or len(found) >= MOVED:
            break
        more = np.setdiff1d(_heavy(_prefixes(docs, like, found, True).select("token"), MOVED - len(found)), found)
        if not len(more):
            break
        found = np.concatenate([found, more])
    return found


def _sketches(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, n and, for three orders, the first 32 bits of the prefix keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, h, doc in _sets_of(batch, like):
                    h, doc = textvec.distinct_in_doc(h, doc)
                    n = np.bincount(doc, minlength=j - i)
                    end = np.cumsum(n)
                    p = like.prefix(n)
                    out = []
                    keys = []
                    for k in range(3):
                        key = order(h, k)
                        keys.append((key[np.lexsort((key, doc))] >> np.uint64(32)).astype("<u4"))
                    for d in range(j - i):
                        at = end[d] - n[d]
                        out.append(b"".join(key[at : at + p[d]].tobytes() for key in keys) if n[d] else b"")
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "n", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(base.trimming(run), "doc_id long, n int, sketch binary")


def _whole_sets(docs: DataFrame, like: Likeness) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, h, doc in _sets_of(batch, like):
                    h, doc = textvec.distinct_in_doc(h, doc)
                    n = np.bincount(doc, minlength=j - i)
                    end = np.cumsum(n)
                    out = [h[end[d] - n[d] : end[d]].astype("<u8").tobytes() for d in range(j - i)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, pa.binary())], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(base.trimming(run), "doc_id long, tokens binary")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection of two sorted arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def passes(na: int, sa: bytes, nb: int, sb: bytes, like: Likeness) -> bool:
    """Whether no order's prefixes rule the pair out."""
    need = like.needed(na, nb)
    a, b = np.frombuffer(sa, "<u4").reshape(3, -1), np.frombuffer(sb, "<u4").reshape(3, -1)
    for x, y in zip(a, b, strict=True):
        end = min(x[-1], y[-1])
        x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
        s = _shared(x, y)
        if min(na - len(x), nb - len(y)) + s < need:
            return False
    return True


def _paired(pairs: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    a = right.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in names])
    b = right.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names])
    return pairs.join(a, "a").join(b, "b")


def verified(pairs: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """(a, b) of `pairs` that link: filtered by the three orders, then exactly."""

    def ids(p: DataFrame) -> DataFrame:
        return p.select(F.col("a").alias("doc_id")).union(p.select("b")).distinct()

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = x.column(0), x.column(1)
            rows = zip(x.column(2).to_pylist(), x.column(3).to_pylist(), x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True)
            keep = pa.array([passes(na, sa, nb, sb, like) for na, sa, nb, sb in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for ta, tb in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                m, n = len(ta) // 8, len(tb) // 8
                s = _shared(np.frombuffer(ta, "<u8"), np.frombuffer(tb, "<u8"))
                keep.append(like.den * s >= like.num * (m + n - s))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], names=["a", "b"])

    near = base.saved(ids(pairs), "near")
    # an id that repeats may have an empty set beside others; it links with nothing
    sketches = base.saved(_sketches(base.restricted_rows(docs, near, "left_semi"), like).where("n > 0"), "sketches")
    left = _paired(pairs, sketches, ["n", "sketch"]).select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    left = base.saved(left.mapInArrow(base.trimming(sift), "a long, b long"), "sifted")
    base.dropped(sketches, near)
    close = base.saved(ids(left), "close")
    whole = base.saved(_whole_sets(base.restricted_rows(docs, close, "left_semi"), like).where("length(tokens) > 0"), "sets")
    out = base.saved(_paired(left, whole, ["tokens"]).select("a", "b", "tokens_a", "tokens_b").mapInArrow(base.trimming(check), "a long, b long").distinct(), "links")
    base.dropped(whole, close, left)
    return out


def _sizes_fit(a: str, b: str, like: Likeness):
    # sizes are ints: products of theirs pass 2**31 at 21 million shingles, an error in ANSI mode
    return F.expr(f"{like.den}L * {a} >= {like.num}L * {b} and {like.den}L * {b} >= {like.num}L * {a}")


def small_group_pairs(rows: DataFrame, like: Likeness) -> DataFrame:
    """Distinct pairs (a < b) that share a token; every token has few rows."""
    a, b = rows.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na")), rows.select("token", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "token").where(F.col("a") < F.col("b")).where(_sizes_fit("na", "nb", like)).select("a", "b").distinct()


def pivot_pairs(rows: DataFrame, like: Likeness) -> DataFrame:
    """Each row's document with the most central one of its token, of its size
    class and the next smaller: as many pairs as rows, twice at most."""
    step = -float(np.log(like.num / like.den))
    r = rows.withColumn("class", F.floor(F.log("n") / step))
    # written, like the tables below that aggregates join: a join of two shuffles may split a hot token
    pivots = base.saved(r.groupBy("token", "class").agg(F.min(F.struct("own", "doc_id")).alias("p")).select("token", "class", F.col("p.doc_id").alias("pivot")), "pivots")
    near = r.select("token", "doc_id", F.explode(F.array("class", F.col("class") - 1)).alias("class"))
    out = near.join(pivots, ["token", "class"]).where("doc_id != pivot")
    return out.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()


def residual_pairs(docs: DataFrame, rows: DataFrame, comps: DataFrame, like: Likeness) -> DataFrame | None:
    """Pairs of different components that large groups may still hide."""
    labelled = rows.select("token", "doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "doc_id"))
    open_ = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
    open_ = base.saved(open_, "open")
    members = base.saved(labelled.join(open_, "token", "left_semi").select("doc_id", "component").distinct(), "members")
    if members.isEmpty():
        return None
    close = base.restricted_rows(docs, members.select("doc_id").distinct(), "left_semi")

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for i, j, h, doc in _sets_of(batch, like):
                    h, doc = textvec.distinct_in_doc(h, doc)
                    n = np.bincount(doc, minlength=j - i)
                    mark = np.zeros(j - i, np.uint64)  # tells the sets of a repeated id apart
                    np.add.at(mark, doc, order(h, 0))
                    columns = [pa.array(h.view(np.int64)), pa.array(ids[i:j][doc], pa.int64()), pa.array(n[doc], pa.int32()), pa.array(mark[doc].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_id", "n", "mark"])

    tokens = base.saved(close.select("doc_id", "text").mapInArrow(base.trimming(explode), "token long, doc_id long, n int, mark long"), "tokens")
    df = base.saved(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "document-frequencies")
    known = base.saved(tokens.join(df, "token"), "frequencies")
    from pyspark.sql import Window as W

    # a document's own tokens (df 1) come first in ascending frequency, so they
    # use up the first n - core places of its prefix
    by_doc = W.partitionBy("doc_id", "mark")
    ranked = known.withColumn("at", F.row_number().over(by_doc.orderBy("df", "token"))).withColumn("core", F.count("*").over(by_doc))
    p = F.expr(f"n - ({like.num}L * n + {like.den - 1}) div {like.den} + 1")
    ranked = ranked.where((F.col("at") + F.col("n") - F.col("core")) <= p).select("token", "doc_id", "n", "core", "at")
    # partners' largest size that the tokens shared with anyone allow
    most = F.least(F.expr(f"n * {like.den}L / {like.num}D"), F.expr(f"core * {like.num + like.den}L / {like.num}D - n"))
    ranked = ranked.withColumn("most", most).join(members, "doc_id")
    fine = 0.005
    bucket = F.floor(F.log("n") / fine).cast("int")
    ranked = base.saved(ranked.withColumn("bucket", bucket), "ranked")
    sizes = ranked.groupBy("token", "component").count()
    major = sizes.groupBy("token").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("k")).where("k > 1").select("token", F.col("m.component").alias("major"))
    major = base.saved(major, "major")
    minor = ranked.join(major, "token").where("component != major")
    low, high = F.floor(F.log(F.expr(f"n * {like.num}D / {like.den}")) / fine).cast("int"), F.floor(F.log("most") / fine).cast("int")
    minor = minor.where(F.col("most") > 0).withColumn("low", low - 1).withColumn("high", high + 1).where("low <= high")
    minor = minor.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("core").alias("ca"), F.col("at").alias("ta"), F.col("component").alias("ka"), F.explode(F.sequence("low", "high")).alias("bucket"))
    other = ranked.select("token", "bucket", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("core").alias("cb"), F.col("at").alias("tb"), F.col("component").alias("kb"))
    # at a pair's first common token, no more than what follows on both sides is shared
    fits = F.expr(f"ka != kb and {like.num}L * (na + nb) <= {like.num + like.den}L * (1 + least(ca - ta, cb - tb))") & _sizes_fit("na", "nb", like)
    found = minor.join(other, ["token", "bucket"]).where(fits)
    out = base.saved(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "residual")
    base.dropped(members, tokens, known, ranked, open_, df, major)
    return out


def join(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id of every row of `docs`."""
    base.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    prints = base.saved(fingerprints(docs, like), "fingerprints")
    real = prints.where("n > 0 and doc_id is not null")
    # written first, so that the join below sees two shuffles and may split a large group
    reps = real.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    reps = base.saved(reps.select("fa", "fb", "rep"), "reps")
    again = base.saved(real.select("doc_id", "fa", "fb").join(reps, ["fa", "fb"]), "copies")
    repeated = real.groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = base.saved(again.join(repeated, "doc_id", "left_semi").select("doc_id", "rep").where("doc_id != rep"), "several")
    idle = base.saved(again.where("doc_id != rep").select("doc_id").distinct().join(repeated, "doc_id", "left_anti"), "idle")
    sources = base.restricted_rows(docs.where("doc_id is not null"), idle, "left_anti")

    moved = moved_tokens(sources, like)
    rows = base.saved(_prefixes(sources, like, moved, False), "prefixes")
    counts = rows.where("not moved").groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    sized = base.saved(rows.where("not moved").drop("moved").join(counts, "token"), "sized")
    large = sized.where(F.col("members") > GROUP).drop("members").unionByName(rows.where("moved").drop("moved"))
    large = base.saved(large.select("token", "doc_id", "n", "own"), "large")
    base.dropped(rows)
    small = sized.where(F.col("members") <= GROUP)
    pairs = base.saved(small_group_pairs(small, like).union(pivot_pairs(large, like)).distinct(), "pairs")
    base.dropped(sized)
    close = verified(pairs, sources, like)
    links = close.union(several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    groups = components(links, "a", "b")
    more = residual_pairs(sources, large, groups, like)
    if more is not None and not more.isEmpty():
        closer = verified(more, sources, like)
        old, groups = groups, components(links.union(closer), "a", "b")
        base.dropped(old, closer)
    base.dropped(several, idle, large, pairs, close, *([more] if more is not None else []))
    # a copy has its first copy's component; by the id itself, where there is none, so that no value is hot
    copy = again.select("doc_id", "fa", "fb", "rep").distinct()
    out = prints.join(copy, ["doc_id", "fa", "fb"], "left").withColumn("node", F.coalesce("rep", "doc_id"))
    few = groups.count() <= base.BROADCAST_ROWS
    out = out.join(F.broadcast(groups) if few else groups, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
