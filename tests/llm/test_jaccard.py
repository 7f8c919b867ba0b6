"""The join against all pairs, with large groups, chains and odd rows."""

import random

from tallyrook.llm import jaccard
from tallyrook.llm.components import components


def plain(rows, like):
    sets = []
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split() if t else []
        sets.append(frozenset(tuple(w[k : k + like.size]) for k in range(max(1, len(w) - like.size + 1))) if w else frozenset())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, _) in enumerate(rows):
        for m in range(k):
            j = rows[m][0]
            a, b = sets[k], sets[m]
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if like.den * both >= like.num * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(repr((i, len(s), find(i) if i is not None else None)) for (i, _), s in zip(rows, sets, strict=True))


def joined(spark, rows, like):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.join(df, like).collect())


def corpus(seed, like):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(55)]
    rows = []
    for k in range(90):  # a large group of near copies, some just beyond the limit, no base text itself
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w[: rng.randint(95, 120)]
        rows.append((1000 + k, " ".join(w)))
    for k in range(40):  # a passage that many share
        rows.append((2000 + k, " ".join([word() for _ in range(rng.randint(5, 60))] + passage)))
    chain = [word() for _ in range(60)]
    for k in range(12):  # each links to the next only
        rows.append((3000 - k, " ".join(chain)))
        chain = chain[3:] + [word() for _ in range(3)]
    rows += [(4000 + k, "same text in all of these rows") for k in range(30)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "one two"), (6, "other words here now"), (7, "other words here now"), (8, "É a b c"), (9, "é a b c"), (10, "lone")]
    return rows


def test_equals_all_pairs(spark):
    for seed, like in ((1, jaccard.Likeness()), (2, jaccard.Likeness(5, 80, 100))):
        rows = corpus(seed, like)
        assert joined(spark, rows, like) == plain(rows, like)


def test_empty(spark):
    assert joined(spark, [], jaccard.Likeness()) == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 360)] + [(999, k) for k in range(400, 450)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(label[u], label[v])
            changed |= label[u] != m or label[v] != m
            label[u] = label[v] = m
    assert got == {x: label[x] for u, v in edges if u != v for x in (u, v)}
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0
