"""Stages on documents with odd rows and clashing columns, and against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrook.llm import docstats, quality
from tallyrook.llm.queries import vocabulary

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words_of(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())


def cut(text, items):
    """`text` without any occurrence of an item's windows of eight words."""
    windows = {tuple(w[k : k + 8]) for w in map(words_of, items) if w for k in range(max(1, len(w) - 7))}
    while True:
        found = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
        w, hit = words_of(text), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if not hit:
            return text
        raw, out, k = text.encode(), [], 0
        at = 0
        while k < len(found):
            if k in hit:
                out.append(raw[at : found[k][0]])
                while k + 1 in hit:
                    k += 1
                at = found[k][1]
            k += 1
        text = b" ".join([*out, raw[at:]]).decode()


def test_each_stage_equals_a_plain_version(spark, tmp_path):
    import sentencepiece

    rng = random.Random(31)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [text(rng.choice([5, 12, 30])) for _ in range(6)]
    rows = []
    for k in range(120):
        t = text(rng.randint(5, 90))
        kind = rng.random()
        if kind < 0.15 and rows:
            w = rng.choice(rows)[1].split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.25:
            t = " ".join([t, rng.choice(items).upper(), text(12)])
        elif kind < 0.35:
            t = text(6) + " " + " ".join(["again and again it is said"] * 9)
        elif kind < 0.45:
            t = "".join(c.upper() + "##" if c.isalpha() and rng.random() < 0.5 else c for c in t)
        rows.append((k, t))
    rows += [(3, rows[3][1]), (4, text(40)), (200, rows[5][1].upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int("##" not in t), 0) for k, t in rows[:120] if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, state = docs, sorted(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.saved(stage(spark, now, str(tmp_path)), name)
        got = sorted((r["doc_id"], r["text"]) for r in now.collect())
        if name == "quality_rules":  # too few labels for a cutoff: the base rule alone
            kept = []
            for i, t in state:
                w = t.split()
                seen = {}
                for k in range(len(w) - 4):
                    seen.setdefault(tuple(w[k : k + 5]), []).append(k)
                many = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
                if len(w) >= 10 and 100 * len(many) <= 20 * len(w):
                    kept.append((i, t))
            assert 0 < len(state) - len(kept) < 60
        elif name == "quality_classifier":
            x = docstats.counted(docs).select("doc_id", *[v.alias(k) for k, v in quality.features().items()]).toPandas()
            names, y = list(quality.features()), dict((k, q) for k, q, _ in labels)
            fold = {r[0]: r[1] for r in docs.select("doc_id", F.crc32(F.col("doc_id").cast("string")) % 5).collect()}
            sides = []
            for q in (0, 1):
                own = x[[y.get(i) == q and fold[i] != 0 for i in x["doc_id"]]][names].to_numpy()
                cov = np.cov(own.T)
                cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(len(names))
                sides.append((len(own), own.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))
            every = docstats.counted(docs.select("doc_id", "text"), keep=("text",)).select("doc_id", "text", *[v.alias(k) for k, v in quality.features().items()]).collect()
            good = set()
            for r in every:
                v = np.array([r[n] for n in names])
                z = [math.log(n) - d / 2 - (v - m) @ inv @ (v - m) / 2 for n, m, inv, d in sides]
                if 1 / (1 + math.exp(-min(60, max(-60, z[1] - z[0])))) >= 0.3:
                    good.add((r["doc_id"], r["text"]))
            kept = [r for r in state if r in good]
            assert 0 < len(state) - len(kept) < 60
        elif name == "ngram_jaccard_join":
            sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.lower().split() for _, t in state)]
            group = list(range(len(state)))
            for a in range(len(state)):
                for b in range(a):
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                        old, new = max(group[a], group[b]), min(group[a], group[b])
                        group = [new if g == old else g for g in group]
            kept = [state[min(k for k in range(len(state)) if group[k] == g)] for g in sorted(set(group))]
            assert 0 < len(state) - len(kept) < 60
        else:
            kept = [(i, cut(t, items)) for i, t in state]
            assert kept != state
        assert [i for i, _ in got] == [i for i, _ in sorted(kept)], name
        assert sorted(t for _, t in got) == sorted(t for _, t in kept), name
        state = sorted(kept)
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sorted((r["doc_id"], tuple(r["piece_ids"])) for r in last) == sorted((i, tuple(sp.encode(t))) for i, t in state)


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    text = [" ".join(words[(k * j + j * j) % 20] + f"{k}x{j}" for j in range(30)) for k in range(1, 13)]
    bench = "one two three four five six seven eight nine ten"
    rows = [(k, t) for k, t in enumerate(text)] + [(50, text[0]), (51, text[1].upper()), (60, None), (61, ""), (None, None), (62, text[2] + " new " + bench), (7, text[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int, score int, kept string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for read in (docs, docs.limit(0)):
        now = read
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path))
            assert out.columns == docs.columns, name
            now = corpus_pipeline.saved(out, name)
        last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        ids = sorted(r["doc_id"] for r in last.collect())
        if read is docs:
            assert ids == [*range(12), 62]
            assert now.where(F.col("text").contains("three four five")).count() == 0
            assert now.where("doc_id = 62 and n_chars = length(text) and n_words = 1 and score = 2 and kept is null").count() == 1
            assert now.join(docs, ["doc_id", "text"], "left_semi").where("doc_id < 12").count() == 12
        else:
            assert ids == []
