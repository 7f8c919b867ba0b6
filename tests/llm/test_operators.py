"""Decontamination, coder, counts, classifiers, rules, licences and url filters
against plain versions, round trips and odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrook.llm import decontaminate, docstats, licences, mixcoder, quality, retokenize, rules, textvec, tokenbin, tokencounts, toxicity, urls, wordids, wordtable
from tallyrook.llm.queries import URL_RULES, vocabulary

ODD = [(1, None), (2, ""), (None, "a b"), (3, "é" * 50), (4, "\n\n"), (4, "a b"), (5, "x " * 40_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int")


def test_decontamination(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "c", "d", "é", "1x"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(1, 14))) for k in range(12)] + [(90, None), (91, "..."), (3, "c, C! c")]
    rows = [(k, text(rng.randint(0, 60)).upper().replace(" ", rng.choice([" ", ", ", "-"]))) for k in range(60)] + ODD
    word = lambda s: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").encode().lower())
    for window in (8, 4):
        found = decontaminate.scan(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window=window)
        got = sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in found.collect())
        want = []
        for i, t in rows:
            w, hit, names = word(t), set(), set()
            for k, x in items:
                v = word(x)
                for a in range(max(1, len(v) - window + 1)) if v else ():
                    p = v[a : a + window]
                    for at in range(len(w) - len(p) + 1):
                        if w[at : at + len(p)] == p:
                            hit.update(range(at, at + len(p)))
                            names.add(str(k))
            want.append(repr((i, len(w), len(hit), sorted(names))))
        assert got == sorted(want)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs(spark, rows), empty).where("n_hit > 0").count() == 0


def test_cleaned_text_has_no_window_left(spark):
    item = "one two three four five six seven eight nine"
    rows = [(1, f"before {item} after"), (2, "clean text"), (3, "One, two three four one two three four five six seven eight five six seven eight")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.scan(docs(spark, rows), bench, clean=True).select("doc_id", F.col("cleaned").alias("text"))
    assert decontaminate.scan(out, bench).where("n_hit > 0").count() == 0
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[2] == "clean text" and got[1].split() == ["before", "after"]


def test_short_items_are_cleaned(spark):
    long_ = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(1, long_), (2, "Red green blue"), (3, "zebra")], "item_id long, text string")
    rows = [(1, f"a red, green blue b {long_} c"), (2, "a red red green blue green blue b"), (3, "red green"), (4, "x Zebra y"), (5, "red green blue"), (6, None)]
    out = decontaminate.scan(docs(spark, rows), bench, clean=True).select("doc_id", F.col("cleaned").alias("text"))
    assert decontaminate.scan(out, bench).where("n_hit > 0").count() == 0
    got = {r["doc_id"]: r["text"] if r["text"] is None else r["text"].split() for r in out.collect()}
    assert got == {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["red", "green"], 4: ["x", "y"], 5: [], 6: None}


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([5]), np.array([2**32 - 1, 0]), np.arange(60000), np.arange(140_000) * 30_000, rng.integers(0, 65535, 5000), rng.integers(0, 200_000, 90_000), np.tile(rng.integers(0, 900, 700), 9), np.minimum(rng.zipf(1.3, 9000), 49407)):
        assert (mixcoder.decode(mixcoder.encode(ids)) == ids).all()
    with pytest.raises(ValueError):
        mixcoder.encode(np.array([-1]))
    chain = [0]
    for _ in range(40_000):  # few followers of each id: orders 1 and 2 predict
        chain.append(int((chain[-1] * 7 + rng.integers(0, 4)) % 500))
    body = mixcoder.encode(np.array(chain))
    assert len(body) * 8 / len(chain) < 6  # tables included; order 0 alone: about 9
    raw = bytearray(body)
    raw[-40] ^= 1  # in the last blocks' bits
    with pytest.raises(ValueError):
        mixcoder.decode(bytes(raw))
    ids, good = mixcoder.decode_blocks(bytes(raw))
    assert (~good).sum() <= mixcoder.BLOCK and (ids[good] == np.array(chain)[good]).all()
    with pytest.raises(ValueError):
        mixcoder.decode_blocks(body[:-2])


def test_coder_counts_are_narrow_and_code_as_before():
    assert mixcoder.Model(8).counts.nbytes <= 8 * 1024  # a lane's; what the coder gathers in every step is most of its time
    step = np.arange(mixcoder.BLOCK * 6).reshape(mixcoder.BLOCK, 6)
    event = ((step * step * 7919 + step // 5) % 101 % mixcoder.EVENTS).astype(np.int8)
    sure = (step * 31 % 7 % 4).astype(np.int8)
    event[:, 4], sure[:, 4], event[:, 5], sure[:, 5] = 3, 0, 15, 3  # all counts in one place
    words, used = mixcoder._coded(event, sure)
    assert (zlib.crc32(words.tobytes()), used.tolist()) == (2097787943, [512, 511, 514, 514, 4, 4])  # as coded with counts in floats
    body = mixcoder.encode(np.arange(mixcoder.BLOCK))
    assert body[8:12] == mixcoder.BLOCK.to_bytes(4, "little")
    with pytest.raises(ValueError, match="too large"):
        mixcoder.decode(body[:8] + (10_000).to_bytes(4, "little") + body[12:])


TEXTS = ["", "Hello  World\n\n", "it's 'quoted' <|endoftext|> x", "naïve café — ﬁ 漢字 é", "\t tab\x85nel\xa0nbsp", "a" * 300 + " b", "don't\nI'LL 12345 !!!", " 'sleading", "́ combining"]


def test_chunked_ids_equal_the_library():
    path = vocabulary("word_bpe_49k.json")
    enc, tok = wordids.ChunkEncoder(path), wordids.tokenizer(path)
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("abé 'sT\n.,1漢́<|>") for _ in range(60)) for _ in range(200)]
    texts += ["<|endoftext|>", "<|ENDOFTEXT|>x<|endoftext|>y", "A<|startoftext|>B!<|x", "\x0b!a\x1cb\x7fc", "it'S 1's !'s a'street", "a|b|c <| |>", "K" * 700 + "," * 300]
    pool = list("abB!,éK\u037e\u0301 'sTrveml\n12\t\r\x0b\x1c\x85|<>—ŉ") + ["<|endoftext|>"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    assert enc.by_words
    for _ in range(2):  # new words, then known ones
        assert [x.tolist() for x in enc(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    other = wordids.ChunkEncoder(vocabulary("byte_bpe_50k.json"))  # joins spaces with words: whole texts
    assert not other.by_words
    assert [x.tolist() for x in other(texts[:60])] == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[:60]]


def test_word_table_starts_anew(monkeypatch):
    monkeypatch.setattr(wordtable, "WORDS", 50)
    table = wordtable.WordTable(lambda words: (list(range(len(words))), np.array([len(w) + 1000 * v for w, v in words], np.uint32), np.ones(len(words), np.int32)))
    rng = random.Random(3)
    for _ in range(40):
        words = ["x" * rng.randint(1, 300) + str(rng.randint(0, 60)) for _ in range(80)]
        data, ends = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(w) for w in words])
        variant = np.array([rng.randint(0, 2) for _ in words])
        with np.errstate(over="ignore"):
            ids, size = table.encode(data, ends - [len(w) for w in words], ends, variant)
        assert ids.tolist() == [len(w) + 1000 * v for w, v in zip(words, variant.tolist(), strict=True)] and (size == 1).all()


def test_span_hashes_tell_words_apart():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 200_000).astype(np.uint8)
    data[rng.random(len(data)) < 0.2] = 32
    data[60_000:140_000] = 97  # a word over several pieces
    with np.errstate(over="ignore"):
        starts, ends, _ = textvec.words(data, np.array([0, len(data)]), textvec.SPACE)
        seen: dict[bytes, int] = {}
        for a, b, h in zip(starts, ends, textvec.span_hashes(data, starts, ends).tolist(), strict=True):
            assert seen.setdefault(data[a:b].tobytes(), h) == h
        assert len(set(seen.values())) == len(seen)
        swap = str.maketrans("ab", "ba")
        for k in (8, 10, 11, 14):  # texts that agree in polynomials modulo a power of two
            t = "a"
            for _ in range(k):
                t += t.translate(swap)
            pair = [np.frombuffer(x.encode(), np.uint8) for x in (t, t.translate(swap))]
            one, two = (textvec.span_hashes(x, np.array([0]), np.array([len(x)]))[0] for x in pair)
            assert one != two


def test_token_files(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + ODD
    path, tok = str(tmp_path / "ids"), wordids.tokenizer(vocabulary("word_bpe_49k.json"))
    tokenbin.write(docs(spark, rows), path, vocabulary("word_bpe_49k.json"), 2)
    got = tokenbin.read(spark, path, ids=True).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    files = spark.read.parquet(path)
    middle = F.expr("concat(substring(body, 1, octet_length(body) - 3), unhex('00'), substring(body, octet_length(body) - 1, 2))")
    files.withColumn("body", F.when(F.octet_length("body") > 100, middle).otherwise(F.col("body"))).write.parquet(path + "x")
    with pytest.raises(Exception, match="damaged"):
        tokenbin.read(spark, path + "x").collect()
    saved = tokenbin.read(spark, path + "x", recover=True).collect()
    assert len(saved) == len(rows) and any(r["ids_crc32"] is None for r in saved)
    tokenbin.write(docs(spark, rows).limit(0), path + "0", vocabulary("word_bpe_49k.json"), 2)
    assert tokenbin.read(spark, path + "0").count() == 0


def test_counts_under_edits(spark):
    path = vocabulary("word_bpe_49k.json")
    enc, tok, rng = wordids.ChunkEncoder(path), wordids.tokenizer(path), random.Random(3)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for n in (0, 3, 900, 6000):
        text = "".join(rng.choice(["word ", "a", "b\n", " ", "é.", "12"]) for _ in range(n))
        tree = retokenize.CountTree(text, enc)
        assert tree.total == count(text)
        for _ in range(40):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 5, 700]))
            new = rng.choice(["", "x", " new words ", "y" * 900, "\n"])
            text = text[:a] + new + text[b:]
            assert tree.edit(a, b, new) == count(text) and tree.text == text and tree.length == len(text)
    big = retokenize.CountTree("some words " * 20_000, enc)
    before = big.encoded_chars
    big.edit(100_000, 100_003, "changed")
    assert big.encoded_chars - before < 3 * retokenize.LEAF_CHARS
    df = spark.createDataFrame([(1, "one two", [(0, 3, "x")]), (2, None, None), (None, "", [(0, 9, None), (None, 1, "z")])], "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>")
    got = {r["doc_id"]: (r["n_tokens"], r["counts"]) for r in tokencounts.counts_under_edits(df, path).collect()}
    assert got == {1: (2, [2]), 2: (0, []), None: (0, [0, 0])}


def test_trees_are_kept(spark):
    path, rng = vocabulary("word_bpe_49k.json"), random.Random(5)
    tok = wordids.tokenizer(path)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    texts = {k: "".join(rng.choice(["word ", "a", "b\n", " ", "é.", "12"]) for _ in range(rng.choice([0, 5, 3000]))) for k in range(20)}
    kept = tokencounts.trees(spark.createDataFrame([*texts.items(), (None, None)], "doc_id long, text string"), path)
    for _ in range(3):
        edits = {k: [(a := rng.randint(0, len(t)), a + rng.choice([0, 3, 900]), rng.choice(["", "x y", "z" * 700])) for _ in range(rng.randint(0, 3))] for k, t in texts.items()}
        frame = kept.join(spark.createDataFrame([*edits.items()], "doc_id long, edits array<struct<start:long,end:long,new:string>>"), "doc_id", "left")
        out = tokencounts.counts_under_edits(frame, path, tree="tree", after=True).collect()
        for r in out:
            k = r["doc_id"]
            counts, t = [], texts.get(k, "")
            assert r["n_tokens"] == count(t)
            for a, b, new in edits.get(k, []):
                t = t[:a] + new + t[max(a, min(b, len(t))) :]
                counts.append(count(t))
            assert (r["counts"], r["text"], r["n_chars"]) == (counts, t, len(t))
            assert sum(r["tree"]["leaf_tokens"]) == count(t) and sum(r["tree"]["leaf_chars"]) == len(t)
            if len(t) > 9000 and not any(len(new) > 3 or b > a + 3 for a, b, new in edits[k]):
                assert r["encoded_chars"] < len(t) / 2
            if k is not None:
                texts[k] = t
        kept = spark.createDataFrame([(r["doc_id"], r["text"], r["tree"]) for r in out], kept.schema)


def plain_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(["a", "b", " ", " c ", "\n", "é", "#", "|", "\t", "\x0b", "\x1c", "\x85"]) for _ in range(rng.randint(0, 200)))) for k in range(150)] + ODD
    got = docstats.counted(docs(spark, rows).drop("n_words")).collect()
    names = docstats.COUNTS[:5]
    assert sorted(repr((r["doc_id"], *[r[c] for c in names])) for r in got) == sorted(repr((i, *plain_counts(t))) for i, t in rows)


def test_binomial_bound_is_exact():
    for k, n, delta in ((0, 100, 0.05), (3, 50, 0.01), (10, 40, 0.2)):
        p = rules.upper_bound(k, n, delta)
        below = sum(__import__("math").comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(below - delta) < 1e-9
    assert rules.upper_bound(5, 5, 0.1) == 1.0 and rules.upper_bound(0, 0, 0.1) == 1.0


def test_rules(spark):
    rng = random.Random(7)
    good = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))) for k in range(3000)]
    junk = [(10_000 + k, t.replace(" ", "### ")) for k, (_, t) in enumerate(good[:50])]
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in junk], "doc_id long, quality int, toxic int")
    frame = docs(spark, good + junk + ODD).drop("n_words")
    kept = {r["doc_id"]: r["kept"] for r in rules.apply(frame, labels).collect()}
    assert not any(kept[k] for k, _ in junk)
    assert sum(not kept[k] for k, _ in good) <= 0.03 * len(good)
    assert not kept[1] and not kept[2]
    none = rules.apply(frame, labels.limit(0))
    assert none.where("kept = base_failed").count() == 0  # no evidence: the base rule alone
    assert rules.apply(frame.limit(0), labels).count() == 0


def test_quality_scores_equal_plain_densities(spark):
    rng = random.Random(9)
    rows = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) + ("##" if k % 3 == 0 else "") for _ in range(rng.randint(1, 80)))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k, _ in rows] + [(None, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    frame = docs(spark, rows + ODD).drop("n_words")
    out = quality.classify(frame, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in out.collect() if r["doc_id"] is not None and r["doc_id"] > 5}
    held = [(got[k], k % 3 > 0) for k, _ in rows if k % 5 == 0 and k > 5]
    assert sum((s >= 0.5) == y for s, y in held) > 0.9 * len(held)
    stats = docstats.counted(frame.where("doc_id between 6 and 399"))
    names = list(quality.features())
    x = stats.select("doc_id", *[v.alias(k) for k, v in quality.features().items()]).toPandas().sort_values("doc_id")
    m = quality.fit(stats, labels.where("doc_id % 5 != 0 and quality is not null").selectExpr("doc_id", "quality as y"))
    z = []
    for g in m.classes:
        d = (x[names].to_numpy() - g.mean) @ g.factor.T
        z.append(np.log(g.n) - g.log_det - (d * d).sum(1) / 2)
    want = 1 / (1 + np.exp(-np.clip(z[1] - z[0], -60, 60)))
    have = quality.scored(stats, m).select("doc_id", "score").toPandas().sort_values("doc_id")["score"].to_numpy()
    assert np.abs(want - have).max() < 1e-9
    assert {r["score"] for r in quality.classify(frame, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_toxicity(spark):
    rng = random.Random(10)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet"]
    rows = [(k, " ".join(rng.choice(filler) for _ in range(30)) + (". they are a zorgle and idiot. " if k % 4 == 1 else ". ") + "end") for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 1)) for k, _ in rows], "doc_id long, quality int, toxic int")
    extra = [(900, "You are a zorgle."), (901, "The sea is calm.")]
    out = {r["doc_id"]: r["score"] for r in toxicity.classify(docs(spark, rows + extra + ODD), labels, F.col("doc_id") % 3 != 0).collect()}
    assert all((out[k] >= 0.3) == (k % 4 == 1) for k, _ in rows if k > 5)
    assert out[900] > 0.3 > out[901] and abs(out[1] - out[2]) < 1e-12
    assert toxicity.classify(docs(spark, rows).limit(0), labels, F.lit(True)).count() == 0


def test_grammar_weighs_clauses():
    machine, lexicon = toxicity.composed(), toxicity.Lexicon.of(toxicity.fixed_lexicon())

    def most(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        with np.errstate(over="ignore"):
            return toxicity.clause_scores(raw, np.array([0, len(raw)]), lexicon, machine)[2][0]

    assert most("you idiot") > most("idiot") > most("not idiot") > 0
    assert most("he said you idiot") < most("you idiot")
    assert most("I will hurt you") > most("it may hurt") and most("calm words") == 0


def test_licences(spark):
    rows = [(10, "Text.\nReleased under the MIT License.\nMore."), (11, "licensed under the apache license, version 2.0"), (12, "Licensed under CC BY-NC 4.0."), (13, "Version 2.0 of the report was released."), (14, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["doc_id"]: (r["n_paragraphs"], r["families"]) for r in licences.scan(docs(spark, rows + ODD)).collect()}
    assert {k: got[k] for k in range(10, 15)} == {10: (3, "MIT"), 11: (1, "Apache-2.0"), 12: (1, "CC-BY-NC"), 13: (1, ""), 14: (1, "GPL")}
    assert got[1] == (0, "") and got[2] == (0, "")


def test_licence_notices_inside_long_lines(spark):
    filler = " ".join(f"river{k} stone{k} of the lamp{k} is old" for k in range(60))
    mit, apache = "Licensed under the MIT license.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (20, f"{filler} {mit} {filler}"), (21, f"First line.\n{filler} {mit}\nLast line."), (22, f"{mit} {filler} {apache} {filler}"), (23, filler),
        (24, f"{filler} This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation {filler}"),
        (25, f"{filler} Licensed under CC BY-NC 4.0. {filler}"), (26, f"{filler} All the rights of the public are reserved under the general version of the license {filler}"),
    ]
    strange = " ".join(f"river{k} stone{k}" for k in range(60))
    rows += [(30, f"{strange} {mit}"), (31, f"One.\n{mit} {strange}")]
    rows += [(100 + k, f"{filler} {t} {filler}") for k, t in enumerate(t for texts in licences.TEMPLATES.values() for t in texts)]
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_licence"], r["families"], [x["paragraph"] for x in r["licences"]]) for r in licences.scan(docs(spark, rows)).collect()}
    assert got[20] == (1, 1, "MIT", [0]) and got[21] == (3, 1, "MIT", [1]) and got[22] == (1, 1, "Apache-2.0,MIT", [0, 0])
    assert got[30] == (1, 1, "MIT", [0]) and got[31] == (2, 1, "MIT", [1])
    assert got[23] == (1, 0, "", []) and got[24][2] == "LGPL" and got[25][2] == "CC-BY-NC" and got[26][2] == ""
    families = [n for n, texts in licences.TEMPLATES.items() for _ in texts]
    assert [got[100 + k][2] for k in range(len(families))] == families


def test_urls(spark):
    page = "<html><link href='{}' rel=canonical></html>"
    rows = [
        (1, "http://a.example.com/en/1", ""), (2, "HTTP://Example.COM/en/77?x", ""), (3, "http://x.net/p#f", page.format("/q")), (4, "http://x.net/q", page.format("http://b.org/es/1")),
        (5, None, None), (6, "no scheme", "canonical"), (7, "http://b.org/es/1", ""), (8, "http://c.net/z", page.format("http://example.com/en/7")), (9, "http://c.net/y", page.format("http://b.org/es/9")),
        (10, "http://c.net/y?q", '<meta http-equiv="refresh" content="0; url=http://c.net/z">'), (11, "http://xcom/en/", ""), (12, "http://com/en/", ""),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block") and got[2] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[3][3] == got[4][3] == "block" and got[7][2] == "org/es/"
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[8][3] == "allow" and got[9][3] == "block" and got[10][3] == "allow"
    assert got[11][2] is None and got[12][2] == "com/en/"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_all_links_of_a_page(spark):
    rows = [
        ("http://x.net/a/b", "<LINK rel='alternate canonical' href=c?x=1&amp;y=2>", ["http://x.net/a/c?x=1&y=2"]),
        ("http://x.net/a/b", "<link rel=canonical href=../q><link data-href='/no' href=\"/r\" rel=\"canonical\">", ["http://x.net/q", "http://x.net/r"]),
        ("http://x.net/a/b?z", "<meta http-equiv=Refresh content=\"0;url='/s'\"><meta content='5; URL=?p=2' http-equiv='refresh'>", ["http://x.net/s", "http://x.net/a/b?p=2"]),
        ("https://x.net", "<link rel=canonical href='//Y.net'>", ["https://y.net/"]),
        ("http://x.net/a/", "<!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script><link rel='canonical' title='a > b' href='&#x2f;k&#47;&#233;'>", ["http://x.net/k/é"]),
        ("http://x.net/a", "<base href='http://z.net/d/e'><link rel=canonical href='./f/../g'>", ["http://z.net/d/g"]),
        ("http://x.net/a", "<link rel=canonical href='javascript:x()'><link rel=canonical href='#top'><link rel=canonical href=''><link rel=canonicals href=/no>", []),
        ("http://x.net/a#f", "<link rel=canonical href='a'>", []),
        ("no scheme", "<link rel=canonical href='/a'>", []), (None, "<link rel=canonical href='http://q.net/a'>", []), ("http://x.net/n", None, []),
    ]
    named = [(k, u.replace("x.net", f"x{k}.net") if u else None, h) for k, (u, h, _) in enumerate(rows)]
    got = {}
    for r in urls.page_edges(spark.createDataFrame(named, "k long, url string, html string")).collect():
        got.setdefault(r["u"], []).append(r["v"])
    for k, (_, html, want) in enumerate(rows):
        mine = [v for u, vs in got.items() if f"//x{k}.net/" in u for v in vs]
        assert sorted(mine) == sorted(w.replace("x.net", f"x{k}.net") for w in want), html


def test_components_decide_verdicts(spark):
    """Pages, canonical links and redirects at random, against sets merged one by one."""
    rng = random.Random(12)
    hosts = ["a.com", "b.example.com", "c.net", "d.org", "e.io", "f.io", "g.io"]
    address = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(1, 9)}"
    pages = [(k, u := address(), f"<link rel=canonical href={address()}>" if rng.random() < 0.3 else "<p>canonical</p>") for k in range(150)]
    pages += [(200 + k, f"http://h{k}.io/p", f"<link rel=canonical href=http://h{k + 1}.io/p>") for k in range(30)] + [(300, "http://h30.io/p", "<link rel=canonical href=http://x.org/es/1>")]
    moved = [(address(), address()) for _ in range(25)] + [(None, address())]
    edges = [(u, h.split("href=")[1].rstrip(">")) for _, u, h in pages if "href" in h] + [m for m in moved if m[0]]
    group = {}
    for e in edges:
        one, two = (group.setdefault(x, {x}) for x in e)
        if one is not two:
            one |= two
            for x in two:
                group[x] = one

    def rule(u):
        host, _, path = u.split("://")[1].partition("/")
        fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fit, key=lambda r: (len(r.text), r.verdict == "allow")) if fit else None

    want = {}
    for k, u, _ in pages:
        own, said = rule(u), {r.verdict for x in group.get(u, {u}) if (r := rule(x))}
        want[k] = (own.text if own else None, own.verdict if own else "allow" if "allow" in said else "block" if "block" in said else "allow")
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(frame, URL_RULES, spark.createDataFrame(moved, "u string, v string")).collect()}
    assert got == want
    assert sum(v == "block" and r is None for r, v in got.values()) > 20  # blocked by an alias alone
    only = urls.judge(frame.drop("html"), URL_RULES, spark.createDataFrame([("http://h0.io/p", "http://d.org/es/1")], "u string, v string"), html=None)
    assert only.where("page_id = 200 and verdict = 'block'").count() == 1


def test_unlisted_licences_are_unknown(spark):
    rows = [
        (0, "Licensed under the Eclipse Public License, version 2.0."), (1, "Licensed under the Reciprocal Public License, version 1.5."), (2, "Distributed under the Mulan Permissive Software License, Version 2."),
        (3, "SPDX-License-Identifier: Apache-2.0"), (4, "// SPDX-License-Identifier: GPL-2.0-or-later"), (5, "SPDX-License-Identifier: EPL-2.0"), (6, "Licensed under the Mozilla Public License, version 2.0."),
        (7, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ]
    got = {r["doc_id"]: r["families"] for r in licences.scan(docs(spark, rows)).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "Apache-2.0", 4: "GPL", 5: "", 6: "MPL-2.0", 7: "MIT"}
    assert licences.scan(docs(spark, rows).limit(0)).count() == 0


def test_licences_line_by_line():
    """A line's licences don't depend on what else is scanned with it, and each
    found one has the template's share of 2-grams in the line, counted plainly."""
    rng, m = random.Random(4), licences.train()
    pool = [t for own in licences.TEMPLATES.values() for t in own] + licences.PLAIN + licences.UNLISTED

    def scanned(texts):
        with np.errstate(over="ignore"):
            _, doc, number, family, _ = licences.scan_chunk(*textvec.text_buffer(pa.array(texts)), m)
        return sorted(zip(doc.tolist(), number.tolist(), family.tolist(), strict=True))

    lines = []
    for _ in range(250):
        words = rng.choice(pool).split() + rng.choice(pool).split()[: rng.randint(0, 6)]
        lines.append(" ".join(w for w in words if rng.random() > 0.05) or "x")
    alone = [(k, f) for k, line in enumerate(lines) for _, _, f in scanned([line])]
    assert sorted(alone) == [(k, f) for _, k, f in scanned(["\n".join(lines)])] == [(k, f) for k, _, f in scanned(lines)]
    for k, f in alone:
        w = licences._words(lines[k])
        pairs = set(zip(w, w[1:]))
        shares = [len(pairs & (t := set(zip(v, v[1:])))) / max(1, min(len(t), len(pairs))) for v in map(licences._words, licences.TEMPLATES[m.names[f]])]
        assert max(shares) >= licences.CONFIRM - 1e-9


def test_kept_columns_may_have_any_name(spark):
    names = ["total", "matched", "most", "size", "n_words_", "x_words", "__s"]
    frame = docs(spark, [(1, "you idiot"), (2, None), (2, "calm"), (None, "x")]).drop("n_words").selectExpr("*", *[f"doc_id as `{n}`" for n in names])
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for out in (
        toxicity.classify(frame, labels, F.lit(True), keep=(*names, "text")), quality.classify(frame, labels, F.lit(True), keep=(*names, "text")), rules.apply(frame, labels, keep=(*names, "text")),
        decontaminate.scan(frame, spark.createDataFrame([(1, "you idiot")], "item_id long, text string"), keep=tuple(names), clean=True),
    ):
        rows = out.collect()
        assert len(rows) == 4 and all(r[n] == r["doc_id"] for r in rows for n in names)
    for call in (lambda: toxicity.classify(frame, labels, F.lit(True), keep=("doc_id",)), lambda: rules.apply(frame.withColumn("kept", F.lit(1)), labels, keep=("kept",))):
        with pytest.raises(ValueError, match="clash"):
            call()
    texts = docs(spark, [(1, "a"), (2, "b")]).selectExpr("cast(doc_id as string) as doc_id", "text")
    marks = spark.createDataFrame([("1", 1, 1), ("2", 0, 0)], "doc_id string, quality int, toxic int")
    assert toxicity.classify(texts, marks, F.lit(True)).count() == quality.classify(texts, marks, F.lit(True)).count() == 2


def test_benchmark_of_several_blocks(spark, monkeypatch):
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = spark.createDataFrame([(k, text(rng.randint(1, 30))) for k in range(40)], "item_id long, text string")
    frame = docs(spark, [(k, text(rng.randint(0, 300))) for k in range(30)])
    whole = sorted(map(repr, decontaminate.scan(frame, items, window=4).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    assert sorted(map(repr, decontaminate.scan(frame, items, window=4).collect())) == whole


def test_cutoffs_equal_a_plain_choice(spark):
    """kept against a plain walk over cutoffs with exact binomial tails."""
    import math

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    for k in range(1500):
        t = [word() for _ in range(rng.randint(12, 60))]
        if rng.random() < 0.03:
            t = [w + "#" * rng.randint(1, 4) for w in t]
        rows.append((k, " ".join(t), ("en", "de", None)[k % 3 if k % 30 else 2]))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 10 > 0), 0) for k, _, _ in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    limit, delta = 0.3, 0.05
    out = rules.apply(frame, labels, limit, delta).select("*", *[r.step().alias(f"s_{r.name}") for r in rules.RULES]).collect()
    strata = {r["lang"] for r in out}
    each, share = limit / len(rules.RULES), delta / (len(strata) * len(rules.RULES))
    cuts = {}
    for s in strata:
        good = [r for r in out if r["lang"] == s and r["doc_id"] % 10 > 0]
        for rule in rules.RULES:
            steps = [r[f"s_{rule.name}"] for r in good]
            for cut in range(rules.BINS - 1, -1, -1):
                k, n = sum(x > cut for x in steps), len(steps)
                tail = sum(math.comb(n, i) * each**i * (1 - each) ** (n - i) for i in range(k + 1))
                if tail > share:  # the share of wrong rejections may be above the limit
                    break
                cuts[s, rule.name] = cut
    assert len(cuts) > 3
    want = {r["doc_id"]: not r["base_failed"] and not any(r[f"s_{x.name}"] > cuts[r["lang"], x.name] for x in rules.RULES if (r["lang"], x.name) in cuts) for r in out}
    assert {r["doc_id"]: r["kept"] for r in out} == want
    assert 20 < sum(not v for v in want.values()) < 200
