"""The folder gate, sources and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tallyrook.operators import score
from tallyrook.plans import gate
from tallyrook.sources import datasets, files
from tallyrook.streaming import watch

BAD = "#include <string.h>\nvoid f(char *d, char *s) {\n    strcpy(d, s);\n}\n"
GOOD = "/* strcpy( is not used */\nint g(void) { return 1; }\n"


def scorer(p):
    value = 4.0 if p > 0.5 else -4.0

    def run(code):
        return score.from_logits(code.select("code_id", F.lit(0.0).alias("logit0"), F.lit(value).alias("logit1")), "stub")

    return run


def test_exit_codes(spark, tmp_path):
    said = []
    assert gate.main(spark, ["scan", str(tmp_path / "none")], scorer(1), said.append) == 2
    (tmp_path / "good.c").write_text(GOOD)
    assert gate.main(spark, ["scan", str(tmp_path)], scorer(0), said.append) == 0
    (tmp_path / "bad.c").write_text(BAD)
    assert gate.main(spark, ["scan", str(tmp_path)], scorer(1), said.append) == 1
    assert any(x.startswith("[VULNERABLE  ]") and "bad.c" in x and "R002" in x for x in said)
    assert any("(confirmed=['R002'] model=1 P=0.982)" in x for x in said) and any("confirmed=[] " in x for x in said)
    assert said[-1] == "\nScanned 2 file(s); 1 flagged 'vulnerable'."
    said.clear()
    assert gate.main(spark, ["list", str(tmp_path)], scorer(1), said.append) == 0
    assert [x.rsplit("/", 1)[1] for x in said] == ["bad.c", "good.c"]


def test_command(spark, monkeypatch, capsys):
    import tallyrook.__main__ as command

    monkeypatch.setattr(command.SparkSession, "builder", type("B", (), {"appName": lambda s, x: s, "config": lambda s, *a: s, "getOrCreate": lambda s: spark})())
    assert command.main(["--assume", "0.9"]) == 1
    out = capsys.readouterr().out
    assert "[VULNERABLE  ]" in out and "unbounded_copy.c" in out and "[NEEDS_REVIEW]" in out
    assert command.main(["--assume", "0.1", "scan", "samples"]) == 0
    assert command.main(["scan", "samples"]) == 2 and "no model" in capsys.readouterr().err
    assert command.main(["--assume", "0.1", "list", "nowhere"]) == 2 and "nowhere" in capsys.readouterr().err


def test_saved_model_is_the_second_choice(spark, tmp_path):
    from tallyrook.operators import train

    rows = spark.createDataFrame([(k, "strcpy a b" if k % 2 else "int x y", k % 2) for k in range(40)], "k long, func_before string, vul int")
    best = train.save_if_better(train.fit(rows), str(tmp_path / "fitted"), 0.5, 0.0)
    assert best == 0.5 and train.save_if_better(None, str(tmp_path / "fitted"), 0.5, best) == 0.5
    run = score.resolve(str(tmp_path / "none.onnx"), str(tmp_path / "fitted"), str(tmp_path / "none.json"))
    got = {r["code_id"]: r["label"] for r in run(spark.createDataFrame([(0, "int x y"), (1, "strcpy a b")], "code_id long, code string")).collect()}
    assert got == {0: 0, 1: 1}
    with pytest.raises(FileNotFoundError):
        score.resolve(str(tmp_path / "none.onnx"), str(tmp_path / "empty"), str(tmp_path / "none.json"))


def test_literal_and_written_splits(spark, tmp_path):
    assert [tuple(r) for r in files.literal(spark, ["a", "b"]).collect()] == [(0, "a"), (1, "b")]
    rows = spark.createDataFrame([("p", "c", "CWE-1", "C", "x", "y", k % 3 == 0, "train" if k < 8 else "test") for k in range(10)], "project string, commit_id string, `CWE ID` string, lang string, func_before string, func_after string, vul boolean, split string")
    datasets.write_splits(rows, str(tmp_path / "out"))
    assert tuple(datasets.read_split(spark, str(tmp_path / "out/split=test")).columns) == datasets.KEPT
    datasets.check_written(rows, str(tmp_path / "out"))
    with pytest.raises(AssertionError):
        datasets.check_written(rows.limit(3), str(tmp_path / "out"))


def test_encoded_rows_and_batches(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(0, "int f(void);", 1), (1, "", 0), (2, None, 0), (3, "x " * 900, 1)], "k long, func_before string, vul int")
    tok = Tokenizer.from_file(path)
    for r in score.encoded(rows, path).collect():
        ids = tok.encode(r["func_before"] or "").ids[: score.MAX_LENGTH]
        assert r["input_ids"] == ids + [1] * (score.MAX_LENGTH - len(ids)) and sum(r["attention_mask"]) == len(ids) and r["labels"] == r["vul"]
    got = score.batches(spark.range(50).withColumnRenamed("id", "k"), "k").groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in got) == [(0, 16), (1, 16), (2, 16), (3, 2)]


def test_export(spark, tmp_path):
    (tmp_path / "good.c").write_text(GOOD)
    said = []
    assert gate.main(spark, ["export", str(tmp_path)], scorer(0), said.append) == 0
    (key, value), = json.loads(said[0]).items()
    assert key.endswith("good.c") and value["verdict"] == "likely_safe" and value["confirmed"] == []


def test_files(spark, tmp_path):
    for name in ("b.C", "_a.h", ".h.cpp", "build/x.c", "sub/z.hxx", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"a\r\nb\xff\rc")
    paths = files.list_files(spark, str(tmp_path))
    names = [r["path"][len(str(tmp_path)) + 1 :] for r in paths.collect()]
    assert names == [".h.cpp", "_a.h", "b.C", "sub/z.hxx"]
    missing = paths.union(spark.createDataFrame([(str(tmp_path / "gone.c"),)], "path string"))
    rows = files.read_files(missing).collect()
    assert [r["code"] for r in rows if r["error"] is None] == ["a\nb�\nc"] * 4
    assert sum(r["error"] is not None for r in rows) == 1
    results = gate.scan_results(files.read_files(missing), scorer(0))
    assert gate.summary(results).first().asDict() == {"n_files": 5, "n_flagged": 0}


def test_weights_round_trip(spark, tmp_path):
    made = datasets.weights_json(spark.createDataFrame([(0, 0.5), (1, 2.0)], "vul int, weight double"))
    (tmp_path / "w.json").write_text(made)
    assert {r["vul"]: r["weight"] for r in datasets.read_weights(spark, str(tmp_path / "w.json")).collect()} == {0: 0.5, 1: 2.0}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/bad.c").write_text(BAD)
    got = []
    q = watch.watch(spark, str(tmp_path / "in"), scorer(1), lambda df, n: got.extend(df.select("verdict").collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["verdict"] for r in got] == ["vulnerable"]
