"""Single files as a data source, edits counted as they are written, scorers by name."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lexiloom import drivers
from lexiloom.sources import chat, sinks
from lexiloom.sources.files import read_files, write_files


def names(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def test_round_trip_and_push_down(spark, tmp_path):
    rows = [(f"{tmp_path}/a{i % 3}/f{i:03}.cha", f"line {i}\né\n" if i else None) for i in range(60)] + [(f"{tmp_path}/a0/x.txt", "other")]
    write_files(spark.createDataFrame(rows, "path string, content string").repartition(7))
    assert names(tmp_path) == sorted(os.path.relpath(r[0], tmp_path) for r in rows)  # and nothing that was staged
    got = {r["path"]: r["content"] for r in read_files(spark, str(tmp_path), "*.cha", split=40).collect()}
    assert got == {p: c or "" for p, c in rows[:-1]}
    os.chmod(rows[5][0], 0)
    some = read_files(spark, str(tmp_path)).where(F.col("path").endswith("7.cha") & (F.length("content") > 3))
    assert {os.path.basename(r["path"]) for r in some.collect()} == {f"f{i:03}.cha" for i in range(7, 60, 10)}
    assert "endswith" not in some._jdf.queryExecution().executedPlan().toString().lower().split("batchscan")[0]  # not tested again
    assert read_files(spark, str(tmp_path)).where(F.col("path") == rows[9][0]).first()["content"] == rows[9][1]
    assert read_files(spark, str(tmp_path), "*.none").count() == 0
    with pytest.raises(Exception, match="mounted folders only"):
        write_files(spark.createDataFrame([("s3a://x/y", "z")], "path string, content string"))


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "f0").write_text("old")

    @F.udf("string")
    def late(i):
        if i == 37:
            raise RuntimeError("lost")
        return "new"

    df = spark.range(40).repartition(4).select(F.concat(F.lit(f"{tmp_path}/f"), F.col("id").cast("string")).alias("path"), late("id").alias("content"))
    with pytest.raises(Exception, match="lost"):
        write_files(df)
    time.sleep(2)  # the other tasks of the job are stopped meanwhile
    assert names(tmp_path) == ["f0"] and (tmp_path / "f0").read_text() == "old"
    write_files(df.where("path not like '%37'"))
    assert len(names(tmp_path)) == 39 and (tmp_path / "f0").read_text() == "new"


def test_edits_are_counted_as_they_are_written(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    said = "@UTF8\n*CHI:\t( . ) he ran .\n*CHI:\tshe hid .\n*CHI:\t( .. ) oh .\n@End\n"
    write_files(spark.createDataFrame([(f"{src}/{i}.cha", said if i % 2 else said.replace("( ", "(")) for i in range(6)], "path string, content string"))
    got = drivers.edit(spark, "normalize-initial-pauses", str(src), str(out))
    assert got["lines"] == 30 and names(out) == [f"{i}.cha" for i in range(6)]
    dry = sinks.changed_in_place(sinks.edited(chat.lines_of(chat.read_transcripts(spark, str(src))), drivers.EDITORS["normalize-initial-pauses"]))
    per = {os.path.basename(r["path"]): r["changed"] for r in dry.collect()}
    assert sum(per.values()) == got["changed"] > 0
    plan = dry._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
    old = sinks.changed_counts(*(lambda x: (x, drivers.EDITORS["normalize-initial-pauses"](x)))(chat.lines_of(chat.read_transcripts(spark, str(src)))))
    assert {os.path.basename(r["path"]): r["changed"] for r in old.collect()} == per
    again = drivers.edit(spark, "normalize-initial-pauses", str(out), str(tmp_path / "out2"))
    assert again["changed"] == 0


def test_nearest_sequences_through_bounds_equal_all_pairs(spark):
    import random

    from lexiloom.operators import retrieval

    g = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 25
    texts = [g.choices(vocabulary, k=g.randint(1, 25)) for _ in range(80)]
    texts += [texts[3], texts[3][:-2], ["lone"], [], None, ["the"], ["the"] * 6]
    rows = [(i, "ab"[i % 2], x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, g string, t array<string>").repartition(3)
    for group in (None, "g"):
        want = {r["query_id"]: r for r in retrieval.rouge_neighbours(df.where("t is not null"), "id", "t", group).collect()}
        got = {r["query_id"]: r for r in retrieval.nearest_rouge(df, df, "id", "t", group).collect()}
        assert len(got) == len(rows)
        for i, r in want.items():
            assert abs(got[i]["nearest"] - r["nearest"]) < 1e-12 and (got[i]["nearest_id"] == r["nearest_id"] or r["nearest"] == 0), i
        assert got[84]["nearest"] == 0 and got[84]["nearest_id"] is None
        assert sum(r["compared"] for r in got.values()) < 0.5 * sum(1 for a in rows for b in rows if a[0] != b[0] and (group is None or a[1] == b[1]))


def test_scorers_by_name_module_and_file(spark, tmp_path, capsys):
    from lexiloom.__main__ import parser
    from lexiloom.operators import learning

    schema = "k long, a array<string>, b array<string>"
    df = spark.createDataFrame([(1, ["the dog ran", "it hid"], ["dog ran", "cat sat"]), (2, ["x"], ["x"]), (3, [], ["x"]), (4, None, ["x"]), (5, ["q"], ["r", "s"])], schema).repartition(2)
    score = lambda s: {r["k"]: r["score"] for r in learning.score_with(df, "k", ["a", "b"], s).collect()}
    assert score("unit-r-precision") == {1: 0.5, 2: 1.0, 3: None, 4: None, 5: 0.0}
    (tmp_path / "my_scorer.py").write_text("def count(a, b):\n    return len(a) + 10 * len(b)\n")
    assert score(f"{tmp_path}/my_scorer.py:count") == {1: 22.0, 2: 11.0, 3: None, 4: None, 5: 21.0}
    assert score("operator:eq") == {1: 0.0, 2: 1.0, 3: None, 4: None, 5: 0.0}
    assert score(lambda a, b: len(a)) == {1: 2.0, 2: 1.0, 3: None, 4: None, 5: 1.0}
    with pytest.raises(ValueError, match="No scorer"):
        score("nothing")
    args = parser().parse_args(["score-stories", "t", "r", "o", "--scorer", "m:f"])
    assert args.scorer == "m:f"
    (tmp_path / "m.csv").write_text("a,b\n1,x\n2,y\n")
    drivers.show(spark, str(tmp_path / "m.csv"), 1)
    assert "| 1 | x |" in capsys.readouterr().out
    assert drivers.validate_layout(spark, str(tmp_path), "m.csv,data") == ["data"]
    (tmp_path / "refs.json").write_text('{"S1": {"units": ["dog ran"]}}')
    (tmp_path / "n.csv").write_text('path,story_id,story_units_json\np,S1,"[""dog ran""]"\np,S2,"[""dog ran""]"\n')
    drivers.score_stories(spark, str(tmp_path / "n.csv"), str(tmp_path / "refs.json"), str(tmp_path / "out"))
    got = {r["_key"]: r["score"] for r in spark.read.csv(str(tmp_path / "out/scores"), header=True).collect()}
    assert float(got["p#S1"]) == 1.0 and got["p#S2"] is None
