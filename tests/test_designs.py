"""Packages, plans, drivers and the operators that SQL cannot say."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import __main__ as cli
from lexiloom import drivers
from lexiloom.operators import columns, learning, lines, packages, retrieval, stats
from lexiloom.sources import chat, clan, sinks

CHA = "@UTF8\n@Begin\n@ID:\teng|Corpus|CHI|4;06.15|male|{grp}||Target_Child|||\n@G:\tA1\n{said}@End\n"


def transcripts(folder, n=24):
    folder.mkdir(parents=True, exist_ok=True)
    g = np.random.default_rng(0)
    words = "the dog ran home and it goed away then a big frog sat down".split()
    for i in range(n):
        said = "".join(f"*CHI:\t( . ) {' '.join(g.choice(words, 6))} [* m:=ed] .\n%umor:\tverb|go-Fin-Ind-Past-S3 noun|dog\n%ugra:\t1|2|ROOT 2|1|OBJ\n" for _ in range(4))
        (folder / f"{100 + i}.cha").write_text(CHA.format(grp="TD" if i % 2 else "SLI", said=said))
    return str(folder)


def read(spark, path):
    return clan.read_text_csv(spark, path)


def test_transcript_drivers(spark, tmp_path):
    root, out = transcripts(tmp_path / "in"), str(tmp_path / "out")
    cli_args = cli.parser().parse_args(["normalize-initial-pauses", root, out, "--dry-run"])
    assert cli_args.dry_run and cli_args.command in drivers.EDITORS
    drivers.edit(spark, "normalize-initial-pauses", root, f"{out}/dry", True)
    assert {r["changed"] for r in read(spark, f"{out}/dry/changed").collect()} == {"4"}
    drivers.edit(spark, "normalize-initial-pauses", root, f"{out}/edited")
    edited = chat.read_transcripts(spark, f"{out}/edited")
    assert edited.count() == 24 and edited.where("content like '%*CHI:\t(.) %'").count() == 24
    drivers.error_codes(spark, root, f"{out}/err")
    assert {r["error_morphology_total"] for r in read(spark, f"{out}/err/errors").collect()} == {"4"}
    drivers.past_verbs(spark, root, f"{out}/past")
    row = read(spark, f"{out}/past/past").first()
    assert (row["overt_past_finite_verbs"], row["past_overgeneralization_errors"]) == ("4", "4")
    drivers.syntax(spark, root, f"{out}/syn")
    assert read(spark, f"{out}/syn/syntax").count() == 24
    drivers.file_list(spark, root, f"{out}/list")
    assert spark.read.text(f"{out}/list").count() == 24
    drivers.narratives(spark, root, f"{out}/nar")
    assert json.loads(read(spark, f"{out}/nar/narratives").first()["story_units_json"])


def test_perplexity_driver(spark, tmp_path):
    real = transcripts(tmp_path / "real")
    fake = tmp_path / "fake"
    fake.mkdir()
    for i in range(6):
        (fake / f"pair_sli{100 + i}_td{200 + i}_rep1_TD_bundle.cha").write_text(CHA.format(grp="TD", said="*CHI:\ta frog sat on a log .\n" * 3))
    out = str(tmp_path / "out")
    drivers.text_perplexity(spark, str(fake), real, out, folds=3)
    got = read(spark, f"{out}/scores").groupBy("source").agg(F.avg("perplexity").alias("p"), F.count("*").alias("n")).collect()
    by = {r["source"]: r for r in got}
    assert by["synthetic"]["n"] == 6 and by["real"]["n"] == 12 and by["synthetic"]["p"] > 0
    assert json.loads(spark.read.text(f"{out}/summary").first()[0])["n_a"] == 6
    drivers.text_perplexity(spark, str(fake), real, out, folds=3, exclude=True)
    assert read(spark, f"{out}/scores").where("source = 'real'").count() == 9


def test_redundancy_driver(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 7) * 2, (i * 37) % 11, "k") for i in range(50)]
    spark.createDataFrame(rows, "File_ID long, a double, b double, c long, d string").coalesce(1).write.csv(str(tmp_path / "t"), header=True)
    drivers.redundancy(spark, str(tmp_path / "t"), str(tmp_path / "o"))
    report = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "o/report")).collect())
    assert "| a | b | 50 | 1.0000 |" in report and "| a | a, b |" in report and "| d |" in report


def test_text_evaluation_driver(spark, tmp_path):
    real, fake = transcripts(tmp_path / "real", 12), transcripts(tmp_path / "fake", 8)
    out = str(tmp_path / "o")
    drivers.text_evaluation(spark, fake, real, out)
    report = {(r["summary_level"], r["grp"]): r for r in read(spark, f"{out}/report").collect()}
    assert ("overall", "ALL") in report and report["overall", "ALL"]["n_synthetic"] == "8"
    assert float(report["overall", "ALL"]["real_nearest_rouge_l_median"]) > 0


def test_matched_pool_raises(spark):
    m = spark.createDataFrame([("1", "TD"), ("2", "TD")], "eval_child_id string, eval_group string")
    r = spark.createDataFrame([(1.0, "TD", 3)], "File_ID double, Group string, v int")
    assert packages.matched_pool(m.limit(1), r).first()["v"] == 3
    with pytest.raises(Exception, match="no measures"):
        packages.matched_pool(m, r).collect()


def test_loocv_plan(spark):
    kids = [(i, "SLI" if i < 3 else "TD", 50.0 + i, "mild", "x", ["A1", "A2", "B1"]) for i in range(8)]
    refs = [("A1", "A2", "B1", 53.0, 50.0, "mild", "x"), ("A2", "A1", "B1", 54.0, 52.0, "severe", "y")]
    plan = packages.loocv_plan(spark.createDataFrame(kids, "id long, grp string, age double, band string, label string, stories array<string>"), spark.createDataFrame(refs, "target_story string, e1_story string, e2_story string, td_age double, sli_age double, sli_band string, sli_label string"))
    prompts = {(r["fold_id"], r["target_story"]): (r["target_td_child_id"], r["prompt_sli_child_id"]) for r in plan["prompts"].collect()}
    # the first fold holds out child 0 and its nearest control, 3; the unused and nearest come first
    assert prompts["fold_01_sli_0", "A1"] == (4, 1) and prompts["fold_01_sli_0", "A2"] == (5, 2)
    s = packages.plan_summary(plan).first()
    assert (s["folds"], s["unique_td_eval_children"], s["least_eval_rows"], s["most_eval_rows"]) == (3, 3, 6, 6)


def test_column_decisions_raise(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="decision"):
        columns.specification(spark, ["a", "b"], {"a": ("keep", "key", "")}, ["a"])
    with pytest.raises(ValueError, match="Missing"):
        columns.severity_table(df, ["a", "c"])


def test_repair_takes_the_other_tiers(spark):
    def block(said, umor, mor):
        return f"*CHI:\t{said}\n%umor:\t{umor}\n%ugra:\t1|2|DEP 2|2|ROOT\n%mor:\t{mor}\n%gra:\t1|2|DEP 2|0|ROOT\n"

    good = block("he ran .", "pro|he verb|run .", "pro|he verb|run .")
    other = block("he ran .", "pro|he verb|run adv|home noun|dog .", "n|a n|b n|c n|d .")
    end = block("did he ?", "aux|do pro|he ?", "aux|do pro|he .")
    f = spark.createDataFrame([("x", good + other + end)], "path string, content string")
    got = [r["line"] for r in lines.repair_tiers(chat.lines_of(f)).orderBy("line_no").collect() if r["line"].startswith("%mor")]
    assert got == ["%mor:\tpro|he verb|run .", "%mor:\tpro|he verb|run adv|home noun|dog .", "%mor:\taux|do pro|he ?"]


def test_encoder_and_scorer(spark):
    learning.register_encoder("letters", lambda: lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts], float))
    df = spark.createDataFrame([(1, "aab"), (2, "b"), (3, None)], "k long, t string")
    got = {r["k"]: list(r["embedding"]) for r in learning.encode(df, "k", "t", "letters", batch=2).collect()}
    assert np.allclose(got[1], [0.8944, 0.4472], atol=1e-4) and got[2] == [0.0, 1.0] and got[3] == [0.0, 0.0]
    scored = learning.score_with(df.where("t is not null"), "k", ["t"], lambda t: len(t))
    assert {r["k"]: r["score"] for r in scored.collect()} == {1: 3.0, 2: 1.0}


def test_nested_models_and_marginal_means(spark):
    g = np.random.default_rng(1)
    rows = [(c, float(x), float(z), float(2 * x + u + e)) for c, u in enumerate(g.normal(0, 1, 40)) for x, z, e in g.normal(size=(6, 3)) * [1, 1, 0.5]]
    df = spark.createDataFrame(rows, "c int, x double, z double, y double")
    got = {r["model"]: r for r in stats.nested_models(df, "y", [["x"], ["z"]], "c").collect()}
    assert got["m0"]["p"] is None and got["m1"]["p"] < 1e-6 and 0 <= got["m2"]["p"] <= 1 and got["m1"]["degrees"] == 1
    assert abs(stats.chi_square_tail(3.841459, 1) - 0.05) < 1e-6 and abs(stats.chi_square_tail(5.991465, 2) - 0.05) < 1e-6
    m = stats.marginal_means(stats.random_intercept(df, "y", ["x"], "c"), {"low": {"x": -1.0}, "high": {"x": 1.0}}).collect()
    by = {(r["level"], r["minus"]): r["estimate"] for r in m}
    assert abs(by["low", "high"] + 4) < 0.3 and abs(by["high", None] - by["low", None] + by["low", "high"]) < 1e-9


def test_quantiles_over_groups_with_nulls(spark):
    rows = [(None if i % 3 == 0 else "ab"[i % 2], float((i * 7919) % 101), None if i % 10 == 0 else float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {r["g"]: r for r in stats.quantiles(df, "v", {"lo": 0.1, "mid": 0.5, "hi": 0.975}, ["g"]).collect()}
    for g in (None, "a", "b"):
        x = [r[1] for r in rows if r[0] == g]
        assert np.allclose([got[g]["lo"], got[g]["mid"], got[g]["hi"]], np.quantile(x, [0.1, 0.5, 0.975])) and got[g]["n"] == len(x)
    wide = stats.quantiles_of(df, ["v", "w"], {"mid": 0.5}).first()
    assert np.isclose(wide["w_mid"], np.median([r[2] for r in rows if r[2] is not None]))


def test_rounds_in_neighbours(spark):
    q = spark.createDataFrame([("s1", "TD", 1, 1.0), ("s2", "TD", 2, 1.0)], "id string, g string, r int, v double")
    pool = spark.createDataFrame([("c1", "TD", 1, 1.5), ("c2", "TD", 2, 0.5), ("c3", "TD", 2, 3.0)], "id string, g string, r int, v double")
    got = {(r["query_id"], r["candidate_id"]) for r in retrieval.zscore_neighbours(q, pool, "g", "id", "id", ["v"], also=["r"]).collect()}
    assert got == {("s1", "c1"), ("s2", "c2"), ("s2", "c3")}


def test_generated_transcripts_and_manifest(spark, tmp_path):
    rows = [("b1", "p1", "A1", "The dog ran.", "It goed.", "4;01.", "4;02.")]
    spark.createDataFrame(rows, "bundle_id string, pair_id string, target_story string, stage1_td_story string, stage2_sli_story string, td_age string, sli_age string").write.csv(str(tmp_path / "t"), header=True)
    drivers.stories_to_transcripts(spark, str(tmp_path / "t"), str(tmp_path / "o"))
    got = chat.headers(chat.read_transcripts(spark, str(tmp_path / "o")))
    assert {(r["grp"], r["age"]) for r in got.collect()} == {("TD", "4;01."), ("SLI", "4;02.")}
    assert read(spark, str(tmp_path / "o/manifest")).count() == 2


def test_audit_cells(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "v double")
    assert [r[0] for r in df.select(sinks.cell(F.col("v"))).collect()] == ["1.5000", "NA"]


def test_longest_common_subsequence(spark):
    g = np.random.default_rng(2)
    pairs = [([str(x) for x in g.integers(0, 5, g.integers(0, 90))], [str(x) for x in g.integers(0, 5, g.integers(0, 90))]) for _ in range(60)] + [([], []), (["a"], [])]

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["s"] for r in df.select("i", retrieval.rouge_l("a", "b").alias("s")).collect()}
    assert all(abs(got[i] - brute(a, b)) < 1e-12 for i, (a, b) in enumerate(pairs))


def test_loocv_prompts_equal_a_full_search(spark):
    g = np.random.default_rng(3)
    stories = ["A1", "A2", "A3", "B1", "B2", "B3"]
    kids = [(i, "SLI" if g.random() < 0.4 else "TD", float(g.integers(0, 8)), "ab"[g.integers(2)], "xy"[g.integers(2)], [s for s in stories if g.random() < 0.8]) for i in range(60)]
    refs = [(s, stories[(i + 1) % 6], stories[(i + 2) % 6], float(g.integers(0, 8)), float(g.integers(0, 8)), "ab"[i % 2], "xy"[i % 3 % 2]) for i, s in enumerate(stories)]
    plan = packages.loocv_plan(spark.createDataFrame(kids, "id long, grp string, age double, band string, label string, stories array<string>"), spark.createDataFrame(refs, "target_story string, e1_story string, e2_story string, td_age double, sli_age double, sli_band string, sli_label string"))
    got = {(r["fold_id"], r["target_story"]): (r["target_td_child_id"], r["prompt_sli_child_id"]) for r in plan["prompts"].collect()}
    folds = plan["folds"].collect()
    assert len(got) == 6 * len(folds) > 60
    for f in folds:
        used = {}
        for story, e1, e2, td_age, sli_age, band, label in refs:
            td = [k for k in kids if k[1] == "TD" and k[0] != f["heldout_td_child_id"] and {story, e1} <= set(k[5])]
            sl = [k for k in kids if k[1] == "SLI" and k[0] != f["heldout_sli_child_id"] and e2 in k[5]]
            t = min(td, key=lambda k: (used.get(k[0], 0), abs(k[2] - td_age), k[0]))
            s = min(sl, key=lambda k: (k[4] != label, k[3] != band, used.get(k[0], 0), abs(k[2] - sli_age), k[0]))
            for k in (t, s):
                used[k[0]] = used.get(k[0], 0) + 1
            assert got[f["fold_id"], story] == (t[0], s[0])


def test_matching_grows_with_children_not_pairs():
    import time
    import tracemalloc

    from lexiloom.operators.design import best_controls, nearest_left

    g = np.random.default_rng(4)
    t, c = np.sort(g.integers(0, 10**9, 20_000)), np.sort(g.integers(0, 10**9, 60_000))
    tracemalloc.start()
    begin = time.process_time()
    best = best_controls(t.tolist(), c.tolist(), g.permutation(60_000).tolist())
    near = nearest_left(t / 1.0, c / 1.0)
    assert len(best) == len(set(near)) == 20_000 and abs(t - c[best]).sum() <= abs(t - c[near]).sum()
    # a bit for each pair took 150 MB
    assert tracemalloc.get_traced_memory()[1] < 60e6 and time.process_time() - begin < 60
    tracemalloc.stop()
