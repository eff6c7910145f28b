import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import checks
from lexiloom.operators import audit, design, norms, retrieval, stats
from lexiloom.operators import language_model as lm


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 2.0)], "k int, w double")
    with pytest.raises(ValueError):
        checks.checked_join(a, b, ["k"])
    assert checks.checked_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(ValueError):
        checks.require_columns(a, ["k", "zz"])
    r = spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(checks.safe_rate("a", "b").alias("x"), checks.safe_rate("a", "b", 0.0).alias("y")).first()
    assert r["x"] is None and r["y"] == 0.0
    c = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(checks.safe_corr("a", "b").alias("r")).first()
    assert c["r"] is None


def test_spline_is_a_partition_of_unity_and_matches_lstsq(spark):
    g = np.random.default_rng(0)
    age = g.uniform(48, 120, 200)
    y = np.sin(age / 20) + g.normal(0, 0.1, 200)
    df = spark.createDataFrame([(float(a), float(v), i % 4 != 0) for i, (a, v) in enumerate(zip(age, y))], "age double, y double, td boolean")
    b = norms.spline_basis(F.col("age"), 48.0, 80.0, 120.0)
    s = df.select(sum(b[1:], b[0]).alias("s")).toPandas()["s"]
    assert np.allclose(s, 1)
    out = norms.spline_norm(df, ["y"], "age", F.col("td")).toPandas()
    td = out[out.td]
    assert abs((td.y - td.y_td_expected).mean()) < 1e-9 and abs(td.y_td_z.std() - 1) < 1e-6


def test_profile_bands_percentiles(spark):
    df = spark.createDataFrame([(1, 1.0, 0.2, 0.1, 0.0), (2, 0.3, 0.2, 0.1, 0.0), (3, None, 1.0, 0.0, 0.0)], "id int, a double, b double, c double, d double")
    got = {r["id"]: r["l"] for r in df.select("id", norms.profile_label({"a": "A", "b": "B", "c": "C", "d": "D"}).alias("l")).collect()}
    assert got == {1: "A", 2: "balanced", 3: None}
    x = spark.createDataFrame([(i, float(i), i <= 9) for i in range(1, 13)], "id int, v double, r boolean")
    p = {r["id"]: r["percentile"] for r in norms.reference_percentile(x, "v", F.col("r")).collect()}
    assert math.isclose(p[3], 3 / 9) and p[12] == 1.0
    bands = norms.tertile_bands(x, "v", F.col("r")).groupBy("band_reference").count().collect()
    assert {r[0]: r[1] for r in bands if r[0]} == {"mild": 3, "moderate": 3, "severe": 3}


def test_fold_model_equals_a_rebuilt_one(spark):
    docs = {0: [["a", "b"], ["a"]], 1: [["b", "c"]], 2: [["a", "b", "d"]]}
    df = spark.createDataFrame([(k, k % 2, v) for k, v in docs.items()], "id int, fold int, utterance_tokens array<array<string>>")
    got = {r["id"]: r["perplexity"] for r in lm.fold_perplexity(df, "id", "fold", 2).collect()}
    for k, us in docs.items():
        train = [u for j, v in docs.items() if j % 2 != k % 2 for u in v]
        pad = lambda u: ["<s>", *u, "</s>"]
        grams = [tuple(pad(u)[i : i + 2]) for u in train for i in range(len(u) + 1)]
        vocab = {w for u in train for w in pad(u)}
        logs = []
        for u in us:
            p = pad(u)
            for i in range(len(u) + 1):
                logs.append(math.log((grams.count((p[i], p[i + 1])) + 0.5) / (sum(g[0] == p[i] for g in grams) + 0.5 * len(vocab))))
        assert math.isclose(got[k], math.exp(-sum(logs) / len(logs)), rel_tol=1e-9)
    folds = lm.numpy_folds([str(i) for i in range(11)], 5, 0)
    assert sorted(folds.values()) == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_neighbours(spark):
    df = spark.createDataFrame([(1, "g", 0.0, 1.0), (2, "g", 0.1, None), (3, "g", 5.0, 2.0)], "id int, grp string, x double, y double")
    n = retrieval.zscore_neighbours(df, df, "grp", "id", "id", ["x", "y"], F.col("query_id") == F.col("candidate_id"))
    best = {r["query_id"]: r["candidate_id"] for r in n.where("rank = 1").collect()}
    assert best == {1: 2, 2: 1, 3: 1}
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "a", [0.0, 1.0])], "id int, g string, v array<double>")
    kept = sorted(r["id"] for r in retrieval.greedy_distinct(v, "id", "v", "g").collect())
    assert kept == [1, 3]
    r = spark.createDataFrame([(["a", "b", "c"], ["a", "c"])], "a array<string>, b array<string>").select(retrieval.rouge_l("a", "b").alias("s")).first()
    assert math.isclose(r["s"], 0.8)


def test_rank_tests(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (4.0, False)], "v double, s boolean")
    m = stats.mann_whitney(df, "v", F.col("s")).first()
    assert m["u"] == 0.5 and math.isclose(m["auc"], 0.5 / 6)
    k = stats.ks_two_sample(df, "v", F.col("s")).first()
    assert math.isclose(k["d"], 1 - 1 / 3)
    z = spark.createDataFrame([(0.5,), (1.96,), (3.0,)], "z double").select(stats.normal_tail(F.col("z")).alias("p")).toPandas()["p"]
    assert np.allclose(z, [0.3085375, 0.0249979, 0.0013499], atol=1e-6)
    b = stats.bh_adjust(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double"), "p").orderBy("p").toPandas()
    assert np.allclose(b.p_adjusted, [0.03, 0.04, 0.04])


def test_mixed_model_recovers_parameters(spark):
    g = np.random.default_rng(1)
    rows = []
    for c in range(200):
        u = g.normal(0, 2)
        rows += [(c, float(x), float(1 + 3 * x + u + e)) for x, e in zip(g.normal(size=6), g.normal(size=6))]
    m = {r["term"]: r["estimate"] for r in stats.random_intercept(spark.createDataFrame(rows, "c int, x double, y double"), "y", ["x"], "c").collect()}
    assert abs(m["x"] - 3) < 0.1 and abs(m["tau"] - 2) < 0.3 and abs(m["sigma"] - 1) < 0.1


def test_designs(spark):
    kids = [(0, i, float(a), t) for i, (a, t) in enumerate([(1.0, True), (2.0, True), (1.9, False), (2.1, False), (9.0, False)])]
    df = spark.createDataFrame(kids, "cohort int, id int, age double, target boolean")
    assert sum(r["gap"] for r in design.optimal_match(df, "cohort", "id", "age", "target").collect()) == pytest.approx(1.0)
    assert [(r["target_id"], r["control_id"]) for r in design.greedy_match(df, "cohort", "id", "age", "target").orderBy("target_id").collect()] == [(0, 2), (1, 3)]
    roster = spark.createDataFrame([(f"p{i}", i, 100 + i) for i in range(5)], "pair_id string, td_child_id int, sli_child_id int")
    rounds = design.prompt_rounds(roster, 2, ["td_child_id"])
    assert [r["prompt_pair_count"] for r in rounds.orderBy("pair_order").collect()] == [2, 2, 2, 2, 1]
    m = design.eval_manifest(rounds)
    own = {r["pair_id"]: r["round_index"] for r in rounds.collect()}
    assert all(own[r["eval_pair_id"]] != r["round_index"] for r in m.collect()) and m.count() == 20
    inv = audit.column_inventory(spark.createDataFrame([(1, None), (2, None)], "id int, v string"))
    assert {r["column_name"]: (r["is_constant"], r["is_id_like"]) for r in inv.collect()} == {"id": (0, 1), "v": (1, 0)}


def test_manifest_is_made_in_many_tasks(spark):
    """Rounds are numbered in one task, and the whole list, which grows with their square, was made in that one too."""
    roster = spark.range(400).selectExpr("concat('p', id) AS pair_id", "id AS td_child_id", "id + 1000 AS sli_child_id").coalesce(1)
    m = design.eval_manifest(design.prompt_rounds(roster, 7, ["td_child_id"]))
    tasks = m.groupBy(F.spark_partition_id().alias("p")).count().collect()
    n = sum(r["count"] for r in tasks)
    assert n == 2 * (400 * 58 - 400) and len(tasks) > 3 and max(r["count"] for r in tasks) < n / 3
    want = {(k, f"p{i}", g, str(i + (1000 if g == "SLI" else 0))) for i in range(400) for k in range(1, 59) for g in ("TD", "SLI") if k != i // 7 + 1}
    assert set(map(tuple, m.collect())) == want


def test_bootstrap_takes_all_rows(spark, tmp_path):
    from lexiloom.plans.measure_queries import bootstrap_interval

    g = np.random.default_rng(4)
    n = 3001
    # the first rows differ from all the others
    rows = [(i, int(g.integers(100, 900)) + (4000 if i < 500 else 0) + 50 * (i % 2), i % 2) for i in range(n)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = bootstrap_interval(spark, str(tmp_path)).first()
    v, q = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows]) == 1
    draw = lambda x: np.median(g.choice(x, (4000, len(x))), 1)
    want = np.percentile(draw(v[~q]) - draw(v[q]), [2.5, 97.5])
    assert got["reps"] == 10_000 and abs(got["difference_low"] - want[0]) < 6 and abs(got["difference_high"] - want[1]) < 6


def test_bootstrap_of_few_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (None, True), (4.0, False), (4.0, False)], "v double, s boolean")
    r = stats.bootstrap(df, "v", F.col("s")).first()
    assert (r["difference_low"], r["difference_high"], r["ratio_low"], r["ratio_high"]) == (2.0, 3.0, 2.0, 4.0)
    r = stats.bootstrap(df.where("not s"), "v", F.col("s")).first()
    assert r["reps"] == 10_000 and math.isnan(r["difference_low"])


def test_matching_takes_every_customer(spark, tmp_path):
    from lexiloom.plans import measure_queries as Q

    def least(t, c):
        row = [0] * (len(c) + 1)
        for x in sorted(t):
            new = [math.inf]
            for j, y in enumerate(sorted(c)):
                new.append(min(new[j], row[j] + abs(x - y)))
            row = new
        return row[-1]

    g = np.random.default_rng(6)
    rows = [(i, int(g.integers(0, 25)), int(g.integers(-99_999, 999_999)) / 100) for i in range(1, 2001)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    best = Q.optimal_match(spark, str(tmp_path)).toPandas()
    near = Q.greedy_match(spark, str(tmp_path)).toPandas()
    for got in (best, near):
        assert set(got.target_id) == set(range(4, 2001, 4)) and got.control_id.is_unique and (got.control_id % 4 != 0).all()
    for k in range(5):
        t = [round(b * 100) for i, n, b in rows if n % 5 == k and i % 4 == 0]
        c = [round(b * 100) for i, n, b in rows if n % 5 == k and i % 4 != 0]
        assert best[best.cohort == k].gap.sum() == pytest.approx(least(t, c) / 10_000, abs=1e-9)
    chosen = Q.balanced_prompt_choice(spark, str(tmp_path)).toPandas()
    for k in range(5):
        s = chosen[chosen.cohort == k].sort_values("slot")
        left = sorted((i, b / 100) for i, n, b in rows if n % 5 == k and i % 4 != 0)
        for slot, i in zip(s.slot, s.chosen):
            want = min(left, key=lambda r: (abs(r[1] - slot * 1.5), r[0]))
            assert i == want[0]
            left.remove(want)


def test_optimal_match_equals_every_assignment(spark):
    from itertools import permutations

    g = np.random.default_rng(8)
    rows = [(k, 10_000 * k + int(i), float(g.integers(0, 6)), bool(i % 3 == 0)) for k in range(30) for i in g.permutation(9)]
    got = design.optimal_match(spark.createDataFrame(rows, "cohort int, id int, age double, target boolean"), "cohort", "id", "age", "target").toPandas()
    for k in range(30):
        t, c = [r for r in rows if r[0] == k and r[3]], [r for r in rows if r[0] == k and not r[3]]
        want = min((sum(abs(a[2] - b[2]) for a, b in zip(t, p)), sum(b[1] for b in p)) for p in permutations(c, len(t)))
        mine = got[got.cohort == k]
        assert (mine.gap.sum(), mine.control_id.sum()) == want


def test_detectability_runs_the_whole_operator(spark, tmp_path, monkeypatch):
    from lexiloom.plans import text_queries as Q

    seen = []
    plain = Q.detectability
    monkeypatch.setattr(Q, "detectability", lambda df, *a, **k: (seen.append(df), plain(df, *a, **k))[1])
    rows = [(i, ("alpha beta " if i % 2 else "gamma delta ") * (1 + i % 3), i % 2) for i in range(60)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    out = Q.detectability_auc(spark, str(tmp_path)).toPandas()
    assert sorted(out.fold) == [0, 1, 2, 3, 4] and (out.auc == 1).all()
    assert {len(g) for g in seen[0].first()["grams"]} == {3, 4, 5}


def test_vocabulary_shuffles_texts_and_terms_once(spark):
    from lexiloom.operators import detectability as X

    rows = [(i % 7, i % 2, "ab ab cde" if i % 3 else "abcd xyz") for i in range(20)]
    df = spark.createDataFrame(rows, "k long, fold int, text string")
    grams = retrieval.word_char_ngrams
    got = X.gram_holders(df, "k", "text", grams)
    want = X.gram_counts(df, "k", grams(F.col("text"))).select("fold", "term")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the n-grams of a text are worked out after the last exchange
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("Aggregate") and plan.count("Aggregate") == 1


def test_neighbours_in_parts_of_the_pool(spark, monkeypatch):
    g = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], float(g.integers(0, 9)), None if i % 5 == 0 else float(g.integers(0, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, grp string, x double, y double")
    queries = df.where("id % 4 = 0").union(df.where("id = 4"))  # one of them twice
    run = lambda **k: sorted(map(tuple, retrieval.zscore_neighbours(queries, df, "grp", "id", "id", ["x", "y"], F.col("query_id") == F.col("candidate_id"), **k).drop("margin").collect()))
    whole, best = run(), run(best=2)
    assert len(whole) == 10 * 19 and {r[3] for r in whole if r[1] == 4} == {1, 2}
    monkeypatch.setattr(retrieval, "POOL_ROWS", 3)
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in run()] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in whole]
    assert best == [r for r in whole if r[-1] <= 2]


def test_vectors_of_texts_whose_key_is_named_id(spark):
    from lexiloom.operators import detectability as X

    df = spark.createDataFrame([(i, i % 2, "ab abc" if i % 3 else "abc xyz") for i in range(12)], "id long, fold int, text string")
    counts = X.gram_counts(df, "id", retrieval.word_char_ngrams(F.col("text")))
    vectors, width = X.gram_vectors(df.drop("text"), counts, X.gram_index(counts, {0: 6, 1: 6}), "id", [0, 1])
    assert width > 0 and sorted(r["id"] for r in vectors.collect()) == list(range(12))


def test_nearest_by_terms_in_blocks_equals_brute_force(spark):
    """Pairs were written a row for each term they share; now blocks meet blocks (here of four texts), also at slices without a name."""
    from lexiloom.operators.evaluation import nearest_by_terms

    g = np.random.default_rng(5)
    texts = [(i, [None, "a", "b"][int(g.integers(3))], [str(w) for w in g.choice(list("uvwxyz"), int(g.integers(1, 6)))]) for i in range(40)]
    texts += [(40, "a", ["none"]), (41, "c", ["u"]), (42, "a", texts[0][2]), (43, "a", texts[0][2]), (44, "a", [])]
    real = spark.createDataFrame(texts, "id long, s string, terms array<string>")
    others = [(i + 100, s, w) for i, s, w in texts]
    rows = spark.createDataFrame(others, "id long, s string, terms array<string>")

    def want(asked, leave_out):
        out = {}
        for i, s, terms in asked:
            pool = [(j, w) for j, z, w in texts if z == s]
            df = collections.Counter(t for _, w in pool for t in set(w))

            def unit(w):
                x = {t: (1 + math.log(n)) * (math.log((1 + len(pool)) / (1 + df[t])) + 1) for t, n in collections.Counter(w).items() if t in df}
                size = math.sqrt(sum(v * v for v in x.values()))
                return {t: v / size for t, v in x.items()}

            x = unit(terms)
            near = [(round(sum(v * x.get(t, 0) for t, v in unit(w).items()), 12), j) for j, w in pool if not (leave_out and i == j)]
            best = min(near, key=lambda p: (-p[0], p[1]), default=(None, None))
            out[i] = (len(near), best[1], best[0], sum(p[0] for p in near) / len(near) if near else None)
        return out

    for asked, table, leave_out in ((texts, real, True), (others, rows, False)):
        truth = want(asked, leave_out)
        for block in (4, 1000):
            got = {r[1]: tuple(r[2:]) for r in nearest_by_terms(real, table, ["s"], "id", "terms", leave_out, block).collect()}
            assert len(got) == len(asked)
            for i, (n, best, top, mean) in truth.items():
                low = [j for j, z, _ in texts if z == dict((a, b) for a, b, _ in asked)[i] and not (leave_out and j == i)]
                assert got[i][0] == n and (n == 0 or abs(got[i][2] - top) < 1e-9 and abs(got[i][3] - mean) < 1e-9), i
                if n and top > 0:
                    assert got[i][1] == best, i
                elif n:  # shares nothing: the first one, the last if it is the first itself
                    assert got[i][1] in (min(low), max(low)), i


def test_cosines_of_frequent_and_rare_columns():
    from lexiloom.operators.evaluation import _cosines

    g = np.random.default_rng(2)
    a, b = (g.random((n, 50)) * (g.random((n, 50)) < np.linspace(0.01, 0.9, 50)) for n in (23, 31))
    table = lambda m: (*(x.astype(np.int64) for x in np.nonzero(m)), m[np.nonzero(m)])
    for often in (0.0, 0.3, 2.0):
        out = np.zeros((23, 31))
        for lo, s in _cosines(table(a), table(b), 31, often, 7, 40):
            out[lo : lo + len(s)] += s
        assert np.allclose(out, a @ b.T)


def test_measures_that_are_not_asked_for_are_not_made(spark):
    from lexiloom.operators.evaluation import slice_report, text_metrics

    rows = [(i, i % 2, 0, f"the dog {'ran' if i % 3 else 'sat'} {i}", ["the", "dog", "ran" if i % 3 else "sat"]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, grp int, story_id int, text string, tokens array<string>")
    sides = df.where("id < 8"), df.where("id >= 8")
    whole, base = text_metrics(*sides, ["grp", "story_id"], "id", "text", "tokens")
    got, less = text_metrics(*sides, ["grp", "story_id"], "id", "text", "tokens", ("terms", "bigram"))
    assert not [c for c in got.columns + less.columns if "rouge" in c or "unigram" in c] and "nearest_rouge_l_f1" in base.columns
    order = lambda d, c: sorted(map(repr, d.select(*c).collect()))
    assert order(whole, got.columns) == order(got, got.columns)
    report = slice_report(got, less)
    assert order(slice_report(whole, base), report.columns) == order(report, report.columns)


def test_char_ngrams_of_words_equal_their_sql(spark):
    import pyarrow as pa

    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))  # more letters than fit 64 bits
    for words in (["a", "ab", "abcdef", "wörld", "日本語", "x\0y"], ["q"], [], [wide, "ab", wide[:7]]):
        terms, ids, size = retrieval.char_ngrams(pa.array(words, pa.string()))
        terms, ends = terms.to_pylist(), np.cumsum(size)
        got = [sorted(terms[j] for j in ids[e - n : e]) for e, n in zip(ends, size)]
        rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
        assert len(set(terms)) == len(terms)
        assert got == [sorted(r[1]) for r in sorted(rows.select("i", retrieval.word_char_ngrams(F.col("w"))).collect())]


def test_told_apart_is_the_minimum_and_writes_terms_once(spark, monkeypatch):
    """Fitted to the end (it used to stop where single probabilities were some hundredths away), from texts written in a few bytes a
    term for all folds, where each fold had its own vectors of 12 bytes a term."""
    from lexiloom.operators import detectability as X

    g = np.random.default_rng(4)
    words = ["".join(g.choice(list("abcde"), int(g.integers(1, 6)))) for _ in range(60)]
    texts = [(i, int(i % 3 == 0), " ".join(g.choice(words[: 45 + 15 * (i % 2 or i % 3 == 0)], int(g.integers(0, 40))))) for i in range(90)]
    texts[7] = (7, 0, None)
    texts[8] = (8, 0, "aaa " * 300)  # a count beyond a byte
    df = spark.createDataFrame(texts, "id long, y int, text string")
    sizes, plain = [], X.kept
    monkeypatch.setattr(X, "kept", lambda t: (sizes.append(t.columns), plain(t))[1])
    monkeypatch.setattr(X, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(X, "TERMS_AT_ONCE", 70)
    monkeypatch.setattr(X, "WORDS_CUT", 300)
    got = {r[0]: r[1:] for r in X.told_apart(df, "id", "grams", "y", text="text").collect()}
    assert len(got) == 90 and not any("x0" in c for c in sizes)
    listed = X.told_apart(df.withColumn("grams", retrieval.word_char_ngrams(F.col("text"))), "id", "grams", "y").collect()
    assert {r[0]: round(r[3], 9) for r in listed} == {i: round(r[2], 9) for i, r in got.items()}

    def grams(text):
        padded = [f" {w} " for w in (text or "").split()]
        return collections.Counter(w[i : i + n] for w in padded for n in (3, 4, 5) for i in range(len(w) - n + 1))

    for f in range(5):
        train = [t for t in texts if got[t[0]][1] != f]
        df_ = collections.Counter(t for x in train for t in grams(x[2]))
        at = {t: i for i, t in enumerate(sorted(t for t, n in df_.items() if n >= 2))}

        def vector(text):
            x = np.zeros(len(at) + 1)
            for t, n in grams(text).items():
                if t in at:
                    x[at[t]] = (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df_[t])) + 1)
            x /= np.linalg.norm(x) or 1
            x[-1] = 1
            return x

        x, y = np.array([vector(t[2]) for t in train]), np.array([t[1] for t in train])
        w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        ridge, b = np.append(np.ones(len(at)), 0), np.zeros(len(at) + 1)
        for _ in range(30):  # Newton
            p = 1 / (1 + np.exp(-x @ b))
            b -= np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(ridge + 1e-12), x.T @ (w * (p - y)) + ridge * b)
        for i, label, text in texts:
            if got[i][1] == f:
                assert got[i][0] == label and abs(got[i][2] - 1 / (1 + math.exp(-vector(text) @ b))) < 2e-3, i
