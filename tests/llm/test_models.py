"""Learned operators: held-out accuracy, gradients, word counts, odd inputs."""

import collections
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import language, lm_scoring, quality, toxicity
from lexiloom.llm.base import SPACE, Words, text_bytes

TOK = pytest.mark.skipif(not os.path.exists(lm_scoring.TOKENIZER), reason="no tokenizer file")
EN, DE = "the of and to in that with from this have".split(), "der die und das nicht mit ein auch sich werden".split()


def texts(n=160, seed=0):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = EN if i % 2 else DE
        t = " ".join(g.choice(w, int(g.integers(8, 60))))
        tox = int(i % 5 == 0)
        if tox:
            t += " you idiot scum"
        q = int(i % 3 != 0)
        rows.append((i, t if q else t.upper() + "!!", "en" if i % 2 else "de", q, tox, "x"))
    return rows


SCHEMA = "doc_id long, text string, lang string, quality int, toxic int, k string"
ODD = [(1000, None, None, None, None, None), (1001, "", "en", 1, 0, None), (1002, "12 34 !!", "en", 1, 0, None), (None, "the of", None, 1, 0, None), (1003, "the " * 60000, "en", 1, 0, None)]


def test_word_hashes_are_exact_across_pieces():
    rows = ["The  quick\tbrown", "", "the QUICK\x0bbrown\n" * 50, "x" * 500 + " y", "é é"]
    data, offs = text_bytes(__import__("pyarrow").array(rows))
    for limit in (64, 1 << 18):
        got = collections.defaultdict(list)
        for doc, h, start, end, _ in Words(SPACE, True, limit)(data, offs):
            for d, x in zip(doc, h):
                got[int(d)].append(int(x))
        want = {i: r.lower().encode().split() for i, r in enumerate(rows)}
        assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items() if v}
        names = {}
        for i, v in got.items():
            for x, w in zip(v, want[i]):
                assert names.setdefault(x, w) == w


def test_language(spark):
    df = spark.createDataFrame(texts() + ODD, SCHEMA)
    model = language.fit_language(df.where("doc_id < 120"))
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert len(got) == 165 and np.mean([got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(120, 160)]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    assert got[1003]["lang_pred"] == "en"
    kept = language.keep_identified(df, model)
    assert kept.count() == 162 and kept.columns == df.columns
    none = language.fit_language(df.where("false"))
    assert language.identify(df, none).where("lang_pred = 'und'").count() == 165
    assert language.identify(df.where("false"), model).count() == 0


def test_convolution_tables_match_the_network():
    g = np.random.default_rng(0)
    m = language.ByteCNN(["a", "b"])
    x = g.integers(0, 256, (20, language.WINDOW), dtype=np.uint8)
    padded = np.concatenate([x, np.full((20, 1), 32, np.uint8)], 1)
    assert np.abs(m.compile().windows(padded) - m._forward(x)[3]).max() < 0.01


def test_toxicity(spark):
    df = spark.createDataFrame(texts() + ODD, SCHEMA)
    model = toxicity.fit_toxicity(df.where("doc_id < 120"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert len(got) == 165 and all(got[i]["predicted"] == int(i % 5 == 0) for i in range(120, 160))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == got[1001]["score"] < 0.5
    empty = toxicity.fit_toxicity(df.where("false"))
    assert toxicity.score_toxicity(df, empty).count() == 165


def test_factorization_gradient():
    m = toxicity.FactorizationMachine()
    doc, term = np.array([0, 0, 1, 1, 1]), np.array([3, 9, 3, 4, 9])
    z = m.logits(doc, term, 2)
    v = m.v.astype(float)
    assert math.isclose(z[0], m.b + v[3] @ v[9], abs_tol=1e-9)
    assert math.isclose(z[1], m.b + v[3] @ v[4] + v[3] @ v[9] + v[4] @ v[9], abs_tol=1e-9)


def test_pairs_tell_what_single_terms_cannot():
    """Toxic where an insult meets its own target, harmless where it meets the other: every single term is as frequent on both
    sides.  The pairwise part tells them apart, the linear part alone does not."""
    g = np.random.default_rng(0)
    rows, y = [], []
    for i in range(1200):
        a, b = g.integers(0, 2, 2)
        rows.append(" ".join([*g.choice(EN, 6), ["scum", "vermin"][a], *g.choice(EN, 3), ["northers", "southers"][b]]))
        y.append(int(a == b))
    data, offs = text_bytes(__import__("pyarrow").array(rows))
    doc, term = toxicity.terms(data, offs)
    cut = doc < 900
    m = toxicity.FactorizationMachine()
    m.fit(doc[cut], term[cut], np.array(y[:900], float))
    right = lambda: np.mean((m.logits(doc[~cut] - 900, term[~cut], 300) > 0) == (np.array(y[900:]) > 0))
    whole = right()
    m.v = np.zeros_like(m.v)
    assert whole > 0.95 and right() < 0.65


def test_models_over_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame(texts() + texts(3) * 2, SCHEMA).withColumns({c: F.lit(c) for c in ("t", "y", "l", "score", "predicted", "lang_pred")})
    vec = quality.corpus_vectors(df)
    model = language.fit_language(df)
    for got in (
        toxicity.score_toxicity(df, toxicity.fit_toxicity(df)),
        quality.score_quality(df, quality.fit_quality(df, vec), vec),
        language.identify(df, model),
    ):
        rows = got.where("doc_id < 3").collect()
        assert got.count() == 166 and len(rows) == 9 and len(set(rows)) == 3
    assert language.keep_identified(df, model).columns == df.columns


def test_unknown_languages_go(spark):
    df = spark.createDataFrame(texts(400), SCHEMA)
    model = language.fit_language(df)
    junk = [(i, t, "x", 0, 0, "x") for i, t in enumerate(["%$ 1#2 a ~~ ^^ 00" * 9, "\u0436" * 300, "12 34 56"])]
    kept = language.keep_identified(spark.createDataFrame(junk, SCHEMA), model).count()
    assert kept < len(junk) and language.keep_identified(df, model).count() == 400
    one = language.fit_language(df.where("lang = 'en'"))
    assert language.keep_identified(df, one).count() == 400


def test_pairs_of_all_frequent_terms_are_looked_at():
    """The bounded search for pairs against every pair, for rare and common labels and blocks of any size."""
    g = np.random.default_rng(0)
    for k in range(12):
        n, terms = int(g.integers(20, 200)), 60
        x = g.random((n, terms)) < g.random(terms) * 0.6
        y = ((x[:, 0] & x[:, 1]) | (g.random(n) < g.random() * 0.5)).astype(float)
        doc, term = np.nonzero(x)
        size = 1 << toxicity.BITS
        seen, hits = np.bincount(term, minlength=size), np.bincount(term, y[doc], size)
        f = x.astype(float)
        both, toxic, own = f.T @ f, (f * y[:, None]).T @ f, f.T @ y / np.maximum(f.sum(0), 1)
        e = np.clip(own[:, None] + own[None] - y.mean(), 0.02, 0.98)
        for chi2 in (4.0, 15.0):
            strays = (both >= 8) & ((toxic - both * e) ** 2 > chi2 * both * e * (1 - e)) & (seen[:terms] >= 8)[:, None] & (seen[:terms] >= 8)[None]
            np.fill_diagonal(strays, False)
            want = np.flatnonzero(strays.any(1)) if 0 < y.mean() < 1 else []
            for block in (1 << 21, 256):
                assert list(toxicity._in_pairs(doc, term, y, seen, hits, chi2, block=block)) == list(want)


def test_bounded_samples(spark):
    from lexiloom.llm.base import bounded_sample

    df = spark.range(10_000)
    got = {r[0] for r in bounded_sample(df, 500).collect()}
    assert len(got) == 500 and got == {r[0] for r in bounded_sample(df.repartition(7), 500).collect()}
    assert bounded_sample(df, 10_000).count() == bounded_sample(df, 20_000).count() == 10_000
    none = spark.range(20_000).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    assert bounded_sample(none, 300).distinct().count() == 300  # no ids, different texts
    equal = spark.range(20_000).select(F.lit(7).alias("id"), F.lit("t").alias("t"))
    assert bounded_sample(equal, 300).count() == 300
    assert bounded_sample(df.where("false"), 300).count() == 0


@pytest.mark.parametrize("same", [None, 5])
def test_models_learn_where_ids_are_missing_or_equal(spark, same):
    """Every row without an id, or with one and the same: languages are known, nothing is dropped, both labels are learned."""
    base = spark.createDataFrame(texts(200), SCHEMA).withColumn("doc_id", F.lit(same).cast("long"))
    docs = base.crossJoin(spark.range(40).select(F.col("id").alias("copy"))).withColumn("text", F.concat("text", F.lit(" "), F.col("copy").cast("string"))).drop("copy").repartition(8)
    model = language.fit_language(docs, sample=400)
    assert model.langs == ["de", "en"] and language.keep_identified(docs, model).count() == 8000
    fm = toxicity.fit_toxicity(docs, sample=400)
    assert toxicity.score_toxicity(docs, fm).where("predicted = 1").count() == 1600
    net = quality.fit_quality(docs, quality.corpus_vectors(docs), sample=400)
    good = quality.score_quality(docs, net, quality.corpus_vectors(docs)).where("predicted = 1").count()
    assert 5200 < good < 5500
    labels = spark.createDataFrame([(same, 1, 0), (same, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(docs, labels, "toxic", 400).count() == (400 if same else 0)


def test_quality_needs_its_vectors(spark):
    """Two classes of one shape that differ in words alone: the random-indexing vectors carry them."""
    g = np.random.default_rng(3)
    good, bad = "river stone cloud meadow".split(), "bargain coupon casino jackpot".split()
    rows = [(i, " ".join(g.choice(good if i % 2 else bad, 30)), "en", i % 2, 0, "x") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    vec = quality.corpus_vectors(df)
    right = lambda v: np.mean([r["predicted"] == r["doc_id"] % 2 for r in quality.score_quality(df.where("doc_id >= 200"), quality.fit_quality(df.where("doc_id < 200"), v), v, threshold=0.5).collect()])
    assert right(vec) > 0.95 and right(np.zeros_like(vec)) < right(vec)


def test_quality(spark):
    df = spark.createDataFrame(texts() + ODD, SCHEMA)
    vec = quality.corpus_vectors(df)
    model = quality.fit_quality(df.where("doc_id < 120"), vec)
    got = {r["doc_id"]: r for r in quality.score_quality(df, model, vec).collect()}
    assert len(got) == 165 and np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in range(120, 160)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = quality.corpus_vectors(df.where("false"))
    assert not none.any() and quality.score_quality(df, quality.fit_quality(df.where("false"), none), none).count() == 165


def _batch(ids, offs, which):
    """(inputs, first windows, targets, whether a target counts) of the given (text, window) pairs, cut one by one."""
    x, y, ok = (np.full((len(which), n), lm_scoring.END) for n in (lm_scoring.SLOTS, lm_scoring.STRIDE, lm_scoring.STRIDE))
    for i, (d, k) in enumerate(which):
        text = [lm_scoring.END, *ids[offs[d] : offs[d + 1]].tolist()]  # the input of target j is text[j]
        for slot in range(lm_scoring.SLOTS):
            j = k * lm_scoring.STRIDE + slot - lm_scoring.CONTEXT
            if 0 <= j < len(text):
                x[i, slot] = text[j]
            if slot >= lm_scoring.CONTEXT:
                ok[i, slot - lm_scoring.CONTEXT] = j + 1 < len(text)
                y[i, slot - lm_scoring.CONTEXT] = text[j + 1] if j + 1 < len(text) else lm_scoring.END
    return x, np.flatnonzero([k == 0 for _, k in which]), y, ok


def test_attention_gradients():
    m = lm_scoring.CausalModel(dim=8)
    g = np.random.default_rng(0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.start_from(g.integers(0, 5, (lm_scoring.VOCAB, lm_scoring.VOCAB)))
    ids, offs = g.integers(0, lm_scoring.PIECES, 200), np.array([0, 30, 31, 200])
    w = _batch(ids, offs, [(0, 0), (0, 1), (1, 0), (2, 0), (2, 3)])
    _, grad = m.step(*w)
    for k, v in grad.items():
        i = np.unravel_index(np.abs(v).argmax(), v.shape)
        m.p[k][i] += 1e-4
        a = m.step(*w)[0]
        m.p[k][i] -= 2e-4
        b = m.step(*w)[0]
        m.p[k][i] += 1e-4
        assert abs((a - b) / 2e-4 - v[i]) < 1e-5 + 1e-3 * abs(v[i]), k


def test_training_is_adam_and_only_meets_the_embeddings_of_a_batch():
    """Gradients and means of all embeddings, a hundred times those of a batch's ids, took much of op1's steps."""
    g = np.random.default_rng(2)
    start = lm_scoring.CausalModel(dim=8).start_from(g.integers(0, 5, (lm_scoring.VOCAB, lm_scoring.VOCAB)))
    windows = g.integers(0, 60, (70, lm_scoring.SLOTS + 3)).astype(np.uint16)
    windows[:, 0], windows[:, 1] = g.integers(0, 2, 70), g.integers(1, lm_scoring.STRIDE + 1, 70)
    steps, batch, share = 600, 16, (1, 4)  # several passes with a short last batch
    got = start.copy().fit(windows, steps, batch, seed=3, share=share)

    want, g = start.copy(), np.random.default_rng(3)
    m, s, met = ({k: np.zeros(v.shape) for k, v in want.p.items()} for _ in range(3))
    order, at = g.permutation(len(windows)), 0
    for t in range(1, steps + 1):
        if at >= len(windows):
            order, at = g.permutation(len(windows)), 0
        w = windows[order[at : at + batch]].astype(np.int64)
        at += batch
        _, grad = want.step(w[:, 2:-1], np.flatnonzero(w[:, 0] == 0), w[:, lm_scoring.CONTEXT + 3 :], np.arange(lm_scoring.STRIDE) < w[:, 1, None])
        for k, x in grad.items():
            m[k], s[k] = 0.9 * m[k] + 0.1 * x, 0.99 * s[k] + 0.01 * np.square(x, dtype=np.float64)
            rate = 8e-3 * (1 - 0.9 * (share[0] + t / steps) / share[1])
            want.p[k] = (want.p[k] - rate * m[k] / (1 - 0.9**t) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    assert all(np.abs(got.p[k] - want.p[k]).max() < 2e-2 and np.abs(got.p[k] - want.p[k]).mean() < 1e-3 for k in want.p)
    assert any(np.abs(want.p[k] - start.p[k]).max() > 0.1 for k in want.p) and (got.p["E"][60:] == start.p["E"][60:]).all()

    args = next(start._batches(windows, 1, batch, np.random.default_rng(3)))
    _, rest, seen, rows = start._passes(*args)
    _, grad = start.step(*args[:3], args[3] > 0)
    assert set(rest) == set(start.p) - {"E"} and (seen == np.unique(args[0])).all() and np.allclose(rows, grad["E"][seen], atol=1e-6)


def test_each_id_is_scored_once_in_its_window():
    m = lm_scoring.CausalModel(dim=8).start_from(np.ones((lm_scoring.VOCAB, lm_scoring.VOCAB))).ready()
    g = np.random.default_rng(1)
    size = np.array([1, 5, 16, 17, 32, 100])
    offs = np.concatenate([[0], np.cumsum(size)])
    ids = g.integers(0, lm_scoring.PIECES, offs[-1]).astype(np.uint16)
    ids[offs[1:] - 1] = lm_scoring.END
    whole = lm_scoring.score_ids(m, ids, offs)
    for d, n in enumerate(size):
        x, first, y, ok = _batch(ids, offs, [(d, k) for k in range(-(-n // lm_scoring.STRIDE))])
        assert ok.sum() == n and abs((m.window_scores(x, first, y) * ok).sum() / math.log(10) - whole[d]) < 1e-4
        # the folded tables against the network itself
        assert abs(m.step(x, first, y, ok)[0] * n / math.log(10) + whole[d]) < 1e-3 * n
    # a distribution: probabilities of all next ids add up to 1
    x, first, y, _ = _batch(ids, offs, [(5, 1)])
    total = sum(np.exp(m.window_scores(x, first, np.full_like(y, t))[0, 0]) for t in range(lm_scoring.VOCAB))
    assert abs(total - 1) < 1e-3


@TOK
def test_learning_reads_all_texts(spark):
    """Every pair of neighbouring ids is counted, and with a share of 1 every window is drawn, copies and null ids included."""
    ranks = lm_scoring.load_pieces()
    rows = [*texts(50), *texts(3) * 4, *ODD]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    data, offs = text_bytes(__import__("pyarrow").array([r[1] for r in rows]))
    _, _, ids, at = lm_scoring.texts_as_ids(data, offs, lm_scoring.Subwords(ranks), Words(SPACE))
    want = np.zeros((lm_scoring.VOCAB, lm_scoring.VOCAB), np.int64)
    for a, b in zip(at, at[1:]):
        np.add.at(want, (np.concatenate([[lm_scoring.END], ids[a : b - 1]]), ids[a:b]), 1)
    got = lm_scoring.gather(df.select(F.coalesce("text", F.lit("")).alias("t")), ranks, 1.0, 5, "t")
    assert (lm_scoring.bigram_counts(got) == want).all()
    drawn = [np.frombuffer(r["load"], np.uint16).reshape(-1, lm_scoring.SLOTS + 3) for r in got.where("kind = 1").collect()]
    assert got.where("kind = 1").select("g", "round").distinct().count() == 5 * lm_scoring.ROUNDS
    lay = lm_scoring.Layout(ids, at)
    assert sorted(map(bytes, np.concatenate(drawn))) == sorted(map(bytes, lay.pack(np.arange(len(lay.doc)))))
    part = lm_scoring.gather(df.select(F.coalesce("text", F.lit("")).alias("t")), ranks, 0.25, 1, "t").where("kind = 1").agg(F.sum("weight")).first()[0]
    assert abs(part / len(lay.doc) - 0.25) < 0.03


@TOK
def test_training_helps(spark):
    df = spark.createDataFrame(texts(400), SCHEMA)
    ranks = lm_scoring.load_pieces()
    train = df.where("doc_id % 7 <> 2")
    model = lm_scoring.fit_model(train, ranks, shard=400)  # several shards
    plain = lm_scoring.CausalModel().start_from(lm_scoring.bigram_counts(lm_scoring.gather(train, ranks, 0.0, 1))).ready()
    held = [lm_scoring.score_texts(df, m, ranks, F.col("doc_id") % 7 == 2).where("held_out").agg(F.sum("score")).first()[0] for m in (model, plain)]
    assert held[0] > held[1]


def test_texts_are_cut_into_windows_by_bytes():
    """4,096 texts at once, whatever their size, took an executor over 3,000 MB on 0.5 GB."""
    offs = np.cumsum([0, 5, 5, 0, 0, 30, 1, 2, 3, 0])
    got = list(lm_scoring.stretches(offs, 10))
    assert [a for a, _ in got] == [0, *(b for _, b in got[:-1])] and got[-1][1] == 9
    assert all(offs[b] - offs[a] <= 10 or b == a + 1 for a, b in got) and len(got) == 3
    assert list(lm_scoring.stretches(np.zeros(1, np.int64), 10)) == []
    assert list(lm_scoring.stretches(np.arange(0, 4096 * 4096 + 1, 4096), lm_scoring.AT_ONCE))[0] == (0, 256)


@TOK
def test_texts_are_scored_by_bytes():
    """Blocks of 4,096 texts, with all their windows at once, took an executor over 3,000 MB on 0.5 GB."""
    model = lm_scoring.CausalModel(dim=8).start_from(np.ones((lm_scoring.VOCAB, lm_scoring.VOCAB))).ready()
    said = [(r[1] or "") * 20 for r in [*texts(300), ODD[0], ODD[1]]] + ["the " * 60000]
    data, offs = text_bytes(__import__("pyarrow").array(said))
    code, words = lm_scoring.Subwords(lm_scoring.load_pieces()), Words(SPACE, limit=1 << 18)
    want_doc, want_h, ids, at = lm_scoring.texts_as_ids(data, offs, code, words)
    want = lm_scoring.score_ids(model, ids, at)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_scoring, "AT_ONCE", 1 << 14)
        sizes, real = [], lm_scoring.texts_as_ids
        patch.setattr(lm_scoring, "texts_as_ids", lambda d, o, *a: sizes.append((o[-1] - o[0], len(o) - 1)) or real(d, o, *a))
        doc, h, score = lm_scoring.block_scores(model, data, offs, code, words)
    assert (doc == want_doc).all() and (h == want_h).all() and np.allclose(score, want, rtol=1e-6, atol=1e-4)
    assert len(sizes) > 10 and all(size <= 1 << 14 or n == 1 for size, n in sizes)
    assert max(b - a for a, b in lm_scoring.stretches(np.zeros(10001, np.int64), 10, 4096)) == 4096


@TOK
def test_a_round_sends_its_weights_alone(spark):
    """The counts go out once: with them in every round's broadcast, rounds took most of op1's disk."""
    df = spark.createDataFrame(texts(60), SCHEMA)
    sent, real = [], type(spark.sparkContext).broadcast
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or real(self, x))
        model = lm_scoring.fit_model(df, lm_scoring.load_pieces())
    assert sum(isinstance(x, lm_scoring.CausalModel) for x in sent) == 1
    again = lm_scoring.fit_model(df, lm_scoring.load_pieces())
    assert (model.weights() == again.weights()).all()


@TOK
def test_scores_and_word_counts(spark):
    rows = texts(60) + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    pieces = lm_scoring.load_pieces()
    model = lm_scoring.fit_model(df.where(~held), pieces)
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(df, model, pieces, held).collect()}
    words = {r[0]: [*(r[1] or "").lower().encode().split(), None] for r in rows}
    count = collections.Counter(w for i, ws in words.items() if i is None or i % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm_scoring.score_texts(df.where("false"), model, pieces, held).count() == 0
    twice = lm_scoring.score_texts(df.union(df.where("doc_id = 3")), model, pieces, held).where("doc_id = 3").collect()
    assert len(twice) == 2 and twice[0] == twice[1] and math.isclose(twice[0]["score"], got[3]["score"], rel_tol=1e-6)
    assert lm_scoring.fit_model(df.where("false"), pieces).weights().size


def test_remainders(spark):
    from lexiloom.llm.base import remainder

    got = [r[0] for r in spark.range(50).select(remainder("id", 7)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 7 for i in range(50)]
