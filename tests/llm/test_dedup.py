"""N-gram join, suffix dedup and components against brute force, with odd inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import ngram_join, suffix_dedup
from lexiloom.llm.components import components

SCHEMA = "doc_id long, text string, id string, k string"


def corpus(seed=0, n=80):
    g = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(g.choice(words) for _ in range(g.randint(6, 60))) for _ in range(8)]
    docs = []
    for _ in range(n):
        w = g.choice(base).split()
        for _ in range(g.randint(0, 4)):
            w[g.randrange(len(w))] = g.choice(words)
        docs.append(" ".join(w) if g.random() < 0.8 else " ".join(g.choice(words) for _ in range(30)))
    docs += [None, "", " \n ", "one two", "ONE two", "one two three", "Äé " * 40, "a\x00b " * 50, base[0], base[0], "x" * 5000, "lone " * 3000]
    return [(i * 3, t, "clash", "col") for i, t in enumerate(docs)]


def sets_of(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    s = [sets_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            o = len(s[i] & s[j])
            if o and 100 * o >= 75 * (len(s[i]) + len(s[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {r[0]: (len(s[i]), rows[find(i)][0]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("block", [4096, 3])  # 3: clusters go over several blocks, and pairs across them are compared
def test_join_equals_brute_force(spark, block):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert got == brute_components(rows)


def test_join_empty_repeated_and_null_ids(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d e f", None, None), (5, "a b c d e f", None, None), (None, "a b c d e f", None, None), (7, None, None, None), (8, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(5, None), (5, None), (None, None), (7, 7), (8, 8)], key=str)
    assert sorted((r["doc_id"] for r in ngram_join.keep_one_of_each(df).collect()), key=str) == [7, 8, None]


def brute_cut(rows, length):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1]) for r in rows if r[1] is not None) + [(r[0], "") for r in rows if r[1] is None]:
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k] += 1
                gone[k + length] -= 1
            seen.add(w)
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "hot"), [(100, 4096), (40, 1)])  # hot 1: keys are cut into single strings
def test_cut_equals_brute_force(spark, length, hot):
    rows = corpus(3, 50)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=length, hot=hot).collect()}
    assert got == brute_cut(rows, length)


def test_cut_repeated_ids_and_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    a, b = "abcdefghij" * 15, "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    rows = [(1, b, None, None), (1, b, None, None), (1, b + "!", None, None), (None, b, None, None), (2, a, None, None)]
    got = suffix_dedup.cut_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    by = sorted(((r["doc_id"], len(r["text"])) for r in got), key=str)
    # the null id comes first and keeps its text; both rows of (1, b) lose theirs; the periodic text keeps its first string
    assert len(got) == 5 and (None, len(b)) in by and by.count((1, 0)) == 2 and (1, 1) in by and got[0].asDict().keys() == {"doc_id", "text", "id", "k"}


def test_cut_many_texts_under_null_ids_and_clashes(spark):
    g = random.Random(9)
    text = lambda: "".join(g.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150))
    same = text()
    rows = [(None if i % 3 else i, text() + same * (i % 5 == 0), i) for i in range(60)]
    df = spark.createDataFrame([(*r, *[f"{c}{r[2]}" for c in ("k", "s", "t", "kept", "row", "_sub", "a.b")]) for r in rows], "doc_id long, text string, nth long, k string, s string, t string, kept string, row string, _sub string, `a.b` string")
    out = suffix_dedup.cut_repeats(df)
    assert out.columns == df.columns
    got = {r["nth"]: r.asDict() for r in out.collect()}
    assert len(got) == 60 and all(r[c] == f"{c}{i}" for i, r in got.items() for c in ("k", "s", "kept", "_sub", "a.b"))
    assert sum(r["text"].count(same) for r in got.values()) == 1 and all(got[i]["doc_id"] == d and got[i]["text"][:140] == t[:140] for d, t, i in rows)


def test_one_text_of_each_group_stays_under_repeated_ids(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x"), (3, b, "x"), (None, c, "x"), (None, c, "x"), (4, None, "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("nth", F.lit("clash")).withColumn("row", F.lit("clash"))
    out = ngram_join.keep_one_of_each(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (4, None), (4, None)], key=str)


def test_rarity_keeps_the_order():
    n = np.unique(np.geomspace(1, 1e9, 5000).astype(np.int64))
    r = ngram_join.rarity(n)
    assert (np.diff(r.astype(int)) >= 0).all() and (r[n <= 64] == n[n <= 64]).all() and len(set(r[n < 1 << 20])) > 150


def test_transform_by_levels():
    g = np.random.default_rng(0)
    for trial in range(40):
        t = g.integers(97, 97 + g.integers(1, 4), g.integers(2, 200)).astype(np.uint8)
        t = np.concatenate([t, t[: len(t) // 2], [255], t]).astype(np.uint8)
        n = int(g.integers(1, 20))
        order = suffix_dedup.suffix_order(t, n)
        long = suffix_dedup.long_prefixes(t, order, n)
        s = t.tobytes()
        for i in range(1, len(t)):
            a, b = order[i - 1], order[i]
            assert s[a : a + n] <= s[b : b + n]
            if max(a, b) + n <= len(t):
                assert long[i] == (s[a : a + n] == s[b : b + n])


def test_components(spark):
    g = random.Random(1)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)] + [(None, 1), (3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_threshold_passages_over_many_blocks(spark):
    """Documents around one common passage, just below and just above the threshold, in clusters of several blocks."""
    g = random.Random(11)
    passage = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join(passage + [f"u{i}_{j}" for j in range(g.randint(0, 8))]), "x", "y") for i in range(70)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), block=4).collect()}
    assert got == brute_components(rows)


def test_repeats_are_compared_where_a_half_is_shared_and_dealt_by_task():
    import pyarrow as pa

    S = suffix_dedup
    g = np.random.default_rng(5)
    mark = b"@" + bytes(range(33, 63))  # an anchor that many texts share, in surroundings of their own
    text = lambda n: bytes(g.integers(97, 123, n, np.uint8))
    same = text(60) + mark + text(60)
    docs = [text(90) + mark + text(90) for _ in range(300)] + [text(40) + same + text(40) for _ in range(3)]
    batch = pa.record_batch([pa.array(range(len(docs)), pa.int64()), pa.array([0] * len(docs), pa.int64()), pa.array([d.decode() for d in docs])], ["k", "s", "t"])
    asked = {}
    for buckets in (64, 4096):
        seen = list(S._occurrences(100, buckets, buckets)(iter([batch])))
        told = [r for b in S._compare_digests(100, buckets, 4096)(iter(seen)) for r in zip(*(c.to_pylist() for c in b.columns))]
        want = [S.unpack(pa.scalar(x, pa.binary()).as_buffer()) for _, k, x in told if k == S._ASKED]
        asked[buckets] = sorted(int(i) for x in want for i in x[0])
        # a destination gets one row of a task, however many destinations the task had itself
        assert len({(d, k) for d, k, _ in told}) == len(told)
    assert asked[64] == asked[4096] and set(asked[64]) == {300, 301, 302}


def test_hot_strings_are_hashed_alike_in_blocks():
    S = suffix_dedup
    data = np.random.default_rng(6).integers(0, 256, 5000, np.uint8)
    at, more = np.array([0, 700, 1500, 3000]), np.array([84, 0, 30, 84])
    p, _ = S._powers(100)
    want = [S.mix((S._table(False)[data[a + i : a + i + 100]] * p[:100]).sum(keepdims=True, dtype=S.U64))[0] for a, m in zip(at, more) for i in range(m + 1)]
    for block in (1, 3, 4096):
        assert S._names(data, at, more, 100, block).tolist() == want
