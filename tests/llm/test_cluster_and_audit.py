"""Ball k-means against plain k-means, the filter audit against documents walked through every order, odd inputs."""

import hashlib
import itertools

import numpy as np
import pytest

from lexiloom.llm import ball_kmeans as B
from lexiloom.llm import filter_audit as A


def plain(rows, k, rounds, size, scale=256, seed="2"):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c, n = [v for _, v in first], len(kept)
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    by = {j: sum(d for d, a in last if a == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, a, d, by[a], sum(by.values()), sha[a]) for (i, _), (d, a) in zip(kept, last)), key=repr) if n else []


def run(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return sorted((tuple(r) for r in B.ball_kmeans(df, **more).collect()), key=repr)


@pytest.mark.parametrize("k, rounds, size", [(8, 4, 4), (25, 6, 3), (3, 0, 6)])
def test_ball_kmeans_is_plain_kmeans(spark, monkeypatch, k, rounds, size):
    monkeypatch.setattr(B, "BLOCK", 64)
    g = np.random.default_rng(k)
    x = (g.normal(size=(12, size)) * 3)[g.integers(0, 12, 700)] + g.normal(size=(700, size)) * 0.3
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    report = []
    assert run(spark, rows, k=k, rounds=rounds, size=size, report=report) == plain(rows, k, rounds, size)
    if rounds:
        assert sum(report[1:]) < 0.7 * 700 * k * rounds, report  # cores and annuli spare comparisons


def test_ties_copies_and_empty_clusters(spark):
    """Points on a coarse grid: many ties, equal centroids, clusters that stay empty; ids repeat and are missing."""
    g = np.random.default_rng(3)
    rows = [(int(i % 60) if i % 50 else None, [float(v) for v in g.integers(-1, 2, 3)]) for i in range(300)]
    assert run(spark, rows, k=20, rounds=5, size=3, scale=1) == plain(rows, 20, 5, 3, 1)
    assert run(spark, rows, k=20, rounds=5, size=3, scale=2) == plain(rows, 20, 5, 3, 2)
    same = [(i, [0.5, -0.25]) for i in range(40)]
    assert run(spark, same, k=7, rounds=2, size=2) == plain(same, 7, 2, 2)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, 2.0, 3.0])]
    rows = [*odd, (8, [0.1, -0.1]), (9, [-3.7, 2.0]), (None, [1e5, -1e5])]
    got = run(spark, rows, "double", k=2, rounds=3, size=2)
    assert got == plain(rows, 2, 3, 2) and len(got) == 3
    assert run(spark, rows, "double", k=40, rounds=3, size=2) == plain(rows, 40, 3, 2)  # fewer vectors than clusters
    assert run(spark, odd, "double", size=2) == [] and run(spark, [], size=2) == []
    far = run(spark, [(1, [1e300, 0.0]), (2, [0.0, 0.0])], "double", k=1, rounds=0, size=2)
    assert sorted(r[2] for r in far) == [0, B.FAR**2]
    clash = spark.createDataFrame([(1, [0.0, 1.0], 7, "x")], "vec_id long, embedding array<float>, cluster int, ids string")
    assert B.ball_kmeans(clash, k=1, rounds=1, size=2).count() == 1


def test_annuli_are_exact():
    """Assignment from any earlier cluster equals a comparison with all centroids."""
    g = np.random.default_rng(8)
    c = g.integers(-50, 50, (30, 5))
    x = g.integers(-60, 60, (2000, 5))
    want, d, _ = B.every(x, c)
    for last in (want, g.integers(0, 30, 2000)):
        far = [int(B.distances(x[last == j], c[j]).max()) if (last == j).any() else 0 for j in range(30)]
        for radii in (None, [int(np.sqrt(f)) + 2 for f in far]):
            best, e, compared = B.Balls(c, radii).assign(x, last)
            assert (best == want).all() and (e == d).all()
    assert B.Balls(c, [int(np.sqrt(f)) + 2 for f in far]).assign(x, want)[2] < 2000 * 30


# ---------------------------------------------------------------- audit
def walk(docs, labels):
    text = lambda d: d[1] or ""
    part = lambda d: d[2] or ""
    rank = lambda i: -1 if i is None else i
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for d in docs:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", text(d)) if x]
        f = ""
        f += "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text(d)) > 3 * len(text(d)))
        f += "D" * any(c in "#$%&*|" for c in text(d)) + "E" * any(text(e) == text(d) and rank(e[0]) < rank(d[0]) for e in docs)
        fails.append(f)
    out = []
    for p in {part(d) for d in docs}:
        mine = [(d, f) for d, f in zip(docs, fails) if part(d) == p]
        removed_in = {f: 0 for f in "ABCDE"}
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                stay = [(d, x) for d, x in left if f not in x]
                removed_in[f] += len(gone)
                rows.append([p, "".join(order), k, len(stay), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == f for _, x in mine), sum(d[0] in good for d, _ in gone), sum(d[0] in toxic for d, _ in gone), f])
                left = stay
        out += [tuple([*r[:9], removed_in[r[9]]]) for r in rows]
    return sorted(out)


def audit(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, good int, E string").repartition(3)
    got = A.interactions(A.failure_counts(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    return sorted(tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_audit_equals_a_walk_through_every_order(spark):
    g = np.random.default_rng(2)
    words = [*"abcdefghij", "Kl", "#", "m$", "\x0b", "é", "\U0001f600"]
    docs = []
    for i in range(120):
        n = int(g.choice([0, 3, 150, 230]))
        t = " ".join(f"{g.choice(words)}{g.integers(0, 300 if g.random() < 0.5 else 6)}" for _ in range(n))
        t = t.replace("#", "").replace("$", "") if g.random() < 0.6 else t
        docs.append((int(i), t if g.random() < 0.9 else t.upper(), [None, "", "en", "de"][int(g.integers(0, 4))], 1, "x"))
    docs += [(200 + i, docs[i % 7][1], ["en", "de", None][i % 3], 1, "x") for i in range(60)]  # copies across parts
    docs += [docs[5], docs[5], docs[9], (None, docs[3][1], "en", 1, "x"), (None, "a " * 300, "de", 1, "x"), (None, None, None, 1, "x"), (900, None, "en", 1, "x"), (901, "", "fr", 1, "x"), (902, "B" * 100_000, "fr", 1, "x"), (3, "other", "en", 1, "x")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 200, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (201, 1, 1), (5000, 1, 1), (5, None, 1), (5, None, 1)]
    got = audit(spark, docs, labels)
    assert got == walk(docs, labels) and len(got) == 600 * 4


def test_audit_of_little(spark):
    assert audit(spark, [], [(1, 1, 1)]) == []
    one = audit(spark, [(1, None, None, 1, "x")], [])
    assert len(one) == 600 and one == walk([(1, None, None, 1, "x")], [])


def test_survivors_of_every_set(spark):
    """All flags true everywhere: only the empty set has survivors, and the others are zeros."""
    counts = spark.createDataFrame([("p", True, True, 5, 2, 1)], "part string, A boolean, B boolean, kept long, good long, toxic long")
    got = {r["set"]: (r["kept"], r["good"], r["toxic"]) for r in A.survivors(counts, "AB").collect()}
    assert got == {0: (5, 2, 1), 1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0)}
    assert A.interactions(counts, "AB").count() == 4
