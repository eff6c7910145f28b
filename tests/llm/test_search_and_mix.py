"""Permutation index, URL filters, decontamination and mixing against brute force and by their promises."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import ann, decontaminate, mixing, url_filters


def test_search_recall_ties_and_odd_vectors(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(1500, 24)) * g.uniform(0.5, 2, (1500, 1))
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] + [1.0] * 23), (5004, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((1500 if r["vec_id"] is None else r["vec_id"], r["score"]))
    hit = 0
    x = np.vstack([x, np.ones(24)])  # the row without an id is a candidate too
    for i in range(0, 1500, 20):
        s = x @ x[i]
        best = [j for j in np.lexsort((np.arange(1501), -np.round(s, 12))) if j != i][:20]
        assert len(got[i]) == 20 and all(abs(v - s[j]) < 1e-9 for j, v in got[i])
        assert got[i] == sorted(got[i], key=lambda t: (-t[1], t[0]))
        hit += len(set(best) & {j for j, _ in got[i]})
    assert len(got) == 75 and hit / 1500 >= 0.9
    assert ann.search(df.where("false"), F.col("id") == 0).count() == 0
    few = ann.search(df.where("vec_id < 3"), F.col("id") == 0).collect()
    assert len(few) == 2


def test_search_over_repeated_and_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (None, [5.0, 1.0]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash")).withColumn("query", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank", "score").collect():
        got[r["query_id"], r["rank"]].append((r["vec_id"], r["score"]))
    # both rows of id 0 ask, and find each other, both rows of id 1, and the row without an id
    assert got == {
        (0, 1): [(None, 5.0), (None, 10.0)],
        (0, 2): [(1, 3.0), (1, 6.0)],
        (0, 3): [(1, 3.0), (1, 6.0)],
        (0, 4): [(0, 2.0), (0, 2.0)],
        (0, 5): [(2, -2.0), (2, -1.0)],
    }


def test_url_rules_and_aliases(spark):
    page = lambda i, u, h=None: (i, u, h)
    rows = [
        page(1, "http://a.net/x", '<LINK href="https://b.example.org/es/q" REL=canonical>'),
        page(2, "http://c.net/", '<meta http-equiv="refresh" content="0; url=http://a.net/x#f">'),
        page(3, "http://d.net/y"),
        page(4, None, "x"),
        page(5, "HTTP://E.ORG/z?q", "<link href=//f.net/k rel='canonical'>"),
        page(6, "http://f.net/k"),
        page(7, "http://g.com/de/1", "<link rel=canonical href=http://f.net/k>"),
        page(8, "no scheme"),
        page(9, "http://x.example.org/en/12"),
        page(10, "http://org"),
        page(11, "http://seen.net/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    moved = spark.createDataFrame([("http://seen.net", "http://c.net/"), (None, "http://c.net/")], "a string, b string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, redirects=moved).collect()}
    assert got == {
        1: ("a.net", "/x", None, "block"),  # its canonical page is blocked
        2: ("c.net", "/", None, "block"),  # an alias of an alias
        3: ("d.net", "/y", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("e.org", "/z", "org/", "allow"),
        6: ("f.net", "/k", None, "allow"),  # an allowed alias takes precedence over a blocked one
        7: ("g.com", "/de/1", "com/de/", "block"),
        8: ("", "", None, "allow"),
        9: ("x.example.org", "/en/12", "example.org/en/1", "block"),
        10: ("org", "", None, "allow"),
        11: ("seen.net", "/", None, "block"),
    }
    assert url_filters.filter_urls(df.where("false")).count() == 0


def test_a_large_redirect_table(spark):
    """Chains, hubs, cycles and alias pages over 30,000 redirects, against a union-find; rules of equal length."""
    g = random.Random(12)
    tld = ["net", "org", "com", "example.org"]
    url = lambda i: f"http://h{i}.{tld[i % 4]}/{['es', 'fr', 'de', 'x'][i // 4 * 7 % 4]}/{i}"
    n = 6000
    moved = [(url(i), url(i + 1)) for i in range(0, 2000) if i % 50]  # chains of fifty
    moved += [(url(2000), url(i)) for i in range(2001, 3000)]  # a hub
    moved += [(url(3000 + i), url(3000 + (i + 1) % 40)) for i in range(40)]  # a cycle
    moved += [(url(g.randrange(4000, 5500)), url(g.randrange(4000, 5500))) for _ in range(500)] + [(url(5), url(5))] * 20
    moved = moved * 8  # seen again and again
    pages = spark.createDataFrame([(i, url(i), "x") for i in range(n)], "page_id long, url string, html string")
    rules = [*url_filters.RULES, ("net", "/xx/", "block"), ("net", "/es/", "block")]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    number = {url(i): i for i in range(n)}
    for a, b in moved:
        p, q = find(number[a]), find(number[b])
        root[max(p, q)] = min(p, q)

    def rule(i):
        host, path = url(i).split("/")[2], "/" + "/".join(url(i).split("/")[3:])
        fit = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[3:] if fit else (None, None)

    told = [rule(i) for i in range(n)]
    said = collections.defaultdict(set)
    for i in range(n):
        said[find(i)].add(told[i][1])
    want = {i: (told[i][0], told[i][1] or ("block" if "block" in said[find(i)] and "allow" not in said[find(i)] else "allow")) for i in range(n)}
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, rules, spark.createDataFrame(moved, "a string, b string").repartition(8)).collect()}
    assert got == want and {v for r, v in got.values() if r is None} == {"allow", "block"}


def test_url_rules_of_equal_length_and_repeated_pages(spark):
    long = "http://a.b/" + "x" * 200_000
    df = spark.createDataFrame([(1, "http://a.bc/d/", None), (1, "http://a.bc/d/", None), (2, long, ""), (3, "http://", ""), (4, "", "")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) if r["page_id"] < 4 else (4, None, "x") for r in url_filters.filter_urls(df, [("bc", "/d/", "block"), ("a.bc", "/", "allow")]).collect())
    # both are five characters: the longer host counts
    assert got[:2] == [(1, "a.bc/", "allow")] * 2 and (2, None, "allow") in got and (3, None, "allow") in got


def brute_edits(item: bytes, text: bytes) -> int:
    row = np.arange(len(item) + 1)
    best = row[-1]
    for c in text:
        new = row.copy()
        new[0] = 0
        for i, x in enumerate(item, 1):
            new[i] = min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1)
        row = new
        best = min(best, row[-1])
    return int(best)


def test_semi_global_edits():
    g = random.Random(0)
    for _ in range(60):
        item, text = (bytes(g.choice(b"abc") for _ in range(g.randint(1, 70))) for _ in range(2))
        want = brute_edits(item, text)
        got = decontaminate.semi_global(item, text, 100)
        assert got is not None and got[0] == want
        assert decontaminate.semi_global(item, text, want - 1) is None


def test_decontamination_recall_and_clean_texts(spark):
    g = random.Random(1)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(g.randint(16, 50))) for i in range(20)] + [(90, None), (91, ""), (92, "0short")]
    rows, want = [], set()
    for i in range(120):
        k, t = g.choice(items[:20])
        t = list(t)
        for _ in range(g.randint(0, len(t) // 10)):
            p = g.randrange(len(t))
            t[p : p + g.randint(0, 1)] = g.choice(["", "x", "yz"[:1]])
        rows.append((i, prose(g.randint(0, 200)) + " " + "".join(t).upper() + " " + prose(g.randint(0, 99)), "x"))
        want.add((i, k))
    rows += [(1000 + i, prose(150), "x") for i in range(80)] + [(2000, None, "x"), (2001, "", "x"), (2002, "word " * 40000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    parts = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, most_bytes=1500).collect()}
    assert parts == got
    kept = decontaminate.drop_contaminated(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got} and kept.columns == df.columns
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0
    assert decontaminate.contaminated(df.where("false"), bench).count() == 0


def _edited(g, t: str, n: int, alphabet: str) -> str:
    out = list(t)
    for _ in range(n):
        p = g.randrange(len(out))
        out[p : p + g.randint(0, 1)] = [g.choice(alphabet)] if g.random() < 0.7 else []
    return "".join(out)


def test_decontamination_against_all_stretches(spark):
    """The query against the edit distance to every stretch of every text, for items of 3 bytes and more."""
    g = random.Random(4)
    letters = "abcdefg "
    text = lambda n: "".join(g.choice(letters) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 5, 9, 10, 15, 15, 23, 31, 39, 40, 47, 64, 65, 80, 120, 300])] + [(3, text(33)), (50, None), (51, "")]
    rows = [(i, text(g.randint(0, 30)) + _edited(g, t, g.randint(0, len(t) // 10 + 1), letters) + text(g.randint(0, 30))) for i, (_, t) in enumerate([x for x in items if x[1]] * 8)]
    rows += [(500, None), (501, ""), (7, rows[7][1]), (7, "another text of this id")]
    want, exact, limit = set(), set(), set()
    for d, t in rows:
        for k, x in items:
            if x and t:
                e = brute_edits(x.encode(), t.encode())
                if e <= int(0.1 * len(x)):
                    want.add((d, k))
                    (exact if e == 0 or len(x) < 40 else limit).add((d, k))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("edits", F.lit("clash")).withColumn("k", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").union(spark.createDataFrame(items[:2], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got <= want and exact <= got and len(limit) > 25 and len(got & limit) >= 0.97 * len(limit)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and not {r["doc_id"] for r in kept.collect()} & ({d for d, _ in got} - {7})


def test_windows_from_pieces_lose_nothing():
    """Whatever the edits up to the limit, a window of the item starts within the limit of the place."""
    g = random.Random(5)
    for _ in range(150):
        n = g.choice([12, 25, 40, 55, 79, 80, 100, 119, 120, 200, 400, 1500, 2500])
        t = "".join(g.choice("abcd") for _ in range(n))
        known = decontaminate.Items([1], [t.encode()], 0.1)
        before = "".join(g.choice("wxyz") for _ in range(g.randint(0, 50)))
        passage = t
        for _ in range(n // 10):  # substitutions, insertions, deletions spread as they come
            p = g.randrange(len(passage))
            passage = passage[:p] + g.choice(["", "w", passage[p] + "x"]) + passage[p + 1 :]
        data = np.frombuffer((before + passage + "zz").encode(), np.uint8)
        _, unit, start = known.windows(data, np.array([0, len(data)]))
        near = np.abs(start - known.at[unit] - len(before)) <= n // 10
        assert near.any(), (n, t, passage)


def test_long_items_in_bounded_memory():
    g = np.random.default_rng(6)
    million, long = (g.integers(97, 123, n, dtype=np.uint8) for n in (1 << 20, 20000))
    known = decontaminate.Items([1, 2], [million.tobytes(), long.tobytes()], 0.1)
    assert known.bits.nbytes <= 3 * 4096 * 256 and known.keys.nbytes < 1 << 20
    edited = long.copy()
    edited[g.choice(20000, 1500, replace=False)] = 46
    texts = [g.integers(97, 123, 50000, dtype=np.uint8), edited, million, long[:9000]]
    data, offs = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = known.search(data, offs)
    assert set(got) == {(1, 1), (2, 0)} and got[2, 0][0] == 0 and 1400 < got[1, 1][0] <= 1500


def test_word_distance():
    g = random.Random(7)
    pairs = [("".join(g.choice("ab ") for _ in range(g.randint(1, 64))).encode(), "".join(g.choice("ab ") for _ in range(g.randint(0, 90))).encode()) for _ in range(200)]
    data = np.frombuffer(b"".join(t for _, t in pairs), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for _, t in pairs])])
    pattern = np.array([np.frombuffer(p.ljust(64), np.uint8) for p, _ in pairs])
    edits, end = decontaminate.word_global(pattern, np.array([len(p) for p, _ in pairs]), data, offs[:-1], offs[1:])
    for (p, t), e, at in zip(pairs, edits, end):
        assert e == brute_edits(p, t)
        got = decontaminate.semi_global(p, t, len(p))
        assert got is None or e == len(p) or got == (e, at)


def test_pfair_schedule_stays_within_one_block_of_the_targets():
    g = random.Random(5)
    names = [f"src{i}" for i in range(20)]
    skewed = {f"s{i}": g.random() ** 4 + 1e-5 for i in range(7)} | {"rare": 1 / 5000}
    for w, n in ((mixing.targets(names), 3000), (skewed, 4000)):
        blocks = {s: n + g.randint(0, 9) for s in w}
        placed = 0
        for at, _, slots, length in mixing.phases(blocks, w):
            assert at == placed
            left = {s for s in w if blocks[s] > 0}
            total = sum(w[s] for s in left)
            seen = collections.Counter()
            for i in range(1, length + 1):
                seen[slots[(i - 1) % len(slots)]] += 1
                if i % 7 == 0 or i == length:
                    assert all(abs(seen[s] - w[s] / total * i) < 1 for s in left)
            for s in seen:
                blocks[s] -= seen[s]
            placed += length
        assert not any(blocks.values())


def test_pfair_over_a_hundred_thousand_slots():
    """Random weights: at each slot every source is less than a block off its true share, by simulation of the whole mix."""
    g = np.random.default_rng(8)
    for w in ([1 / 3, 2 / 3], g.random(5).tolist(), (g.random(12) ** 3 + 1e-4).tolist()):
        share = np.array(w) / sum(w)
        (at, _, slots, length), *_ = mixing.phases({f"s{i:02}": int(x * 100_000) + 1 for i, x in enumerate(share)}, {f"s{i:02}": x for i, x in enumerate(w)})
        assert at == 0 and length > 99_000
        seen = np.zeros((length, len(w)), np.int32)
        name = {f"s{i:02}": i for i in range(len(w))}
        seen[np.arange(length), [name[slots[i % len(slots)]] for i in range(length)]] = 1
        off = np.abs(np.cumsum(seen, 0) - np.arange(1, length + 1)[:, None] * share)
        assert off.max() < 1 + 1e-9 * length


def test_mix_columns_that_clash_and_bounded_slots(spark, monkeypatch):
    names = ["s", "r", "h", "t", "id", "row", "n", "b", "k", "q", "first", "slot", "len", "i", "place", "before", "end", "mix_slot", "mix_block", "a.b"]
    df = spark.createDataFrame([(i, "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(200)], ["doc_id", "source", *names])
    out = mixing.mix_sources(df, {"a": 0.5, "b": 0.5}, block=4)
    assert out.columns == ["doc_id", "source", *[c for c in names if not c.startswith("mix")], "mix_block", "mix_slot", "mix_place"]
    got = out.toPandas()
    assert all((got[c] == c + got.doc_id.astype(str)).all() for c in ("s", "row", "k", "a.b")) and got.mix_slot.nunique() == 50
    monkeypatch.setattr(mixing, "MOST_SLOTS", 10)
    few = mixing.mix_sources(df, {"a": 0.30000000000000007, "b": 0.7}, block=4).toPandas()
    assert few.mix_slot.max() < 10 and len(few) == 200 and not few.duplicated(["mix_slot", "mix_place"]).any()


def test_many_sources(spark):
    """Hosts as sources: what the driver makes grows with the blocks, not with the square of the sources."""
    n = {f"h{i}": 1 + i % 3 for i in range(500)}
    plan = mixing.phases(n, {s: 1 + (i % 7) / 10 for i, s in enumerate(n)})
    assert sum(x[3] for x in plan) == sum(n.values()) and sum(len(x[2]) for x in plan) <= 2 * sum(n.values())


def test_mix_of_exact_weights_follows_the_phases(spark, monkeypatch):
    rows = [(i, "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    w = {"a": 0.123456789012345, "b": 0.7, "c": 0.2}
    want = [s for _, _, slots, n in mixing.phases(dict.fromkeys("abc", 250), w) for s in (slots * (n // len(slots) + 1))[:n]]
    for most in (mixing.BROADCAST_SLOTS, 10):
        monkeypatch.setattr(mixing, "BROADCAST_SLOTS", most)
        out = mixing.mix_sources(df, w, block=4).toPandas()
        assert len(out) == 3000 and not out.duplicated(["mix_slot", "mix_place"]).any()
        assert out.drop_duplicates("mix_slot").sort_values("mix_slot").source.tolist() == want


def test_mix_places_every_row_once(spark):
    g = random.Random(3)
    rows = [(i if i % 50 else None, g.choice(["a", "a", "a", "b", "c", None]), "t") for i in range(2000)] + [(7, "a", "t"), (7, "a", "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_x string")
    out = mixing.mix_sources(df, {"a": 0.5, "b": 0.3, "c": 0.1, None: 0.1}, block=8).toPandas()
    assert len(out) == 2002 and not out.duplicated(["mix_slot", "mix_place"]).any()
    assert (out.groupby("mix_slot").source.nunique(dropna=False) == 1).all() and out.mix_slot.nunique() == out.mix_slot.max() + 1
    head = out[out.mix_slot < 40].drop_duplicates("mix_slot")
    assert abs((head.source == "b").sum() - 12) <= 1
    assert mixing.mix_sources(df.where("false"), {"a": 1.0}).count() == 0


def test_blocks_stay_small_however_large_the_mix(spark):
    """The production weights have a period of 76 slots: 2 x 10^10 documents are mixed in blocks of 16."""
    names = [f"src{i}" for i in range(20)]
    w = mixing.targets(names)
    totals = {s: 10**9 + 1000 * i for i, s in enumerate(names)}
    assert mixing.block_size(totals, w) == 16 and mixing.block_size(totals, {s: 0.1 + i * 2.0**-50 for i, s in enumerate(names)}) > 16
    blocks = {s: -(-n // 16) for s, n in totals.items()}
    plan = mixing.phases(blocks, w)
    assert max(len(slots) for _, _, slots, _ in plan) <= 76 and sum(n for *_, n in plan) == sum(blocks.values())
    at, first, slots, n = plan[0]
    assert slots.count("src0") == 19 and n // 76 == min(blocks["src0"] // 19, blocks["src1"] // 3)


def test_a_hot_source_is_numbered_in_many_tasks(spark):
    """Spans meet the ranges of a source, not its documents: no exchange by source alone."""
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 30}") for i in range(3000)], "doc_id long, source string")
    out = mixing.mix_sources(df, None, block=4)
    rows = out.collect()
    assert len({(r["mix_slot"], r["mix_place"]) for r in rows}) == 3000 and len({r["doc_id"] for r in rows}) == 3000
    assert {r["mix_slot"] for r in rows} == set(range(1 + max(r["mix_slot"] for r in rows)))


def test_aliases_do_not_depend_on_spelling(spark):
    """A rule for ``org/`` allows the node of a bare host, whichever way the redirects spell it."""
    pages = spark.createDataFrame([(1, "http://other.net/a", None), (2, "http://site.org", None), (3, "http://site.org/", None), (4, "http://lone.net/b", None)], "page_id long, url string, html string")
    for one, two in (("http://site.org", "http://site.org/"), ("http://site.org/", "http://site.org"), ("http://site.org", "https://SITE.org#x"), ("http://site.org/", "http://site.org/")):
        moved = spark.createDataFrame([(one, "http://bad.com/de/x"), ("http://other.net/a", two)], "a string, b string")
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, redirects=moved).collect()}
        assert got == {1: (None, "allow"), 2: (None, "allow"), 3: ("org/", "allow"), 4: (None, "allow")}
    without = spark.createDataFrame([("http://site.net", "http://bad.com/de/x"), ("http://other.net/a", "http://site.net/")], "a string, b string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages, redirects=without).collect()}[1] == "block"


def test_links_are_resolved_as_in_sql(spark):
    """Relative links, folders, bases, entities, other schemes: against the SQL, with expected targets of their own."""
    from urllib.parse import urljoin

    import pandas as pd

    duckdb = pytest.importorskip("duckdb")
    from lexiloom.llm.oracle import ORACLE_SQL

    base = "http://a.net/d/e/page.html?x=1"
    links = ["b.html", "../b.html", "../../../b", "./", "..", "/r/./s/../t", "//h.net/z", "?q=2", "#f", "http://bad.com/de/k", "g/?u=http://h.net", "/go?to=http://h.net/", "c/../../f.html", "mailto:x@y.z", "b&amp;c.html"]
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, x string").select("i", url_filters.resolved(F.lit(base), F.col("x")).alias("r"))
    for r in asked.collect():
        want = urljoin(base, links[r["i"]])
        if links[r["i"]].startswith("#"):
            want = "http://a.net/d/e/page.html#f"
        assert r["r"] == (None if want.startswith("mailto") else want), links[r["i"]]
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [(0, "http://bad.com/de/x.html", None), (1, "http://bad.com/de/y/z.html", canonical.format("../x.html")), (2, "http://n.net/1", canonical.format("2")), (3, "http://n.net/2", refresh.format("http://bad.com/de/x.html?a=1&amp;b=2")), (4, "http://n.net/3", refresh.format("http://bad.com/de/x.html?a=1&b=2"))]
    pages += [(5, "http://n.net/c/5", '<base href="/b/">' + canonical.format("6")), (6, "http://n.net/b/6", refresh.format("http://bad.com/de/w")), (7, "http://n.net/b/7", canonical.format("mailto:a@b.c")), (8, "http://n.net", canonical.format("b/6")), (9, None, canonical.format("b")), (10, "http://ok.org/p", canonical.format("http://n.net/9")), (11, "http://n.net/9", canonical.format("/b/../8#t")), (12, "http://n.net/8", refresh.format("http://bad.com/de/v"))]
    frame = pd.DataFrame(pages, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", frame)
    answer = con.execute(ORACLE_SQL["op2_url_filters"])
    at = [c[0] for c in answer.description]
    want = {r[at.index("page_id")]: tuple(r[at.index(c)] for c in ("host", "path", "rule", "verdict")) for r in answer.fetchall()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
    assert [got[i][3] for i in (2, 3, 4, 5, 6, 7, 8, 10, 11, 12)] == ["block", "block", "block", "block", "block", "allow", "block", "allow", "allow", "allow"]
