"""The pipeline's stages on a small corpus, and what the registry promises."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_dedup import brute_components
from test_search_and_mix import brute_edits

import corpus_pipeline
from lexiloom.llm import queries


def test_stages(spark, tmp_path):
    g = random.Random(0)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, shared = prose(30), prose(40)
    rows = [(i, prose(80), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s1", 0), (101, prose(20) + " " + item + " " + prose(20), "en", "s0", 0), (102, "1 2 3", "en", "s0", 0), (103, None, "en", "s0", 0)]
    rows += [(110 + i, prose(60) + " " + shared, "en", "s2", 0) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "decontamination", "mixing"]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {r[0] for r in rows} - {100, 101, 102, 103}
    texts = {r[0]: r[1] for r in rows}
    assert shared[5:] not in out[111]["text"] and out[110]["text"] == texts[110]
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert sorted(r["mix_slot"] for r in out.values())[0] == 0


def _brute(rows, items):
    """What the stages after language leave, one document after another: (id, text)."""
    kept = brute_components([(i, t) for i, t, *_ in rows])
    rows = [r for r in sorted(rows) if kept[r[0]][1] == r[0]]
    seen, cut = set(), []
    for i, t, *_ in rows:
        b, gone = t.encode(), np.zeros(len(t.encode()) + 1, int)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            seen.add(b[k : k + 100])
        gone = np.cumsum(gone[:-1]) > 0
        cut.append((i, bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return [(i, t) for i, t in cut if all(brute_edits(x.lower().encode(), t.lower().encode()) > len(x) // 10 for x in items)]


def test_run_equals_brute_force(spark, tmp_path):
    g = random.Random(5)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(g.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items, passages = [prose(20) for _ in range(3)], [prose(30) for _ in range(4)]
    texts = [prose(g.randint(8, 60)) for _ in range(40)]
    for _ in range(60):
        t = g.choice(texts).split()
        if g.random() < 0.4:
            t[g.randrange(len(t))] = word()
        if g.random() < 0.5:
            t += g.choice(passages).split()
        if g.random() < 0.2:
            t[2:2] = g.choice(items).split()
        texts.append(" ".join(t))
    rows = [(i * 2, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert len(left) == len(rows)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == _brute(rows, items)
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert len({(r["mix_slot"], r["mix_place"]) for r in out}) == len(out) and max(r["mix_slot"] for r in out) < len(out)


def test_stages_over_odd_tables(spark, tmp_path):
    """Empty tables, null columns, repeated rows and names that clash with those of the operators."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = ["row", "k", "s", "t", "id", "nth", "keep", "component_id", "mix_slot", "edits"]
    a = "one two three four five six seven eight nine ten " * 4
    rows = [(1, a, "en", "x", 1), (1, a, "en", "x", 1), (2, a + "end", "en", None, None), (None, "uno dos tres cuatro cinco", "es", "x", 3), (3, None, None, None, None), (4, "", "en", "y", 0)]
    full = spark.createDataFrame(rows, schema).withColumns({n: F.lit(n) for n in names})
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (full, full.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if name != "mixing":
                assert out.columns == docs.columns, name
            assert all(r[n] == n for r in got for n in names if not n.startswith("mix")), name
            if docs is full:
                want = {"language": 4, "near_duplicates": 4, "repeats": 6, "decontamination": 6, "mixing": 6}[name]
                assert len(got) == want, name
            else:
                assert not got


def test_registry():
    assert len(queries.QUERIES) == 10 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
