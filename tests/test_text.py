import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("y")).first()["y"]


def test_cleaners(spark):
    said = "&-um <the dog> [/] the dog 0is run [* m:03s:a] \x15123_456\x15 +..."
    assert one(spark, said, T.clean("x", "surface")) == "the dog the dog run"
    assert one(spark, said, T.tokens(T.clean("x", "spoken"))) == ["um", "the", "dog", "the", "dog", "is", "run"]
    assert one(spark, "0subj goed [* m:=ed] (a)nother <x>", T.clean("x", "plain")) == "goed another x"
    assert one(spark, "*CHI:\the go [* m:0es] 0det (.) park [+ gram] .", T.clean("x", "raw_pair")) == "he go park ."
    assert one(spark, None, T.clean("x")) is None


def test_quicker_cleaners_equal_their_definitions(spark):
    """Cleaning ran every substitution as it is defined, 72 passes in ``chat_normalize``; it takes cheaper equals of them."""
    g = random.Random(5)
    bits = [" ", "  ", *"\t\n\r\x0b\x0c\x15\x15\u0085\u2028\xa0<>[](){}^+&-=:,.?!'\"_|\\/$09abxyZ\u00e9\U0001f600", "[/]", "[//]", "(.)", "(..)", "&-", "&+", "&=", "um", "UH", "0a", "xx", "xxx", "yyy", "x<xx", "::", "Lil", "LIL", "*CHI:", "*12:", "12_34", "[*", "[:"]
    rows = [("".join(g.choice(bits) for _ in range(g.randint(0, 16))),) for _ in range(4000)] + [(None,), (" ".join(map(chr, range(1, 0x300))),)]
    df = spark.createDataFrame(rows, "x string").repartition(4).cache()
    passes = 0
    for name, rules in T.CLEANERS.items():
        want = F.col("x")
        for pattern, to in rules:
            want = F.regexp_replace(want, pattern, to)
        assert df.where(~F.trim(want).eqNullSafe(T.clean("x", name))).count() == 0, name
        passes += len(T.FEWER.get(name, rules))
    assert passes < sum(map(len, T.CLEANERS.values()))


def test_tokens_and_ngrams(spark):
    assert one(spark, "It's XXX 12 o'clock yyy", T.tokens("x")) == ["it's", "o'clock"]
    assert one(spark, "", T.tokens("x")) == []
    assert one(spark, "a b", T.ngrams(T.padded(T.tokens("x"), 2), 2)) == [["<s>", "a"], ["a", "b"], ["b", "</s>"]]
    assert one(spark, "a", T.ngrams(T.tokens("x"), 2)) == []
    assert one(spark, "", T.type_token_ratio(T.tokens("x"))) == 0.0


def test_names_lemmas_ages(spark):
    assert one(spark, "m:+3s:a", T.code_name("x")) == "m_c_plus_3s_c_a"
    assert one(spark, "m:0's", T.code_name("x")) == "m_c_0_apos_s"
    assert one(spark, "%mor:\tpro|he verb|go-Fin-S3~aux|be .", T.lemmas(T.tier_tokens(F.col("x")))) == ["he", "go"]
    assert abs(one(spark, "4;06.15", T.age_months("x")) - 54.5) < 1e-9
    assert one(spark, "5;00.", T.age_months("x")) == 60
    assert one(spark, "4;06.15", T.age_months("x", None)) == 54
    assert one(spark, "?", T.age_months("x")) is None
    assert one(spark, "482.0", T.normal_id("x")) == "482" and one(spark, None, T.normal_id("x")) == ""


def test_sentences_and_repeats(spark):
    assert one(spark, "One. Two!  three", T.sentences("x")) == ["One.", "Two!", "three."]
    assert one(spark, "In 10. 11 or 1", T.sentences("x")) == ["In 10.", "11 or 1."]
    assert one(spark, "the the dog", T.mark_repeats("x")) == "the [/] the dog"


def test_quotes(spark):
    from lexiloom.operators.quotes import utterances

    lines = lambda x: one(spark, x, utterances("x"))
    assert lines('He said, "Go home. Now!" and left.') == ['He said +"/.', '+" Go home .', '+" Now !', "and left ."]
    assert lines('"Stop" said the dog. It ran.') == ['+" Stop .', 'said the dog +".', "It ran ."]
    assert lines('an "open end') == ["an open end ."]
    assert lines("") == [] and spark.range(1).select(utterances(F.lit(None).cast("string")).alias("u")).first()["u"] == []
    assert lines('"Why?" asked Tim "now. ok" bye.') == ['+" Why ?', 'asked Tim now +".', "ok bye ."]
    assert lines("One; two: three. ") == ["One ; two : three ."]


def test_quotations_of_random_texts_equal_sql(spark):
    """The fold against quotations taken off one by one, in SQL."""
    import random

    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from lexiloom.operators.quotes import utterances
    from lexiloom.plans.text_queries import QUOTED

    g = random.Random(5)
    alphabet = ['"', '"', " ", " ", ". ", ".", "!", "?", ",", ", ", ";", "a", "He ran", "\u201c", "\u201d", "x1", "\n"]
    documents = pd.DataFrame({"doc_id": range(1500), "text": ["".join(g.choices(alphabet, k=g.randint(0, 30))) for _ in range(1500)]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = dict(con.execute(QUOTED).fetchall())
    got = {r["doc_id"]: r["u"] for r in spark.createDataFrame(documents).select("doc_id", utterances("text").alias("u")).collect()}
    wrong = [(documents.text[i], got[i], want[i]) for i in got if got[i] != want[i]]
    assert not wrong, wrong[:3]
    assert sum(any('+"' in x for x in v) for v in got.values()) > 500
