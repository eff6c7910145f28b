import pytest
from pyspark.sql import functions as F

from lexiloom.operators import annotation as A
from lexiloom.operators import lines as L
from lexiloom.sources import chat, clan

CHA = """@UTF8
@Begin
@ID:\teng|Corpus|CHI|4;06.15|male|SLI||Target_Child|||
@Comment:\tkind=test
@G:\tA1
*CHI:\the goed [* m:=ed] home .
%umor:\tpro|he verb|go-Fin-Ind-Past-S3 adv|home .
%ugra:\t1|2|NSUBJ 2|1|ROOT 3|2|ADVMOD 4|2|PUNCT
*INV:\tand then ?
@G:\tA2
*CHI:\t( . ) she run [* m:03s:a] .
%umor:\tpro|she verb|run .
*CHI:\tloop here .
%umor:\ta|x b|y c|z
%ugra:\t1|2|DEP 2|1|DEP 3|3|ROOT
@End
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("/SLI/12.cha", CHA)], "path string, content string")


def test_blocks_and_headers(files):
    u = {r["first_line"]: r for r in chat.utterances(chat.lines_of(files)).collect()}
    assert [u[k]["speaker"] for k in sorted(u)] == ["CHI", "INV", "CHI", "CHI"]
    assert u[5]["tiers"]["%umor"].startswith("pro|he")
    h = chat.headers(files).first()
    assert (h["age"], h["grp"], h["comments"]) == ("4;06.15", "SLI", {"kind": "test"})
    n = {r["story_id"]: r["story_text"] for r in chat.narratives(files).collect()}
    assert n == {"A1": "he goed home .", "A2": "( . ) she run . loop here ."}
    assert chat.bundles(files).first()["utterance_tokens"] == [["he", "goed", "home"], ["she", "run"], ["loop", "here"]]
    assert files.select(chat.file_id("path")).first()[0] == "12"


def test_errors_past_verbs_syntax(files):
    lines = chat.lines_of(files)
    c = A.code_counts(lines, "path", "line")
    assert {r["code"]: r["n"] for r in c.collect()} == {"m:=ed": 1, "m:03s:a": 1}
    e = A.error_table(lines).first()
    assert (e["chi_utterances"], e["chi_utterances_with_error_code"], e["error_morphology_total"]) == (3, 2, 2)
    p = A.past_verbs(chat.utterances(lines), c).first()
    assert (p["overt_past_finite_verbs"], p["past_verb_opportunities"], p["past_overgeneralization_errors"]) == (1, 1, 1)
    s = A.syntax_table(chat.utterances(lines)).first()
    assert (s["chi_blocks_total"], s["chi_blocks_analyzed"], s["chi_blocks_skipped_missing_tiers"]) == (3, 2, 1)
    assert s["Syntax_Max_TreeDepth"] == 2 and s["Syntax_Subject_Utt_Prop"] == 0.5  # the cycle stops where it comes back
    g = A.grouped_errors(c, lines.groupBy("path").agg(F.lit(0).alias("utts")), "path", "utts").first()
    assert g["bare_marking_errors"] == 1 and g["bare_marking_errors_per_utt"] == 0.0


def test_line_editors(files):
    text = lambda d: [r["line"] for r in d.orderBy("line_no").collect()]
    lines = chat.lines_of(files)
    assert "*CHI:\t(.) she run [* m:03s:a] ." in text(L.normalise_pauses(lines))
    full = text(L.insert_missing_tiers(lines))
    assert "%gra:\t1|2|NSUBJ 2|0|ROOT 3|2|ADVMOD 4|2|PUNCT" in full and "%mor:\tpro|she verb|run ." in full
    assert "%gra:\t1|2|DEP 2|0|ROOT 3|2|PUNCT" in full
    assert not any(x.startswith("%mor") for x in text(L.strip_tiers(L.insert_missing_tiers(lines))))
    assert "*CHI:\t( . ) she run [* m:03s:a] . [+ gram]" in text(L.add_gram_mark(lines))
    assert "*CHI:\t( . ) she run ." in text(L.remove_code(lines))
    q = lines.limit(1).withColumn("line", F.lit('*CHI:\the said +"/ .'))
    assert text(L.normalise_quote_ends(q)) == ['*CHI:\the said +"/.']


def test_clan_readers(spark):
    tbl = "dss +x\nFrom file <a/7.cha>\n  Sentence |IP |PP |MV |SV |NG |CNJ|IR |WHQ|  S|TOT|\nTOTAL |  1|  2|  3|  4|  5|  6|  7|  8|  9| 45|\nWARNING: DSS requires 50 sentences\nDevelopmental sentence score:  4.71\n"
    f = spark.createDataFrame([("x.tbl.cex", tbl)], "path string, content string")
    r = clan.score_tables(f).first()
    assert (r["File_ID"], r["DSS_tbl_score"], r["DSS_tbl_TOT"], r["DSS_tbl_warning_50"]) == ("7", 4.71, 45, 1)
    fr = clan.code_frequencies(spark.createDataFrame([("p", "  3 [* m:0ed]\n  2 [* m:0ed]\n 1 0subj")], "path string, content string"))
    assert [(x["code"], x["n"]) for x in fr.collect()] == [("m:0ed", 5)]
    assert clan.unique_names(["File", "Group", "Group", ""]) == ["File", "Group", "Group_2", "Unnamed"]
    assert clan.numeric_columns(spark.createDataFrame([("1", "x"), ("", "2")], "a string, b string")) == ["a"]


def test_sinks(spark):
    from lexiloom.sources import sinks

    df = spark.createDataFrame([(1, "The dog ran. It hid", None, "4;00.", "male")], "k int, td string, sli string, age string, sex string")
    r = sinks.stories_to_transcripts(df, ["k"], {"TD": "td", "SLI": "sli"}, "age", "sex").collect()
    assert len(r) == 1 and r[0]["grp"] == "TD" and r[0]["content"].endswith("*CHI:\tThe dog ran .\n*CHI:\tIt hid .\n@End\n")
    back = chat.headers(spark.createDataFrame([("p", r[0]["content"])], "path string, content string")).first()
    assert (back["age"], back["sex"], back["grp"]) == ("4;00.", "male", "TD")
    j = spark.createDataFrame([('{"text":"a b"}',), ("broken",)], "value string")
    out = [x["value"] for x in sinks.transform_json_field(j, "value", "text string", "text", F.upper).collect()]
    assert out == ['{"text":"A B"}', "broken"]
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "t string")
    assert [x["t"] for x in sinks.new_rows(a, spark.createDataFrame([("y",)], "t string"), ["t"]).collect()] == ["x"]
    assert sinks.markdown(a.limit(1)) == "| t |\n| --- |\n| x |"
