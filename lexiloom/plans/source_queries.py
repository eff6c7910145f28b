"""Queries over files: what is written from the tables is read back, parsed and edited."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines as L
from ..session import scratch
from ..sources import chat, clan, sinks
from ..sources.files import read_files, write_files
from .text_queries import _TOK, _as_files, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- files
@query("SELECT conv_id || '.cha' AS name, CAST(4 + 3 * count(*) + count(*) FILTER (turn % 3 = 0) AS BIGINT) AS lines, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS child_lines FROM conversations GROUP BY conv_id")
def transcript_scan(spark, d):
    """Transcripts written as files in two folders, found again at any depth."""
    root = scratch(spark, "transcripts")
    files = _as_files(spark, d)
    write_files(files.select(F.concat(F.lit(root), F.when(F.col("path").rlike(r"[02468]\.cha$"), "/TD/A").otherwise("/TD"), F.lit("/"), chat.file_name("path")).alias("path"), "content"))
    lines = chat.lines_of(chat.read_transcripts(spark, root))
    return lines.groupBy(chat.file_name("path").alias("name")).agg(F.count("*").alias("lines"), F.count_if(F.col("line").startswith("*CHI:")).alias("child_lines"))


@query("SELECT conv_id || '.cha' AS name, CAST(4 + 3 * count(*) + count(*) FILTER (turn % 3 = 0) AS BIGINT) AS lines FROM conversations WHERE conv_id % 10 = 7 GROUP BY conv_id")
def files_round_trip(spark, d):
    """Files written with a commit and read back, those with a certain end of their names only."""
    root = scratch(spark, "files").removeprefix("file://")
    write_files(_as_files(spark, d).select(F.concat(F.lit(f"{root}/"), chat.file_name("path")).alias("path"), "content"))
    lines = chat.lines_of(read_files(spark, root, "*.cha").where(F.col("path").endswith("7.cha")))
    return lines.groupBy(chat.file_name("path").alias("name")).agg(F.count("*").alias("lines"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def typed_csv(spark, d):
    path = scratch(spark, "csv")
    sinks.write_csv(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("o_orderdate")), path)
    got = clan.read_csv(spark, path)
    assert dict(got.dtypes)["o_totalprice"] == "double" and dict(got.dtypes)["o_orderstatus"] == "string"
    return got.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(lang, '') END AS lang, 'a \"quoted, line\"' || chr(10) || source AS note FROM documents")
def text_csv(spark, d):
    path = scratch(spark, "csv")
    rows = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.concat(F.lit('a "quoted, line"\n'), F.col("source")).alias("note"))
    rows.write.option("escape", '"').mode("overwrite").csv(path, header=True)
    return clan.read_text_csv(spark, path)


@query("SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS key, CAST(2 AS INTEGER) AS fields FROM customer")
def csv_records(spark, d):
    path = scratch(spark, "csv")
    sinks.write_csv(t(spark, d, "customer").select("c_name", F.col("c_custkey").alias("key (text)")), path)
    r = clan.read_records(spark, path)
    return r.select(F.col("record")["c_name"].alias("name"), F.col("record")["key (text)"].alias("key"), F.size("record").alias("fields"))


def _score_files(spark, d):
    """Score tables of suppliers: every second one has a category that the others lack, every fifth no score."""
    k = F.col("s_suppkey")
    extra = k % 2 == 0
    head = F.concat(F.lit("  Sentence |IP |PP |"), F.when(extra, "XQ |").otherwise(""), F.lit("TOT|"))
    total = F.concat(F.lit("TOTAL |  "), (k % 7).cast("string"), F.lit("|  "), (k % 5).cast("string"), F.lit("|"), F.when(extra, F.concat(F.lit(" "), (k % 3).cast("string"), F.lit("|"))).otherwise(""), F.lit(" "), (k % 50).cast("string"), F.lit("|"))
    score = F.when(k % 5 == 0, "NA").otherwise(F.format_string("%.2f", (k % 12).cast("double") / 4))
    text = F.concat(F.lit("dss +x\nFrom file <a/"), (k - F.when(k % 10 == 9, 1).otherwise(0)).cast("string"), F.lit(".cha>\n"), head, F.lit("\n"), total, F.when(k % 3 == 0, "\nWARNING: DSS requires 50 complete sentences").otherwise(""), F.lit("\nDevelopmental sentence score:  "), score, F.lit("\n"))
    return t(spark, d, "supplier").select(F.concat(F.lit("/dss/"), k.cast("string"), F.lit(".tbl.cex")).alias("path"), text.alias("content"))


_SCORES = "s AS (SELECT s_suppkey AS k, CAST(s_suppkey - CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR) AS File_ID FROM supplier)"


@query(f"WITH {_SCORES} SELECT '/dss/' || k || '.tbl.cex' AS path, File_ID, CASE WHEN k % 5 <> 0 THEN (k % 12) / 4 END AS DSS_tbl_score, CAST(k % 5 = 0 AS INTEGER) AS DSS_tbl_score_is_na, CAST(k % 3 = 0 AS INTEGER) AS DSS_tbl_warning_50, CAST(k % 7 AS INTEGER) AS DSS_tbl_IP, CAST(k % 5 AS INTEGER) AS DSS_tbl_PP, CAST(CASE WHEN k % 2 = 0 THEN k % 3 END AS INTEGER) AS DSS_tbl_XQ, CAST(k % 50 AS INTEGER) AS DSS_tbl_TOT FROM s")
def score_table_scan(spark, d):
    return clan.score_tables(_score_files(spark, d)).drop("DSS_tbl_transcript", "DSS_tbl_command")


@query(f"WITH {_SCORES}, g AS (SELECT File_ID, count(*) AS n, count(*) FILTER (k % 3 = 0) AS w, count(*) FILTER (k % 5 = 0) AS na FROM s GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS files, count(*) AS ids, CAST(sum(w) AS BIGINT) AS warnings, CAST(sum(na) AS BIGINT) AS missing, list_sort(list(File_ID) FILTER (n > 1)) AS duplicate_ids FROM g")
def score_table_quality(spark, d):
    return clan.score_table_summary(clan.score_tables(_score_files(spark, d)))


def _workbook(spark, d):
    """Nations as a spreadsheet: two columns of one name, a blank one, gaps given by index, a note and a blank row."""
    row = lambda *c: F.concat(F.lit("<Row>"), *c, F.lit("</Row>"))
    gap = F.concat(F.lit('<Cell ss:Index="5"><Data>'), F.col("n_regionkey").cast("string"), F.lit("</Data></Cell>"))
    plain = lambda v: F.concat(F.lit("<Cell><Data>"), v, F.lit("</Data></Cell>"))
    body = F.when(F.col("n_nationkey") % 6 == 5, F.lit("<Row><Cell><Data>IF YOU DID NOT MARK ERRORS, so be it</Data></Cell></Row>")).otherwise(F.when(F.col("n_nationkey") % 6 == 4, F.lit("<Row><Cell><Data> </Data></Cell></Row>")).otherwise(""))
    full = F.concat(row(plain(F.col("n_nationkey").cast("string")), plain(F.col("n_name")), plain(F.lit("x")), gap), body)
    head = '<?xml version="1.0"?><Workbook xmlns:ss="urn:ss"><Worksheet><Table><Row>' + "".join(f"<Cell><Data>{h}</Data></Cell>" for h in ("File", "Group", "Group", "", "Region")) + "</Row>"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", full.alias("x")))), lambda c: c["x"]), "")
    return t(spark, d, "nation").agg(F.concat(F.lit(head), rows, F.lit("</Table></Worksheet></Workbook>")).alias("content"))


def _workbook_table(spark, d):
    path = scratch(spark, "workbook")
    write_files(_workbook(spark, d).select(F.lit(f"{path}/k.xml").alias("path"), "content"))
    return clan.with_header(clan.workbook_rows(spark, f"{path}/k.xml"))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS File, n_name AS \"Group\", 'x' AS Group_2, CAST(n_regionkey AS DOUBLE) AS Region FROM nation")
def workbook_measures(spark, d):
    return clan.clean_measures(_workbook_table(spark, d)).drop("Unnamed")


@query("SELECT 25 + count(*) FILTER (n_nationkey % 6 = 5) AS raw_rows, count(*) FILTER (n_nationkey % 6 = 5) AS removed_warning_rows, CAST(0 AS BIGINT) AS removed_blank_rows, count(*) AS clean_rows FROM nation")
def workbook_quality(spark, d):
    raw = _workbook_table(spark, d)
    return clan.measure_quality(raw, clan.clean_measures(raw))


@query("SELECT count(*) FILTER (c_custkey % 3 <> 0) + count(*) FILTER (c_custkey % 30 = 1) AS mlt_rows, count(*) FILTER (c_custkey % 30 = 1) AS mlt_duplicate_file_id, count(*) AS kideval_rows, CAST(0 AS BIGINT) AS kideval_duplicate_file_id, count(*) FILTER (c_custkey % 3 = 0) AS merged_missing_mlt FROM customer")
def match_overlap(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("File_ID"))
    mlt = c.where("File_ID % 3 <> 0")
    return clan.match_overlap(c, mlt.union(mlt.where("File_ID % 30 = 1")))


@query("SELECT r_name AS story, CAST(r_regionkey AS INTEGER) AS rank, [r_name || '1', r_name || '2'] AS units FROM region")
def json_reference(spark, d):
    path = scratch(spark, "json")
    ref = F.struct(F.col("r_regionkey").alias("rank"), F.array(F.concat("r_name", F.lit("1")), F.concat("r_name", F.lit("2"))).alias("units"))
    one = t(spark, d, "region").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", ref.alias("v"))))).alias("content"))
    write_files(one.select(F.lit(f"{path}/r.json").alias("path"), "content"))
    return clan.read_reference(spark, f"{path}/r.json", "struct<rank:int,units:array<string>>")


@query("SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0")
def json_lines_skip(spark, d):
    """Every fourth line is cut off in the middle."""
    path = scratch(spark, "jsonl")
    line = F.to_json(F.struct("event_id", "event_type"))
    t(spark, d, "events").select(F.when(F.col("event_id") % 4 == 0, F.substr(line, F.lit(1), F.lit(9))).otherwise(line).alias("value")).write.text(path)
    return clan.read_json_lines(spark, path, "event_id long, event_type string")


@query("SELECT c_custkey AS k, trim(c_name) AS text FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def appended_lines(spark, d):
    """Texts of a CSV as JSON lines, those that are there already left out."""
    path = scratch(spark, "jsonl")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("  "), F.col("c_name")).alias("x"))
    have = c.where("k % 7 = 0").select("k", F.trim("x").alias("text"))
    fresh = c.where("k % 5 <> 0").select("k", F.trim("x").alias("text"))
    sinks.write_json_lines(sinks.new_rows(fresh.union(fresh), have, ["k"]), path)
    return clan.read_json_lines(spark, path, "k long, text string")


@query("SELECT trim(p_name) AS text FROM part")
def column_as_lines(spark, d):
    path = scratch(spark, "jsonl")
    sinks.write_json_lines(sinks.text_lines(t(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")).alias("output_story")), "output_story"), path)
    return clan.read_json_lines(spark, path, "text string")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'broken' ELSE '{\"text\":\"' || upper(c_name) || '\",\"n\":1}' END AS value FROM customer")
def json_field_change(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "broken").otherwise(F.to_json(F.struct(F.col("c_name").alias("text"), F.lit(1).alias("n")))).alias("value"))
    return sinks.transform_json_field(c, "value", "text string, n int", "text", F.upper)


@query("SELECT '{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_name\":\"' || c_name || '\"}' AS value FROM customer")
def summary_lines(spark, d):
    return sinks.summary_json(t(spark, d, "customer").select("c_name", "c_mktsegment", "c_custkey"))


def _listings(spark, d):
    """Frequency listings of orders, a customer a file: codes, omissions and other lines."""
    k = F.col("o_orderkey")
    line = F.concat(F.lit("  "), (k % 4 + 1).cast("string"), F.when(k % 3 == 0, " [* m:+ed]").when(k % 3 == 1, " 0subj").otherwise(" word"))
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "\n").alias("content")).select(F.col("o_custkey").cast("string").alias("path"), "content")


@query("SELECT CAST(o_custkey AS VARCHAR) AS path, 'm:+ed' AS code, CAST(sum(o_orderkey % 4 + 1) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey")
def code_listing(spark, d):
    return clan.code_frequencies(_listings(spark, d))


@query("SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(sum(o_orderkey % 4 + 1) AS BIGINT) AS \"0subj\", CAST(0 AS BIGINT) AS \"0det\" FROM orders WHERE o_orderkey % 3 = 1 GROUP BY o_custkey")
def omission_listing(spark, d):
    return clan.wide_frequencies(clan.code_frequencies(_listings(spark, d), "omissions"), ["0subj", "0det"])


@query("SELECT s_name, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS INTEGER) AS ord FROM supplier")
def roster_order(spark, d):
    path = scratch(spark, "csv")
    sinks.write_csv(t(spark, d, "supplier").select("s_name", "s_nationkey", "s_suppkey"), path)
    return clan.read_roster(spark, path, ["s_name"], ["s_nationkey", "s_suppkey"]).select("s_name", "ord")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 7 = 0 THEN 'Z9' ELSE ['A1','A2','A3','B1','B2','B3'][n_nationkey % 7] END AS target_story, CAST(n_nationkey % 7 AS INTEGER) AS ord FROM nation")
def story_manifest_order(spark, d):
    path = scratch(spark, "csv")
    story = F.when(F.col("n_nationkey") % 7 == 0, "Z9").otherwise(F.element_at(F.array(*[F.lit(s) for s in ("A1", "A2", "A3", "B1", "B2", "B3")]), F.greatest(F.col("n_nationkey") % 7, F.lit(1)).cast("int")))
    sinks.write_csv(t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), story.alias("target_story")), path)
    return clan.read_story_manifest(spark, path, ["key"]).select("key", "target_story", F.col("ord").cast("int").alias("ord"))


# ---------------------------------------------------------------- names and headers
def _paths(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("pair_sli"), k.cast("string"), F.lit("_td"), (k + 1).cast("string"), F.lit("_rep"), (k % 10).cast("string"), F.lit("_A2_TD.cha"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("_B1.cha"))).otherwise(F.concat(F.lit("x"), k.cast("string"), F.lit(".cha")))
    return t(spark, d, "customer").select("c_custkey", F.concat(F.when(k % 2 == 0, "/data/TD/").otherwise("/data/SLI/"), name).alias("path"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS sli_child_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) ELSE '' END AS td_child_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 10 AS VARCHAR) ELSE '' END AS replicate_id, CASE c_custkey % 3 WHEN 0 THEN 'A2' WHEN 1 THEN 'B1' ELSE '' END AS story_id, CASE WHEN c_custkey % 3 = 0 THEN 'TD' ELSE '' END AS grp, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS child_id FROM customer")
def name_parts(spark, d):
    return _paths(spark, d).select("c_custkey", chat.name_parts("path").alias("p")).select("c_custkey", "p.*")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '1' ELSE 'pair_sli' || c_custkey || '_td' || (c_custkey + 1) || '_rep' || (c_custkey % 10) || '_A2_TD' END AS digits, CASE c_custkey % 3 WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '1' ELSE '' END AS number, CASE c_custkey % 3 WHEN 2 THEN 'x' || c_custkey WHEN 1 THEN c_custkey || '_B1' ELSE 'pair_sli' || c_custkey || '_td' || (c_custkey + 1) || '_rep' || (c_custkey % 10) || '_A2_TD' END AS stem FROM customer")
def file_ids(spark, d):
    p = _paths(spark, d)
    got = p.select("c_custkey", *[chat.file_id("path", rule=r).alias(r) for r in ("digits", "number", "strip", "stem", "first")])
    return got.where("strip = stem and first = stem").drop("strip", "first")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'TD' ELSE 'SLI' END AS grp, CAST(c_custkey AS VARCHAR) AS child, CASE WHEN c_custkey % 3 = 1 THEN 'B1' ELSE '' END AS story FROM customer WHERE c_custkey % 3 <> 0")
def path_index(spark, d):
    return chat.path_index(_paths(spark, d).where("c_custkey % 3 <> 0")).select("grp", "child", "story")


def _heads(spark, d):
    k = F.col("c_custkey")
    age = F.concat((k % 9 + 2).cast("string"), F.lit(";"), F.lpad((k % 12).cast("string"), 2, "0"), F.lit("."), F.when(k % 4 != 0, F.lpad((k % 28).cast("string"), 2, "0")).otherwise(""))
    ident = F.concat(F.lit("@ID:\teng|Corpus"), (k % 3).cast("string"), F.lit("|CHI|"), age, F.lit("|"), F.when(k % 2 == 0, "male").otherwise("female"), F.lit("|"), F.when(k % 5 != 0, "SLI").otherwise(""), F.lit("||Target_Child|||"))
    text = F.concat(F.lit("@UTF8\n@ID:\teng|Other|INV|||||Investigator|||\n"), ident, F.lit("\n@Types:\tcross, "), F.when(k % 10 == 0, "DLD").otherwise("toys"), F.lit("\n@Comment:\tbundle_id=b"), k.cast("string"), F.lit("\n@Comment:\tkind=a=b\n*CHI:\thi .\n@End\n"))
    return t(spark, d, "customer").select(k.cast("string").alias("path"), age.alias("age"), text.alias("content"))


_AGE = "CAST(c_custkey % 9 + 2 AS VARCHAR) || ';' || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0') || '.' || CASE WHEN c_custkey % 4 <> 0 THEN lpad(CAST(c_custkey % 28 AS VARCHAR), 2, '0') ELSE '' END"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS path, {_AGE} AS age, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CASE WHEN c_custkey % 5 <> 0 THEN 'SLI' ELSE '' END AS grp, 'b' || c_custkey AS bundle_id, 'a=b' AS kind FROM customer")
def transcript_headers(spark, d):
    return chat.headers(_heads(spark, d)).select("path", "age", "sex", "grp", F.col("comments")["bundle_id"].alias("bundle_id"), F.col("comments")["kind"].alias("kind"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS path, 'Corpus' || (c_custkey % 3) AS corpus, 'CHI' AS speaker, {_AGE} AS age, CASE WHEN c_custkey % 5 <> 0 THEN 'SLI' WHEN c_custkey % 10 = 0 THEN 'DLD/SLI' ELSE 'Unknown' END AS diagnosis FROM customer")
def transcript_identity(spark, d):
    return chat.identity(_heads(spark, d))


_MONTHS = "((c_custkey % 9 + 2) * 12 + c_custkey % 12)"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS path, round({_MONTHS} + CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 28 ELSE 0 END / 30.0, 6) AS months, CAST({_MONTHS} AS DOUBLE) AS whole_months, round(c_custkey % 9 + 2 + (c_custkey % 12) / 12.0, 6) AS years, CAST(c_custkey % 9 + 2 AS INTEGER) AS year FROM customer")
def age_forms(spark, d):
    return _heads(spark, d).select("path", F.round(T.age_months("age"), 6).alias("months"), T.age_months("age", None).alias("whole_months"), F.round(T.age_years("age"), 6).alias("years"), T.age_year("age").alias("year"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 9 + 2 = 4")
def filtered_bundles(spark, d):
    return chat.bundles(_heads(spark, d), grp="SLI", years=4).select("path")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '' ELSE 'x7' END AS id FROM customer")
def normal_ids(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", T.normal_id(F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 3 == 1, F.when(k % 2 == 0, "NaN")).otherwise(" x7 ")).alias("id"))


# ---------------------------------------------------------------- line editors
def _lines(spark, d):
    return chat.lines_of(_as_files(spark, d))


@query("SELECT '/TD/' || conv_id || '.cha' AS path, CAST(count(*) AS BIGINT) AS changed FROM conversations WHERE role = 'user' AND turn % 4 = 0 GROUP BY conv_id")
def dry_run_counts(spark, d):
    """A spaced pause at the beginning of some of the child's lines; what its removal would change."""
    first = chat.story_lines(_lines(spark, d)).where(F.col("line").startswith("*"))
    c = t(spark, d, "conversations").select(F.concat(F.lit("/TD/"), "conv_id", F.lit(".cha")).alias("path"), (F.row_number().over(_by("conv_id", "turn")) - 1).alias("nth"), "role", "turn")
    numbered = first.withColumn("nth", F.row_number().over(_by("path", "line_no")) - 1).join(c, ["path", "nth"])
    lines = numbered.select("path", "line_no", F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), F.regexp_replace("line", r"^\*CHI:\t", "*CHI:\t( .. ) ")).otherwise(F.col("line")).alias("line"))
    return sinks.changed_in_place(sinks.edited(lines, L.normalise_pauses))


def _by(key: str, order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy(order)


@query("SELECT row_number() OVER (ORDER BY '/TD/' || conv_id || '.cha') AS place, '/TD/' || conv_id || '.cha' AS path FROM (SELECT DISTINCT conv_id FROM conversations)")
def file_list(spark, d):
    from pyspark.sql.window import Window

    return sinks.file_list(_as_files(spark, d)).withColumn("place", F.row_number().over(Window.orderBy("path")).cast("long"))  # one row a file name


@query("SELECT '/TD/' || conv_id || '.cha' AS path, conv_id % 3 = 0 AS moved FROM (SELECT DISTINCT conv_id FROM conversations)")
def routed_files(spark, d):
    """Two files in three have a morphology tier; the others are moved aside, and the same are found by their lines."""
    files = _as_files(spark, d).withColumn("content", F.when(F.regexp_extract("path", r"(\d+)\.cha", 1).cast("int") % 3 != 0, F.regexp_replace("content", "%umor:", "%mor:")).otherwise(F.col("content")))
    stay, moved = sinks.route_files(files)
    lacking = sinks.files_without(chat.lines_of(moved), "%mor:")
    return stay.select("path", F.lit(False).alias("moved")).union(moved.join(lacking, "path", "left_semi").select("path", F.lit(True)))


_TIERS = f"x AS (SELECT conv_id, turn, role, {_TOK.format(c='text')} AS k FROM conversations)"
_MOR = "array_to_string(list_transform(k, lambda w: CASE WHEN len(w) % 3 = 0 THEN 'verb|' ELSE 'noun|' END || w || CASE WHEN len(w) % 2 = 0 THEN '-Fin-Ind-Past-S3' ELSE '' END), ' ')"


@query(f"WITH {_TIERS} SELECT '/TD/' || conv_id || '.cha' AS path, CAST(count(*) AS BIGINT) AS n, md5(string_agg('%mor:' || chr(9) || {_MOR}, '|' ORDER BY turn)) AS mor FROM x GROUP BY conv_id")
def inserted_morphology(spark, d):
    """Blocks without a morphology tier get one from the other annotator's; pauses and quotation ends are normal before."""
    lines = L.insert_missing_tiers(L.normalise_quote_ends(L.normalise_pauses(_lines(spark, d))))
    cells = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.where(F.col("line").startswith("%mor:")).groupBy("path").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(cells, lambda c: c["line"]), "|")).alias("mor"))


_GRA = "array_to_string(list_transform(k, lambda w, i: i || '|' || CASE WHEN i = 1 THEN '0|ROOT' WHEN len(w) % 4 = 0 THEN (i - 1) || '|NSUBJ' ELSE (i - 1) || '|OBJ' END), ' ')"


@query(f"WITH {_TIERS} SELECT '/TD/' || conv_id || '.cha' AS path, md5(string_agg('%gra:' || chr(9) || {_GRA}, '|' ORDER BY turn)) AS gra FROM x GROUP BY conv_id")
def inserted_dependencies(spark, d):
    lines = L.insert_missing_tiers(_lines(spark, d))
    cells = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.where(F.col("line").startswith("%gra:")).groupBy("path").agg(F.md5(F.array_join(F.transform(cells, lambda c: c["line"]), "|")).alias("gra"))


@query("SELECT '/TD/' || conv_id || '.cha' AS path, CAST(4 + 3 * count(*) + count(*) FILTER (turn % 3 = 0) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def stripped_tiers(spark, d):
    """What was inserted goes again."""
    return L.strip_tiers(L.insert_missing_tiers(_lines(spark, d))).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {_TIERS} SELECT '/TD/' || conv_id || '.cha' AS path, md5(string_agg({_MOR} || '#' || {_GRA}, '|' ORDER BY turn)) AS tiers FROM x GROUP BY conv_id")
def promoted_tiers(spark, d):
    """The annotator's tiers take the place of stale ones two lines below."""
    stale = F.regexp_replace("content", r"(?m)^(%ugra:[^\n]*)$", "$1\n%mor:\tx|stale\n%gra:\t1|0|STALE")
    lines = L.promote_tiers(chat.lines_of(_as_files(spark, d).withColumn("content", stale)))
    u = chat.utterances(lines)
    cells = F.array_sort(F.collect_list(F.struct("first_line", F.concat(F.col("tiers")["%mor"], F.lit("#"), F.col("tiers")["%gra"]).alias("x"))))
    return u.groupBy("path").agg(F.md5(F.array_join(F.transform(cells, lambda c: c["x"]), "|")).alias("tiers"))


_FLAT = "CASE WHEN len(k) = 0 THEN '' ELSE array_to_string(list_transform(k, lambda w, i: i || '|' || CASE WHEN i = r THEN '0|ROOT' ELSE r || '|DEP' END), ' ') END"


@query(f"WITH {_TIERS}, r AS (SELECT *, coalesce(list_position(list_transform(k, lambda w: len(w) % 3 = 0), true), 1) AS r FROM x) SELECT conv_id, turn, '%gra:' || chr(9) || {_FLAT} AS gra FROM r")
def flat_parses(spark, d):
    k = T.tokens("text")
    mor = F.concat(F.lit("%mor:\t"), F.array_join(F.transform(k, lambda w: F.concat(F.when(F.length(w) % 3 == 0, "verb|").otherwise("noun|"), w)), " "))
    return t(spark, d, "conversations").select("conv_id", "turn", L.fallback_gra(mor).alias("gra"))


@query(f"WITH {_TIERS} SELECT conv_id, turn, k AS lemmas, CAST(len(k) AS INTEGER) AS n FROM x")
def tier_lemmas(spark, d):
    line = F.concat(F.lit("%mor:\t"), F.array_join(F.transform(T.tokens("text"), lambda w: F.concat(F.lit("n|"), w, F.lit("-Acc-S1~aux|be"))), " "), F.lit(" ."))
    got = t(spark, d, "conversations").select("conv_id", "turn", T.tier_tokens(line).alias("t"))
    return got.select("conv_id", "turn", T.lemmas(F.col("t")).alias("lemmas"), F.size("t").alias("n"))


@query("SELECT page_id, page_id % 2 = 0 AS quote, CASE page_id % 4 WHEN 0 THEN '.' WHEN 1 THEN '?' WHEN 2 THEN '!' ELSE '' END AS mark FROM pages")
def ending_marks(spark, d):
    k = F.col("page_id")
    line = F.concat(F.lit("it ran "), F.when(k % 4 == 0, ".").when(k % 4 == 1, "?").when(k % 4 == 2, "!").otherwise("on"), F.when(k % 2 == 0, ' +"/').otherwise(""))
    return t(spark, d, "pages").select("page_id", T.ending(line).alias("e")).select("page_id", "e.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) AND o_orderkey % 5 <> 0 THEN 'it goed [* m:+ed] . [+ gram]' WHEN o_orderkey % 4 IN (0, 1) THEN 'it goed [* m:+ed]' WHEN o_orderkey % 5 <> 0 THEN 'it went .' ELSE 'it went' END AS line, CASE WHEN o_orderkey % 4 IN (0, 1) AND o_orderkey % 5 <> 0 THEN 'it goed .' WHEN o_orderkey % 4 IN (0, 1) THEN 'it goed' WHEN o_orderkey % 5 <> 0 THEN 'it went .' ELSE 'it went' END AS without FROM orders")
def gram_marks(spark, d):
    k = F.col("o_orderkey")
    line = F.concat(F.when(k % 4 < 2, "it goed [* m:+ed]").otherwise("it went"), F.when(k % 5 != 0, " .").otherwise(""))
    o = t(spark, d, "orders").select("o_orderkey", line.alias("line"))
    marked = L.add_gram_mark(o)
    return marked.join(L.remove_code(o, r"m:\+ed").select("o_orderkey", F.col("line").alias("without")), "o_orderkey")


@query("SELECT c_nationkey AS bundle_id, md5('@Begin' || chr(10) || string_agg('@G:' || chr(9) || 'S' || s || chr(10) || lines, chr(10) ORDER BY s) || chr(10) || '@End' || chr(10)) AS content FROM (SELECT c_nationkey, c_custkey % 3 AS s, string_agg('*CHI:' || chr(9) || c_name, chr(10) ORDER BY c_custkey) AS lines FROM customer GROUP BY 1, 2) GROUP BY 1")
def rebundled_stories(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("bundle_id"), (F.col("c_custkey") % 3).cast("int").alias("slot"), F.col("c_custkey").alias("line_no"), F.concat(F.lit("*CHI:\t"), F.col("c_name")).alias("line"))
    marks = c.select("bundle_id", "slot").distinct().select("bundle_id", (F.col("slot") + 1).alias("slot"), F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit("@G:\tS"), F.col("slot").cast("string")).alias("line"))
    ends = c.select("bundle_id", "slot").distinct().select("bundle_id", (F.col("slot") + 1).alias("slot"), F.lit(1 << 40).alias("line_no"), F.lit("@End").alias("line"))
    head = c.select("bundle_id").distinct().select("bundle_id", F.lit(0).cast("long").alias("line_no"), F.lit("@Begin").alias("line"))
    out = L.rebundle(head, c.withColumn("slot", F.col("slot") + 1).unionByName(marks).unionByName(ends))
    return out.select("bundle_id", F.md5("content").alias("content"))


# ---------------------------------------------------------------- texts for training and generation
@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN true ELSE false END AS fragment, c_custkey % 4 = 3 AS marked FROM customer")
def fragments(spark, d):
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, "the .").when(k % 4 == 1, "it went to and.").when(k % 4 == 2, "it went home .").otherwise("it goed [* m:+ed] home .")
    return t(spark, d, "customer").select("c_custkey", T.is_fragment(line).alias("fragment"), T.is_marked(line).alias("marked"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(0 AS INTEGER) AS line_no, 'it goed home .' AS input, 'it goed [: went] [* m:+ed] home .' AS output FROM orders WHERE o_orderkey % 3 = 0")
def training_pairs(spark, d):
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, "*CHI:\tit goed [: went] [* m:+ed] home . [+ gram]").when(k % 3 == 1, "*CHI:\tthe .").otherwise("%mor:\tn|x")
    got = chat.training_pairs(t(spark, d, "orders").select(k.cast("string").alias("path"), F.lit(0).alias("line_no"), line.alias("line")))
    return got.drop("instruction")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['he ran +...', 'it hid ?'] WHEN 1 THEN ['so (...) he ran .'] WHEN 2 THEN ['oh !', 'it hid .'] ELSE ['no end .'] END AS lines FROM part")
def transcript_sentences(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "he ran... it hid?").when(k % 4 == 1, "so...he ran.").when(k % 4 == 2, "oh!  it hid.").otherwise("no end")
    return t(spark, d, "part").select("p_partkey", T.transcript_sentences(text).alias("lines"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ['he said +\"/.', '+\" go .'] WHEN p_partkey % 3 = 1 THEN ['+\" go , .', 'he said +\".', 'It ran .'] ELSE ['It ran.', 'he said +\"/.', '+\" go now !'] END AS lines FROM part")
def quoted_lines(spark, d):
    from ..operators.quotes import utterances

    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, 'he said, "go."').when(k % 3 == 1, '"go," he said. It ran.').otherwise("It ran. he said: \u201cgo now!\u201d")
    return t(spark, d, "part").select("p_partkey", utterances(text).alias("lines"))


_GENERATED = "g AS (SELECT s_suppkey AS k, unnest(['TD', 'SLI']) AS grp FROM supplier)"


@query(f"WITH {_GENERATED} SELECT 'round1' AS round_id, 'b' || k AS bundle_id, 'p' || k AS pair_id, '' AS replicate_id, 'A1' AS target_story, CASE WHEN grp = 'TD' THEN 'stage1_td' ELSE 'stage2_sli' END AS stage, grp AS \"group\", '' AS source_child_id, '4;00.' AS age, '/out/' || CASE WHEN grp = 'TD' THEN 'stage1_td' ELSE 'stage2_sli' END || '/b' || k || '_A1_' || grp || '.cha' AS output_path FROM g WHERE grp = 'TD' OR k % 2 = 0")
def generated_manifest(spark, d):
    k = F.col("s_suppkey").cast("string")
    rows = t(spark, d, "supplier").select(F.lit("round1").alias("round_id"), F.concat(F.lit("b"), k).alias("bundle_id"), F.concat(F.lit("p"), k).alias("pair_id"), F.lit("A1").alias("target_story"), F.lit("4;00.").alias("age"), F.lit("male").alias("sex"), F.lit("The dog ran. It hid").alias("td"), F.when(F.col("s_suppkey") % 2 == 0, "dog runned.").alias("sli"))
    made = sinks.stories_to_transcripts(rows, ["round_id", "bundle_id", "pair_id", "target_story"], {"TD": "td", "SLI": "sli"}, "age", "sex")
    return sinks.transcript_manifest(made.withColumn("age", F.regexp_extract("content", r"\|CHI\|([^|]*)\|", 1)), "/out")


@query("WITH m AS (SELECT conv_id, 'A' || last_value(CASE WHEN turn % 3 = 0 THEN CAST(floor(turn / 3) + 1 AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS s, role, text FROM conversations) SELECT DISTINCT s AS story_id, '{\"story_id\":\"' || s || '\",\"title\":\"\",\"units\":[],\"content_invariants\":[],\"optional_content\":[],\"notes\":\"\"}' AS reference FROM m WHERE role = 'user' AND s IS NOT NULL")
def reference_templates(spark, d):
    return sinks.reference_template(chat.narratives(_as_files(spark, d)))


@query("SELECT r_regionkey, 'Tell them:' || chr(10) || string_agg(i || '. ' || n_name, chr(10) ORDER BY i) AS prompt FROM (SELECT r_regionkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS i FROM region JOIN nation ON r_regionkey = n_regionkey) GROUP BY 1")
def numbered_prompts(spark, d):
    from ..operators.design import prompt_text

    n = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("items"))
    return n.select("r_regionkey", prompt_text("items", "Tell them:").alias("prompt"))


@query("SELECT c_custkey, '[\"caf\\u00e9 \\ud83d\\ude00\",\"' || c_name || '\"]' AS units FROM customer")
def ascii_units(spark, d):
    return t(spark, d, "customer").select("c_custkey", T.ascii_json(F.array(F.lit("caf\u00e9 \U0001f600"), F.col("c_name"))).alias("units"))


@query("SELECT c_custkey, lower(c_name || ' TEXT') AS low, round(c_acctbal, 3) AS short, CASE WHEN c_custkey % 2 = 0 THEN 'NA' ELSE printf('%.4f', c_acctbal) END AS cell FROM customer")
def number_forms(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.lower(F.concat("c_name", F.lit(" TEXT"))).alias("low"), F.bround("c_acctbal", 3).alias("short"), sinks.cell(F.when(F.col("c_custkey") % 2 != 0, F.col("c_acctbal"))).alias("cell"))
