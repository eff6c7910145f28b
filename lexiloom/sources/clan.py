"""Readers for tool output: score tables, frequency listings, XML workbooks, JSON lines, all-text CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..checks import number, require_columns

def score_cells(files: DataFrame) -> DataFrame:
    """(path, content) of ``.tbl.cex`` files -> one row a file: id, source transcript, command, score, whether the score is
    missing (``NA``), whether it comes of fewer than fifty sentences, and the totals as a map from category."""
    pick = lambda p: F.nullif(F.trim(F.regexp_extract("content", p, 1)), F.lit(""))
    cells = lambda p: F.transform(F.split(F.coalesce(F.regexp_replace(pick(p), r"\|\s*$", ""), F.lit("")), r"\|"), lambda x: F.trim(x))
    names, values = cells(r"(?m)^\s+Sentence\s+\|(.*)$"), cells(r"(?m)^TOTAL\s+\|(.*)$")
    source, score = pick(r"(?m)^From file <(.+)>\s*$"), pick(r"(?m)^Developmental sentence score:\s+(.+?)\s*$")
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: F.coalesce(p["k"], F.lit("")) != "")
    out = files.select(
        "path",
        F.regexp_extract(F.coalesce(source, F.col("path")), r"(\d+)(?:_[AB]\d)?(?:_\w+)?(?:\.cha|\.tbl\.cex)?$", 1).alias("File_ID"),
        source.alias("DSS_tbl_transcript"),
        F.split(F.col("content"), r"\r?\n")[0].alias("DSS_tbl_command"),
        number(score).alias("DSS_tbl_score"),
        F.coalesce(score == "NA", F.lit(False)).cast("int").alias("DSS_tbl_score_is_na"),
        F.col("content").contains("DSS requires 50").cast("int").alias("DSS_tbl_warning_50"),
        pairs.alias("_pairs"),
    )
    names = F.array_distinct(F.transform("_pairs", lambda p: p["k"]))
    last = lambda n: F.element_at(F.filter("_pairs", lambda p: p["k"] == n), -1)["v"].try_cast("int")
    return out.withColumn("totals", F.map_from_arrays(names, F.transform(names, last))).drop("_pairs")


def score_tables(files: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """``score_cells`` with a ``DSS_tbl_*`` column for each category: those given, or the union of what the files have, in name
    order (a driver step over the names of categories)."""
    rows = score_cells(files)
    if categories is None:
        categories = sorted(r[0] for r in rows.select(F.explode(F.map_keys("totals"))).distinct().collect())
    return rows.select(*[c for c in rows.columns if c != "totals"], *[F.try_element_at("totals", F.lit(c)).alias(f"DSS_tbl_{c}") for c in categories])


def score_table_summary(tables: DataFrame) -> DataFrame:
    """File count, id count, warnings, missing scores, and the ids that occur twice."""
    per = tables.groupBy("File_ID").agg(F.count("*").alias("n"), F.sum("DSS_tbl_warning_50").alias("w"), F.sum("DSS_tbl_score_is_na").alias("na"))
    return per.agg(F.sum("n").alias("files"), F.count_if(F.col("File_ID") != "").alias("ids"), F.sum("w").alias("warnings"), F.sum("na").alias("missing"), F.array_sort(F.collect_list(F.when((F.col("n") > 1) & (F.col("File_ID") != ""), F.col("File_ID")))).alias("duplicate_ids"))


def code_frequencies(files: DataFrame, kind: str = "codes") -> DataFrame:
    """(path, code, n) of frequency listings: ``N [* code]`` lines, or ``N 0word`` lines for ``omissions``.  Count and code
    are captured together, so that a repeated code adds up instead of taking another's count."""
    pat = r"^\s*(\d+)\s+\[\*\s*([^\]]+?)\s*\]" if kind == "codes" else r"^\s*(\d+)\s+(0\w+)"
    lines = files.select("path", F.explode(F.split("content", r"\r?\n")).alias("l")).where(F.col("l").rlike(pat))
    return lines.groupBy("path", F.regexp_extract("l", pat, 2).alias("code")).agg(F.sum(F.regexp_extract("l", pat, 1).cast("long")).alias("n"))


def wide_frequencies(freq: DataFrame, codes: list[str]) -> DataFrame:
    """File x code, 0 where a code does not occur; the codes are given, so that one job does and columns are stable."""
    return freq.groupBy("path").pivot("code", codes).agg(F.sum("n")).na.fill(0)


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a spreadsheet stored as XML: (row_no, cells array<string>), ``ss:Index`` gaps filled with empty cells."""
    cell = T.StructType([T.StructField("_ss:Index", T.IntegerType()), T.StructField("ss:Data", T.StringType()), T.StructField("Data", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", "Row").schema(T.StructType([T.StructField("Cell", T.ArrayType(cell)), T.StructField("ss:Cell", T.ArrayType(cell))])).load(path)
    raw = F.coalesce(F.col("Cell"), F.col("ss:Cell"), F.array().cast(T.ArrayType(cell)))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, c: Column) -> Column:
        at = F.coalesce(c["_ss:Index"] - 1, acc["next"])
        gap = F.array_repeat(F.lit(""), F.greatest(at - acc["next"], F.lit(0)))
        return F.struct((at + 1).alias("next"), F.concat(acc["out"], gap, F.array(F.coalesce(c["Data"], c["ss:Data"], F.lit("")))).alias("out"))

    return rows.select(F.monotonically_increasing_id().alias("row_no"), F.aggregate(raw, start, add, lambda a: a["out"]).alias("cells"))


def unique_names(header: list[str]) -> list[str]:
    """A second ``Group`` becomes ``Group_2``, a blank name ``Unnamed``."""
    seen: dict[str, int] = {}
    out = []
    for h in header:
        h = (h or "").strip() or "Unnamed"
        seen[h] = seen.get(h, 0) + 1
        out.append(h if seen[h] == 1 else f"{h}_{seen[h]}")
    return out


def with_header(rows: DataFrame) -> DataFrame:
    """First row as names; short rows are padded with empty cells; rows that are blank throughout, or a warning, go."""
    first = rows.orderBy("row_no").first()
    if first is None:
        return rows
    names = unique_names(first["cells"])
    body = rows.where(F.col("row_no") > first["row_no"]).where(F.exists("cells", lambda c: F.trim(c) != "") & ~F.exists("cells", lambda c: c.rlike("(?i)^\\s*warning")))
    return body.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns all of whose non-blank cells are numbers (one job for all)."""
    blank = lambda c: F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`")) == "")
    bad = df.agg(*[F.count_if(~blank(c) & F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if not bad[c]]


# The notes that the measuring program leaves in its tables.
WARNINGS = "IF YOU DID NOT MARK ERRORS|Please be sure to mark utterances"


def clean_measures(raw: DataFrame) -> DataFrame:
    """A measure table without notes and blank rows, columns of numbers only as numbers (one job finds them)."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    first = q(raw.columns[0]).cast("string")
    blank = reduce(lambda a, b: a & b, (F.trim(F.coalesce(q(c).cast("string"), F.lit(""))) == "" for c in raw.columns))
    rows = raw.where(~F.coalesce(first.rlike(WARNINGS), F.lit(False)) & ~blank)
    numbers = set(numeric_columns(rows))
    return rows.select(*[(number(q(c)) if c in numbers else q(c)).alias(c) for c in raw.columns])


def measure_quality(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows before and after cleaning, and the notes and blank rows that went."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    first = q(raw.columns[0]).cast("string")
    blank = reduce(lambda a, b: a & b, (F.trim(F.coalesce(q(c).cast("string"), F.lit(""))) == "" for c in raw.columns))
    before = raw.agg(F.count("*").alias("raw_rows"), F.count_if(F.coalesce(first.rlike(WARNINGS), F.lit(False))).alias("removed_warning_rows"), F.count_if(blank).alias("removed_blank_rows"))
    return before.crossJoin(clean.agg(F.count("*").alias("clean_rows")))  # one row each


def match_overlap(kideval: DataFrame, mlt: DataFrame, key: str = "File_ID") -> DataFrame:
    """Rows and repeated ids of both tables, and rows of the first whose id the second lacks."""
    twice = lambda d, n: d.groupBy(key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias(f"{n}_rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias(f"{n}_duplicate_file_id"))
    missing = kideval.join(mlt.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("merged_missing_mlt"))
    return twice(mlt, "mlt").crossJoin(twice(kideval, "kideval")).crossJoin(missing)  # one row each


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; types as given, else inferred."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record map<string,string>): the rows of a CSV as maps from column to text, missing cells empty."""
    rows = read_text_csv(spark, path)
    return rows.select(F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col("`" + c.replace("`", "``") + "`"))]).alias("record"))


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, missing cells empty."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').na.fill("")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value").where(F.col("r").isNotNull() & F.expr("exists(map_values(from_json(value, 'map<string,string>')), v -> v is not null)")).select("r.*")


def read_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object of story references as (story, fields)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{schema}>")).alias("story", "ref")).select("story", "ref.*")


def read_manifest(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    return require_columns(read_text_csv(spark, path), required)


def read_roster(spark: SparkSession, path: str, required: list[str], order: list[str]) -> DataFrame:
    """A roster or rule table with its columns checked, and ``ord``, its place in the stated order (numbers as numbers)."""
    rows = read_manifest(spark, path, [*required, *order])
    by = [F.struct(F.col(c).try_cast("double").alias("n"), F.col(c).alias("t")) for c in order]
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(*by)))  # a roster: one row a pair of children


def read_story_manifest(spark: SparkSession, path: str, required: list[str], story: str = "target_story") -> DataFrame:
    """A manifest with its columns checked, and ``ord``, the place of its story."""
    from ..operators.design import story_rank

    return read_manifest(spark, path, [*required, story]).withColumn("ord", story_rank(story))
