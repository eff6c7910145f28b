"""Transcripts as DataFrames: files -> lines -> speaker blocks -> utterances, stories and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import age_year, clean, is_fragment, normal_id, tokens

LINE_ENDS = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def read_transcripts(spark: SparkSession, root: str, pattern: str = "*.cha") -> DataFrame:
    """(path, content), one row a file; any depth."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no, line); the empty piece after a final line end is no line."""
    parts = F.split(F.regexp_replace("content", f"(?:{LINE_ENDS})$", ""), LINE_ENDS)
    return files.select("path", F.posexplode(parts).alias("line_no", "line"))


def blocks_of(lines: DataFrame) -> DataFrame:
    """Lines with ``block_id`` (counted speaker lines so far; header lines close a block) and ``in_block``."""
    w = Window.partitionBy("path").orderBy("line_no")
    opens, closes = F.col("line").startswith("*"), F.col("line").startswith("@")
    edge = F.when(opens, F.lit(1)).when(closes, F.lit(0))
    return lines.withColumn("block_id", F.sum(opens.cast("int")).over(w)).withColumn("in_block", F.last(edge, ignorenulls=True).over(w) == 1)


def utterances(lines: DataFrame) -> DataFrame:
    """(path, block_id, first_line, speaker, text, tiers map) per speaker block; the last of equal tiers counts."""
    b = blocks_of(lines).where("in_block")
    head = F.col("line").startswith("*")
    tier = F.regexp_extract("line", r"^(%\w+):", 1)
    body = F.regexp_extract("line", r"^[%*][^:]*:\t?(.*)$", 1)
    cell = F.struct("line_no", tier.alias("tier"), body.alias("body"))
    found = b.groupBy("path", "block_id").agg(
        F.min("line_no").alias("first_line"),
        F.max(F.when(head, F.regexp_extract("line", r"^\*([^:]+):", 1))).alias("speaker"),
        F.max(F.when(head, body)).alias("text"),
        F.array_sort(F.collect_list(F.when(tier != "", cell))).alias("cells"),
    )
    names = F.array_distinct(F.transform("cells", lambda c: c["tier"]))
    last = lambda n: F.element_at(F.filter("cells", lambda c: c["tier"] == n), -1)["body"]
    return found.withColumn("tiers", F.map_from_arrays(names, F.transform(names, last))).drop("cells")


def story_lines(lines: DataFrame) -> DataFrame:
    """Lines with the story they belong to: the last ``@G:`` mark so far in the file."""
    w = Window.partitionBy("path").orderBy("line_no")
    mark = F.nullif(F.regexp_extract("line", r"^@G:\s+(\S+)\s*$", 1), F.lit(""))
    return lines.withColumn("story_id", F.last(mark, ignorenulls=True).over(w))


def headers(files: DataFrame) -> DataFrame:
    """(path, age, sex, grp, comments map) from the target child's ``@ID`` and the ``@Comment: k=v`` lines."""
    pat = r"(?m)^@ID:\s+eng\|[^|]+\|CHI\|([^|]*)\|([^|]*)\|([^|]*)\|"
    pairs = F.regexp_extract_all("content", F.lit(r"(?m)^@Comment:\t([^=\n]+=[^\n]*)$"), F.lit(1))
    keys = F.array_distinct(F.transform(pairs, lambda p: F.trim(F.split(p, "=", 2)[0])))
    value = lambda k: F.trim(F.split(F.element_at(F.filter(pairs, lambda p: F.trim(F.split(p, "=", 2)[0]) == k), -1), "=", 2)[1])
    return files.select("path", *[F.regexp_extract("content", pat, i).alias(n) for i, n in ((1, "age"), (2, "sex"), (3, "grp"))], F.map_from_arrays(keys, F.transform(keys, value)).alias("comments"))


def identity(files: DataFrame) -> DataFrame:
    """(path, corpus, speaker, age, diagnosis) from the fields of the last target-child ``@ID``; the diagnosis is its sixth field, or
    ``DLD/SLI`` where that is empty and the ``@Types`` line names one of them."""
    ids = F.regexp_extract_all("content", F.lit(r"(?m)^@ID[^\n]*$"), F.lit(0))
    cells = F.filter(F.transform(ids, lambda l: F.split(l, r"\|")), lambda c: F.get(c, F.lit(2)) == "CHI")
    f = F.try_element_at(cells, F.lit(-1))
    given = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(F.get(c, F.lit(5)), F.lit("")))), lambda x: x != "")
    typed = F.col("content").rlike(r"(?m)^@Types.*(?:SLI|DLD|LI)")
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    corpus = F.regexp_replace(F.get(f, F.lit(1)), r"^@ID:\s*", "")
    return files.select("path", known(corpus).alias("corpus"), known(F.get(f, F.lit(2))).alias("speaker"), known(F.get(f, F.lit(3))).alias("age"), F.coalesce(F.try_element_at(given, F.lit(-1)), F.when(typed, "DLD/SLI"), F.lit("Unknown")).alias("diagnosis"))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_id(path: Column | str, suffix: str = r"\.cha$", rule: str = "digits") -> Column:
    """The id in a file's name.  ``digits``: the digits before the suffix, else the stem; ``number``: the digits before the suffix,
    else empty; ``strip``: the name without ``.cha``, ``.tbl.cex`` or ``.dss.cex``; ``stem``: the name without its last suffix;
    ``first``: the name up to its first dot."""
    name = file_name(path)
    digits = F.regexp_extract(name, r"(\d+)" + suffix, 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    rules = {"digits": F.when(digits != "", digits).otherwise(stem), "number": digits, "strip": F.regexp_replace(name, r"(?:\.cha|\.tbl\.cex|\.dss\.cex)$", ""), "stem": stem, "first": F.substring_index(name, ".", 1)}
    return rules[rule]


# The names of generated and real files.
GENERATED = r"pair_sli(\d+)_td(\d+)_rep(\d+)_(?:([AB]\d)_(TD|SLI)|(TD|SLI)_bundle)\.cha$"
REAL = r"(\d+)(?:_([AB]\d))?\.cha$"


def name_parts(path: Column | str) -> Column:
    """A struct of what a file's name tells: the children it was generated for, replicate, story and group, or the child of a real
    one; empty where it does not."""
    name = file_name(path)
    g = lambda i: F.regexp_extract(name, GENERATED, i)
    r = lambda i: F.when(g(1) == "", F.regexp_extract(name, REAL, i)).otherwise("")
    return F.struct(g(1).alias("sli_child_id"), g(2).alias("td_child_id"), g(3).alias("replicate_id"), F.concat(g(4), r(2)).alias("story_id"), F.concat(g(5), g(6)).alias("grp"), r(1).alias("child_id"))


def path_index(files: DataFrame) -> DataFrame:
    """(grp, child, story or '', path): the last path in order for each key."""
    grp = F.when(F.col("path").rlike("(?i)/SLI/|/B/"), "SLI").when(F.col("path").rlike("(?i)/TD/|/A/"), "TD")
    child = F.regexp_extract("path", r"(\d+)(?:_([AB]\d))?\.cha$", 1)
    story = F.regexp_extract("path", r"(\d+)(?:_([AB]\d))?\.cha$", 2)
    return files.select(grp.alias("grp"), normal_id(child).alias("child"), story.alias("story"), "path").where("child <> ''").groupBy("grp", "child", "story").agg(F.max("path").alias("path"))


def narratives(files: DataFrame, speaker: str = "CHI", least: int = 1) -> DataFrame:
    """One row per (file, story): ordered cleaned utterances, their text, tokens and type-token ratio."""
    told = story_lines(lines_of(files)).where(F.col("story_id").isNotNull() & F.col("line").startswith(f"*{speaker}:\t"))
    said = told.select("path", "story_id", "line_no", clean(F.regexp_extract("line", r"^\*[^:]+:\t(.*)$", 1)).alias("u")).where("u <> ''")
    out = said.groupBy("path", "story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "u"))), lambda c: c["u"]).alias("units")).where(F.size("units") >= least)
    out = out.withColumn("story_text", F.array_join("units", " ")).withColumn("tokens", tokens("story_text", r"[A-Za-z0-9']+", digits=False))
    return out.withColumn("story_unit_count", F.size("units")).withColumn("story_units_json", F.to_json("units"))


def stories(files: DataFrame, speaker: str = "CHI", least: int = 3) -> DataFrame:
    """(path, story_id, transcript): the cleaned words of each gem (``General`` before the first) that has ``least`` utterances."""
    w = Window.partitionBy("path").orderBy("line_no")
    gem = F.when(F.col("line").startswith("@G:"), F.trim(F.regexp_replace("line", "@G:", "")))
    lines = lines_of(files).withColumn("gem", F.coalesce(F.last(gem, ignorenulls=True).over(w), F.lit("General"))).withColumn("nth", F.count(gem).over(w))
    said = lines.where(F.col("line").startswith(f"*{speaker}:")).select("path", "nth", "gem", "line_no", F.trim(F.regexp_replace(clean("line", "embedding"), r"\s+", " ")).alias("u")).where("u <> ''")
    out = said.groupBy("path", "nth", "gem").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "u"))), lambda c: c["u"]).alias("us")).where(F.size("us") >= least)
    return out.select("path", F.col("gem").alias("story_id"), F.array_join("us", " ").alias("transcript"))


def training_pairs(lines: DataFrame, instruction: str = "Annotate the following sentence with CLAN error codes.") -> DataFrame:
    """(path, line_no, instruction, input, output): speaker lines without and with their annotation; fragments and empty lines are
    left out."""
    said = lines.where(F.col("line").startswith("*"))
    pairs = said.select("path", "line_no", F.lit(instruction).alias("instruction"), clean("line", "raw_pair").alias("input"), clean("line", "annotated_pair").alias("output"))
    return pairs.where(~is_fragment("input") & (F.col("input") != ""))


def bundles(files: DataFrame, speaker: str = "CHI", grp: str | None = None, years: int | None = None, names: str | None = None) -> DataFrame:
    """One row per file: its utterances as arrays of spoken tokens, in order, and its header; files without any are left out, and
    so are those of another group, age in years, or (by a pattern) name."""
    known = headers(files)
    if grp is not None:
        known = known.where(F.col("grp") == grp)
    if years is not None:
        known = known.where(age_year("age") == years)
    if names is not None:
        known = known.where(file_name("path").rlike(names))
    said = lines_of(files).where(F.col("line").startswith(f"*{speaker}:\t")).select("path", "line_no", tokens(clean(F.regexp_extract("line", r"^\*[^:]+:\t(.*)$", 1), "spoken")).alias("t")).where(F.size("t") > 0)
    return said.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda c: c["t"]).alias("utterance_tokens")).join(known, "path")
