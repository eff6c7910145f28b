"""Writers: tables, summaries, reports, transcripts, appended unique rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def summary_json(df: DataFrame) -> DataFrame:
    """One row a record as JSON with keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def split_by(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition and the rest (routed outputs)."""
    return df.where(condition), df.where(~F.coalesce(condition, F.lit(False)))


def files_without(lines: DataFrame, tier: str) -> DataFrame:
    """Paths of files that have no line of a tier."""
    return lines.groupBy("path").agg(F.max(F.col("line").startswith(tier)).alias("has")).where("not has").select("path")


def file_list(files: DataFrame) -> DataFrame:
    return files.select("path").orderBy("path")


def new_rows(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not there yet, each once: what an append of unique rows writes."""
    return df.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def transcript_text(df: DataFrame, header: list[str], utterances: str = "lines", speaker: str = "CHI") -> DataFrame:
    """A transcript as one text per row: header lines, speaker lines, end mark."""
    said = F.transform(utterances, lambda u: F.concat(F.lit(f"*{speaker}:\t"), u))
    return df.withColumn("content", F.concat(F.array_join(F.concat(F.array(*[F.lit(h) for h in header]), said, F.array(F.lit("@End"))), "\n"), F.lit("\n")))


def changed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a rewrite would change, by file: lines that differ (the dry run of an editor that adds or drops lines)."""
    a, b = before.select("path", "line_no", F.col("line").alias("old")), after.select("path", "line_no", F.col("line").alias("new"))
    return a.join(b, ["path", "line_no"], "full").where("not (old <=> new)").groupBy("path").agg(F.count("*").alias("changed"))


#: The line as it was, which goes along with the line that an editor returns.
WAS = "_was"


def edited(lines: DataFrame, editor) -> DataFrame:
    """The lines that an editor returns, each with the line it was: for editors that change lines where they are."""
    return editor(lines.withColumn(WAS, F.col("line")))


def changed_in_place(after: DataFrame) -> DataFrame:
    """By file, how many of the ``edited`` lines have changed: one pass, no join."""
    return after.where(~F.col("line").eqNullSafe(F.col(WAS))).groupBy("path").agg(F.count("*").alias("changed"))


def watched(after: DataFrame, name: str = "edit") -> tuple[DataFrame, Observation]:
    """``edited`` lines without the lines they were, and an observation that counts (lines, changed) as whatever reads them runs:
    a rewrite and its counts are one scan."""
    seen = Observation(name)
    out = after.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("line").eqNullSafe(F.col(WAS))).alias("changed"))
    return out.drop(WAS), seen


def cell(value: Column) -> Column:
    """A number as a report shows it: four places, ``NA`` for none."""
    return F.when(value.isNotNull(), F.format_string("%.4f", value)).otherwise("NA")


def markdown(df: DataFrame, most: int = 12) -> str:
    """The first rows of an ordered result as a table (a report of at most ``most`` rows)."""
    rows = df.limit(most).collect()
    cell = lambda v: "NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


# The columns that tell where a transcript comes from.
MANIFEST = ["round_id", "bundle_id", "pair_id", "replicate_id", "target_story", "stage", "group", "source_child_id", "age", "output_path"]


def transcript_manifest(transcripts: DataFrame, folder: str) -> DataFrame:
    """One row a transcript: where it comes from (empty where a column is missing) and the file it goes to."""
    name = F.concat_ws("_", "bundle_id", "target_story", F.concat(F.col("grp"), F.lit(".cha")))
    stage = F.when(F.col("grp") == "TD", "stage1_td").otherwise("stage2_sli")
    out = transcripts.withColumn("stage", stage).withColumn("group", F.col("grp")).withColumn("output_path", F.concat_ws("/", F.lit(folder), stage, name))
    return out.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in out.columns else F.lit("")).alias(c) for c in MANIFEST])


def write_json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; columns without a value are left out."""
    df.write.mode("overwrite").json(path)


def text_lines(df: DataFrame, column: str) -> DataFrame:
    """(text): a column's trimmed texts, as rows for JSON lines."""
    return df.select(F.trim(F.coalesce(F.col(column), F.lit(""))).alias("text"))


def audit_report(inventory: DataFrame, duplicates: DataFrame, pairs: DataFrame, clusters: DataFrame, excluded: DataFrame, threshold: float = 0.95, most: int = 12) -> str:
    """A Markdown report on redundant columns: counts, the strongest pairs (at most ``most``), clusters and recommendations.  All
    its tables have one row a column of the schema, or a pair of them."""
    from ..operators.audit import strongest_pairs

    n, numbers, constant, ids = inventory.agg(F.count("*"), F.count_if(~F.col("dtype").isin("string", "boolean")), F.sum("is_constant"), F.sum("is_id_like")).first()
    strong = strongest_pairs(pairs, threshold)
    grouped = clusters.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ", ").alias("columns")).orderBy("cluster")
    parts = [
        "# Feature redundancy",
        f"- Columns: {n}, of numbers: {numbers}\n- Constant: {constant or 0}\n- Like an id: {ids or 0}\n- Duplicates: {duplicates.count()}\n- Pairs with |r| >= {threshold}: {strong.count()}\n- Clusters: {grouped.count()}",
        "## Duplicate columns",
        markdown(duplicates.orderBy("first_column", "column_name"), most),
        "## Strongest pairs",
        markdown(strong.select("column_a", "column_b", "n", "pearson"), most),
        "## Clusters",
        markdown(grouped, most),
        "## Recommended exclusions",
        markdown(excluded.orderBy("column_name"), most),
    ]
    return "\n\n".join(parts) + "\n"


def route_files(files: DataFrame, tier: str = "%mor:") -> tuple[DataFrame, DataFrame]:
    """(files that have a line of the tier, files that lack it): what stays and what is moved aside."""
    pattern = r"(?m)^" + "".join("\\" + c if not c.isalnum() else c for c in tier)
    return split_by(files, F.col("content").rlike(pattern))


def stories_to_transcripts(stories: DataFrame, keys: list[str], text_columns: dict[str, str], age: str | dict[str, str], sex: str) -> DataFrame:
    """(keys, grp, content): one transcript for each text column of a row, e.g. a control and a target story; ``text_columns``
    maps a group to its column, and so may ``age``.  Texts without words give no transcript."""
    from ..operators.quotes import utterances

    ages = age if isinstance(age, dict) else dict.fromkeys(text_columns, age)
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(c).alias("text"), F.col(ages[g]).alias("_age")) for g, c in text_columns.items()]))
    rows = stories.select(*keys, F.col(sex).alias("_sex"), each.alias("e")).select(*keys, "e._age", "_sex", "e.grp", utterances("e.text").alias("u")).where(F.size("u") > 0)
    who = F.concat(F.lit("@ID:\teng|Generated|CHI|"), F.coalesce("_age", F.lit("")), F.lit("|"), F.coalesce("_sex", F.lit("")), F.lit("|"), F.col("grp"), F.lit("||Target_Child|||"))
    said = F.transform("u", lambda x: F.concat(F.lit("*CHI:\t"), x))
    head = F.array(F.lit("@UTF8"), F.lit("@Begin"), F.lit("@Languages:\teng"), F.lit("@Participants:\tCHI Target_Child"), who)
    return rows.select(*keys, "grp", F.concat(F.array_join(F.concat(head, said, F.array(F.lit("@End"))), "\n"), F.lit("\n")).alias("content"))


def reference_template(narratives: DataFrame) -> DataFrame:
    """One empty reference per story, as JSON."""
    empty = F.array().cast("array<string>")
    ref = F.struct(F.col("story_id"), F.lit("").alias("title"), empty.alias("units"), empty.alias("content_invariants"), empty.alias("optional_content"), F.lit("").alias("notes"))
    return narratives.select("story_id").distinct().select("story_id", F.to_json(ref).alias("reference"))


def transform_json_field(rows: DataFrame, column: str, schema: str, field: str, change) -> DataFrame:
    """JSON lines with one field changed by a column function; lines without it, or that do not parse, stay as they are."""
    parsed = F.from_json(column, schema)
    return rows.withColumn(column, F.when(parsed[field].isNotNull(), F.to_json(parsed.withField(field, change(parsed[field])))).otherwise(F.col(column)))
