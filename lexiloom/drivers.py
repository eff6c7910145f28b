"""Whole chains from files to files, one function a command (``python -m lexiloom <command> ...``).

Tables are read from CSV with a header and written as folders of CSV parts; summaries are one-row folders of JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import number, safe_rate
from .functions.text import age_months, tokens
from .operators import annotation, audit, columns, design, language_model, learning, lines, norms, packages, retrieval, stats
from .operators.detectability import detectability_summary, told_apart
from .operators.evaluation import slice_report, text_metrics
from .operators.joins import prefer, suffix_join
from .sources import chat, clan, sinks
from .sources.files import write_files


def _table(spark: SparkSession, path: str) -> DataFrame:
    return clan.read_text_csv(spark, path)


def _files(spark: SparkSession, root: str, pattern: str = "*.cha") -> DataFrame:
    return chat.read_transcripts(spark, root, pattern)


def _write(out: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col("`" + c.replace("`", "``") + "`") for c, k in df.dtypes])
        sinks.write_csv(flat, f"{out}/{name}")


def _summary(out: str, df: DataFrame) -> None:
    sinks.summary_json(df).write.mode("overwrite").text(f"{out}/summary")


# ---------------------------------------------------------------- transcripts
def file_list(spark, root: str, out: str) -> None:
    sinks.file_list(_files(spark, root)).write.mode("overwrite").text(out)


EDITORS = {
    "normalize-initial-pauses": lines.normalise_pauses,
    "normalize-quote-terminators": lines.normalise_quote_ends,
    "repair-alignment": lines.repair_tiers,
    "promote-tiers": lines.promote_tiers,
    "insert-missing-tiers": lines.insert_missing_tiers,
    "strip-tiers": lines.strip_tiers,
    "add-gram-mark": lines.add_gram_mark,
    "remove-code": lines.remove_code,
}


#: These return every line at its place, some of them changed.
IN_PLACE = {"normalize-initial-pauses", "normalize-quote-terminators", "promote-tiers", "add-gram-mark", "remove-code"}


def edit(spark, editor: str, root: str, out: str, dry_run: bool = False) -> dict:
    """Runs a line editor over all transcripts: writes the changed files below ``out``, or with ``dry_run`` the number of lines
    that would change by file.  Editors that work in place return how many lines the rewrite has read and changed, which is
    counted as the files are written."""
    before = chat.lines_of(_files(spark, root))
    in_place = editor in IN_PLACE
    after = sinks.edited(before, EDITORS[editor]) if in_place else EDITORS[editor](before)
    if dry_run:
        _write(out, changed=sinks.changed_in_place(after) if in_place else sinks.changed_counts(before, after))
        return {}
    after, seen = sinks.watched(after) if in_place else (after, None)
    cells = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = after.groupBy("path").agg(F.concat(F.array_join(F.transform(cells, lambda c: c["line"]), "\n"), F.lit("\n")).alias("content"))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() else c for c in base) + "/*", "")
    write_files(text.select(F.concat(F.lit(out.rstrip("/") + "/"), relative).alias("path"), "content"))
    return seen.get if seen else {}


def route(spark, root: str, out: str, tier: str = "%mor:") -> None:
    """Copies the transcripts that have a tier, and those that lack it, to two folders."""
    for name, df in zip(("with", "without"), sinks.route_files(_files(spark, root), tier)):
        write_files(df.select(F.concat(F.lit(f"{out}/{name}/"), chat.file_name("path")).alias("path"), "content"))


def narratives(spark, root: str, out: str) -> None:
    _write(out, narratives=chat.narratives(_files(spark, root)))


def reference_template(spark, root: str, out: str) -> None:
    _write(out, references=sinks.reference_template(chat.narratives(_files(spark, root))))


def stories(spark, root: str, out: str) -> None:
    files = _files(spark, root)
    _write(out, stories=chat.stories(files).join(chat.identity(files), "path"))


def training_pairs(spark, root: str, out: str) -> None:
    pairs = chat.training_pairs(chat.lines_of(_files(spark, root)))
    sinks.write_json_lines(pairs.select("instruction", "input", "output"), out)


def stories_to_transcripts(spark, table: str, out: str) -> None:
    """Transcripts of generated stories (columns stage1_td_story and stage2_sli_story) and their manifest."""
    rows = _table(spark, table).withColumn("_none", F.lit(""))
    keys = [c for c in ("round_id", "bundle_id", "pair_id", "replicate_id", "target_story") if c in rows.columns]
    ages = {g: c if c in rows.columns else "_none" for g, c in (("TD", "td_age"), ("SLI", "sli_age"))}
    made = sinks.stories_to_transcripts(rows, keys, {"TD": "stage1_td_story", "SLI": "stage2_sli_story"}, ages, "_none")
    manifest = sinks.transcript_manifest(made, out)
    write_files(made.join(manifest.withColumnRenamed("group", "grp").select("bundle_id", "target_story", "grp", "output_path"), ["bundle_id", "target_story", "grp"]).select(F.col("output_path").alias("path"), "content"))
    _write(out, manifest=manifest)


# ---------------------------------------------------------------- measures
def score_tables(spark, root: str, out: str) -> None:
    tables = clan.score_tables(_files(spark, root, "*.tbl.cex"))
    _write(out, scores=tables)
    _summary(out, clan.score_table_summary(tables))


def clean_workbook(spark, path: str, out: str) -> None:
    raw = clan.with_header(clan.workbook_rows(spark, path))
    clean = clan.clean_measures(raw)
    if "File" in clean.columns:
        clean = clean.withColumn("File_ID", chat.file_id("File", rule="strip"))
    if "Age" in clean.columns:
        clean = clean.withColumn("Age_Month_approx", age_months("Age"))
    _write(out, measures=clean)
    _summary(out, clan.measure_quality(raw, clean))


def merge_scores(spark, master: str, scores: str, out: str, suffix: str = "Sample_Suffix") -> None:
    """The master table with the score columns; of several tables of one id the one whose transcript fits counts."""
    m, s = _table(spark, master), _table(spark, scores)
    m = m if suffix in m.columns else m.withColumn(suffix, F.lit(""))
    _write(out, master=suffix_join(m, s, "File_ID", "DSS_tbl_transcript", suffix, [c for c in s.columns if c.startswith("DSS_tbl_") and c not in m.columns], "DSS_tbl_transcript", "File_ID"))


def error_codes(spark, root: str, out: str) -> None:
    said = chat.lines_of(_files(spark, root)).where(F.col("line").startswith("*CHI:")).withColumn("File_ID", chat.file_id("path"))
    counts = annotation.code_counts(said, "File_ID", "line")
    _write(out, errors=annotation.error_table(said, "File_ID"), codes=counts, inventory=audit.most_common(counts.groupBy("code").agg(F.sum("n").alias("n")), "n", "code"))


def grouped_errors(spark, root: str, out: str) -> None:
    said = chat.lines_of(_files(spark, root)).where(F.col("line").startswith("*CHI:")).withColumn("File_ID", chat.file_id("path"))
    sizes = said.groupBy("File_ID").agg(F.count("*").alias("chi_utterances"))
    _write(out, grouped=annotation.grouped_errors(annotation.code_counts(said, "File_ID", "line"), sizes, "File_ID", "chi_utterances"))


def past_verbs(spark, root: str, out: str) -> None:
    l = chat.lines_of(_files(spark, root))
    said = l.where(F.col("line").startswith("*CHI:"))
    _write(out, past=annotation.past_verbs(chat.utterances(l), annotation.code_counts(said, "path", "line")).withColumn("File_ID", chat.file_id("path")))


def syntax(spark, root: str, out: str) -> None:
    _write(out, syntax=annotation.syntax_table(chat.utterances(chat.lines_of(_files(spark, root)))).withColumn("File_ID", chat.file_id("path")))


def replace_features(spark, master: str, features: str, out: str, key: str = "File_ID") -> None:
    """The master table with the columns of a feature table in place of its own (syntax, grouped errors, past verbs)."""
    _write(out, master=columns.replace_columns(_table(spark, master), _table(spark, features), key))


def error_rates(spark, master: str, out: str) -> None:
    """Errors by utterance and by word; nothing where there is no utterance or word."""
    m = _table(spark, master)
    rate = lambda c, per, n: safe_rate(number(F.col(c)), number(F.col(f"`{per}`"))).alias(f"{c}_per_{n}")
    by = [("Word_Errors", "#utterances", "utt"), ("retracing", "#utterances", "utt"), ("repetition", "#utterances", "utt"), *[(c, "#words", "word") for c in packages.GROUPED_RATES]]
    new = [rate(c, per, n) for c, per, n in by if c in m.columns and per in m.columns and f"{c}_per_{n}" not in m.columns]
    _write(out, master=m.select("*", *new))


def severity_features(spark, table: str, out: str, generated: bool = False) -> None:
    df = _table(spark, table)
    _write(out, features=columns.generated_severity_table(df) if generated else columns.severity_table(df))


def age_adjusted(spark, table: str, out: str) -> None:
    """Expected values and z by linear and spline norms of the control group, for the measures of the severity profile."""
    df = _table(spark, table)
    known = [c for c in (*norms.ABILITY, *norms.BURDEN) if c in df.columns]
    age, td = "_age", F.col("Group") == "TD"
    df = df.withColumn(age, number(F.col(f"`{packages.AGE}`")))
    _write(out, adjusted=norms.linear_norm(norms.spline_norm(df, known, age, td), known, age, td).drop(age))


def severity_profile(spark, table: str, out: str) -> None:
    df = _table(spark, table)
    profile = norms.severity_profile(df, [c for c in ("File_ID", "Group", packages.AGE) if c in df.columns])
    banded = norms.tertile_bands(profile, "severity_core_composite", F.col("Group") == "SLI").withColumnRenamed("band_reference", packages.BAND)
    _write(out, profile=banded.withColumn("profile_label", norms.profile_label(norms.LABELS)), bands=norms.band_counts(banded, packages.BAND))


def redundancy(spark, table: str, out: str, threshold: float = 0.95, cluster: float = 0.98, key: str = "File_ID") -> None:
    """The audit of a feature table: inventory, duplicates, correlations, clusters, recommendations, and a Markdown report."""
    df = clan.read_csv(spark, table)
    inventory = audit.column_inventory(df)
    numbers = [c for c, k in df.dtypes if k in ("int", "bigint", "double") and c != key]
    duplicates = audit.duplicate_columns(df, key, [c for c in df.columns if c != key])
    pairs = audit.pair_correlations(df, numbers)
    clusters = audit.correlation_clusters(pairs, cluster)
    excluded = audit.recommended_exclusions(inventory, duplicates)
    _write(out, inventory=inventory, duplicates=duplicates, pairs=audit.strongest_pairs(pairs, threshold), clusters=clusters, exclusions=excluded)
    report = sinks.audit_report(inventory, duplicates, pairs, clusters, excluded, threshold)
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")


def generated_measures(spark, stories_: str, kideval: str, mlt: str, scores: str, grouped: str, past: str, out: str) -> None:
    tables = [_table(spark, p) for p in (kideval, mlt, scores, grouped, past)]
    named = [df if "File_ID" in df.columns else df.withColumn("File_ID", chat.file_id("File", rule="strip")) for df in tables]
    dev = packages.generated_measures(*named, packages.bundle_metadata(_table(spark, stories_)))
    _write(out, measures=dev)
    _summary(out, packages.measures_summary(dev))


# ---------------------------------------------------------------- designs
def generation_package(spark, dev: str, severity: str, rules: str, out: str, replicates: int = 10, low: int = 48, high: int = 59, per_round: int | None = None) -> None:
    order = clan.read_manifest(spark, rules, ["target_story", "e1_story", "e2_story"]).withColumn("_row", F.monotonically_increasing_id())
    package = packages.generation_package(_table(spark, dev), _table(spark, severity), packages.read_order(order, "_row", ["target_story"]).drop("_row"), replicates, low, high, None, columns.KEEP[8:], per_round)
    _write(out, **package)
    _summary(out, packages.package_summary(package))


def generation_packages(spark, dev: str, severity: str, rules: str, out: str, replicates: int = 10, per_round: int = 3) -> None:
    """Rotating packages of all age bins, each in a folder of its cohort."""
    for label, low, high in packages.AGE_BINS:
        slug = spark.range(1).select(norms.cohort_slug(F.lit(label))).first()[0]
        generation_package(spark, dev, severity, rules, f"{out}/{slug}", replicates, low, high, per_round)


def frozen_roster(spark, dev: str, severity: str, out: str, low: int = 48, high: int = 59) -> None:
    _write(out, roster=packages.frozen_roster(packages.roster_frame(_table(spark, dev), _table(spark, severity), low, high), norms.cohort_label(low, high)))


def _tellers(spark, banded: str, root: str) -> DataFrame:
    """Children with strata and the stories they tell."""
    kids = _table(spark, banded).where(F.col("Group").isin(packages.GROUPS))
    told = chat.narratives(_files(spark, root)).select(chat.name_parts("path")["child_id"].alias("File_ID"), "story_id").groupBy("File_ID").agg(F.collect_set("story_id").alias("stories"))
    band = F.when(F.col("Group") == "TD", "typical").otherwise(F.coalesce(F.nullif(F.col(packages.BAND), F.lit("")), F.lit("unspecified")))
    label = F.when(F.col("Group") == "TD", "typical").otherwise(F.col("profile_label"))
    return kids.select("File_ID", F.col("Group").alias("grp"), norms.cohort(F.col(f"`{packages.AGE}`")).alias("cohort"), band.alias("band"), label.alias("label"), age_months(F.col("Age")).alias("age") if "Age" in kids.columns else number(F.col(f"`{packages.AGE}`")).alias("age")).join(told, "File_ID")


def story_design(spark, banded: str, rules: str, root: str, out: str, least_prompt: int = 2, least_eval: int = 3) -> None:
    kids, strata = _tellers(spark, banded, root), ["cohort", "grp", "band", "label"]
    prompt, evaluation = packages.story_pools(kids.select(*strata, F.col("File_ID").cast("long").alias("id"), "stories"), strata, "id", "stories")
    cells = packages.generation_cells(clan.read_manifest(spark, rules, ["target_story", "e1_story", "e2_story"]), prompt, evaluation, strata, "id", least_prompt, least_eval)
    _write(out, pools=prompt.withColumn("pool", F.lit("prompt")).unionByName(evaluation.withColumn("pool", F.lit("eval"))), cells=cells, manifest=design.config_ids(cells, ["target_story", *strata]))


def loocv_plan(spark, banded: str, root: str, references: str, out: str, cohort: str = "4-year-old") -> None:
    kids = _tellers(spark, banded, root).where(F.col("cohort") == cohort).select(F.col("File_ID").cast("long").alias("id"), "grp", "age", "band", "label", "stories")
    refs = clan.read_story_manifest(spark, references, ["e1_story", "e2_story", "target_td_age", "prompt_sli_age", "prompt_sli_severity_band", "prompt_sli_profile_label"])
    plan = packages.loocv_plan(kids, refs.select("target_story", "e1_story", "e2_story", age_months("target_td_age").alias("td_age"), age_months("prompt_sli_age").alias("sli_age"), F.col("prompt_sli_severity_band").alias("sli_band"), F.col("prompt_sli_profile_label").alias("sli_label")))
    _write(out, **plan)
    _summary(out, packages.plan_summary(plan))


# ---------------------------------------------------------------- evaluation
def bundle_evaluation(spark, generated: str, real: str, roster: str, out: str, per_round: int = 3) -> None:
    """Generated bundles against the real children of their round's evaluation pool: distances, nearest and margins."""
    g, r = _table(spark, generated), _table(spark, real)
    rounds = design.prompt_rounds(_table(spark, roster).withColumn("pair_order_n", number("pair_order")), per_round, ["pair_order_n"])
    pool = packages.matched_pool(design.eval_manifest(rounds), r).withColumnRenamed("Group", "comparison_target_group")
    features = audit.usable_features(pool, g, columns.KEEP[8:])
    q = g.withColumn("round_index", F.regexp_extract("round_id", r"(\d+)", 1).cast("int"))
    distances = retrieval.zscore_neighbours(q, pool, "comparison_target_group", "File_ID", "eval_child_id", features, also=["round_index"])
    _write(out, distances=distances, nearest=distances.where("rank = 1"))
    _summary(out, distances.where("rank = 1").agg(F.count("*").alias("rows"), F.percentile("rms_z", F.lit(0.5)).alias("median_best_rms_z")))


def _told(spark, root: str, grp: str | None = None, years: int | None = None) -> DataFrame:
    """Stories of transcripts with group, story, source child and cleaned text."""
    files = _files(spark, root)
    known = chat.headers(files)
    known = known if years is None else known.where(chat.age_year("age") == years)
    known = known if grp is None else known.where(F.col("grp") == grp)
    return chat.narratives(files).join(known.select("path", "grp", "comments"), "path").select(F.concat_ws("#", "path", "story_id").alias("id"), "grp", "story_id", F.lower("story_text").alias("text"), "tokens")


def text_evaluation(spark, synthetic: str, real: str, out: str, years: int = 4) -> None:
    """Metrics of every generated and real story, the report by slice, and how well the two can be told apart."""
    s, r = _told(spark, synthetic), _told(spark, real, None, years)
    got, base = text_metrics(r, s, ["grp", "story_id"], "id", "text", "tokens")
    both = r.select("id", "grp", "story_id", "text", F.lit(0).alias("y")).unionByName(s.select("id", "grp", "story_id", "text", F.lit(1).alias("y"))).withColumn("grams", retrieval.word_char_ngrams(F.col("text")))
    p = told_apart(both, "id", "grams", "y", strata=["grp", "story_id"], text="text")
    tables = {} if p is None else {"detectability_predictions": p}
    _write(out, synthetic=got, real=base, report=slice_report(got, base), detectability=detectability_summary(p, "y", spark), **tables)


def _bundles(spark, root: str, grp: str, years: int | None, names: str) -> DataFrame:
    return chat.bundles(_files(spark, root), grp=grp, years=years, names=names)


def _pools(spark, synthetic: str, real: str, group: str, years: int, exclude: bool) -> tuple[DataFrame, DataFrame]:
    s = _bundles(spark, synthetic, group, None, chat.GENERATED)
    r = _bundles(spark, real, group, years, r"^\d{3}\.cha$").withColumn("child", chat.file_id("path"))
    if exclude:
        used = s.select(F.explode(F.array(chat.name_parts("path")["sli_child_id"], chat.name_parts("path")["td_child_id"])).alias("child")).distinct()
        r = r.join(used, "child", "left_anti")
    return s, r


def _compare(both: DataFrame, value: str, out: str, reps: int = 10_000) -> None:
    synthetic = F.col("source") == "synthetic"
    test = stats.mann_whitney(both, value, synthetic)
    interval = stats.bootstrap(both, value, synthetic, reps)
    _write(out, scores=both, distribution=stats.describe(both, value, ["source"]))
    _summary(out, test.crossJoin(interval))  # one row each


def text_perplexity(spark, synthetic: str, real: str, out: str, group: str = "TD", years: int = 4, folds: int = 5, order: int = 3, alpha: float = 0.5, seed: int = 0, exclude: bool = False) -> None:
    """Perplexity of whole bundles under models of the real ones: real ones by held-out folds, generated ones under every fold."""
    s, r = _pools(spark, synthetic, real, group, years, exclude)
    of = language_model.numpy_folds(sorted(x[0] for x in r.select("path").collect()), folds, seed)  # names only
    fold = spark.createDataFrame(list(of.items()), "path string, fold int")
    both = r.select("path", "utterance_tokens").join(F.broadcast(fold), "path").withColumn("real", F.lit(True)).unionByName(s.select("path", "utterance_tokens").withColumn("fold", F.lit(None).cast("int")).withColumn("real", F.lit(False)))  # one row a bundle
    got = language_model.fold_perplexity(both, "path", "fold", order, alpha=alpha, every_fold=~F.col("real"))
    mean = got.groupBy("path").agg(F.avg("perplexity").alias("perplexity"), F.max("token_count").alias("token_count"), F.count("*").alias("folds"))
    _compare(mean.join(both.select("path", F.when(F.col("real"), "real").otherwise("synthetic").alias("source")), "path"), "perplexity", out)


def text_semantics(spark, synthetic: str, real: str, out: str, encoder: str, group: str = "TD", years: int = 4, exclude: bool = False, reps: int = 10_000) -> None:
    """Nearness of whole bundles to the real ones by a registered encoder: nearest, mean and centroid."""
    s, r = _pools(spark, synthetic, real, group, years, exclude)
    text = F.array_join(F.flatten("utterance_tokens"), " ")
    enc = lambda d: learning.encode(d.select("path", text.alias("text")), "path", "text", encoder)
    es, er = enc(s), enc(r)
    sides = [(es, "synthetic"), (er, "real")]
    both = None
    for e, name in sides:
        part = retrieval.embedding_neighbours(e, er, "path", "path", "embedding").withColumn("source", F.lit(name))
        both = part if both is None else both.unionByName(part)
    _compare(both.withColumnRenamed("query_id", "path"), "nearest", out, reps)


def score_stories(spark, table: str, references: str, out: str, scorer: str = "unit-r-precision") -> None:
    """Scores of narratives against their story's reference by a scorer's name, ``module:function`` or ``file.py:function``, on two
    arrays of units; a narrative without units, or whose story has none, has no score."""
    rows = _table(spark, table).withColumn("units", F.from_json("story_units_json", "array<string>"))
    refs = clan.read_reference(spark, references, "struct<units:array<string>>").select(F.col("story").alias("story_id"), F.col("units").alias("wanted"))
    keyed = rows.join(refs, "story_id", "left").withColumn("_key", F.concat_ws("#", "path", "story_id"))
    _write(out, scores=learning.score_with(keyed, "_key", ["units", "wanted"], scorer))


def show(spark, table: str, limit: int = 100) -> None:
    """Prints the first rows of a table (a roster, a manifest, a counterbalance)."""
    print(sinks.markdown(_table(spark, table), limit))


def validate_layout(spark, root: str, folders: str) -> list[str]:
    """Prints which of the folders or files (comma-separated, below ``root``) are there, and returns those that are missing."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {name: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base, name)) for name in folders.split(",")}
    print("\n".join(f"{'ok' if found else 'missing'}\t{name}" for name, found in there.items()))
    return [name for name, found in there.items() if not found]


def preferred(spark, table: str, out: str, keys: str, column: str) -> None:
    """One row per key (comma-separated columns): rows with the column first, then the largest."""
    df = _table(spark, table)
    _write(out, rows=prefer(df, keys.split(","), F.col(column) != "", column))


def token_table(spark, table: str, out: str, text: str = "text") -> None:
    df = _table(spark, table)
    _write(out, tokens=df.withColumn("n_tokens", F.size(tokens(text))))
