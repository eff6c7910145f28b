"""Whole designs: rosters, bundle templates, generation packages, prompt and evaluation pools, leave-one-out plans, measures of
generated bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import checked_join, number, require_columns
from ..functions.text import normal_id
from .design import STORIES, balanced_stories, bundle_index, candidate_cells, eval_manifest, greedy_match, optimal_match, prompt_rounds, story_rank, story_schedule, template
from .norms import LABELS, cohort_label, profile_label

# Columns of the measure and severity tables, and bins of ages in months.
AGE, AGE_APPROX = "Age(Month)", "Age_Month_approx"
BAND = "severity_band_sli_tertile_sli_only"
SEVERITY = ["severity_core_composite", "severity_domain_composite", "severity_structural", "severity_lexical", "severity_disruption", "severity_morphosyntax_burden"]
GROUPS = ["SLI", "TD"]
AGE_BINS = [("5-year-old", 60, 71), ("6-year-old", 72, 83), ("7-year-old", 84, 95), ("8-year-old", 96, 107), ("9-year-old", 108, 119)]

# What of the error and past-verb tables goes into the measures of bundles, and what a row may lack.
ERROR_COLUMNS = [
    "chi_utterances_with_error_code",
    "error_total_annotations",
    "bare_marking_errors",
    "bare_marking_errors_per_utt",
    "determiner_errors",
    "determiner_errors_per_utt",
    "pronoun_errors",
    "pronoun_errors_per_utt",
    "rule_generalization_errors",
    "rule_generalization_errors_per_utt",
]
PAST_COLUMNS = ["overt_past_finite_verbs", "bare_past_error_tokens", "past_verb_opportunities", "past_overgeneralization_errors", "past_overgeneralization_errors_per_past_opp"]
BUNDLE_COLUMNS = [
    "bundle_id",
    "pair_id",
    "round_id",
    "replicate_id",
    "source",
    "stage",
    "comparison_target_group",
    "evaluation_pool_policy",
    "prompt_exclusion_policy",
    "source_child_id",
    "prompt_td_child_id",
    "prompt_sli_child_id",
    "td_child_id",
    "sli_child_id",
    "sli_age_generated_from",
    "sli_severity_band_generated_from",
    "sli_profile_label_generated_from",
    "story_slots",
    "n_stories",
]
GROUPED_RATES = ["bare_marking_errors", "determiner_errors", "pronoun_errors", "rule_generalization_errors"]


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# ---------------------------------------------------------------- rosters
def roster_frame(dev: DataFrame, severity: DataFrame, low: int, high: int) -> DataFrame:
    """Children of both groups in the age bin that both tables hold, one row a child, with severity columns and profile label
    (``typical`` for the control group); rows without an approximate age are left out."""
    inside = lambda d: d.where(F.col("Group").isin(GROUPS) & number(_c(AGE)).between(low, high))
    sev = inside(severity).select("File_ID", "Group", BAND, *SEVERITY)
    out = checked_join(inside(dev).drop(BAND, *SEVERITY), sev, ["File_ID", "Group"], "inner", "one_to_one")
    out = out.withColumn("age_months_approx", number(_c(AGE_APPROX))).where("age_months_approx is not null")
    return out.withColumn("profile_label", F.when(F.col("Group") == "TD", "typical").otherwise(profile_label(LABELS)))


def frozen_roster(roster: DataFrame, cohort: str) -> DataFrame:
    """Each SLI child with a TD child of its own, so that the age gaps add up to the least: pairs in age order, with both sides'
    columns."""
    children = roster.select(F.lit(cohort).alias("cohort"), F.col("File_ID").cast("long").alias("id"), F.col("age_months_approx").alias("age"), (F.col("Group") == "SLI").alias("target"))
    pairs = optimal_match(children, "cohort", "id", "age", "target")
    side = lambda g, p: roster.where(F.col("Group") == g).select(F.col("File_ID").cast("long").alias(f"{p}_child_id"), F.col("File_kideval").alias(f"{p}_file_kideval"), F.col("Age").alias(f"{p}_age"), F.col("age_months_approx").alias(f"{p}_age_months_approx"), F.col(BAND).alias(f"{p}_severity_band"), F.col("profile_label").alias(f"{p}_profile_label"))
    out = pairs.select("cohort", F.col("target_id").alias("sli_child_id"), F.col("control_id").alias("td_child_id"), F.bround("gap", 3).alias("age_gap_months"))
    out = out.join(side("SLI", "sli"), "sli_child_id").join(side("TD", "td").drop("td_severity_band", "td_profile_label"), "td_child_id")
    order = Window.orderBy("sli_age_months_approx", "sli_child_id")  # one row a pair of children of one cohort
    out = out.withColumn("pair_order", F.row_number().over(order)).withColumn("pair_id", F.format_string("pair_sli%d_td%d", "sli_child_id", "td_child_id"))
    rounded = {f"{p}_age_months_approx": F.bround(f"{p}_age_months_approx", 3) for p in ("sli", "td")}
    return out.withColumns(rounded).select("pair_order", "pair_id", "cohort", "sli_child_id", "sli_file_kideval", "sli_age", "sli_age_months_approx", "sli_severity_band", "sli_profile_label", "td_child_id", "td_file_kideval", "td_age", "td_age_months_approx", "age_gap_months")


def read_order(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """``variant_index`` from 0 within the keys, in the order of a stated column (rows of a rule table in file order)."""
    return df.withColumn("variant_index", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


# ---------------------------------------------------------------- bundles and packages
def real_bundle_template(roster: DataFrame, features: list[str] | None = None) -> DataFrame:
    """One row a real child in the layout of generated bundles: the columns of its own group filled, those of the other empty."""
    sli, td = F.col("Group") == "SLI", F.col("Group") == "TD"
    name, none = F.col("File_ID").cast("long").cast("string"), F.lit("")
    only = lambda g, v: F.when(g, v).otherwise(none)
    slots = F.lit("|".join(STORIES))
    cols = {
        "bundle_id": F.concat(F.lit("real_"), name),
        "source": F.lit("real"),
        "group": F.col("Group"),
        "cohort": F.concat(F.floor(number(_c(AGE)) / 12).cast("string"), F.lit("-year-old")),
        "age": F.col("Age"),
        "age_months_approx": F.col("age_months_approx"),
        "cluster_id": name,
        "pair_id": none,
        "replicate_id": none,
        "sli_child_id": only(sli, name),
        "sli_file_kideval": only(sli, F.col("File_kideval")),
        "sli_age": only(sli, F.col("Age")),
        "sli_age_months_approx": F.when(sli, F.col("age_months_approx")),
        "sli_severity_band": F.when(sli, F.col(BAND)).otherwise("typical"),
        "sli_profile_label": F.when(sli, F.col("profile_label")).otherwise("typical"),
        "td_child_id": only(td, name),
        "td_file_kideval": only(td, F.col("File_kideval")),
        "td_age": only(td, F.col("Age")),
        "td_age_months_approx": F.when(td, F.col("age_months_approx")),
        "age_gap_months": F.lit(None).cast("double"),
        "n_stories": F.lit(len(STORIES)),
        "story_slots": slots,
        "target_story_order": slots,
        "prompt_td_child_id": none,
        "prompt_sli_child_id": none,
    }
    out = roster.select(*[v.alias(k) for k, v in cols.items()], *SEVERITY)
    return template(out, out.columns, [f for f in features or [] if f not in out.columns])


def generation_package(dev: DataFrame, severity: DataFrame, rules: DataFrame, replicates: int = 10, low: int = 48, high: int = 59, cohort: str | None = None, features: list[str] | None = None, per_round: int | None = None) -> dict[str, DataFrame]:
    """The tables of a generation run: roster, schedule (pair x replicate x story), bundle index, templates of generated and, in a
    single package, real bundles; with ``per_round`` also prompt rounds and the evaluation manifest of the rotating design."""
    children = roster_frame(dev, severity, low, high)
    roster = frozen_roster(children, cohort or cohort_label(low, high))
    rounds = prompt_rounds(roster, per_round, ["pair_order"]) if per_round else roster
    schedule = story_schedule(rounds, rules, replicates)
    parts = [F.col("pair_id"), F.format_string("rep%02d", "replicate_id"), *([F.format_string("round%02d", "round_index")] if per_round else [])]
    schedule = schedule.withColumn("bundle_id", F.concat_ws("_", *parts))
    key = ["bundle_id", "pair_id", "replicate_id", *(["round_index"] if per_round else [])]
    index = bundle_index(schedule, key)
    out = {"roster": roster, "schedule": schedule, "bundle_index": index, "synthetic_template": template(index, index.columns, features or [])}
    if per_round:
        return out | {"prompt_rounds": rounds, "eval_manifest": eval_manifest(rounds)}
    return out | {"real_template": real_bundle_template(children, features)}


def package_summary(package: dict[str, DataFrame]) -> DataFrame:
    """Counts of a package: pairs, bundles, story rows, and rounds and evaluation rows where it has them."""
    one = lambda d, **c: d.agg(*[v.alias(k) for k, v in c.items()])
    out = one(package["bundle_index"], n_pairs=F.countDistinct("pair_id"), n_bundles=F.countDistinct("bundle_id")).crossJoin(one(package["schedule"], n_story_rows=F.count("*")))  # one row each
    if "prompt_rounds" in package:
        m = package["eval_manifest"]
        out = out.crossJoin(one(package["prompt_rounds"], n_rounds=F.countDistinct("round_index"))).crossJoin(one(m, n_eval_rows=F.count("*"), n_eval_td_rows=F.count_if(F.col("eval_group") == "TD"), n_eval_sli_rows=F.count_if(F.col("eval_group") == "SLI")))
    return out


def multi_age_packages(dev: DataFrame, severity: DataFrame, rules: DataFrame, replicates: int = 10, per_round: int = 3, bins: list[tuple[str, int, int]] | None = None) -> dict[str, dict[str, DataFrame]]:
    """A rotating package for each age bin, by its label."""
    bins = AGE_BINS if bins is None else bins
    if not bins:
        raise ValueError("no age bins")
    return {label: generation_package(dev, severity, rules, replicates, low, high, label, None, per_round) for label, low, high in bins}


# ---------------------------------------------------------------- pools and plans
def story_pools(children: DataFrame, strata: list[str], key: str, available: str) -> tuple[DataFrame, DataFrame]:
    """(prompt pool, evaluation pool) of (strata, key, story_id): the prompt story of a child is the one of its stories that its
    stratum has used least; its others are for evaluation."""
    cell = F.concat_ws("\x1f", *strata)
    prompt = balanced_stories(children.withColumn("_cell", cell), "_cell", key, available).select(key, F.col("story").alias("story_id"))
    prompt = children.select(*strata, key).join(prompt, key)
    told = children.select(*strata, key, F.explode(available).alias("story_id")).where(F.col("story_id").isin(STORIES))
    return prompt, told.join(prompt.select(key, "story_id"), [key, "story_id"], "left_anti").select(*strata, key, "story_id")


def generation_cells(rules: DataFrame, prompt: DataFrame, evaluation: DataFrame, strata: list[str], key: str, least_prompt: int = 2, least_eval: int = 3) -> DataFrame:
    """Rule x stratum that tells the rule's target story: numbers and ids of prompt and evaluation candidates, and whether there
    are enough.  ``rules`` has target_story, e1_story, e2_story."""
    every = prompt.unionByName(evaluation).select(*strata, F.col("story_id").alias("target_story")).distinct()
    pool = lambda d, n: candidate_cells(d.withColumnRenamed("story_id", "target_story"), [*strata, "target_story"], key, 0).select(*strata, "target_story", F.col("candidates").alias(f"n_{n}_candidates"), F.col("ids").alias(f"{n}_subject_ids"))
    cells = rules.join(every, "target_story").join(pool(prompt, "prompt"), [*strata, "target_story"], "left").join(pool(evaluation, "eval"), [*strata, "target_story"], "left")
    cells = cells.na.fill(0, ["n_prompt_candidates", "n_eval_candidates"]).na.fill("", ["prompt_subject_ids", "eval_subject_ids"])
    return cells.withColumn("cell_status", F.when((F.col("n_prompt_candidates") >= least_prompt) & (F.col("n_eval_candidates") >= least_eval), "usable").otherwise("sparse"))


def located(rows: DataFrame, child: list[str], story: str, base: DataFrame, split: DataFrame) -> DataFrame:
    """Rows with ``path`` and ``scope`` of the child's story: its own file (``single_story``) before the child's whole transcript
    (``multi_story``).  ``base`` (child, path), ``split`` (child, story, path)."""
    b, s = base.select(*child, F.col("path").alias("_base")), split.select(*child, F.col("story").alias(story), F.col("path").alias("_split"))
    out = rows.join(s, [*child, story], "left").join(b, child, "left")
    scope = F.when(F.col("_split").isNotNull(), "single_story").when(F.col("_base").isNotNull(), "multi_story")
    return out.withColumn("path", F.coalesce("_split", "_base")).withColumn("scope", scope).drop("_split", "_base")


def first_existing(rows: DataFrame, candidates: list[Column], files: DataFrame) -> DataFrame:
    """Rows with ``path``, the first candidate that is among ``files`` (path); the first of all where none is."""
    out = rows
    for i, c in enumerate(candidates):
        f = files.select(F.col("path").alias(f"_p{i}")).distinct()
        out = out.withColumn(f"_c{i}", c)
        out = out.join(f, F.col(f"_c{i}") == F.col(f"_p{i}"), "left")
    n = range(len(candidates))
    return out.withColumn("path", F.coalesce(*[F.col(f"_p{i}") for i in n], F.col("_c0"))).drop(*[f"_{x}{i}" for i in n for x in "cp"])


def _short_lists(children: DataFrame, wanted: list[dict]) -> dict[tuple[int, str], list[dict]]:
    """By number of the reference and group: the children that tell its stories, by ``kind`` (SLI: whether label and band differ)
    and ``place`` (by age gap, then id), those of each kind down to the place that follows the number of references."""
    if not wanted:
        return {}
    columns = "n int, target_story string, e1_story string, e2_story string, td_age double, sli_age double, sli_band string, sli_label string"
    names = [c.split()[0] for c in columns.split(", ")][1:]
    refs = children.sparkSession.createDataFrame([(i, *(r[c] for c in names)) for i, r in enumerate(wanted)], columns)
    td, differs = F.col("grp") == "TD", lambda a, b: (~F.col(a).eqNullSafe(F.col(b))).cast("int")
    tells = lambda c: F.array_contains("stories", F.col(c))
    fits = (td & tells("target_story") & tells("e1_story")) | ((F.col("grp") == "SLI") & tells("e2_story"))
    c = children.crossJoin(F.broadcast(refs)).where(fits)  # one row a story
    c = c.withColumn("kind", F.when(td, 0).otherwise(2 * differs("label", "sli_label") + differs("band", "sli_band")))
    gap = F.abs(F.col("age") - F.when(td, F.col("td_age")).otherwise(F.col("sli_age")))
    place = F.row_number().over(Window.partitionBy("n", "grp", "kind").orderBy(gap.asc_nulls_last(), "id"))
    out: dict = {}
    for r in c.withColumn("place", place).where(F.col("place") <= len(wanted) + 1).select("n", "grp", "kind", "place", "id").collect():
        out.setdefault((r["n"], r["grp"]), []).append(r.asDict())
    return out


def loocv_plan(children: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """Leave-one-out folds: every SLI child is held out once, with the nearest TD child that is left; each fold's prompts go, for
    each reference row in story order, to the TD and SLI children that fit best and were used least.

    ``children`` (id, grp, age, band, label, stories array); ``references`` (target_story, e1_story, e2_story, td_age, sli_age,
    sli_band, sli_label).  A fold leaves out one child of each group and has used fewer than it has references, so the first
    children in a reference's order, one more than there are references, hold its choice (of SLI children, the first of each kind
    of label and band): the folds look at these short lists alone."""
    import pandas as pd

    pool = children.select(F.lit(0).alias("_all"), "id", "age", (F.col("grp") == "SLI").alias("target"))
    held = greedy_match(pool, "_all", "id", "age", "target")
    sli = children.where(F.col("grp") == "SLI")
    order = Window.orderBy("age", "id")  # one row a child of a cohort
    folds = sli.withColumn("fold", F.row_number().over(order)).join(held.select(F.col("target_id").alias("id"), F.col("control_id").alias("heldout_td_child_id"), F.bround("gap", 3).alias("heldout_td_age_gap_months")), "id")
    folds = folds.select(F.format_string("fold_%02d_sli_%d", "fold", "id").alias("fold_id"), F.col("id").alias("heldout_sli_child_id"), F.col("band").alias("heldout_sli_severity_band"), F.col("label").alias("heldout_sli_profile_label"), "heldout_td_child_id", "heldout_td_age_gap_months")
    wanted = references.orderBy(story_rank("target_story")).toPandas().to_dict("records")  # one row a story
    short = _short_lists(children, wanted)

    def choose(batches):
        for pdf in batches:
            rows = []
            for fold, out_sli, out_td in zip(pdf.fold_id, pdf.heldout_sli_child_id, pdf.heldout_td_child_id):
                used: dict = {}
                for i, r in enumerate(wanted):
                    td = [c for c in short.get((i, "TD"), ()) if c["id"] != out_td]
                    sl = [c for c in short.get((i, "SLI"), ()) if c["id"] != out_sli]
                    if not td or not sl:
                        raise ValueError(f"no prompt candidate for {r['target_story']} in {fold}")
                    t, s = (min(x, key=lambda c: (c["kind"], used.get((c["grp"], c["id"]), 0), c["place"])) for x in (td, sl))
                    for c in (t, s):
                        used[c["grp"], c["id"]] = used.get((c["grp"], c["id"]), 0) + 1
                    rows.append((fold, r["target_story"], r["e1_story"], r["e2_story"], t["id"], s["id"]))
            yield pd.DataFrame(rows, columns=["fold_id", "target_story", "e1_story", "e2_story", "target_td_child_id", "prompt_sli_child_id"])

    prompts = folds.select("fold_id", "heldout_sli_child_id", "heldout_td_child_id").mapInPandas(choose, "fold_id string, target_story string, e1_story string, e2_story string, target_td_child_id long, prompt_sli_child_id long")
    ids = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), "/")
    per = prompts.groupBy("fold_id").agg(F.count("*").alias("n_target_rows"), F.countDistinct("target_td_child_id").alias("n_unique_td_prompt_children"), F.countDistinct("prompt_sli_child_id").alias("n_unique_sli_prompt_children"), ids("target_td_child_id").alias("td_prompt_child_ids"), ids("prompt_sli_child_id").alias("sli_prompt_child_ids"))
    both = F.explode(F.array(F.struct(F.lit("TD").alias("grp"), F.col("heldout_td_child_id").alias("id")), F.struct(F.lit("SLI").alias("grp"), F.col("heldout_sli_child_id").alias("id"))))
    tells = children.select("grp", "id", F.explode("stories").alias("eval_story_id"))
    evaluation = folds.select("fold_id", both.alias("e")).select("fold_id", "e.grp", "e.id").join(tells, ["grp", "id"]).select("fold_id", F.col("grp").alias("eval_group"), F.col("id").alias("eval_child_id"), "eval_story_id")
    return {"folds": folds.join(per, "fold_id", "left"), "prompts": prompts, "evaluation": evaluation}


def plan_summary(plan: dict[str, DataFrame]) -> DataFrame:
    """Folds, evaluation rows a fold (least, most), and how many children of each group are evaluated."""
    per = plan["evaluation"].groupBy("fold_id").agg(F.count("*").alias("n"))
    f = plan["folds"].agg(F.count("*").alias("folds"), F.countDistinct("heldout_td_child_id").alias("unique_td_eval_children"), F.countDistinct("heldout_sli_child_id").alias("unique_sli_eval_children"))
    return f.crossJoin(per.agg(F.min("n").alias("least_eval_rows"), F.max("n").alias("most_eval_rows")))  # one row each


# ---------------------------------------------------------------- measures of generated bundles
def bundle_metadata(stories: DataFrame, key: str = "File_ID", order: str = "target_story") -> DataFrame:
    """One row a bundle from one row a story: the first value of every column, the stories in order, and how many there are."""
    rest = [c for c in stories.columns if c not in (key, order)]
    cell = F.struct(story_rank(order).alias("k"), F.col(order).alias("s"))
    cells = F.array_sort(F.collect_list(cell))
    out = stories.groupBy(key).agg(*[F.min_by(_c(c), cell).alias(c) for c in rest], F.array_join(F.transform(cells, lambda c: c["s"]), "|").alias("story_slots"), F.count("*").alias("n_stories"))
    return out


def generated_measures(kideval: DataFrame, mlt: DataFrame, dss: DataFrame, grouped: DataFrame, past: DataFrame, metadata: DataFrame, key: str = "File_ID") -> DataFrame:
    """The measures of generated bundles in the layout of the real ones: five one-to-one left joins on the file id, then the
    bundle's metadata; columns of the second table that the first has take ``_mlt``, columns that no table has are empty, and
    grouped errors also come per word.  Raises where a table repeats an id."""
    clash = {c: f"{c}_mlt" for c in mlt.columns if c != key and c in kideval.columns}
    dev = checked_join(kideval, mlt.withColumnsRenamed(clash), [key])
    for part, columns in ((dss, None), (grouped, ERROR_COLUMNS), (past, PAST_COLUMNS), (metadata, None)):
        use = part if columns is None else require_columns(part, columns).select(key, *columns)
        use = use.drop(*[c for c in use.columns if c != key and c in dev.columns])
        dev = checked_join(dev, use, [key])
    dev = dev.withColumns({c: F.lit("") for c in ["File_mlt", *ERROR_COLUMNS, *PAST_COLUMNS, *BUNDLE_COLUMNS] if c not in dev.columns})
    words = number(_c("#words")) if "#words" in dev.columns else F.lit(None).cast("double")
    return dev.withColumns({f"{c}_per_word": F.when(words > 0, number(_c(c)) / words) for c in GROUPED_RATES})


def measures_summary(dev: DataFrame) -> DataFrame:
    """Rows, groups, rounds, and how many bundles and prompt children there are."""
    some = lambda c: F.countDistinct(F.when(F.col(c).cast("string") != "", F.col(c)))
    names = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))
    return dev.agg(F.count("*").alias("rows"), names("Group").alias("groups"), names("round_id").alias("rounds"), some("bundle_id").alias("n_bundle_ids"), some("prompt_td_child_id").alias("n_prompt_td_child_ids"), some("prompt_sli_child_id").alias("n_prompt_sli_child_ids"))


def matched_pool(manifest: DataFrame, real: DataFrame, child: str = "eval_child_id", group: str = "eval_group", key: str = "File_ID", own: str = "Group") -> DataFrame:
    """The children of a manifest with their measures, by normalised id and group (many to one); raises where one has none."""
    left = manifest.withColumn("_id", normal_id(child)).withColumn("_grp", F.col(group))
    right = real.withColumn("_id", normal_id(key)).withColumn("_grp", F.col(own))
    out = checked_join(left, right, ["_id", "_grp"], "left", "many_to_one")
    name = F.concat_ws(" ", group, child)
    return out.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.concat(F.lit("no measures of held-out child "), name)).cast(dict(real.dtypes)[key])).otherwise(F.col(key))).drop("_id", "_grp")


def candidate_range(pairs: DataFrame, query: str, count: str) -> DataFrame:
    """Least, most and mean number of candidates, each query once."""
    return pairs.select(query, count).distinct().agg(F.min(count).alias("least"), F.max(count).alias("most"), F.avg(count).alias("mean"))
