"""Queries over designs and tables of measures: rosters, packages, pools, plans, merged measures, column decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import design as D
from ..operators import norms as N
from ..operators import packages as P
from ..operators import stats as S
from ..operators.audit import shared_columns, usable_features
from .text_queries import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- children from customers
def _dev(spark, d):
    """Customers as children: one in five in the clinical group, ages of 36 to 119 months."""
    k = F.col("c_custkey")
    months = 36 + k % 84
    return t(spark, d, "customer").select(
        k.alias("File_ID"),
        F.concat(k.cast("string"), F.lit(".cha")).alias("File_kideval"),
        F.when(k % 5 == 0, "SLI").when(k % 11 == 1, "XX").otherwise("TD").alias("Group"),
        months.cast("string").alias("Age(Month)"),
        F.concat(F.floor(months / 12).cast("string"), F.lit(";"), F.lpad((months % 12).cast("string"), 2, "0"), F.lit(".")).alias("Age"),
        F.when(k % 13 != 2, months + (k % 30) / 30).alias("Age_Month_approx"),
        F.col("c_acctbal").alias("MLU_Morphemes"),
    )


def _severity(spark, d):
    k = F.col("c_custkey")
    score = {c: ((k * (i + 3)) % 17).cast("double") / 10 for i, c in enumerate(P.SEVERITY)}
    x = _dev(spark, d).select(F.col("File_ID").alias("c_custkey"), "Group", "Age(Month)")
    return x.select(F.col("c_custkey").alias("File_ID"), "Group", "Age(Month)", F.when(F.col("Group") == "SLI", F.when(k % 2 == 0, "mild").otherwise("severe")).alias(P.BAND), *[v.alias(c) for c, v in score.items()])


_S = {c: f"(((c_custkey * {i + 3}) % 17) / 10)" for i, c in enumerate(P.SEVERITY)}
_LABELS = {k: v for k, v in N.LABELS.items()}
_PROFILE = " UNION ALL ".join(f"SELECT c_custkey, '{n}' AS n, {i} AS o, {_S[c]} AS v FROM kids" for i, (c, n) in enumerate(_LABELS.items()))
_KIDS = f"""kids AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'SLI' WHEN c_custkey % 11 = 1 THEN 'XX' ELSE 'TD' END AS grp, 36 + c_custkey % 84 AS months, CASE WHEN c_custkey % 13 <> 2 THEN 36 + c_custkey % 84 + (c_custkey % 30) / 30 END AS approx FROM customer),
lab AS (SELECT c_custkey, CASE WHEN max(CASE WHEN k = 1 THEN v END) - max(CASE WHEN k = 2 THEN v END) < 0.35 THEN 'balanced' ELSE max(CASE WHEN k = 1 THEN n END) END AS label FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, o) AS k FROM ({_PROFILE})) GROUP BY 1),
frame AS (SELECT kids.*, CASE WHEN grp = 'TD' THEN 'typical' ELSE label END AS profile_label, CASE WHEN grp = 'SLI' THEN CASE WHEN c_custkey % 2 = 0 THEN 'mild' ELSE 'severe' END END AS band FROM kids JOIN lab USING (c_custkey) WHERE grp IN ('SLI', 'TD') AND months BETWEEN 48 AND 59 AND approx IS NOT NULL)"""


@query(f"WITH {_KIDS} SELECT c_custkey AS File_ID, grp, round(approx, 6) AS age, profile_label, band FROM frame")
def roster_frame(spark, d):
    r = P.roster_frame(_dev(spark, d), _severity(spark, d), 48, 59)
    return r.select("File_ID", F.col("Group").alias("grp"), F.round("age_months_approx", 6).alias("age"), "profile_label", F.col(P.BAND).alias("band"))


@query(f"WITH {_KIDS} SELECT 'real_' || c_custkey AS bundle_id, grp AS \"group\", '4-year-old' AS cohort, CASE WHEN grp = 'SLI' THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS sli_child_id, CASE WHEN grp = 'TD' THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS td_child_id, CASE WHEN grp = 'SLI' THEN band ELSE 'typical' END AS sli_severity_band, profile_label AS sli_profile_label, round(CASE WHEN grp = 'TD' THEN approx END, 6) AS td_age, 'A1|A2|A3|B1|B2|B3' AS story_slots, {_S['severity_core_composite']} AS severity_core_composite, CAST(NULL AS DOUBLE) AS MLU_Morphemes FROM frame")
def real_bundle_template(spark, d):
    out = P.real_bundle_template(P.roster_frame(_dev(spark, d), _severity(spark, d), 48, 59), ["MLU_Morphemes"])
    return out.select("bundle_id", "group", "cohort", "sli_child_id", "td_child_id", "sli_severity_band", "sli_profile_label", F.round("td_age_months_approx", 6).alias("td_age"), "story_slots", "severity_core_composite", "MLU_Morphemes")


def _rules(spark):
    return spark.createDataFrame([(s, v, f"{s}_{v}", f"{s}_x") for s in D.STORIES for v in (0, 1)], "target_story string, variant_index int, e1_story string, e2_story string")


@query(f"WITH {_KIDS}, n AS (SELECT count(*) FILTER (grp = 'SLI') AS n FROM frame) SELECT n AS n_pairs, n * 10 AS n_bundles, n * 60 AS n_story_rows FROM n")
def single_package(spark, d):
    """Every clinical child of the bin is matched, in ten replicates of six stories."""
    return P.package_summary(P.generation_package(_dev(spark, d), _severity(spark, d), _rules(spark)))


@query(f"WITH {_KIDS}, n AS (SELECT count(*) FILTER (grp = 'SLI') AS n FROM frame), r AS (SELECT n, CAST(ceil(n / 3) AS BIGINT) AS r, n % 3 AS rest FROM n) SELECT n AS n_pairs, n * 10 AS n_bundles, n * 60 AS n_story_rows, r AS n_rounds, 2 * n * (r - 1) AS n_eval_rows, n * (r - 1) AS n_eval_td_rows, n * (r - 1) AS n_eval_sli_rows FROM r")
def rotating_package(spark, d):
    return P.package_summary(P.generation_package(_dev(spark, d), _severity(spark, d), _rules(spark), per_round=3))


@query(f"WITH {_KIDS.replace('BETWEEN 48 AND 59', 'BETWEEN 60 AND 119')} SELECT (months // 12) || '-year-old' AS cohort, ['zero','one','two','three','four','five','six','seven','eight','nine'][CAST(months // 12 + 1 AS INTEGER)] || '_year_old' AS slug, count(*) AS n_pairs FROM frame WHERE grp = 'SLI' GROUP BY 1, 2")
def multi_age_packages(spark, d):
    got = None
    for label, package in P.multi_age_packages(_dev(spark, d), _severity(spark, d), _rules(spark), 2).items():
        one = package["roster"].groupBy("cohort").agg(F.count("*").alias("n_pairs")).select("cohort", N.cohort_slug("cohort").alias("slug"), "n_pairs")
        got = one if got is None else got.union(one)
    return got


@query(f"WITH {_KIDS}, p AS (SELECT row_number() OVER (ORDER BY approx, c_custkey) AS pair_order, c_custkey FROM frame WHERE grp = 'SLI') SELECT CAST(pair_order AS INTEGER) AS pair_order, c_custkey AS sli_child_id FROM p")
def frozen_roster(spark, d):
    """Pairs in the order of the clinical side's age; each control once (checked, as the pairing itself is beyond SQL)."""
    r = P.frozen_roster(P.roster_frame(_dev(spark, d), _severity(spark, d), 48, 59), "4-year-old")
    n, u = r.agg(F.count("*"), F.countDistinct("td_child_id")).first()
    assert n == u
    return r.select("pair_order", "sli_child_id")


@query("SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1 AS INTEGER) AS variant_index FROM supplier")
def variant_indices(spark, d):
    return P.read_order(t(spark, d, "supplier"), "s_name", ["s_nationkey"]).select("s_nationkey", "s_suppkey", "variant_index")


# ---------------------------------------------------------------- pools, plans
def _told(spark, d):
    k = F.col("File_ID")
    has = F.filter(F.array(*[F.when(k % (i + 2) != 0, F.lit(s)) for i, s in enumerate(D.STORIES)]), lambda x: x.isNotNull())
    return _dev(spark, d).where("Group <> 'XX'").select((k % 4).alias("cohort"), F.col("Group").alias("grp"), k.alias("id"), has.alias("stories"))


_HAS = " UNION ALL ".join(f"SELECT c_custkey AS id, c_custkey % 4 AS cohort, CASE WHEN c_custkey % 5 = 0 THEN 'SLI' ELSE 'TD' END AS grp, '{s}' AS story_id, {i} AS o FROM customer WHERE c_custkey % {i + 2} <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 11 <> 1)" for i, s in enumerate(D.STORIES))


@query(f"SELECT cohort, grp, CAST(count(*) - count(DISTINCT id) AS BIGINT) AS eval_rows, CAST(count(DISTINCT id) AS BIGINT) AS prompt_rows FROM ({_HAS}) GROUP BY ALL")
def story_pools(spark, d):
    """Each child with a story has one for prompting, and its others for evaluation."""
    prompt, evaluation = P.story_pools(_told(spark, d), ["cohort", "grp"], "id", "stories")
    a, b = (x.groupBy("cohort", "grp").agg(F.count("*").alias(n)) for x, n in ((prompt, "prompt_rows"), (evaluation, "eval_rows")))
    return a.join(b, ["cohort", "grp"], "left").na.fill(0, ["eval_rows"])


@query(
    f"""WITH h AS ({_HAS}), p AS (SELECT id, first(story_id ORDER BY o) AS s FROM h GROUP BY 1), prompt AS (SELECT DISTINCT h.* FROM h JOIN p ON h.id = p.id AND h.story_id = p.s), ev AS (SELECT h.* FROM h JOIN p ON h.id = p.id AND h.story_id <> p.s),
r AS (SELECT unnest(['A1','A2','A3','B1','B2','B3']) AS target_story), cells AS (SELECT DISTINCT cohort, grp, story_id AS target_story FROM h)
SELECT cohort, grp, target_story, target_story || '_e' AS e1_story, (SELECT count(DISTINCT id) FROM prompt WHERE prompt.cohort = cells.cohort AND prompt.grp = cells.grp AND prompt.story_id = target_story) AS n_prompt_candidates, (SELECT count(DISTINCT id) FROM ev WHERE ev.cohort = cells.cohort AND ev.grp = cells.grp AND ev.story_id = target_story) AS n_eval_candidates, CASE WHEN (SELECT count(DISTINCT id) FROM prompt WHERE prompt.cohort = cells.cohort AND prompt.grp = cells.grp AND prompt.story_id = target_story) >= 2 AND (SELECT count(DISTINCT id) FROM ev WHERE ev.cohort = cells.cohort AND ev.grp = cells.grp AND ev.story_id = target_story) >= 3 THEN 'usable' ELSE 'sparse' END AS cell_status FROM cells JOIN r USING (target_story)"""
)
def generation_cells(spark, d):
    """Rules by strata with their pools; here every child prompts with the first story it has."""
    told = _told(spark, d).select("cohort", "grp", "id", F.posexplode("stories").alias("at", "story_id"))
    rules = spark.createDataFrame([(s, f"{s}_e") for s in D.STORIES], "target_story string, e1_story string")
    cells = P.generation_cells(rules, told.where("at = 0").drop("at"), told.where("at > 0").drop("at"), ["cohort", "grp"], "id")
    return cells.select("cohort", "grp", "target_story", "e1_story", "n_prompt_candidates", "n_eval_candidates", "cell_status")


def _plan(spark, d):
    k = F.col("File_ID")
    kids = P.roster_frame(_dev(spark, d), _severity(spark, d), 48, 59).select(k.alias("id"), F.col("Group").alias("grp"), F.col("age_months_approx").alias("age"), F.coalesce(F.col(P.BAND), F.lit("typical")).alias("band"), F.col("profile_label").alias("label"))
    kids = kids.withColumn("stories", F.filter(F.array(*[F.when(F.col("id") % (i + 211) != 0, F.lit(s)) for i, s in enumerate(D.STORIES)]), lambda x: x.isNotNull()))
    refs = spark.createDataFrame([(s, D.STORIES[(i + 1) % 6], D.STORIES[(i + 2) % 6], 50.0 + i, 51.0 + i, "mild", "balanced") for i, s in enumerate(D.STORIES)], "target_story string, e1_story string, e2_story string, td_age double, sli_age double, sli_band string, sli_label string")
    return P.loocv_plan(kids, refs)


@query(f"WITH {_KIDS}, f AS (SELECT c_custkey, row_number() OVER (ORDER BY approx, c_custkey) AS k, band, profile_label FROM frame WHERE grp = 'SLI') SELECT 'fold_' || lpad(CAST(k AS VARCHAR), CAST(greatest(2, length(CAST(k AS VARCHAR))) AS INTEGER), '0') || '_sli_' || c_custkey AS fold_id, c_custkey AS heldout_sli_child_id, band AS heldout_sli_severity_band, profile_label AS heldout_sli_profile_label, CAST(6 AS BIGINT) AS n_target_rows FROM f")
def loocv_folds(spark, d):
    return _plan(spark, d)["folds"].select("fold_id", "heldout_sli_child_id", "heldout_sli_severity_band", "heldout_sli_profile_label", "n_target_rows")


@query()
def loocv_prompts(spark, d):
    return _plan(spark, d)["prompts"]


@query(f"WITH {_KIDS} SELECT count(*) AS folds, count(*) AS unique_sli_eval_children, count(*) AS unique_td_eval_children FROM frame WHERE grp = 'SLI'")
def loocv_summary(spark, d):
    return P.plan_summary(_plan(spark, d)).select("folds", "unique_td_eval_children", "unique_sli_eval_children")


@query("SELECT o_custkey AS child, 'A' || (o_orderkey % 3 + 1) AS story, o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'split/' || o_custkey || '_A1' WHEN o_custkey % 5 <> 0 THEN 'base/' || o_custkey END AS path, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'single_story' WHEN o_custkey % 5 <> 0 THEN 'multi_story' END AS scope FROM orders")
def located_stories(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("child"))
    base = c.where("child % 5 <> 0").withColumn("path", F.concat(F.lit("base/"), F.col("child")))
    split = c.where("child % 2 = 0").withColumn("story", F.lit("A1")).withColumn("path", F.concat(F.lit("split/"), F.col("child"), F.lit("_A1")))
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("child"), F.concat(F.lit("A"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("story"), "o_orderkey")
    return P.located(o, ["child"], "story", base, split)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'r/' || c_custkey WHEN c_custkey % 3 = 0 THEN 'r/A/' || c_custkey WHEN c_custkey % 5 = 0 THEN 'r/B/' || c_custkey ELSE 'r/' || c_custkey END AS path FROM customer")
def first_existing_paths(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select("c_custkey")
    at = [F.concat(F.lit(p), k) for p in ("r/", "r/A/", "r/B/")]
    files = c.where("c_custkey % 2 = 0").select(at[0].alias("path")).union(c.where("c_custkey % 3 = 0").select(at[1])).union(c.where("c_custkey % 5 = 0").select(at[2]))
    return P.first_existing(c, at, files)


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS o FROM supplier), i AS (SELECT unnest([1, 2, 3]) AS round_index) SELECT CAST(round_index AS INTEGER) AS round_index, c_custkey, c_nationkey FROM customer CROSS JOIN i WHERE NOT (c_custkey % 3 + 1 = round_index AND c_nationkey < 10)")
def held_out_pool(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    rounds = spark.createDataFrame([(1,), (2,), (3,)], "round_index int")
    prompts = c.where("c_nationkey < 10").select((F.col("c_custkey") % 3 + 1).cast("int").alias("round_index"), "c_custkey")
    return D.held_out(c, prompts, rounds, ["c_custkey"])


@query("SELECT s_suppkey, 'A1|A2|A3|B1|B2|B3' AS story_slots FROM supplier")
def bundle_index(spark, d):
    rows = t(spark, d, "supplier").select("s_suppkey", F.posexplode(F.array(*[F.lit(s) for s in reversed(D.STORIES)])).alias("at", "target_story"))
    return D.bundle_index(rows.select("s_suppkey", "target_story", (6 - F.col("at")).alias("story_slot_order")), ["s_suppkey"])


@query("SELECT 'cfg_' || lpad(CAST(row_number() OVER (ORDER BY c_mktsegment, c_nationkey) AS VARCHAR), 4, '0') AS config_id, c_mktsegment, c_nationkey, CAST(NULL AS DOUBLE) AS mlu FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)")
def config_templates(spark, d):
    cells = t(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()
    return D.template(D.config_ids(cells, ["c_mktsegment", "c_nationkey"]), ["config_id", "c_mktsegment", "c_nationkey"], ["mlu"])


# ---------------------------------------------------------------- measures
@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS File_ID, s_name, CAST(s_suppkey * 10 AS VARCHAR) AS words, CASE WHEN s_suppkey % 2 = 0 THEN 'mlt' END AS s_name_mlt, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS dss, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 7 END AS bare_marking_errors, round(CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 7) / (s_suppkey * 10) END, 9) AS bare_per_word, CASE WHEN s_suppkey % 5 = 0 THEN CAST(5 AS BIGINT) END AS past_verb_opportunities, CASE WHEN s_suppkey % 6 <> 0 THEN 'A1|B2' END AS story_slots, CASE WHEN s_suppkey % 6 <> 0 THEN CAST(2 AS BIGINT) END AS n_stories, CASE WHEN s_suppkey % 6 <> 0 THEN 'b' || s_suppkey END AS bundle_id, '' AS round_id FROM supplier"""
)
def generated_measures(spark, d):
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").withColumn("File_ID", k.cast("string"))
    zero = lambda cols, **some: [some.get(c, F.lit(0).cast("long")).alias(c) for c in cols]
    kideval = s.select("File_ID", "s_name", (k * 10).cast("string").alias("#words"))
    mlt = s.where("s_suppkey % 2 = 0").select("File_ID", F.lit("mlt").alias("s_name"))
    dss = s.where("s_suppkey % 3 = 0").select("File_ID", F.col("s_acctbal").alias("dss"))
    grouped = s.where("s_suppkey % 4 = 0").select("File_ID", *zero(P.ERROR_COLUMNS, bare_marking_errors=k % 7))
    past = s.where("s_suppkey % 5 = 0").select("File_ID", *zero(P.PAST_COLUMNS, past_verb_opportunities=F.lit(5).cast("long")))
    meta = P.bundle_metadata(s.where("s_suppkey % 6 <> 0").select("File_ID", F.concat(F.lit("b"), k.cast("string")).alias("bundle_id"), F.explode(F.array(F.lit("B2"), F.lit("A1"))).alias("target_story")))
    out = P.generated_measures(kideval, mlt, dss, grouped, past, meta)
    return out.select("File_ID", "s_name", F.col("#words").alias("words"), "s_name_mlt", "dss", "bare_marking_errors", F.round("bare_marking_errors_per_word", 9).alias("bare_per_word"), "past_verb_opportunities", "story_slots", "n_stories", "bundle_id", "round_id")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS eval_child_id, c_mktsegment AS eval_group, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def matched_pool(spark, d):
    """Orders ask for their customer's measures; ids are numbers here and text there, and none may be missing."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    ask = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("o_custkey").cast("string").alias("eval_child_id"), F.col("c_mktsegment").alias("eval_group"))
    real = c.select(F.col("c_custkey").cast("double").alias("File_ID"), F.col("c_mktsegment").alias("Group"), "c_acctbal")
    return P.matched_pool(ask, real).select("o_orderkey", "eval_child_id", "eval_group", "c_acctbal")


@query("SELECT c_custkey, c_name, c_nationkey, upper(c_mktsegment) || c_custkey AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN CAST(1 AS INTEGER) END AS extra FROM (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer)")
def replaced_columns(spark, d):
    c = t(spark, d, "customer").drop("c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.upper("c_mktsegment"), F.col("c_custkey").cast("string")).alias("c_mktsegment"), F.lit(1).alias("extra"))
    return C.replace_columns(c, new, "c_custkey")


@query("SELECT c_custkey AS \"File_ID\", " + ", ".join(f"c_acctbal + {i} AS \"{c}\"" for i, c in enumerate(C.KEEP) if c != "File_ID") + " FROM customer")
def severity_table(spark, d):
    """The kept columns of a wider table, in order; every column has a decision."""
    wide = t(spark, d, "customer").select(F.col("c_custkey").alias("File_ID"), F.lit(0).alias("DSS"), *[(F.col("c_acctbal") + i).alias(c) for i, c in enumerate(C.KEEP) if c != "File_ID"])
    decisions = {c: ("keep" if c in C.KEEP else "drop", "feature", "") for c in wide.columns}
    return C.severity_table(wide, decisions=decisions)


@query("SELECT 'b' || c_custkey AS bundle_id, c_custkey AS \"File_ID\", " + ", ".join("CAST(NULL AS VARCHAR) AS \"IPSyn_Total\"" if c == "IPSyn_Total" else f"c_acctbal + {i} AS \"{c}\"" for i, c in enumerate(C.KEEP) if c != "File_ID") + " FROM customer")
def generated_severity_table(spark, d):
    """A generated table lacks a column, has one under another name and duplicates from a second source."""
    wide = t(spark, d, "customer").select(F.col("c_custkey").alias("File_ID"), F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("bundle_id"), F.lit(1).alias("Age_mlt"), F.lit(2).alias("*-S3"), *[(F.col("c_acctbal") + i).alias(c) for i, c in enumerate(C.KEEP) if c not in ("File_ID", "IPSyn_Total")])
    return C.generated_severity_table(wide)


@query("SELECT * FROM (VALUES ('c_custkey', 'keep', 'key', 1, 'k'), ('c_name', 'drop', 'provenance', 0, 'p'), ('bundle_id', 'keep', 'generated_metadata', 1, 'Identifies the bundle and what it was prompted with.')) AS v(column_name, action, category, included, reason)")
def column_specification(spark, d):
    return C.specification(spark, ["c_custkey", "c_name", "bundle_id"], {"c_custkey": ("keep", "key", "k"), "c_name": ("drop", "provenance", "p")}, ["c_custkey"], ["bundle_id"])


@query("SELECT unnest(['c_custkey', 'c_acctbal']) AS column_name")
def usable_shared_features(spark, d):
    """Of the columns both tables have, those with numbers on both sides."""
    c = t(spark, d, "customer")
    other = c.select("c_acctbal", "c_custkey", F.lit(None).cast("double").alias("c_nationkey"), "c_name", F.lit(1).alias("x"))
    return spark.createDataFrame([(x,) for x in usable_features(c, other, ["c_custkey", "c_nationkey", "c_name", "c_acctbal", "x"])], "column_name string")


@query("SELECT unnest(['c_custkey', 'c_name']) AS column_name")
def column_intersection(spark, d):
    c = t(spark, d, "customer")
    return spark.createDataFrame([(x,) for x in shared_columns(c, c.select("c_name", "c_custkey", F.lit(1).alias("x")))], "column_name string")


@query("SELECT lang, " + ", ".join(f"count(*) FILTER (source = 'src{i}') AS src{i}" for i in range(4)) + " FROM documents GROUP BY lang")
def contingency(spark, d):
    return C.contingency(t(spark, d, "documents"), "lang", "source", [f"src{i}" for i in range(4)])


@query("SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def candidate_range(spark, d):
    from pyspark.sql.window import Window

    o = t(spark, d, "orders").withColumn("n", F.count("*").over(Window.partitionBy("o_custkey")))
    return P.candidate_range(o, "o_custkey", "n").withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT quantile_cont(c_acctbal, 1/3) AS a, quantile_cont(c_acctbal, 2/3) AS b FROM customer WHERE c_mktsegment = 'BUILDING') SELECT CASE WHEN c_acctbal <= a THEN 'mild' WHEN c_acctbal <= b THEN 'moderate' ELSE 'severe' END AS band_reference, count(*) AS n FROM customer CROSS JOIN c WHERE c_mktsegment = 'BUILDING' GROUP BY 1""")
def band_counts(spark, d):
    return N.band_counts(N.tertile_bands(t(spark, d, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING"))


@query("WITH n AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS items FROM orders GROUP BY 1) SELECT count(*) AS n, round(avg(items), 6) AS mean, round(stddev_samp(items), 6) AS sd, min(items) AS min, quantile_cont(items, 0.25) AS q25, quantile_cont(items, 0.5) AS median, quantile_cont(items, 0.75) AS q75, max(items) AS max FROM n")
def distinct_per_group(spark, d):
    s = S.describe_distinct(t(spark, d, "orders"), "o_orderpriority", ["o_custkey"])
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("WITH x AS (SELECT c_mktsegment AS grp, c_nationkey AS feature, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2) SELECT grp, feature, round(v, 6) AS v, round(max(v) OVER (PARTITION BY feature), 6) AS top, CAST(row_number() OVER (PARTITION BY grp ORDER BY v DESC, feature) AS INTEGER) AS place FROM x")
def group_max(spark, d):
    """Per feature the largest value of any group, and each group's features from the largest down."""
    x = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("feature")).agg(F.avg("c_acctbal").alias("v"))
    out = S.ranked_in_group(S.with_group_max(x, ["feature"], "v", "top"), ["grp"], "v", ["feature"], "place")
    return out.select("grp", "feature", F.round("v", 6).alias("v"), F.round("top", 6).alias("top"), "place")


@query("WITH f AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS fold, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT CAST(fold AS INTEGER) AS fold, c_custkey FROM f")
def fold_numbers(spark, d):
    return S.ranked_in_group(t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").withColumn("v", -F.col("c_acctbal")), [], "v", ["c_custkey"], "fold").select("fold", "c_custkey")
