"""Queries over measures and designs: norms, profiles, retrieval, audits, tests, rosters, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checks import checked_join, safe_rate
from ..operators import audit as A
from ..operators import design as D
from ..operators import joins as J
from ..operators import norms as N
from ..operators import retrieval as R
from ..operators import stats as S
from ..operators.learning import isolation_scores, pca, screen_features
from ..streaming import events as EV
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


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT o_custkey, round(CASE WHEN sum(o_totalprice) > 0 THEN count(*) / sum(o_totalprice) END, 9) AS orders_per_price, round(CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / count(*) FILTER (o_orderstatus = 'F') ELSE 0.0 END, 4) AS price_per_finished FROM orders GROUP BY 1")
def safe_rates(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("fp"))
    return g.select("o_custkey", F.round(safe_rate("n", "p"), 9).alias("orders_per_price"), F.round(safe_rate("fp", "f", 0.0), 4).alias("price_per_finished"))


@query("""WITH u AS (SELECT l_returnflag AS grp, 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem)
SELECT grp AS l_returnflag, feature, CAST(count(v) AS BIGINT) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS sd, round(CASE WHEN count(v) <= 1 OR stddev_pop(v) <= 0 THEN 1.0 ELSE stddev_pop(v) END, 5) AS safe_sd FROM u GROUP BY 1, 2""")
def reference_zscore(spark, d):
    z = N.reference_z(t(spark, d, "lineitem"), "l_returnflag", _LINE)
    return z.select("l_returnflag", "feature", "n", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "safe_sd")])


_SUPP = """s AS (SELECT l_suppkey, l_suppkey % 4 AS grp, avg(l_quantity) AS f1, avg(l_extendedprice) AS f2, avg(l_discount) AS f3, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE avg(l_tax) END AS f4 FROM lineitem GROUP BY 1)"""


def _suppliers(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("f1"), F.avg("l_extendedprice").alias("f2"), F.avg("l_discount").alias("f3"), F.avg("l_tax").alias("x"))
    return g.select("l_suppkey", (F.col("l_suppkey") % 4).alias("grp"), "f1", "f2", "f3", F.when(F.col("l_suppkey") % 7 != 0, F.col("x")).alias("f4"))


_NN = f"""WITH {_SUPP}, u AS (SELECT l_suppkey, grp, unnest(['f1','f2','f3','f4']) AS feature, unnest([f1, f2, f3, f4]) AS v FROM s),
r AS (SELECT grp, feature, avg(v) AS m, CASE WHEN count(v) <= 1 OR stddev_pop(v) <= 0 THEN 1.0 ELSE stddev_pop(v) END AS sd FROM u GROUP BY 1, 2),
z AS (SELECT l_suppkey, u.grp, u.feature, (v - m) / sd AS z FROM u JOIN r ON u.grp = r.grp AND u.feature = r.feature WHERE v IS NOT NULL),
p AS (SELECT a.l_suppkey AS query_id, b.l_suppkey AS candidate_id, count(*) AS n_features, sqrt(avg((a.z - b.z) ** 2)) AS rms, max(abs(a.z - b.z)) AS mx FROM z a JOIN z b ON a.grp = b.grp AND a.feature = b.feature AND a.l_suppkey <> b.l_suppkey WHERE a.l_suppkey % 100 = 0 GROUP BY 1, 2)"""


def _pairs(spark, d, best=None):
    s = _suppliers(spark, d)
    return R.zscore_neighbours(s.where("l_suppkey % 100 = 0"), s, "grp", "l_suppkey", "l_suppkey", ["f1", "f2", "f3", "f4"], F.col("query_id") == F.col("candidate_id"), best=best)


@query(_NN + " SELECT query_id, candidate_id, CAST(n_features AS BIGINT) AS n_features, round(rms, 6) AS rms_z, round(mx, 6) AS max_abs_z FROM p")
def zscore_distance_nn(spark, d):
    return _pairs(spark, d).select("query_id", "candidate_id", "n_features", F.round("rms_z", 6).alias("rms_z"), F.round("max_abs_z", 6).alias("max_abs_z"))


@query(_NN + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rms, candidate_id) AS r, lead(rms) OVER (PARTITION BY query_id ORDER BY rms, candidate_id) - rms AS margin FROM p) SELECT query_id, candidate_id, round(rms, 6) AS rms_z, round(margin, 6) AS margin FROM k WHERE r = 1")
def nn_margin(spark, d):
    return _pairs(spark, d, 1).select("query_id", "candidate_id", F.round("rms_z", 6).alias("rms_z"), F.round("margin", 6).alias("margin"))


@query("""WITH o AS (SELECT o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS age, o_totalprice AS y, o_orderstatus = 'F' AS ref FROM orders), f AS (SELECT regr_slope(y, age) AS s, regr_intercept(y, age) AS i FROM o WHERE ref), sd AS (SELECT stddev_samp(y - (i + s * age)) AS sd FROM o CROSS JOIN f WHERE ref)
SELECT o_orderkey, round(i + s * age, 3) AS expected, round((y - (i + s * age)) / sd, 6) AS z FROM o CROSS JOIN f CROSS JOIN sd""")
def linear_norm_z(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("age"), "o_totalprice", "o_orderstatus")
    n = N.linear_norm(o, ["o_totalprice"], "age", F.col("o_orderstatus") == "F")
    return n.select("o_orderkey", F.round("o_totalprice_td_linear_expected", 3).alias("expected"), F.round("o_totalprice_td_linear_z", 6).alias("z"))


@query()
def spline_norm_z(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("age"), "o_totalprice", "o_orderstatus")
    n = N.spline_norm(o, ["o_totalprice"], "age", F.col("o_orderstatus") == "F")
    return n.select("o_orderkey", F.round("o_totalprice_td_expected", 2).alias("expected"), F.round("o_totalprice_td_z", 4).alias("z"))


def _z_table(spark, d):
    """Supplier averages stand for the z columns of the profile."""
    s = _suppliers(spark, d)
    cols = [*N.ABILITY, *N.BURDEN]
    return s.select("l_suppkey", (F.col("l_suppkey") % 2).cast("int").alias("DSS_tbl_warning_50"), *[(F.col(f"f{i % 3 + 1}") / [10, 10000, 0.01][i % 3] * (1 + i / 10)).alias(f"{c}_td_z") for i, c in enumerate(cols)])


def _z_sql(c: str) -> str:
    i = [*N.ABILITY, *N.BURDEN].index(c)
    sign = "-" if c in N.ABILITY else ""
    return f"{sign}(f{i % 3 + 1} / {[10, 10000, 0.01][i % 3]} * {1 + i / 10})"


_DOM = {k: "(" + " + ".join(_z_sql(c) for c in v) + f") / {len(v)}" for k, v in N.DOMAINS.items()}
_PROFILE = f"WITH {_SUPP}, p AS (SELECT l_suppkey, {', '.join(f'{v} AS {k}' for k, v in _DOM.items())}, ({' + '.join(_z_sql(c) for c in N.CORE)}) / {len(N.CORE)} AS core FROM s)"


@query(_PROFILE + f" SELECT l_suppkey, {', '.join(f'round({k}, 6) AS {k}' for k in _DOM)}, round(core, 6) AS severity_core_composite, round(({' + '.join(N.LABELS)}) / 4, 6) AS severity_domain_composite FROM p")
def severity_direction_profile(spark, d):
    p = N.severity_profile(_z_table(spark, d), ["l_suppkey", "DSS_tbl_warning_50"])
    return p.select("l_suppkey", *[F.round(c, 6).alias(c) for c in (*N.DOMAINS, "severity_core_composite", "severity_domain_composite")])


_LABEL_ROWS = " UNION ALL ".join(f"SELECT l_suppkey, '{n}' AS n, {i} AS o, {c} AS v FROM p" for i, (c, n) in enumerate(N.LABELS.items()))


@query(_PROFILE + f", r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, o) AS k FROM ({_LABEL_ROWS})) SELECT l_suppkey, CASE WHEN max(CASE WHEN k = 1 THEN v END) - max(CASE WHEN k = 2 THEN v END) < 0.35 THEN 'balanced' ELSE max(CASE WHEN k = 1 THEN n END) END AS label FROM r GROUP BY 1")
def profile_label(spark, d):
    p = N.severity_profile(_z_table(spark, d), ["l_suppkey", "DSS_tbl_warning_50"])
    return p.select("l_suppkey", N.profile_label(N.LABELS).alias("label"))


@query("""WITH c AS (SELECT quantile_cont(c_acctbal, 1/3) AS a, quantile_cont(c_acctbal, 2/3) AS b FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'mild' WHEN c_acctbal <= b THEN 'moderate' ELSE 'severe' END AS band, CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_acctbal <= a THEN 'mild' WHEN c_acctbal <= b THEN 'moderate' ELSE 'severe' END END AS band_reference FROM customer CROSS JOIN c""")
def tertile_bands(spark, d):
    return N.tertile_bands(t(spark, d, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING").select("c_custkey", "band", "band_reference")


@query("WITH r AS (SELECT c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey, round((SELECT count(*) FROM r WHERE v <= c_acctbal) / (SELECT count(*) FROM r), 6) AS percentile FROM customer")
def reference_percentile(spark, d):
    p = N.reference_percentile(t(spark, d, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING")
    return p.select("c_custkey", F.round("percentile", 6).alias("percentile"))


@query("SELECT o_orderkey, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 365) AS BIGINT) AS years, CASE WHEN o_totalprice BETWEEN 0 AND 100000 THEN 'low' WHEN o_totalprice BETWEEN 100000 AND 250000 THEN 'middle' END AS cohort FROM orders WHERE o_totalprice BETWEEN 0 AND 250000")
def cohort_bins(spark, d):
    o = D.cohort_bins(t(spark, d, "orders"), "o_totalprice", [("low", 0, 100000), ("middle", 100000, 250000)])
    return o.select("o_orderkey", F.floor(F.datediff("o_orderdate", F.lit("1992-01-01")) / 365).alias("years"), "cohort")


@query("SELECT * FROM (SELECT source, lang, CAST(count(DISTINCT doc_id) AS BIGINT) AS candidates, string_agg(DISTINCT CAST(doc_id AS VARCHAR), '/' ORDER BY CAST(doc_id AS VARCHAR)) AS ids, CASE WHEN count(DISTINCT doc_id) >= 20 THEN 'usable' ELSE 'sparse' END AS status FROM documents GROUP BY 1, 2)")
def candidate_cells(spark, d):
    return D.candidate_cells(t(spark, d, "documents"), ["source", "lang"], "doc_id", 20)


def _roster(spark, d):
    return t(spark, d, "supplier").select(F.concat(F.lit("pair_"), F.col("s_suppkey").cast("string")).alias("pair_id"), F.col("s_suppkey").alias("td_child_id"), (F.col("s_suppkey") + 100000).alias("sli_child_id"), "s_acctbal")


_ROUNDS = "rounds AS (SELECT *, 'pair_' || s_suppkey AS pair_id, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS pair_order FROM supplier), r AS (SELECT *, CAST(floor((pair_order - 1) / 7) + 1 AS INTEGER) AS round_index FROM rounds)"


@query(f"WITH {_ROUNDS} SELECT pair_id, CAST(pair_order AS INTEGER) AS pair_order, round_index, CAST(count(*) OVER (PARTITION BY round_index) AS BIGINT) AS prompt_pair_count, CAST(count(*) OVER () - count(*) OVER (PARTITION BY round_index) AS BIGINT) AS eval_pair_count FROM r")
def prompt_rounds(spark, d):
    return D.prompt_rounds(_roster(spark, d), 7, ["s_acctbal", "td_child_id"]).select("pair_id", "pair_order", "round_index", "prompt_pair_count", "eval_pair_count")


@query(f"WITH {_ROUNDS}, rules AS (SELECT story AS target_story, v AS variant_index FROM (SELECT unnest(['A1','A2','A3','B1','B2','B3']) AS story) CROSS JOIN (SELECT unnest([0, 1]) AS v)), reps AS (SELECT unnest([1, 2]) AS replicate_id) SELECT pair_id, CAST(replicate_id AS INTEGER) AS replicate_id, target_story, CAST(variant_index AS INTEGER) AS variant_index, target_story || '_' || variant_index AS e1_story FROM r CROSS JOIN reps JOIN rules ON variant_index = (replicate_id - 1 + pair_order - 1) % 2")
def rotating_schedule(spark, d):
    rules = spark.createDataFrame([(s, v, f"{s}_{v}") for s in D.STORIES for v in (0, 1)], "target_story string, variant_index int, e1_story string")
    return D.story_schedule(D.prompt_rounds(_roster(spark, d), 7, ["s_acctbal", "td_child_id"]), rules, 2).select("pair_id", "replicate_id", "target_story", "variant_index", "e1_story")


@query(f"WITH {_ROUNDS}, i AS (SELECT DISTINCT round_index AS k FROM r), g AS (SELECT unnest(['TD', 'SLI']) AS grp) SELECT k AS round_index, pair_id AS eval_pair_id, grp AS eval_group, CAST(CASE WHEN grp = 'TD' THEN s_suppkey ELSE s_suppkey + 100000 END AS VARCHAR) AS eval_child_id FROM r CROSS JOIN i CROSS JOIN g WHERE k <> round_index")
def eval_manifest(spark, d):
    return D.eval_manifest(D.prompt_rounds(_roster(spark, d), 7, ["s_acctbal", "td_child_id"]))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join_pool(spark, d):
    src = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.excluding(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), src, ["c_custkey"])


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def checked_left_join_chain(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = t(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    x = checked_join(o, c, ["c_custkey"], validate="many_to_one")
    x = checked_join(x, n, ["n_nationkey"], validate="many_to_one")
    return checked_join(x, t(spark, d, "region"), ["r_regionkey"], validate="many_to_one").select("o_orderkey", "c_name", "n_name", "r_name")


_SUFFIX = """m AS (SELECT page_id, page_id // 5 AS k, CAST(page_id % 10 AS VARCHAR) AS suffix FROM pages), r AS (SELECT doc_id, doc_id // 5 AS k, source AS path, n_chars FROM documents)"""


def _suffix(spark, d, mode):
    m = t(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 5).alias("k"), (F.col("page_id") % 10).cast("string").alias("suffix"))
    r = t(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 5).alias("k"), F.col("source").alias("path"), "n_chars")
    return J.suffix_join(m, r, "k", "path", "suffix", ["n_chars"], "doc_id", "page_id", long_prefix="src1", on_ambiguous=mode).select("page_id", "n_chars")


@query(f"WITH {_SUFFIX}, x AS (SELECT page_id, n_chars, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN ends_with(path, 'src1' || suffix) THEN 0 WHEN ends_with(path, suffix) THEN 1 ELSE 2 END, doc_id) AS i FROM m LEFT JOIN r USING (k)) SELECT page_id, n_chars FROM x WHERE i = 1")
def suffix_tiebreak_join(spark, d):
    return _suffix(spark, d, "first")


@query(f"WITH {_SUFFIX}, x AS (SELECT page_id, n_chars, count(path) OVER (PARTITION BY page_id) AS n, sum(CASE WHEN ends_with(path, suffix) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) AS s, ends_with(path, suffix) AS e FROM m LEFT JOIN r USING (k)) SELECT page_id, CAST(coalesce(max(CASE WHEN n = 1 OR (s = 1 AND e) THEN n_chars END), 0) AS BIGINT) AS n_chars FROM x GROUP BY 1")
def suffix_unique_join(spark, d):
    return _suffix(spark, d, "zero")


_INV = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS non_null, CAST(count(*) - count({c}) AS BIGINT) AS missing, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_non_null, CAST(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END <= 1 AS INTEGER) AS is_constant, CAST(count(DISTINCT {c}) = count(*) AS INTEGER) AS is_id_like FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


@query(_INV)
def column_inventory(spark, d):
    return A.column_inventory(t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]).select("column_name", "non_null", "missing", "distinct_non_null", "is_constant", "is_id_like")


_PAIRCOLS = [(a, b) for i, a in enumerate(_LINE) for b in _LINE[i + 1 :]]
_PAIRSQL = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST(count(*) AS BIGINT) AS n, round(corr({a}, {b}), 6) AS pearson, round(avg(abs({a} - {b})), 4) AS mean_abs_diff FROM lineitem" for a, b in _PAIRCOLS)


@query(_PAIRSQL)
def pair_correlation(spark, d):
    return A.pair_correlations(t(spark, d, "lineitem"), _LINE).select("column_a", "column_b", "n", F.round("pearson", 6).alias("pearson"), F.round("mean_abs_diff", 4).alias("mean_abs_diff"))


_SPEAR = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM customer2)" for a, b in (("c_acctbal", "c_nationkey"), ("c_acctbal", "c_custkey"), ("c_nationkey", "c_custkey")))


@query(f"WITH customer2 AS (SELECT * FROM customer) {_SPEAR}")
def spearman_pairs(spark, d):
    return A.spearman_pairs(t(spark, d, "customer"), ["c_acctbal", "c_nationkey", "c_custkey"], "c_custkey").select("column_a", "column_b", F.round("spearman", 6).alias("spearman"))


def _wide(spark, d):
    return t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", F.col("l_quantity").alias("same"), (F.col("l_quantity") * 2 + 1).alias("twice"), "l_tax", (F.col("l_tax") * -3).alias("minus"), "l_discount")


_WIDE = ["l_quantity", "same", "twice", "l_tax", "minus", "l_discount"]
_WIDESQL = "w AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_quantity, l_quantity AS same, l_quantity * 2 + 1 AS twice, l_tax, l_tax * -3 AS minus, l_discount FROM lineitem)"
_WIDEPAIRS = [(a, b) for i, a in enumerate(_WIDE) for b in _WIDE[i + 1 :]]
_STRONG = "c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM w" for a, b in _WIDEPAIRS) + "), e AS (SELECT a, b FROM c WHERE abs(r) >= 0.98 UNION SELECT b, a FROM c WHERE abs(r) >= 0.98)"


@query(f"WITH RECURSIVE {_WIDESQL}, {_STRONG}, reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS column_name, min(b) AS cluster FROM reach GROUP BY a")
def corr_clusters(spark, d):
    return A.correlation_clusters(A.pair_correlations(_wide(spark, d), _WIDE))


_SAME = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS DISTINCT FROM {b}) AS differ FROM w" for i, a in enumerate(_WIDE[:4]) for j, b in enumerate(_WIDE[:4]) if i < j)


@query(f"WITH {_WIDESQL}, p AS ({_SAME}) SELECT first(a ORDER BY i) AS first_column, b AS column_name FROM p WHERE differ = 0 GROUP BY b")
def duplicate_columns(spark, d):
    return A.duplicate_columns(_wide(spark, d), "id", _WIDE[:4])


@query("""WITH i AS (SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS d, count(o_orderkey) AS n, count(*) AS a FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(o_custkey), count(*) FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(o_orderstatus), count(*) FROM orders)
SELECT c AS column_name FROM i WHERE d + CASE WHEN a > n THEN 1 ELSE 0 END <= 1 OR (d = a AND n = a) UNION SELECT 'o_custkey' FROM orders HAVING count(*) FILTER (o_orderkey IS DISTINCT FROM o_custkey) = 0""")
def recommended_exclusions(spark, d):
    o = t(spark, d, "orders")
    return A.recommended_exclusions(A.column_inventory(o, ["o_orderkey", "o_custkey", "o_orderstatus"]), A.duplicate_columns(o, "o_orderkey", ["o_orderkey", "o_custkey"]))


@query(f"WITH {_WIDESQL}, {_STRONG}, k AS (SELECT *, row_number() OVER (ORDER BY abs(round(r, 9)) DESC, a, b) AS place FROM c WHERE abs(r) >= 0.5) SELECT CAST(place AS INTEGER) AS place, a AS column_a, b AS column_b, round(r, 6) AS pearson FROM k")
def strongest_pairs(spark, d):
    from pyspark.sql.window import Window

    p = A.pair_correlations(_wide(spark, d), _WIDE).withColumn("pearson", F.round("pearson", 9))
    rows = A.strongest_pairs(p, 0.5).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("pearson")), "column_a", "column_b")))  # one row a pair of columns
    return rows.select("place", "column_a", "column_b", F.round("pearson", 6).alias("pearson"))


@query(f"WITH RECURSIVE {_WIDESQL}, {_STRONG}, s AS (" + " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, count({c}) / count(*) AS share, stddev_pop({c}) AS sd FROM w" for i, c in enumerate(_WIDE)) + """),
live AS (SELECT i, c, row_number() OVER (ORDER BY i) AS k FROM s WHERE share >= 0.8 AND sd > 1e-8),
g(k, kept) AS (SELECT 0, CAST([] AS VARCHAR[]) UNION ALL SELECT g.k + 1, CASE WHEN EXISTS (SELECT 1 FROM c WHERE abs(c.r) >= 0.9 AND ((c.b = live.c AND list_contains(g.kept, c.a)) OR (c.a = live.c AND list_contains(g.kept, c.b)))) THEN g.kept ELSE list_append(g.kept, live.c) END FROM g JOIN live ON live.k = g.k + 1)
SELECT unnest(kept) AS column_name FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)""")
def feature_screen(spark, d):
    kept = screen_features(_wide(spark, d), _WIDE)
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


_CS = " UNION ALL ".join(f"SELECT corr({a}, {b}) FILTER (l_returnflag = 'A') AS ra, corr({a}, {b}) FILTER (l_returnflag <> 'A') AS rb FROM lineitem" for a, b in _PAIRCOLS)


@query(f"SELECT CAST(count(*) AS BIGINT) AS pairs, round(corr(ra, rb), 5) AS matrix_corr, round(avg(abs(ra - rb)), 6) AS mean_abs_diff, round(max(abs(ra - rb)), 6) AS max_abs_diff, round(sqrt(2 * sum((ra - rb) ** 2)), 6) AS frobenius FROM ({_CS})")
def corr_structure_similarity(spark, d):
    c = A.correlation_structure(t(spark, d, "lineitem"), F.col("l_returnflag") == "A", _LINE)
    return c.select("pairs", F.round("matrix_corr", 5).alias("matrix_corr"), *[F.round(x, 6).alias(x) for x in ("mean_abs_diff", "max_abs_diff", "frobenius")])


_U = "WITH x AS (SELECT n_chars AS v, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rk FROM x), g AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, sum(rk) FILTER (a) AS s FROM r)"


def _labelled(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")


@query(_U + " SELECT CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(s - na * (na + 1) / 2, 3) AS u, round((s - na * (na + 1) / 2) / (na * nb), 6) AS auc FROM g")
def mann_whitney_u(spark, d):
    return S.mann_whitney(_labelled(spark, d), "n_chars", F.col("quality") == 1).select("n_a", "n_b", F.round("u", 3).alias("u"), F.round("auc", 6).alias("auc"))


_UL = "x AS (SELECT lang, n_chars AS v, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY v) + (count(*) OVER (PARTITION BY lang, v) - 1) / 2 AS rk FROM x), tie AS (SELECT lang, sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (SELECT lang, v, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1), g AS (SELECT lang, CAST(count(*) FILTER (a) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS nb, sum(rk) FILTER (a) AS s FROM r GROUP BY 1)"
_ERFC = "CASE WHEN z >= 2 THEN exp(-z * z / 2) / sqrt(2 * pi()) / ({frac}) ELSE 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * ({series}) END"
_FRAC = "z"
for _k in range(40, 0, -1):
    _FRAC = f"(z + {_k} / {_FRAC})"
_SERIES = "z * (1" + "".join(f" + z * z / {2 * k + 1} * (1" for k in range(1, 30)) + ")" * 30


@query(f"WITH {_UL}, m AS (SELECT g.lang, abs(s - na * (na + 1) / 2 - na * nb / 2) - 0.5 AS off, na * nb / 12 * (na + nb + 1 - ties / nullif((na + nb) * (na + nb - 1), 0)) AS var FROM g JOIN tie ON g.lang IS NOT DISTINCT FROM tie.lang), z AS (SELECT lang, CASE WHEN var > 0 THEN greatest(off / sqrt(var), 0) END AS z FROM m) SELECT lang, round(z, 6) AS z, round(2 * ({_ERFC.format(frac=_FRAC, series=_SERIES)}), 6) AS p FROM z")
def mann_whitney_p(spark, d):
    return S.mann_whitney(_labelled(spark, d), "n_chars", F.col("quality") == 1, ["lang"]).select("lang", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("WITH x AS (SELECT n_chars AS v, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), g AS (SELECT v, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS b FROM x GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM g) SELECT round(max(abs(fa - fb)), 6) AS d FROM c")
def ks_statistic(spark, d):
    return S.ks_two_sample(_labelled(spark, d), "n_chars", F.col("quality") == 1).select(F.round("d", 6).alias("d"))


_KS = "x AS (SELECT source, n_chars AS v, toxic = 1 AS a FROM documents JOIN labels USING (doc_id)), g AS (SELECT source, v, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS b FROM x GROUP BY 1, 2), c AS (SELECT source, sum(a) OVER w / nullif(sum(a) OVER p, 0) AS fa, sum(b) OVER w / nullif(sum(b) OVER p, 0) AS fb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM g WINDOW w AS (PARTITION BY source ORDER BY v), p AS (PARTITION BY source)), ks AS (SELECT source, max(abs(fa - fb)) AS d, CAST(max(na) AS DOUBLE) AS na, CAST(max(nb) AS DOUBLE) AS nb FROM c GROUP BY 1), l AS (SELECT source, d, d * sqrt(na * nb / (na + nb)) AS lam FROM ks)"


@query(f"WITH {_KS}, p AS (SELECT source, d, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(least((SELECT sum(2 * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * lam * lam)) FROM (SELECT unnest(range(1, 60)) AS k)), 1.0), 0.0) END AS p FROM l), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(p) OVER () AS m FROM p WHERE d IS NOT NULL) SELECT source, round(d, 6) AS d, round(p, 6) AS p, round(least(min(p * m / i) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS p_adjusted FROM r")
def bh_adjusted_tests(spark, d):
    p = S.ks_two_sample(_labelled(spark, d), "n_chars", F.col("toxic") == 1, ["source"]).where("d is not null")
    return S.bh_adjust(p, "p").select("source", F.round("d", 6).alias("d"), F.round("p", 6).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"))


@query("WITH p AS (SELECT s_suppkey, s_suppkey / (1000.0 + s_suppkey) AS p FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p) SELECT s_suppkey, round(least(min(p * m / i) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 9) AS p_adjusted FROM k")
def bh_adjust(spark, d):
    p = t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") / (1000.0 + F.col("s_suppkey"))).alias("p"))
    return S.bh_adjust(p, "p").select("s_suppkey", F.round("p_adjusted", 9).alias("p_adjusted"))


@query("""WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS v, quality FROM documents JOIN labels USING (doc_id)), o AS (SELECT quality, v, row_number() OVER (PARTITION BY quality ORDER BY v) AS k, count(*) OVER (PARTITION BY quality) AS n FROM x),
i AS (SELECT unnest(range(200)) AS i), h AS (SELECT DISTINCT quality, n, i, greatest(least((n + 1/3) * (i / 199.0) + 1/3, n), 1) AS h FROM o CROSS JOIN i),
q AS (SELECT h.quality, i, a.v + (h - floor(h)) * (b.v - a.v) AS q FROM h JOIN o a ON a.quality = h.quality AND a.k = floor(h) JOIN o b ON b.quality = h.quality AND b.k = least(floor(h) + 1, h.n))
SELECT round(avg(abs(a.q - b.q)), 4) AS wasserstein FROM q a JOIN q b ON a.i = b.i AND a.quality = 1 AND b.quality = 0""")
def wasserstein_type8(spark, d):
    x = _labelled(spark, d).withColumn("v", F.col("n_chars").cast("double"))
    return S.wasserstein(x, "v", F.col("quality") == 1).select(F.round("wasserstein", 4).alias("wasserstein"))


@query("""WITH y AS (SELECT CAST(n_chars AS DOUBLE) AS v, quality FROM documents JOIN labels USING (doc_id)), m AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM y WHERE quality = 1), x AS (SELECT quality, (y.v - m) / s AS v FROM y CROSS JOIN m), o AS (SELECT quality, v, row_number() OVER (PARTITION BY quality ORDER BY v) AS k, count(*) OVER (PARTITION BY quality) AS n FROM x),
i AS (SELECT unnest(range(200)) AS i), h AS (SELECT DISTINCT quality, n, i, greatest(least((n + 1/3) * (i / 199.0) + 1/3, n), 1) AS h FROM o CROSS JOIN i),
q AS (SELECT h.quality, i, a.v + (h - floor(h)) * (b.v - a.v) AS q FROM h JOIN o a ON a.quality = h.quality AND a.k = floor(h) JOIN o b ON b.quality = h.quality AND b.k = least(floor(h) + 1, h.n))
SELECT round(avg(abs(a.q - b.q)), 6) AS wasserstein FROM q a JOIN q b ON a.i = b.i AND a.quality = 1 AND b.quality = 0""")
def wasserstein_standardised(spark, d):
    x = _labelled(spark, d).withColumn("v", F.col("n_chars").cast("double"))
    return S.wasserstein(x, "v", F.col("quality") == 1, standardise=True).select(F.round("wasserstein", 6).alias("wasserstein"))


@query()
def bootstrap_interval(spark, d):
    b = S.bootstrap(_labelled(spark, d), "n_chars", F.col("quality") == 1)
    return b.select("reps", *[F.round(c, 1).alias(c) for c in ("difference_low", "difference_high")])


@query()
def lmm_random_intercept(spark, d):
    o = t(spark, d, "orders").withColumn("x", F.datediff("o_orderdate", F.lit("1992-01-01")) / 365.0).withColumn("y", F.col("o_totalprice") / 1000)
    return S.random_intercept(o, "y", ["x"], "o_custkey").select("term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"))


def _children(spark, d):
    return t(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("cohort"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("age"), (F.col("c_custkey") % 4 == 0).alias("target"))


@query()
def optimal_match(spark, d):
    return D.optimal_match(_children(spark, d), "cohort", "id", "age", "target")


_CHILDREN = "c AS (SELECT c_nationkey % 5 AS cohort, c_custkey AS id, c_acctbal / 100 AS age, c_custkey % 4 = 0 AS target FROM customer), tg AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY age, id) AS k FROM c WHERE target)"


@query(f"""WITH RECURSIVE {_CHILDREN}, g(cohort, k, taken, target_id, control_id, gap) AS (SELECT DISTINCT cohort, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM c
UNION ALL SELECT n.cohort, n.k, list_append(n.taken, n.pick.id), n.id, n.pick.id, n.pick.gap FROM (SELECT g.cohort, tg.k, g.taken, tg.id, (SELECT first({{'id': x.id, 'gap': abs(tg.age - x.age)}} ORDER BY abs(x.age - tg.age), x.age, x.id) FROM c x WHERE NOT x.target AND x.cohort = g.cohort AND NOT list_contains(g.taken, x.id)) AS pick FROM g JOIN tg ON tg.cohort = g.cohort AND tg.k = g.k + 1) n)
SELECT cohort, target_id, control_id, gap FROM g WHERE k > 0""")
def greedy_match(spark, d):
    return D.greedy_match(_children(spark, d), "cohort", "id", "age", "target")


_AVAILABLE = "[" + ", ".join(f"CASE WHEN c_custkey % {i + 2} <> 0 THEN true ELSE false END" for i in range(6)) + "]"


@query(f"""WITH RECURSIVE c AS (SELECT c_nationkey % 5 AS cohort, c_custkey AS id, {_AVAILABLE} AS has, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS k FROM customer),
g(cohort, k, used, id, pick) AS (SELECT DISTINCT cohort, CAST(0 AS BIGINT), [0, 0, 0, 0, 0, 0], CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM c
UNION ALL SELECT n.cohort, n.k, CASE WHEN n.pick IS NULL THEN n.used ELSE list_transform(n.used, lambda x, i: CASE WHEN i = n.pick THEN x + 1 ELSE x END) END, n.id, n.pick FROM (SELECT g.cohort, c.k, g.used, c.id, CAST(list_min(list_transform(list_filter([1, 2, 3, 4, 5, 6], lambda i: c.has[i]), lambda i: g.used[i] * 10 + i)) % 10 AS BIGINT) AS pick FROM g JOIN c ON c.cohort = g.cohort AND c.k = g.k + 1) n)
SELECT cohort, id, ['A1', 'A2', 'A3', 'B1', 'B2', 'B3'][pick] AS story FROM g WHERE pick IS NOT NULL""")
def balanced_story_assignment(spark, d):
    c = _children(spark, d).select("cohort", "id", F.array(*[F.when(F.col("id") % (i + 2) != 0, F.lit(s)) for i, s in enumerate(D.STORIES)]).alias("has"))
    return D.balanced_stories(c, "cohort", "id", "has")


@query()
def balanced_prompt_choice(spark, d):
    slots = spark.range(60).select((F.col("id") % 5).cast("int").alias("cohort"), F.col("id").alias("slot"), (F.col("id") * 1.5).alias("want"))
    return D.balanced_prompts(slots, _children(spark, d).where("not target").drop("target"), "cohort", "slot", "want", "id", "age")


@query()
def pca_scores(spark, d):
    s, _ = pca(_suppliers(spark, d).na.fill(0), "l_suppkey", ["f1", "f2", "f3"], 2)
    return s.select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("pc1", "pc2")])


@query()
def isolation_qc(spark, d):
    return isolation_scores(_suppliers(spark, d), "l_suppkey", ["f1", "f2", "f3", "f4"]).select("l_suppkey", F.round("score", 4).alias("score"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return EV.windowed(t(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return EV.sessions(t(spark, d, "events"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def column_decisions(spark, d):
    from ..checks import apply_decisions

    return apply_decisions(t(spark, d, "customer"), {"c_custkey": "keep", "c_name": "drop", "c_nationkey": "drop", "c_acctbal": "keep", "c_mktsegment": "drop"})


@query("WITH p AS (SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), '|' ORDER BY s_suppkey) AS prompt_ids FROM supplier GROUP BY 1), e AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT s_nationkey, prompt_ids, CAST(coalesce(n, 0) AS BIGINT) AS eval_rows FROM p LEFT JOIN e ON s_nationkey = c_nationkey")
def fold_overview(spark, d):
    return D.fold_overview(t(spark, d, "supplier"), t(spark, d, "customer").withColumnRenamed("c_nationkey", "s_nationkey"), "s_nationkey", "s_suppkey")


@query("SELECT o_orderkey, coalesce(c_name, '') AS exemplar FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def exemplar_lookup(spark, d):
    n = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return D.with_exemplar(t(spark, d, "orders").select("o_orderkey", "o_custkey"), n, ["o_custkey"], "c_name", "exemplar").select("o_orderkey", "exemplar")
