"""Statistics: summaries, rank tests, distances between distributions, bootstrap, mixed models."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_on(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns in which null equals null; the columns of ``a``, then the others of ``b``."""
    if not on:
        return a.join(F.broadcast(b), F.lit(True), how)  # one row
    b = b.withColumnsRenamed({c: f"_on_{c}" for c in on})
    cond = reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"_on_{c}"]) for c in on))
    return a.join(b, cond, how).drop(*[f"_on_{c}" for c in on])


def cut_points(df: DataFrame, value: str, parts: int = 64) -> list:
    """Values that part ``df`` into about equal ranges (one job)."""
    return sorted(set(df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000)).first()[0] or []))


def _ranges(per: DataFrame, value: str, counts: list[str], by: list[str], cuts: list) -> tuple[DataFrame, DataFrame]:
    """``per`` (one row a distinct value) with ``_part``, the range of values it falls in, and ``_r_<c>``, the count up to it within
    the range; and a row a range with its total ``_t_<c>``, the count ``_b_<c>`` before it, and that of the group ``all_<c>``."""
    p = per.withColumn("_part", sum(((F.col(value) > c).cast("int") for c in cuts), F.lit(0)))
    within = Window.partitionBy(*by, "_part").orderBy(value)
    ahead, group = Window.partitionBy(*by).orderBy("_part"), Window.partitionBy(*by)
    total = p.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    total = total.select(*by, "_part", *[f"_t_{c}" for c in counts], *[(F.sum(f"_t_{c}").over(ahead) - F.col(f"_t_{c}")).alias(f"_b_{c}") for c in counts], *[F.sum(f"_t_{c}").over(group).alias(f"all_{c}") for c in counts])
    return p.withColumns({f"_r_{c}": F.sum(c).over(within) for c in counts}), total


def running_counts(per: DataFrame, value: str, counts: list[str], by: list[str] | None = None) -> DataFrame:
    """``per`` (one row a distinct value) with ``run_<c>``, the count up to the value, and ``all_<c>``, that of the group.

    Values are dealt to ranges at approximate quantiles, so that no group is sorted in one task; a range's start is the sum
    of the ranges before it (at most 64 rows a group)."""
    by = by or []
    p, total = _ranges(per, value, counts, by, cut_points(per, value))
    j = join_on(p, total.drop(*[f"_t_{c}" for c in counts]), [*by, "_part"])
    return j.select(*per.columns, *[(F.col(f"_r_{c}") + F.col(f"_b_{c}")).alias(f"run_{c}") for c in counts], *[f"all_{c}" for c in counts])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, kind: str = "linear", cuts: list | None = None, weight: str | None = None) -> DataFrame:
    """(by, n, one column for each named probability): exact quantiles by linear interpolation, or of type 8 (position
    (n + 1/3) p + 1/3 between order statistics).  Null and NaN values are left out, and so are groups without others.  A row
    stands for ``weight`` equal ones, if given.

    Ranks are looked up in counts per distinct value, in the one range of values that holds them: no group's values are
    gathered or sorted in one place."""
    by = by or []
    v = F.col(value).cast("double")
    per = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("v")).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    p, total = _ranges(per, "v", ["c"], by, cut_points(per, "v") if cuts is None else cuts)
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(x)).alias("p")) for n, x in probs.items()]))
    n = F.col("n")
    at = 1 + (n - 1) * F.col("p") if kind == "linear" else F.greatest(F.least((n + 1 / 3) * F.col("p") + 1 / 3, n.cast("double")), F.lit(1.0))
    ask = total.select(*by, F.col("all_c").alias("n")).distinct().select(*by, "n", asked.alias("a")).select(*by, "n", "a.name", "a.p").withColumn("h", at).withColumn("k", F.floor("h").cast("long"))
    ask = ask.withColumn("rank", F.explode(F.array("k", F.least(F.col("k") + 1, "n"))))
    ask = join_on(ask, total, by).where("rank > _b_c and rank <= _b_c + _t_c").select(*by, "_part", "n", "name", "h", "k", (F.col("rank") - F.col("_b_c")).alias("rank"))
    got = join_on(ask, p, [*by, "_part"]).where("rank > _r_c - c and rank <= _r_c").groupBy(*by, "n", "name", "h", "k").agg(F.min("v").alias("x"), F.max("v").alias("y"))
    return got.groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == x, F.col("x") + (F.col("h") - F.col("k")) * (F.col("y") - F.col("x")))).alias(x) for x in probs])


def quantiles_of(df: DataFrame, columns: list[str], probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, ``<column>_<name>`` for each column and probability): the quantiles of several columns in one plan."""
    by = by or []
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, F.col("x.m").alias("_m"), F.col("x.v").alias("_x"))
    q = quantiles(long, "_x", probs, [*by, "_m"])
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("_m") == c, F.col(n))).alias(f"{c}_{n}") for c in columns for n in probs])


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sd, min, quartiles (linear interpolation) and max."""
    by = by or []
    v = F.col(value)
    plain = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by).drop("n")
    return join_on(plain, q, by, "left").select(*by, "n", "mean", "sd", "min", "q25", "median", "q75", "max")


def describe_distinct(df: DataFrame, item: str, by: list[str]) -> DataFrame:
    """Summary, over the groups, of how many different items each has."""
    return describe(df.groupBy(*by).agg(F.countDistinct(item).alias("items")), "items")


def with_group_max(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rows with the largest value of their group, by a join on pre-aggregated maxima."""
    return join_on(df, df.groupBy(*by).agg(F.max(value).alias(name)), by)


def ranked_in_group(df: DataFrame, by: list[str], value: str, ties: list[str], name: str) -> DataFrame:
    """Rows numbered from the largest value down, ties in the order of other columns (reports and folds: small groups)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), *ties)))


def _runs(df: DataFrame, value: str, side: Column, by: list[str]) -> DataFrame:
    """Counts of each side at each distinct value, with running counts and totals."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    r = running_counts(g, "v", ["a", "b"], by).withColumnsRenamed({"run_a": "ca", "run_b": "cb", "all_a": "na", "all_b": "nb"})
    return r.withColumn("below", F.col("ca") + F.col("cb") - F.col("a") - F.col("b"))


def mann_whitney(df: DataFrame, value: str, side: Column, by: list[str] | None = None) -> DataFrame:
    """(n_a, n_b, u, auc, p): U of the rows of ``side`` from average ranks; two-sided p by the normal approximation with tie and
    continuity correction."""
    by = by or []
    r = _runs(df, value, side, by)
    n = F.col("a") + F.col("b")
    rank = F.col("below") + (n + 1) / 2
    g = r.groupBy(*by).agg(F.sum(F.col("a") * rank).alias("rank_sum"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"), F.sum(n * n * n - n).cast("double").alias("ties"))
    prod = (F.col("n_a") * F.col("n_b")).cast("double")
    u = F.col("rank_sum") - F.col("n_a") * (F.col("n_a") + 1) / 2
    m = (F.col("n_a") + F.col("n_b")).cast("double")
    var = prod / 12 * (m + 1 - F.try_divide(F.col("ties"), m * (m - 1)))
    z = (F.abs(u - prod / 2) - 0.5) / F.sqrt(var)
    out = g.withColumn("u", u).withColumn("auc", F.try_divide(F.col("u"), prod)).withColumn("z", F.when(var > 0, F.greatest(z, F.lit(0.0))))
    return out.withColumn("p", normal_tail(F.col("z")) * 2).select(*by, "n_a", "n_b", "u", "auc", "z", "p")


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution: a continued fraction from 2 on, the series of the distribution function below."""
    phi = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    frac = z
    for k in range(40, 0, -1):
        frac = z + k / frac
    term, total = z, z
    for k in range(1, 30):
        term = term * z * z / (2 * k + 1)
        total = total + term
    return F.when(z >= 2, phi / frac).otherwise(0.5 - phi * total)


def ks_two_sample(df: DataFrame, value: str, side: Column, by: list[str] | None = None) -> DataFrame:
    """(n_a, n_b, d, p): largest gap of the two distribution functions; asymptotic p."""
    by = by or []
    g = _runs(df, value, side, by).groupBy(*by).agg(F.max("na").alias("n_a"), F.max("nb").alias("n_b"), F.max(F.abs(F.try_divide(F.col("ca").cast("double"), F.col("na")) - F.try_divide(F.col("cb").cast("double"), F.col("nb")))).alias("d"))
    lam = F.col("d") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2 * k * k * lam * lam) for k in range(1, 60)), F.lit(0.0))
    return g.withColumn("p", F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0))))


def bh_adjust(df: DataFrame, p: str, by: list[str] | None = None, name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg: least p * m / rank from this rank upwards (one row a test)."""
    by = by or []
    t = Window.partitionBy(*by)
    up = Window.partitionBy(*by).orderBy(p)
    raw = F.col(p) * F.count(p).over(t) / F.row_number().over(up)
    return df.withColumn("_raw", raw).withColumn(name, F.least(F.min("_raw").over(up.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("_raw")


def type8_quantiles(df: DataFrame, value: str, probs: int, by: list[str]) -> DataFrame:
    """(by, i, q): quantiles at i / (probs - 1), of type 8."""
    q = quantiles(df, value, {str(i): i / (probs - 1) for i in range(probs)}, by, "type8")
    return q.select(*by, F.posexplode(F.array(*[F.col(str(i)) for i in range(probs)])).alias("i", "q"))


def wasserstein(df: DataFrame, value: str, side: Column, by: list[str] | None = None, probs: int = 200, standardise: bool = False) -> DataFrame:
    """Mean absolute difference of ``probs`` type-8 quantiles; ``standardise``: in units of the side's own mean and sd."""
    by = by or []
    d = df.withColumn("_side", side)
    if standardise:
        own = d.where("_side").groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        d = join_on(d, own, by).withColumn(value, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")))
    q = type8_quantiles(d, value, probs, [*by, "_side"])
    a, b = q.where("_side").select(*by, "i", F.col("q").alias("qa")), q.where("not _side").select(*by, "i", F.col("q").alias("qb"))
    return join_on(a, b, [*by, "i"]).groupBy(*by).agg(F.avg(F.abs(F.col("qa") - F.col("qb"))).alias("wasserstein"))


def _median_ranks(g: np.random.Generator, n: int, reps: int) -> np.ndarray:
    """(reps, 2): the ranks, among n sorted rows, of the two middle rows (the same if n is odd) of n rows drawn with replacement.

    The k-th smallest of n uniform draws is Beta(k, n - k + 1), the next one the least of n - k draws above it."""
    k = (n + 1) // 2
    u = g.beta(k, n - k + 1, reps)
    v = u if n % 2 else u + (1 - u) * g.beta(1, n - k, reps)
    return np.clip(np.ceil(np.column_stack([u, v]) * n), 1, n).astype(np.int64)


def bootstrap(df: DataFrame, value: str, side: Column, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """Percentile intervals of the difference and ratio of medians of two sides (1,000 repetitions at least), over all rows.

    A repetition only needs the values at the ranks its medians fall on, so these are drawn and looked up in the running counts
    per distinct value: the driver gets four values a repetition, whatever the input."""
    import pandas as pd

    reps = max(1000, reps)
    runs = _runs(df.select(side.alias("_s"), F.col(value).cast("double").alias("_v")).where("_s is not null"), "_v", F.col("_s"), []).cache()
    size = runs.agg(F.max("na").alias("na"), F.max("nb").alias("nb")).first()
    sides = {"a": size["na"] or 0, "b": size["nb"] or 0}
    ranks = {x: _median_ranks(np.random.default_rng([seed, i]), n, reps) for i, (x, n) in enumerate(sides.items()) if n}
    wanted = {x: np.unique(r) for x, r in ranks.items()}

    def look(batches):
        for pdf in batches:
            for x, r in wanted.items():
                hi = pdf[f"c{x}"].to_numpy(np.int64)
                lo, hi = np.searchsorted(r, hi - pdf[x].to_numpy(np.int64), "right"), np.searchsorted(r, hi, "right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(lo, hi)] or [np.arange(0)])
                yield pd.DataFrame({"x": x, "r": r[at], "v": np.repeat(pdf["v"].to_numpy(), hi - lo)})

    found = runs.select("v", "a", "b", "ca", "cb").mapInPandas(look, "x string, r long, v double").toPandas() if wanted else None
    runs.unpersist()
    medians = {}
    for x in sides:
        if x in wanted:
            v = found[found.x == x].sort_values("r")["v"].to_numpy()
            medians[x] = v[np.searchsorted(wanted[x], ranks[x])].mean(1)
        else:
            medians[x] = np.full(reps, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        draws = df.sparkSession.createDataFrame(pd.DataFrame({"difference": medians["b"] - medians["a"], "ratio": medians["b"] / medians["a"]}), "difference double, ratio double")
    ci = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.agg(F.count("*").alias("reps"), ci("difference")[0].alias("difference_low"), ci("difference")[1].alias("difference_high"), ci("ratio")[0].alias("ratio_low"), ci("ratio")[1].alias("ratio_high"))


def random_intercept(df: DataFrame, outcome: str, predictors: list[str], cluster: str) -> DataFrame:
    """One linear model with a random intercept: (term, estimate, se), then sigma, tau and log likelihood (``mixed`` fits many)."""
    from .mixed import linear_models

    rows = []
    for f in linear_models(df, [outcome], {"m": predictors}, cluster).collect():  # one row
        rows += [(n, b, math.sqrt(max(f["covariance"][i][i], 0.0))) for i, (n, b) in enumerate(zip(f["terms"], f["estimate"]))]
        rows += [(n, f[n], None) for n in ("sigma", "tau", "log_likelihood")]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double")


def likelihood_ratio(a: DataFrame, b: DataFrame, extra: int) -> float:
    """p of the likelihood-ratio test between nested models that differ by ``extra`` terms."""
    ll = [d.where("term = 'log_likelihood'").first()["estimate"] for d in (a, b)]
    return chi_square_tail(max(0.0, 2 * (ll[1] - ll[0])), extra)


def marginal_means(model: DataFrame, at: dict[str, dict[str, float]]) -> DataFrame:
    """Estimated means at stated predictor values, and all their differences (linear combinations of the coefficients)."""
    b = {r["term"]: r["estimate"] for r in model.collect()}  # one row a term
    mean = {n: b["intercept"] + sum(b[k] * v for k, v in x.items()) for n, x in at.items()}
    names = list(at)
    rows = [(n, None, mean[n]) for n in names] + [(p, q, mean[p] - mean[q]) for i, p in enumerate(names) for q in names[i + 1 :]]
    return model.sparkSession.createDataFrame(rows, "level string, minus string, estimate double")


def slice_summary(real: DataFrame, synthetic: DataFrame, group: str, story: str, value: str) -> DataFrame:
    """By (group, story), group and overall (``*``): medians of both sides, their ratio, and the share of synthetic values within
    the real quartiles.  Rows are counted by slice and value first, and only those counts go to the three levels."""
    star = F.lit("*")

    def levels(df: DataFrame) -> DataFrame:
        per = df.where(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("a"), F.col(story).cast("string").alias("b"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
        names = F.explode(F.array(*[F.struct(g.alias("g"), t.alias("s")) for g, t in ((F.col("a"), F.col("b")), (F.col("a"), star), (star, star))]))
        return per.select(names.alias("k"), "v", "c").groupBy("k.g", "k.s", "v").agg(F.sum("c").alias("c"))

    by, a, b = ["g", "s"], levels(real), levels(synthetic)
    cuts = cut_points(a, "v")
    ref = quantiles(a, "v", {"real_median": 0.5, "lo": 0.25, "hi": 0.75}, by, cuts=cuts, weight="c").withColumnRenamed("n", "n_real")
    inside = F.col("v").between(F.col("lo"), F.col("hi")).cast("int")
    share = join_on(b, ref, by, "left").groupBy(*by, "n_real", "real_median").agg(F.sum("c").alias("n_synthetic"), (F.sum(F.col("c") * inside) / F.sum(F.when(inside.isNotNull(), F.col("c")))).alias("share_in_iqr"))
    got = join_on(share, quantiles(b, "v", {"synthetic_median": 0.5}, by, cuts=cuts, weight="c").drop("n"), by, "left")
    return got.select(*by, "n_real", "real_median", "n_synthetic", "synthetic_median", "share_in_iqr", F.when(F.col("real_median") != 0, F.col("synthetic_median") / F.col("real_median")).alias("median_ratio"))


def chi_square_tail(x: float, degrees: int) -> float:
    """Upper tail of the chi-square distribution."""
    k = degrees / 2
    term = total = 1 / math.gamma(k + 1)
    for i in range(1, 400):
        term *= x / 2 / (k + i)
        total += term
    return max(0.0, 1 - math.exp(-x / 2) * (x / 2) ** k * total) if x < 300 else 0.0


def nested_models(df: DataFrame, outcome: str, steps: list[list[str]], cluster: str) -> DataFrame:
    """(model, terms, log_likelihood, chi_square, degrees, p): random-intercept models that add the predictors of each step,
    and the likelihood-ratio test of each against the one before."""
    from .mixed import likelihood_ratios, linear_models

    models = {f"m{i}": [c for s in steps[:i] for c in s] for i in range(len(steps) + 1)}
    d = likelihood_ratios(linear_models(df, [outcome], models, cluster))
    return d.select("model", (F.col("parameters") - 3).alias("terms"), "log_likelihood", "chi_square", "degrees", "p")
