"""Age norms, severity profiles, bands and percentiles against a reference group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import number, row_mean
from .stats import quantiles, running_counts

# Measures where more is better (their z is turned round) and where more is worse, and the scores they make up.
ABILITY = ["MLU_Morphemes", "VOCD_D_optimum_average", "IPSyn_Total", "DSS_tbl_score", "DSS_tbl_IP", "DSS_tbl_PP", "DSS_tbl_MV", "DSS_tbl_SV", "DSS_tbl_NG", "DSS_tbl_CNJ", "DSS_tbl_IR", "DSS_tbl_WHQ"]
BURDEN = ["Word_Errors_per_utt", "retracing_per_utt", "repetition_per_utt", "bare_marking_errors_per_word", "pronoun_errors_per_word", "past_overgeneralization_errors_per_past_opp"]
DOMAINS = {
    "severity_structural": ["MLU_Morphemes", "IPSyn_Total", "DSS_tbl_score", "DSS_tbl_MV"],
    "severity_lexical": ["VOCD_D_optimum_average"],
    "severity_disruption": ["Word_Errors_per_utt", "retracing_per_utt", "repetition_per_utt"],
    "severity_morphosyntax_burden": ["bare_marking_errors_per_word", "pronoun_errors_per_word", "past_overgeneralization_errors_per_past_opp"],
    "profile_dss_subscales": ["DSS_tbl_IP", "DSS_tbl_PP", "DSS_tbl_MV", "DSS_tbl_SV", "DSS_tbl_NG", "DSS_tbl_CNJ", "DSS_tbl_IR", "DSS_tbl_WHQ"],
}
CORE = ["MLU_Morphemes", "VOCD_D_optimum_average", "IPSyn_Total", "DSS_tbl_score", "Word_Errors_per_utt", "bare_marking_errors_per_word"]
LABELS = {"severity_structural": "structural", "severity_lexical": "lexical", "severity_disruption": "disruption", "severity_morphosyntax_burden": "morphosyntax_burden"}


def linear_norm(df: DataFrame, features: list[str], age: str, reference: Column, suffix: str = "td") -> DataFrame:
    """For each feature the value a line through the reference rows expects at that age, and the residual over the standard
    deviation of the reference residuals (n - 1).  All lines are fitted in two aggregates over the rows."""
    x = number(age)
    of = lambda f: F.when(reference & x.isNotNull() & number(f).isNotNull(), number(f))
    at = lambda f: F.when(of(f).isNotNull(), x)
    fit = df.agg(*[y for f in features for y in (F.regr_slope(of(f), at(f)).alias(f"{f}_s"), F.regr_intercept(of(f), at(f)).alias(f"{f}_i"))])
    out = df.crossJoin(F.broadcast(fit))  # one row
    out = out.withColumns({f"{f}_{suffix}_linear_expected": F.col(f"{f}_i") + F.col(f"{f}_s") * x for f in features})
    sd = out.agg(*[F.stddev_samp(of(f) - F.col(f"{f}_{suffix}_linear_expected")).alias(f"{f}_sd") for f in features])
    out = out.crossJoin(F.broadcast(sd))  # one row
    out = out.withColumns({f"{f}_{suffix}_linear_z": F.when(F.col(f"{f}_sd") > 0, (number(f) - F.col(f"{f}_{suffix}_linear_expected")) / F.col(f"{f}_sd")) for f in features})
    return out.drop(*[f"{f}_{k}" for f in features for k in ("s", "i", "sd")])


def spline_basis(x: Column, lower: float, inner: float, upper: float) -> list[Column]:
    """Cubic B-splines with one inner knot (five functions that add up to 1), as column expressions."""
    knots = [lower] * 4 + [inner] + [upper] * 4
    x = F.greatest(F.least(x, F.lit(upper)), F.lit(lower))
    level = [F.when((x >= knots[i]) & ((x < knots[i + 1]) | (F.lit(knots[i + 1] == upper) & (x <= upper))), 1.0).otherwise(0.0) if knots[i] < knots[i + 1] else F.lit(0.0) for i in range(8)]
    for d in range(1, 4):
        nxt = []
        for i in range(8 - d):
            a, b = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            left = level[i] * (x - knots[i]) / a if a > 0 else F.lit(0.0)
            right = level[i + 1] * (knots[i + d + 1] - x) / b if b > 0 else F.lit(0.0)
            nxt.append(left + right)
        level = nxt
    return level


def spline_norm(df: DataFrame, features: list[str], age: str, reference: Column, suffix: str = "td") -> DataFrame:
    """As ``linear_norm``, with a cubic spline of four degrees of freedom.  The inner knot is the median reference age, learned
    once and used for all rows; the normal equations are summed in Spark and solved on the driver (5 x 5 a feature)."""
    x = number(age)
    lo, mid, hi = df.where(reference).agg(F.min(x), F.percentile(x, F.lit(0.5)), F.max(x)).first()
    if lo is None or not lo < hi:
        return df.withColumns({f"{f}_{suffix}_{k}": F.lit(None).cast("double") for f in features for k in ("expected", "z")})
    basis = spline_basis(x, float(lo), float(mid), float(hi))
    b = [f"_b{i}" for i in range(len(basis))]
    out = df.withColumns(dict(zip(b, basis)))
    ok = lambda f: reference & x.isNotNull() & number(f).isNotNull()
    sums = [F.sum(F.when(ok(f), F.col(p) * F.col(q))).alias(f"{f}|{i}|{j}") for f in features for i, p in enumerate(b) for j, q in enumerate(b) if i <= j]
    sums += [F.sum(F.when(ok(f), F.col(p) * number(f))).alias(f"{f}|{i}|y") for f in features for i, p in enumerate(b)]
    r = out.agg(*sums).first().asDict()
    for f in features:
        m = np.array([[r[f"{f}|{min(i, j)}|{max(i, j)}"] or 0.0 for j in range(5)] for i in range(5)])
        w = np.linalg.lstsq(m, np.array([r[f"{f}|{i}|y"] or 0.0 for i in range(5)]), rcond=None)[0]
        out = out.withColumn(f"{f}_{suffix}_expected", F.when(x.isNotNull(), sum((F.col(p) * float(c) for p, c in zip(b, w)), F.lit(0.0))))
    sd = out.agg(*[F.stddev_samp(F.when(ok(f), number(f) - F.col(f"{f}_{suffix}_expected"))).alias(f"{f}_sd") for f in features])
    out = out.crossJoin(F.broadcast(sd))  # one row
    out = out.withColumns({f"{f}_{suffix}_z": F.when(F.col(f"{f}_sd") > 0, (number(f) - F.col(f"{f}_{suffix}_expected")) / F.col(f"{f}_sd")) for f in features})
    return out.drop(*b, *[f"{f}_sd" for f in features])


def severity_profile(df: DataFrame, meta: list[str], caution: str = "DSS_tbl_warning_50") -> DataFrame:
    """Every z in the direction of severity, means by domain and composites, caution flag."""
    z = lambda f: f"{f}_severity_z"
    out = df.select(*meta, *[(-number(f"{f}_td_z")).alias(z(f)) for f in ABILITY], *[number(f"{f}_td_z").alias(z(f)) for f in BURDEN])
    out = out.withColumns({d: row_mean([z(f) for f in fs]) for d, fs in DOMAINS.items()})
    return out.withColumns({"severity_core_composite": row_mean([z(f) for f in CORE]), "severity_domain_composite": row_mean(list(LABELS)), "severity_use_with_caution": F.col(caution).cast("int")})


def profile_label(cols: dict[str, str], margin: float = 0.35) -> Column:
    """Name of the largest column if it leads by ``margin``, else ``balanced``; NULL if any is missing.  Ties go by order."""
    cells = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(i).alias("o"), F.lit(n).alias("n")) for i, (c, n) in enumerate(cols.items())]))
    missing = F.exists(F.array(*[F.col(c) for c in cols]), lambda x: x.isNull() | F.isnan(x))
    return F.when(~missing, F.when(cells[1]["v"] - cells[0]["v"] < margin, "balanced").otherwise(cells[0]["n"]))


def tertile_bands(df: DataFrame, score: str, reference: Column, names: tuple[str, str, str] = ("mild", "moderate", "severe")) -> DataFrame:
    """Bands by the tertiles of the reference rows, for all rows (``band``) and for those of the reference (``band_reference``)."""
    cut = quantiles(df.where(reference), score, {"_cut1": 1 / 3, "_cut2": 2 / 3}).drop("n")
    s = F.col(score)
    band = F.when(s <= F.col("_cut1"), names[0]).when(s <= F.col("_cut2"), names[1]).when(s.isNotNull() & F.col("_cut1").isNotNull(), names[2])
    return df.join(F.broadcast(cut), how="left").withColumn("band", band).withColumn("band_reference", F.when(reference, F.col("band"))).drop("_cut1", "_cut2")  # one row


def band_counts(banded: DataFrame, band: str = "band_reference") -> DataFrame:
    """Rows in each band; rows without one are left out."""
    return banded.where(F.col(band).isNotNull()).groupBy(band).agg(F.count("*").alias("n"))


def reference_percentile(df: DataFrame, score: str, reference: Column, name: str = "percentile") -> DataFrame:
    """Share of reference rows whose score is at most the row's: distinct scores are counted first, and counts run over ranges
    of them."""
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_v")).agg(F.count_if(reference).alias("r"))
    share = running_counts(per, "_v", ["r"]).select("_v", F.try_divide(F.col("run_r").cast("double"), F.col("all_r")).alias(name))
    return df.join(share, df[score] == share["_v"], "left").drop("_v")


# Numbers as words in the names of cohorts.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


def cohort(age: Column | str) -> Column:
    """``4-year-old`` for an age of 48 to 59 months."""
    return F.concat(F.floor(number(age) / 12).cast("string"), F.lit("-year-old"))


def cohort_label(low: int, high: int) -> str:
    """Name of the inclusive bin of ages in months: ``4-year-old`` if it is one year, else ``50to59_months``."""
    return f"{low // 12}-year-old" if low // 12 == high // 12 and low % 12 == 0 and high % 12 == 11 else f"{low}to{high}_months"


def cohort_slug(label: Column | str) -> Column:
    """``four_year_old`` for ``4-year-old`` (up to twelve); other labels in lower case with underscores, ``cohort`` if empty."""
    c = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    word = F.get(F.array(*[F.lit(w) for w in NUMBER_WORDS]), F.regexp_extract(c, r"^(\d{1,4})-year-old$", 1).try_cast("int"))
    plain = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(word.isNotNull(), F.concat(word, F.lit("_year_old"))).when(plain != "", plain).otherwise("cohort")


def reference_z(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(group, feature, n, mean, sd, safe sd): population standard deviation, 1 where it is 0 or n is 1."""
    long = df.select(group, *[number(f).alias(f) for f in features]).unpivot([group], features, "feature", "value")
    g = long.groupBy(group, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return g.withColumn("safe_sd", F.when((F.col("n") <= 1) | F.col("sd").isNull() | (F.col("sd") <= 0), 1.0).otherwise(F.col("sd")))
