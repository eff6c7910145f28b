"""Models with a random intercept per cluster: many outcomes and nested models at once, binomial outcomes, and what is read from
their coefficients: tables, likelihood ratios, marginal means, contrasts.

A term is a column, or columns joined by ``:``, which is their product.  A fit is one row, whatever the model:
(outcome, model, rows, clusters, terms, estimate, covariance, sigma, tau, log_likelihood, parameters); the functions below it
take any table of fits.  Tests are asymptotic (normal, chi-square) unless degrees of freedom are given.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_kept, kept
from .stats import chi_square_tail

FIT = "outcome string, model string, rows long, clusters long, terms array<string>, estimate array<double>, covariance array<array<double>>, sigma double, tau double, log_likelihood double, parameters int"
INTERCEPT = "intercept"


def crossed(*names: str) -> list[str]:
    """All terms of a full crossing: ``crossed("a", "b")`` is a, b, a:b."""
    return [":".join(c) for k in range(1, len(names) + 1) for c in combinations(names, k)]


def term(name: str) -> Column:
    return reduce(lambda a, b: a * b, (F.col(c).cast("double") for c in name.split(":")))


def _usable(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() & ~F.isnan(c) for c in columns))


# ---------------------------------------------------------------- linear models
def sufficient_statistics(df: DataFrame, outcomes: list[str], terms: list[str], cluster: str) -> DataFrame:
    """(outcome, n, clusters, p<i>_<j>, q<i>_<j>): what the likelihoods of all models within ``terms`` need of all rows.

    Column 0 is the intercept, then come the terms, last the outcome.  ``p`` sums products of two columns over all rows, ``q``
    products of their sums per cluster, for the clusters with ``n`` rows: clusters of one size add up alike.  One pass serves
    every outcome and model, rows are summed before they are shuffled, and a row with a gap is left out of the outcome (of all
    its models, so that these stay comparable); rows without a cluster are one cluster."""
    named = [F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes]
    x = [term(c).alias(f"x{i + 1}") for i, c in enumerate(terms)]
    d = df.select(F.col(cluster).alias("c"), F.lit(1.0).alias("x0"), *x, F.inline(F.array(*named)))
    cols = [*(f"x{i}" for i in range(len(terms) + 1)), "y"]
    d = d.where(_usable(*map(F.col, cols[1:])))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    per = d.groupBy("outcome", "c").agg(F.count("*").alias("n"), *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)])
    return per.groupBy("outcome", "n").agg(F.count("*").alias("clusters"), *[F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i, j in pairs])


class _Profile:
    """The profile likelihood of one model, by the ratio of the variances, from sufficient statistics by cluster size."""

    def __init__(self, n: np.ndarray, k: np.ndarray, p: np.ndarray, q: np.ndarray):
        self.n, self.k, self.p, self.q, self.total = n, k, p.sum(0), q, float((n * k).sum())

    def at(self, theta: float):
        shrink = theta / (1 + theta * self.n)
        a = self.p - np.tensordot(shrink, self.q, 1)
        xx, xy = a[:-1, :-1], a[:-1, -1]
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        rss = max(a[-1, -1] - beta @ xy, 1e-300)
        ll = -0.5 * (self.total * math.log(2 * math.pi * rss / self.total) + float((self.k * np.log1p(theta * self.n)).sum()) + self.total)
        return ll, beta, rss / self.total, xx

    def best(self):
        grid = [0.0, *np.geomspace(1e-6, 1e4, 120)]
        k = max(range(len(grid)), key=lambda i: self.at(grid[i])[0])
        lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
        for _ in range(80):
            a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
            lo, hi = (lo, b) if self.at(a)[0] >= self.at(b)[0] else (a, hi)
        theta = max((0.0, (lo + hi) / 2), key=lambda t: self.at(t)[0])
        return theta, *self.at(theta)


def linear_models(df: DataFrame, outcomes: list[str], models: dict[str, list[str]], cluster: str) -> DataFrame:
    """Fits by maximum likelihood: every model (its terms) of every outcome, each outcome in a task of its own.

    The statistics of all terms are gathered once; a model takes those of its own terms.  An outcome without usable rows has no
    fit; a term that others determine shares their effect (least-norm solution)."""
    terms = list(dict.fromkeys(c for m in models.values() for c in m))
    stats = sufficient_statistics(df, outcomes, terms, cluster)
    m = len(terms) + 2

    def matrix(pdf: pd.DataFrame, letter: str) -> np.ndarray:
        out = np.zeros((len(pdf), m, m))
        for i in range(m):
            for j in range(i, m):
                out[:, i, j] = out[:, j, i] = pdf[f"{letter}{i}_{j}"].to_numpy(np.float64)
        return out

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        n, k = pdf["n"].to_numpy(np.float64), pdf["clusters"].to_numpy(np.float64)
        p, q, rows = matrix(pdf, "p"), matrix(pdf, "q"), []
        for name, own in models.items():
            at = [0, *(terms.index(c) + 1 for c in own), m - 1]
            theta, ll, beta, s2, xx = _Profile(n, k, p[:, at][:, :, at], q[:, at][:, :, at]).best()
            rows.append((pdf["outcome"].iloc[0], name, int((n * k).sum()), int(k.sum()), [INTERCEPT, *own], beta.tolist(), (np.linalg.pinv(xx) * s2).tolist(), math.sqrt(s2), math.sqrt(theta * s2), float(ll), len(own) + 3))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")])

    return stats.groupBy("outcome").applyInPandas(fit, FIT)  # a row a cluster size


# ---------------------------------------------------------------- binomial models
def _ln_factorial(c: Column) -> Column:
    """ln(c!) by Stirling's series at c + 8."""
    z = c + 8.0
    big = 0.5 * F.log(2 * math.pi / z) + z * (F.log(z) - 1) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return big - sum((F.log(c + float(i)) for i in range(1, 8)), F.lit(0.0))


class _Binomial:
    """Laplace's approximation of the likelihood of a binomial model with one random intercept, cluster by cluster in Spark.

    With eta = x'b + s u, u standard normal, a cluster's integral is taken at its mode of u.  The modes are the state: a table
    with one row a cluster, written anew in every pass, together with how the mode moves when b or s move, so that the next
    pass starts next to its modes.  The driver gets one row of sums a pass."""

    def __init__(self, rows: DataFrame, cluster: str, p: int):
        self.rows, self.cluster, self.p, self.passes = rows, cluster, p, 0

    def start(self) -> DataFrame:
        """One row a cluster, at the mode 0, with no way to go."""
        still = {c: F.lit(0.0) for c in ("u", "step", "dus", *(f"du{j}" for j in range(self.p)))}
        return self.rows.select(self.cluster).distinct().withColumns(still)

    def sweep(self, last: DataFrame, beta: np.ndarray, sigma: float, d_beta: np.ndarray | None = None, d_sigma: float = 0.0) -> tuple[DataFrame, dict]:
        """The table of the clusters at the parameters, and its totals.  The modes come from the last table: a Newton step, and the
        way they go when the parameters move by ``d_beta`` and ``d_sigma``."""
        p, self.passes = self.p, self.passes + 1
        # a row of parameters, not literals: every pass runs the same compiled code
        row = [*map(float, beta), float(sigma), *map(float, np.zeros(p) if d_beta is None else d_beta), float(d_sigma)]
        given = self.rows.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{c} double" for c in [*(f"b{j}" for j in range(p)), "s", *(f"db{j}" for j in range(p)), "ds"]))
        x, s, u, h = [F.col(f"x{j}") for j in range(p)], F.col("s"), F.col("u"), F.col("h")
        to = u + F.col("step") + F.col("ds") * F.col("dus") + sum((F.col(f"db{j}") * F.col(f"du{j}") for j in range(p)), F.lit(0.0))
        state = last.crossJoin(F.broadcast(given)).select(F.col(self.cluster).alias("_c"), to.alias("u"), "s", *[f"b{j}" for j in range(p)])  # one row
        joined = self.rows.join(state, self.rows[self.cluster].eqNullSafe(F.col("_c"))).drop("_c")
        d = joined.withColumn("eta", sum((F.col(f"b{j}") * x[j] for j in range(p)), F.lit(0.0)) + s * u).withColumn("pr", 1 / (1 + F.exp(-F.col("eta"))))
        d = d.withColumn("w", F.col("m") * F.col("pr") * (1 - F.col("pr"))).withColumn("r", F.col("y") - F.col("m") * F.col("pr")).withColumn("t", F.col("w") * (1 - 2 * F.col("pr")))
        log1p_exp = F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta")))
        sums = {"r": F.col("r"), "w": F.col("w"), "t": F.col("t"), "ll": F.col("y") * F.col("eta") - F.col("m") * log1p_exp + F.col("choose")}
        sums |= {f"r{j}": x[j] * F.col("r") for j in range(p)} | {f"w{j}": x[j] * F.col("w") for j in range(p)} | {f"t{j}": x[j] * F.col("t") for j in range(p)}
        sums |= {f"w{i}_{j}": x[i] * x[j] * F.col("w") for i in range(p) for j in range(i, p)}
        per = d.groupBy(self.cluster, "u", "s").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
        per = per.withColumn("h", 1 + s * s * F.col("w")).withColumn("step", (s * F.col("r") - u) / h)
        per = per.withColumns({f"du{j}": -s * F.col(f"w{j}") / h for j in range(p)}).withColumn("dus", (F.col("r") - s * u * F.col("w")) / h)
        table = kept(per.withColumnRenamed("s", "_s"))
        per = table.withColumnRenamed("_s", "s")
        along = u + s * F.col("dus")  # how eta moves with s, at the mode
        total = {"ll": F.col("ll") - u * u / 2 - 0.5 * F.log(h), "gs": u * F.col("r") - 0.5 * (2 * s * F.col("w") + s * s * F.col("t") * along) / h}
        total |= {f"g{j}": F.col(f"r{j}") - 0.5 * s * s * (F.col(f"t{j}") + s * F.col("t") * F.col(f"du{j}")) / h for j in range(p)}
        total |= {f"i{i}_{j}": F.col(f"w{i}_{j}") - s * s * F.col(f"w{i}") * F.col(f"w{j}") / h for i in range(p) for j in range(i, p)}
        total |= {f"c{j}": F.col(f"w{j}") * along for j in range(p)}
        total["css"] = u * F.col("w") * along - F.col("r") * F.col("dus") + F.col("w") / h - 2 * s * s * F.col("w") ** 2 / h**2
        total["oss"] = (u * F.col("r") - 0.5 * (2 * s * F.col("w") + s * s * F.col("t") * along) / h) ** 2
        got = per.agg(F.count("*").alias("k"), F.max(F.abs("step")).alias("off"), *[F.sum(c).alias(k) for k, c in total.items()]).first()  # one row
        return table, got.asDict()

    def settle(self, last: DataFrame, beta: np.ndarray, sigma: float, d_beta: np.ndarray | None = None, d_sigma: float = 0.0, close: float = 1e-3) -> tuple[DataFrame, dict]:
        table, got = self.sweep(last, beta, sigma, d_beta, d_sigma)
        for _ in range(25):
            if got["off"] <= close:
                break
            before = table
            table, got = self.sweep(before, beta, sigma)
            drop_kept(before)
        return table, got

    def parts(self, got: dict) -> tuple[np.ndarray, np.ndarray]:
        """Gradient, and an approximation of the information, of (b, s)."""
        p = self.p
        g = np.array([*(got[f"g{j}"] for j in range(p)), got["gs"]])
        a = np.zeros((p + 1, p + 1))
        for i in range(p):
            for j in range(i, p):
                a[i, j] = a[j, i] = got[f"i{i}_{j}"]
            a[i, p] = a[p, i] = got[f"c{i}"]
        a[p, p] = got["css"]
        for _ in range(2):
            try:
                np.linalg.cholesky(a)
                return g, a
            except np.linalg.LinAlgError:
                a[:p, p] = a[p, :p] = 0.0
                a[p, p] = max(got["oss"], 1e-6)
        return g, a + np.eye(p + 1) * 1e-6 * max(1.0, np.trace(a))


def _binomial_rows(df: DataFrame, successes: str, trials: str, terms: list[str], cluster: str) -> DataFrame:
    """(cluster, x:<term>, rows, y, m, choose): the usable rows, those of a cluster that agree in all terms added up."""
    d = df.select(F.col(cluster), *[term(c).alias(f"x:{c}") for c in terms], F.col(successes).cast("double").alias("y"), F.col(trials).cast("double").alias("m"))
    d = d.where(_usable(*[F.col(f"`x:{c}`") for c in terms], F.col("y"), F.col("m")) & (F.col("m") > 0))
    d = d.withColumn("choose", _ln_factorial(F.col("m")) - _ln_factorial(F.col("y")) - _ln_factorial(F.col("m") - F.col("y")))
    return d.groupBy(cluster, *[f"`x:{c}`" for c in terms]).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("y", "m", "choose")])


def _added(rows: DataFrame, terms: list[str], cluster: str) -> DataFrame:
    """Of these rows the columns x0, ... of a model with fewer terms, added up again."""
    x = [F.lit(1.0), *[F.col(f"`x:{c}`") for c in terms]]
    d = rows.select(F.col(cluster), *[c.alias(f"x{j}") for j, c in enumerate(x)], "rows", "y", "m", "choose")
    return d.groupBy(cluster, *[f"x{j}" for j in range(len(x))]).agg(*[F.sum(c).alias(c) for c in ("rows", "y", "m", "choose")])


def binomial_model(df: DataFrame, successes: str, trials: str, terms: list[str], cluster: str, model: str = "m", most: int = 40, close: float = 1e-6, added: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fit, modes) of successes out of trials on the logit scale, with a random intercept per cluster, by Laplace's approximation.

    ``modes`` has (cluster, mode, se): the intercept of each cluster, in units of eta.  Rows with a gap or without trials are
    left out; rows of a cluster that agree in all terms are added up first.  Newton steps with halving maximise the
    likelihood; ``sigma`` of the fit is null, ``tau`` the spread of the intercepts.  No usable row: no fit and no modes.
    ``added``: rows that are added up already, by these terms and perhaps others."""
    p = len(terms) + 1
    rows = kept(_added(_binomial_rows(df, successes, trials, terms, cluster) if added is None else added, terms, cluster))
    n, y, m = rows.agg(F.sum("rows"), F.sum("y"), F.sum("m")).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], FIT), rows.select(F.col(cluster), F.lit(0.0).alias("mode"), F.lit(0.0).alias("se"))
    run = _Binomial(rows, cluster, p)
    rate = min(max(y / m, 1e-6), 1 - 1e-6)
    beta, sigma = np.array([math.log(rate / (1 - rate)), *([0.0] * (p - 1))]), 0.5
    table, got = run.settle(run.start(), beta, sigma)
    for _ in range(most):
        g, a = run.parts(got)
        step = np.linalg.solve(a, g)
        if g @ step < close and got["off"] < 1e-4:
            break
        for halving in range(12):
            d_beta, to = step[:-1] * 0.5**halving, max(sigma + step[-1] * 0.5**halving, sigma / 4)
            tried, new = run.settle(table, beta + d_beta, to, d_beta, to - sigma)
            if new["ll"] >= got["ll"] - 1e-9 * abs(got["ll"]):
                break
            drop_kept(tried)
        else:
            break
        drop_kept(table)
        table, got, beta, sigma = tried, new, beta + d_beta, to
    covariance = np.linalg.pinv(run.parts(got)[1])[:p, :p]
    fit = [(f"{successes}/{trials}", model, int(n), int(got["k"]), [INTERCEPT, *terms], beta.tolist(), covariance.tolist(), None, float(sigma), float(got["ll"]), p + 1)]
    modes = table.select(F.col(cluster), (float(sigma) * (F.col("u") + F.col("step"))).alias("mode"), (float(sigma) / F.sqrt("h")).alias("se"))
    return spark.createDataFrame(fit, FIT), modes


def binomial_models(df: DataFrame, successes: str, trials: str, models: dict[str, list[str]], cluster: str) -> DataFrame:
    """Fits of several models of one outcome, over the rows that all of them can use."""
    terms = list(dict.fromkeys(c for m in models.values() for c in m))
    rows = kept(_binomial_rows(df, successes, trials, terms, cluster))  # the table is read once, for all models
    return reduce(DataFrame.unionByName, [binomial_model(df, successes, trials, own, cluster, name, added=rows)[0] for name, own in models.items()])


# ---------------------------------------------------------------- tails
def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(160)


def _over(lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    return (hi - lo) / 2 * _NODES + (hi + lo) / 2, (hi - lo) / 2 * _WEIGHTS


_cdf = np.vectorize(lambda z: 1 - normal_tail(z))


def _over_scale(tail, degrees: float | None) -> float:
    """The mean of ``tail(s)`` over the spread s of an estimate with so many degrees of freedom (1 without)."""
    if degrees is None or math.isinf(degrees):
        return tail(1.0)
    wide = 8 / math.sqrt(2 * degrees)
    s, w = _over(max(1e-6, 1 - wide), 1 + wide)
    half = degrees / 2
    density = np.exp(half * math.log(half) - math.lgamma(half) + math.log(2) + (degrees - 1) * np.log(s) - half * s * s)
    return float(sum(wi * di * tail(float(si)) for si, wi, di in zip(s, w, density)))


def t_tail(t: float, degrees: float | None) -> float:
    """Two-sided tail of Student's distribution, of the normal one without degrees of freedom."""
    return min(1.0, _over_scale(lambda s: 2 * normal_tail(abs(t) * s), degrees))


def studentized_range_tail(q: float, groups: int, degrees: float | None = None) -> float:
    """P(range of ``groups`` normal values over an independent spread > q)."""
    z, w = _over(-8.0, 8.0)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = _cdf(z)

    def tail(s: float) -> float:
        return 1 - groups * float((w * density * (upper - _cdf(z - q * s)) ** (groups - 1)).sum())

    return min(1.0, max(0.0, _over_scale(tail, degrees))) if q > 0 else 1.0


def _critical(tail, level: float) -> float:
    lo, hi = 0.0, 60.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - level else (lo, mid)
    return (lo + hi) / 2


# ---------------------------------------------------------------- reading fits
def _from_fits(fits: DataFrame, rows, schema: str) -> DataFrame:
    """Rows made from each fit where it is: fits are as many as outcomes and models."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(f.outcome, f.model, *r) for f in pdf.itertuples() for r in rows(f)], columns=names)

    return fits.mapInPandas(run, schema)


def coefficients(fits: DataFrame, degrees: float | None = None) -> DataFrame:
    """(outcome, model, term, estimate, se, z, p)."""

    def rows(f):
        for i, name in enumerate(f.terms):
            se = math.sqrt(max(f.covariance[i][i], 0.0))
            z = f.estimate[i] / se if se > 0 else None
            yield name, float(f.estimate[i]), se, z, None if z is None else t_tail(z, degrees)

    return _from_fits(fits, rows, "outcome string, model string, term string, estimate double, se double, z double, p double")


def likelihood_ratios(fits: DataFrame) -> DataFrame:
    """(outcome, model, parameters, log_likelihood, aic, bic, deviance, chi_square, degrees, p): each model against the one of the
    same outcome with the next fewer parameters; the first has no test."""
    before = Window.partitionBy("outcome").orderBy("parameters", "model")  # the models of one outcome
    d = fits.select("outcome", "model", "parameters", "log_likelihood", (2 * F.col("parameters") - 2 * F.col("log_likelihood")).alias("aic"), (F.log(F.col("rows").cast("double")) * F.col("parameters") - 2 * F.col("log_likelihood")).alias("bic"), (-2 * F.col("log_likelihood")).alias("deviance"))
    gain = 2 * (F.col("log_likelihood") - F.lag("log_likelihood").over(before))
    d = d.withColumn("chi_square", F.when(gain >= 0, gain).when(gain < 0, 0.0)).withColumn("degrees", F.col("parameters") - F.lag("parameters").over(before))

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else 1.0 if b < 1 else chi_square_tail(float(a), int(b)) for a, b in zip(x, k)], dtype="float64")

    return d.withColumn("p", tail("chi_square", "degrees"))


def combination(terms: list[str], at: dict[str, float]) -> np.ndarray:
    """The weights of the coefficients at stated values of the columns; a column that is not stated is at 0 (centred, reference)."""
    return np.array([1.0 if t == INTERCEPT else math.prod(float(at.get(c, 0.0)) for c in t.split(":")) for t in terms])


def marginal_means(fits: DataFrame, levels: dict[str, dict[str, float]], confidence: float = 0.95, degrees: float | None = None) -> DataFrame:
    """(outcome, model, level, mean, se, low, high): the model's mean at each level, from L b and L V L'.

    A level states columns; products follow.  To average over a factor, state the share of each of its indicator columns."""
    crit = _critical(lambda t: t_tail(t, degrees), confidence)

    def rows(f):
        v = np.array([list(r) for r in f.covariance])
        for name, at in levels.items():
            w = combination(list(f.terms), at)
            mean, se = float(w @ np.array(f.estimate)), math.sqrt(max(float(w @ v @ w), 0.0))
            yield name, mean, se, mean - crit * se, mean + crit * se

    return _from_fits(fits, rows, "outcome string, model string, level string, mean double, se double, low double, high double")


def contrasts(fits: DataFrame, levels: dict[str, dict[str, float]], pairs: list[tuple[str, str]] | None = None, adjust: str = "none", confidence: float = 0.95, degrees: float | None = None) -> DataFrame:
    """(outcome, model, level, minus, estimate, se, z, p, low, high): differences of marginal means, all pairs unless stated.

    ``adjust``: none, bonferroni (over the pairs), or tukey (studentised range over the levels), for p and interval alike."""
    names = list(levels)
    asked = pairs or list(combinations(names, 2))
    tails = {
        "none": lambda t: t_tail(t, degrees),
        "bonferroni": lambda t: min(1.0, len(asked) * t_tail(t, degrees)),
        "tukey": lambda t: studentized_range_tail(abs(t) * math.sqrt(2), len(names), degrees),
    }
    tail = tails[adjust]
    crit = _critical(tail, confidence)

    def rows(f):
        v, b, terms = np.array([list(r) for r in f.covariance]), np.array(f.estimate), list(f.terms)
        for one, other in asked:
            w = combination(terms, levels[one]) - combination(terms, levels[other])
            d, se = float(w @ b), math.sqrt(max(float(w @ v @ w), 0.0))
            z = d / se if se > 0 else None
            yield one, other, d, se, z, None if z is None else tail(z), d - crit * se, d + crit * se

    return _from_fits(fits, rows, "outcome string, model string, level string, minus string, estimate double, se double, z double, p double, low double, high double")
