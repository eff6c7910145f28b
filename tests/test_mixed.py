"""Mixed models: likelihoods, likelihood ratios, marginal means and contrasts, the binomial model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import mixed


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def log_density(y, x, beta, sigma, tau, c):
    """Log likelihood of a linear model with a random intercept, from the covariance matrix of each cluster."""
    out = 0.0
    for k in set(c.tolist()):
        m = c == k
        r = y[m] - x[m] @ beta
        v = sigma**2 * np.eye(m.sum()) + tau**2
        out -= 0.5 * (m.sum() * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r))
    return out


@pytest.fixture(scope="module")
def speakers():
    g = np.random.default_rng(4)
    rows = []
    for c, u in enumerate(g.normal(0, 1.5, 40)):
        for _ in range(int(g.integers(1, 7))):
            a, b, z = float(g.integers(0, 2)), float(c % 2), float(g.normal())
            y = 2 + a - b + 0.5 * a * b + 0.3 * z + u + g.normal()
            rows.append((c, a, b, z, float(y), None if g.random() < 0.1 else float(g.normal()), 1.0))
    return rows


SCHEMA = "c int, a double, b double, z double, y double, gap double, flat double"
MODELS = {"m0": ["a", "b"], "m1": ["a", "b", "z"], "m2": [*mixed.crossed("a", "b"), "z"]}


def test_all_outcomes_and_models_at_once(spark, speakers):
    fits = {(r["outcome"], r["model"]): r for r in mixed.linear_models(frame(spark, speakers, SCHEMA), ["y", "gap"], MODELS, "c").collect()}
    assert len(fits) == 6
    rows = np.array([r[:5] for r in speakers])
    for name, terms in MODELS.items():
        f = fits["y", name]
        cols = {"a": rows[:, 1], "b": rows[:, 2], "z": rows[:, 3], "a:b": rows[:, 1] * rows[:, 2]}
        x = np.column_stack([np.ones(len(rows)), *(cols[t] for t in terms)])
        beta = np.array(f["estimate"])
        at = lambda b, s, t: log_density(rows[:, 4], x, b, s, t, rows[:, 0])
        assert f["rows"] == len(rows) and f["clusters"] == 40 and f["terms"] == ["intercept", *terms]
        assert math.isclose(f["log_likelihood"], at(beta, f["sigma"], f["tau"]), rel_tol=1e-9)
        for i in range(len(beta)):  # a maximum: steps to either side lose
            for e in (-1e-2, 1e-2):
                assert at(beta + e * np.eye(len(beta))[i], f["sigma"], f["tau"]) < f["log_likelihood"]
        assert max(at(beta, f["sigma"] * s, f["tau"] * t) for s, t in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98))) < f["log_likelihood"]
        v = np.zeros((len(rows), len(rows)))
        for k in set(rows[:, 0]):
            m = rows[:, 0] == k
            v += np.outer(m, m) * f["tau"] ** 2
        cov = np.linalg.inv(x.T @ np.linalg.solve(v + f["sigma"] ** 2 * np.eye(len(rows)), x))
        assert np.allclose(np.array(f["covariance"]), cov, rtol=1e-6)
    assert fits["gap", "m0"]["rows"] == sum(r[5] is not None for r in speakers)


def test_likelihood_ratios_and_coefficients(spark, speakers):
    fits = mixed.linear_models(frame(spark, speakers, SCHEMA), ["y", "gap"], MODELS, "c")
    lr = {(r["outcome"], r["model"]): r for r in mixed.likelihood_ratios(fits).collect()}
    assert lr["y", "m0"]["p"] is None and lr["y", "m1"]["degrees"] == 1
    assert math.isclose(lr["y", "m1"]["chi_square"], 2 * (lr["y", "m1"]["log_likelihood"] - lr["y", "m0"]["log_likelihood"]))
    assert math.isclose(lr["y", "m2"]["p"], 2 * mixed.normal_tail(math.sqrt(lr["y", "m2"]["chi_square"])), rel_tol=1e-6)
    assert math.isclose(lr["y", "m1"]["aic"], 2 * 6 - 2 * lr["y", "m1"]["log_likelihood"])
    c = {r["term"]: r for r in mixed.coefficients(fits).where("outcome = 'y' and model = 'm1'").collect()}
    assert c["a"]["p"] < 0.01 and math.isclose(c["a"]["z"], c["a"]["estimate"] / c["a"]["se"])
    assert mixed.linear_models(frame(spark, speakers, SCHEMA).where("false"), ["y"], MODELS, "c").count() == 0


def test_contrasts_of_a_balanced_layout_have_a_closed_form(spark):
    """Two groups of clusters of one size, no within effect: the difference of means has variance 2 (tau^2 + sigma^2 / n) / k."""
    g = np.random.default_rng(9)
    k, n = 30, 4
    rows = [(c, float(c % 3 == 1), float(c % 3 == 2), float(u + e + (c % 3))) for c, u in enumerate(g.normal(0, 1, 3 * k)) for e in g.normal(0, 0.5, n)]
    fits = mixed.linear_models(frame(spark, rows, "c int, g1 double, g2 double, y double"), ["y"], {"m": ["g1", "g2"]}, "c")
    f = fits.first()
    levels = {"g0": {}, "g1": {"g1": 1.0}, "g2": {"g2": 1.0}}
    y = np.array([r[3] for r in rows]).reshape(3 * k, n).mean(1)
    means = [y[i::3].mean() for i in range(3)]
    var = (f["tau"] ** 2 + f["sigma"] ** 2 / n) / k
    for r, m in zip(mixed.marginal_means(fits, levels).orderBy("level").collect(), means):
        assert math.isclose(r["mean"], m, rel_tol=1e-8) and math.isclose(r["se"], math.sqrt(var), rel_tol=1e-6)
        assert math.isclose(r["high"] - r["mean"], 1.959964 * r["se"], rel_tol=1e-5)
    got = {(r["level"], r["minus"]): r for r in mixed.contrasts(fits, levels).collect()}
    assert set(got) == {("g0", "g1"), ("g0", "g2"), ("g1", "g2")}
    r = got["g0", "g1"]
    assert math.isclose(r["estimate"], means[0] - means[1], rel_tol=1e-7) and math.isclose(r["se"], math.sqrt(2 * var), rel_tol=1e-6)
    assert math.isclose(r["p"], 2 * mixed.normal_tail(abs(r["z"])), rel_tol=1e-9)
    tukey = {(r["level"], r["minus"]): r for r in mixed.contrasts(fits, levels, adjust="tukey").collect()}
    bonferroni = {(r["level"], r["minus"]): r for r in mixed.contrasts(fits, levels, adjust="bonferroni").collect()}
    for key in got:
        assert got[key]["p"] <= tukey[key]["p"] <= bonferroni[key]["p"] + 1e-12
        assert math.isclose(tukey[key]["high"] - tukey[key]["estimate"], 3.3145 / math.sqrt(2) * tukey[key]["se"], rel_tol=1e-3)
    assert mixed.contrasts(fits, levels, pairs=[("g2", "g0")]).first()["estimate"] == pytest.approx(means[2] - means[0])


def test_interactions_follow_from_stated_columns(spark, speakers):
    fits = mixed.linear_models(frame(spark, speakers, SCHEMA), ["y"], {"m2": MODELS["m2"]}, "c")
    f = fits.first()
    b = dict(zip(f["terms"], f["estimate"]))
    levels = {f"{i}{j}": {"a": i, "b": j} for i in (0, 1) for j in (0, 1)}
    m = {r["level"]: r["mean"] for r in mixed.marginal_means(fits, levels).collect()}
    assert math.isclose(m["11"], b["intercept"] + b["a"] + b["b"] + b["a:b"]) and math.isclose(m["00"], b["intercept"])


def test_tails_against_tables():
    # quantiles of the studentised range and of Student's distribution, from published tables
    for groups, degrees, q in ((3, None, 3.314), (3, 10, 3.877), (5, 20, 4.232), (10, 60, 4.646), (2, None, 2.772)):
        assert abs(mixed.studentized_range_tail(q, groups, degrees) - 0.05) < 2e-4, (groups, degrees)
    assert abs(mixed.t_tail(2.228, 10) - 0.05) < 1e-4 and abs(mixed.t_tail(1.959964, None) - 0.05) < 1e-6 and abs(mixed.t_tail(12.706, 1) - 0.05) < 6e-3


# ---------------------------------------------------------------- binomial
def laplace(theta, y, m, x, c, nodes=0):
    """Log likelihood by Laplace's approximation, or by adaptive Gauss-Hermite integration with so many nodes."""
    beta, s, out = theta[:-1], theta[-1], 0.0
    z, w = np.polynomial.hermite.hermgauss(nodes or 1)
    for k in set(c.tolist()):
        i = c == k
        base = x[i] @ beta
        f = lambda u: float((y[i] * (base + s * u) - m[i] * np.logaddexp(0, base + s * u)).sum()) - u * u / 2
        u = 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-(base + s * u)))
            h = 1 + s * s * (m[i] * p * (1 - p)).sum()
            u += (s * (y[i] - m[i] * p).sum() - u) / h
        if nodes:
            sd = math.sqrt(2 / h)
            out += math.log(sum(wj * math.exp(f(u + sd * zj) - f(u) + zj * zj) for zj, wj in zip(z, w)) * sd / math.sqrt(2 * math.pi)) + f(u)
        else:
            out += f(u) - 0.5 * math.log(h)
        out += sum(math.lgamma(b + 1) - math.lgamma(a + 1) - math.lgamma(b - a + 1) for a, b in zip(y[i], m[i]))
    return out


@pytest.fixture(scope="module")
def trials():
    g = np.random.default_rng(12)
    rows = []
    for c, u in enumerate(g.normal(0, 0.8, 30)):
        for _ in range(int(g.integers(2, 6))):
            a, z, m = float(g.integers(0, 2)), float(np.round(g.normal(), 2)), int(g.integers(3, 15))
            rows.append((c, a, z, int(g.binomial(m, 1 / (1 + math.exp(-(-1 + 0.9 * a + 0.5 * z + u))))), m))
    return rows


def test_binomial_model_is_the_maximum_of_the_laplace_likelihood(spark, trials):
    df = frame(spark, trials, "c int, a double, z double, y int, m int")
    fit, modes = mixed.binomial_model(df, "y", "m", ["a", "z"], "c")
    f = fit.first()
    c, a, z, y, m = (np.array([r[i] for r in trials], float) for i in range(5))
    x = np.column_stack([np.ones(len(c)), a, z])
    theta = np.array([*f["estimate"], f["tau"]])
    top = laplace(theta, y, m, x, c)
    assert math.isclose(f["log_likelihood"], top, abs_tol=1e-5)
    for i in range(4):
        e = 1e-4 * np.eye(4)[i]
        assert abs(laplace(theta + e, y, m, x, c) - laplace(theta - e, y, m, x, c)) / 2e-4 < 2e-2, i
    # numeric integration: the approximation is close, and so is its maximum
    exact = laplace(theta, y, m, x, c, nodes=40)
    assert abs(exact - top) < 0.5
    hessian = np.zeros((4, 4))
    h = 1e-3
    for i in range(4):
        for j in range(4):
            ei, ej = h * np.eye(4)[i], h * np.eye(4)[j]
            hessian[i, j] = (laplace(theta + ei + ej, y, m, x, c, 25) - laplace(theta + ei - ej, y, m, x, c, 25) - laplace(theta - ei + ej, y, m, x, c, 25) + laplace(theta - ei - ej, y, m, x, c, 25)) / (4 * h * h)
    se = np.sqrt(np.diag(np.linalg.inv(-hessian)))[:3]
    assert np.allclose(np.sqrt(np.diag(np.array(f["covariance"]))), se, rtol=0.08)
    shift = np.linalg.solve(hessian, [-(laplace(theta + h * e, y, m, x, c, 25) - laplace(theta - h * e, y, m, x, c, 25)) / (2 * h) for e in np.eye(4)])
    assert np.all(np.abs(shift[:3]) < 0.25 * se)
    got = {r["c"]: r for r in modes.collect()}
    assert len(got) == 30 and all(r["se"] > 0 for r in got.values())
    rate = {k: (y[c == k].sum() / m[c == k].sum()) for k in got}
    assert np.corrcoef([got[k]["mode"] for k in got], [rate[k] for k in got])[0, 1] > 0.8


def test_binomial_model_without_clusters_in_the_data(spark):
    """No spread between clusters: the model is the plain logistic one."""
    g = np.random.default_rng(3)
    rows = [(i % 20, float(i % 2), int(g.binomial(10, 0.3 + 0.2 * (i % 2))), 10) for i in range(400)]
    f = mixed.binomial_model(frame(spark, rows, "c int, a double, y int, m int"), "y", "m", ["a"], "c")[0].first()
    p = [sum(r[2] for r in rows if r[1] == k) / sum(r[3] for r in rows if r[1] == k) for k in (0, 1)]
    logit = [math.log(x / (1 - x)) for x in p]
    assert f["tau"] < 0.12 and abs(f["estimate"][0] - logit[0]) < 0.02 and abs(f["estimate"][1] - (logit[1] - logit[0])) < 0.02


def test_binomial_odd_rows_and_nested_models(spark, trials):
    odd = [*trials, (None, 1.0, 0.5, 1, 2), (3, None, 0.5, 1, 2), (3, 1.0, float("nan"), 1, 2), (3, 1.0, 0.5, 0, 0), (3, 1.0, 0.5, None, 4)]
    df = frame(spark, odd, "c int, a double, z double, y int, m int")
    fits = mixed.binomial_models(df, "y", "m", {"m0": ["a"], "m1": ["a", "z"]}, "c")
    got = {r["model"]: r for r in mixed.likelihood_ratios(fits).collect()}
    assert got["m1"]["chi_square"] > 0 and got["m1"]["degrees"] == 1 and got["m1"]["p"] < 0.05
    assert {r["rows"] for r in fits.collect()} == {len(trials) + 1} and {r["clusters"] for r in fits.collect()} == {31}
    none, modes = mixed.binomial_model(df.where("false"), "y", "m", ["a"], "c")
    assert none.count() == 0 and modes.count() == 0
    c = {r["level"]: r for r in mixed.contrasts(fits.where("model = 'm1'"), {"low": {"a": 0}, "high": {"a": 1}}).collect()}
    assert c["low"]["estimate"] < 0 and c["low"]["high"] < 0


def test_parallel_analysis_on_noise_and_on_planted_factors(spark):
    from lexiloom.operators.learning import parallel_analysis

    g = np.random.default_rng(7)
    noise = g.normal(size=(400, 6))
    names = [f"v{i}" for i in range(6)]
    frame_of = lambda x: spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, *([1.0] * 5))], ", ".join(f"{n} double" for n in names))
    rows = parallel_analysis(frame_of(noise), names, draws=200).orderBy("component").collect()
    direct = np.sort(np.linalg.eigvalsh(np.corrcoef(noise.T)))[::-1]
    assert np.allclose([r["eigenvalue"] for r in rows], direct) and sum(r["kept"] for r in rows) <= 1
    drawn = np.sort([np.linalg.eigvalsh(np.corrcoef(g.normal(size=(400, 6)).T))[::-1] for _ in range(400)], axis=0)
    assert np.allclose([r["chance_mean"] for r in rows], drawn.mean(0), atol=0.01)
    assert np.allclose([r["chance"] for r in rows], np.quantile(drawn, 0.95, axis=0), atol=0.03)
    planted = g.normal(size=(400, 2)) @ np.array([[2, 2, 2, 0, 0, 0], [0, 0, 0, 2, 2, 2.0]]) + noise
    assert [r["kept"] for r in parallel_analysis(frame_of(planted), names, draws=200).orderBy("component").collect()] == [True, True, False, False, False, False]
    few = parallel_analysis(frame_of(noise[:4]), names).collect()
    assert len(few) == 6 and not any(r["kept"] for r in few)


def test_binomial_models_read_their_rows_once(spark):
    """Every model used to read the table, and with it the texts it is measured from."""
    g = np.random.default_rng(3)
    rows = [(int(i % 6), float(i % 2), float(g.normal()), int(g.integers(0, 5)), 5) for i in range(60)] + [(1, None, 1.0, 1, 2), (2, 1.0, 1.0, 0, 0)]
    df = frame(spark, rows, "c int, a double, z double, y int, m int")
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: seen.add(1) or x, "int").asNondeterministic()
    models = {"m0": ["a"], "m1": ["a", "z"]}
    parts = []

    def fitted(table, successes, trials, own, cluster, name, added=None):
        table = table if added is None else mixed._added(added, own, cluster)
        parts.append(table.collect())
        return table.limit(0).select("c"), None

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixed, "binomial_model", fitted)
        mixed.binomial_models(df.withColumn("y", told("y")), "y", "m", models, "c")
    assert seen.value == len(rows)
    for got, wide in zip(parts, (2, 3)):
        want = {}
        for c, a, z, y, m in rows[:60]:
            at = (c, 1.0, a, z)[: wide + 1]
            n, u, v = want.get(at, (0, 0, 0))
            want[at] = n + 1, u + y, v + m
        assert {tuple(r[: wide + 1]): (r["rows"], r["y"], r["m"]) for r in got} == want
