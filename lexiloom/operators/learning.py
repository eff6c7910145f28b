"""Learned operators: principal components, feature screening, outlier forests, user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import number, safe_corr


def pca(df: DataFrame, key: str, columns: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(scores, loadings) of standardised columns: the correlation matrix is one aggregate, its eigenvectors a driver step, and
    the scores column expressions.  The largest loading of a component is positive."""
    d = df.select(key, *[number(c).alias(c) for c in columns]).na.drop()
    agg = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)] + [safe_corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in combinations(range(len(columns)), 2)]
    r = d.agg(*agg).first()
    n = len(columns)
    c = np.eye(n)
    for i, j in combinations(range(n), 2):
        c[i, j] = c[j, i] = r[f"c{i}_{j}"] or 0.0
    w, v = np.linalg.eigh(c)
    order = np.argsort(-w)[:k]
    w, v = w[order], v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    z = [(F.col(x) - float(r[f"m{i}"] or 0)) / float(r[f"s{i}"] or 1) for i, x in enumerate(columns)]
    scores = d.select(key, *[sum((z[i] * float(v[i, p]) for i in range(n)), F.lit(0.0)).alias(f"pc{p + 1}") for p in range(v.shape[1])])
    rows = [(columns[i], p + 1, float(v[i, p]), float(w[p] / n), float(w[: p + 1].sum() / n)) for p in range(v.shape[1]) for i in range(n)]
    return scores, df.sparkSession.createDataFrame(rows, "column_name string, component int, loading double, variance double, cumulative double")


def parallel_analysis(df: DataFrame, columns: list[str], draws: int = 500, quantile: float = 0.95, seed: int = 0) -> DataFrame:
    """(component, eigenvalue, chance_mean, chance, kept): eigenvalues of the correlations against those of independent columns.

    Correlations of n independent normal rows are drawn as such (a triangular root of a Wishart matrix), not as n rows, each draw
    in a task of its own; ``chance`` is the quantile of each component, and components are kept up to the first that does not
    exceed it.  Rows with gaps are left out."""
    d = df.select(*[number(c).alias(c) for c in columns]).na.drop()
    p, spark = len(columns), df.sparkSession
    r = d.agg(F.count("*").alias("n"), *[safe_corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in combinations(range(p), 2)]).first()
    c, n = np.eye(p), r["n"]
    for i, j in combinations(range(p), 2):
        c[i, j] = c[j, i] = r[f"c{i}_{j}"] or 0.0
    own = spark.createDataFrame([(k + 1, float(w)) for k, w in enumerate(np.sort(np.linalg.eigvalsh(c))[::-1])], "component int, eigenvalue double")
    if n <= p:
        return own.select("component", "eigenvalue", F.lit(None).cast("double").alias("chance_mean"), F.lit(None).cast("double").alias("chance"), F.lit(False).alias("kept"))

    def draw(batches):
        for pdf in batches:
            for i in pdf["id"]:
                g = np.random.default_rng([seed, int(i)])
                root = np.tril(g.normal(size=(p, p)), -1) + np.diag(np.sqrt(g.chisquare(n - 1 - np.arange(p))))
                root /= np.linalg.norm(root, axis=1, keepdims=True)
                yield pd.DataFrame({"component": np.arange(1, p + 1), "w": np.sort(np.linalg.eigvalsh(root @ root.T))[::-1]})

    null = spark.range(draws).mapInPandas(draw, "component int, w double").groupBy("component").agg(F.avg("w").alias("chance_mean"), F.percentile("w", F.lit(quantile)).alias("chance"))
    first = F.min(F.when(F.col("eigenvalue") <= F.col("chance"), F.col("component"))).over(Window.partitionBy())  # one row a component
    return own.join(null, "component").select("component", "eigenvalue", "chance_mean", "chance", F.coalesce(F.col("component") < first, F.lit(True)).alias("kept"))


def screen_features(df: DataFrame, columns: list[str], missing: float = 0.2, limit: float = 0.9) -> list[str]:
    """Columns with few gaps and some variance, dropped greedily (in order) where they correlate with one that stays."""
    d = df.select(*[number(c).alias(c) for c in columns])
    r = d.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    live = [c for c in columns if r["n"] and r[f"n_{c}"] >= (1 - missing) * r["n"] and (r[f"s_{c}"] or 0) > 1e-8]
    cor = d.agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in combinations(live, 2)]).first().asDict() if len(live) > 1 else {}
    kept: list[str] = []
    for c in live:
        if all(abs(cor.get(f"{k}|{c}") or 0.0) < limit for k in kept):
            kept.append(c)
    return kept


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 64, sample: int = 256, pool: int = 4096, seed: int = 0) -> DataFrame:
    """(key, score): outlier score of an isolation forest on standardised columns, gaps at the median.  Each tree grows on
    ``sample`` rows of a ``pool`` that a hash of the key draws from all rows (a forest is defined on such samples); every row
    is scored where it is."""
    d = df.select(key, *[number(c).alias(c) for c in columns])
    r = d.agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    d = d.select(key, *[((F.coalesce(F.col(c), F.lit(r[f"m{i}"])) - F.lit(r[f"m{i}"])) / F.lit(float(r[f"s{i}"] or 1) or 1.0)).alias(c) for i, c in enumerate(columns)])
    base = np.array([[row[c] for c in columns] for row in d.orderBy(F.xxhash64(key)).limit(pool).collect()], dtype=float)
    g = np.random.default_rng(seed)
    size = min(sample, len(base))
    depth = int(np.ceil(np.log2(max(size, 2))))
    c_of = lambda n: 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, level: int):
        lo, hi = x.min(0), x.max(0)
        free = np.flatnonzero(hi > lo)
        if level >= depth or len(x) <= 1 or not len(free):
            return level + c_of(len(x))
        f = int(g.choice(free))
        cut = float(g.uniform(lo[f], hi[f]))
        return f, cut, grow(x[x[:, f] < cut], level + 1), grow(x[x[:, f] >= cut], level + 1)

    forest = [grow(base[g.choice(len(base), size, replace=False)], 0) for _ in range(trees)] if len(base) else []

    def lengths(t, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(t, tuple):
            out[rows] += t
            return
        left = x[rows, t[0]] < t[1]
        lengths(t[2], x, rows[left], out)
        lengths(t[3], x, rows[~left], out)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        out = np.zeros(len(x))
        for t in forest:
            lengths(t, x, np.arange(len(x)), out)
        return pd.Series(2.0 ** (-out / max(len(forest), 1) / max(c_of(size), 1e-9)))

    return d.select(key, score(*columns).alias("score"))


_REGISTRY: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}


def register_encoder(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    """Names a loader of ``encode(texts) -> matrix``; it is called once per task."""
    _REGISTRY[name] = load


def encode(df: DataFrame, key: str, text: str, name: str, batch: int = 16) -> DataFrame:
    """(key, embedding) by a registered encoder, in batches, rows at length 1."""
    load = _REGISTRY[name]
    kind = dict(df.dtypes)[key]

    def run(batches):
        model = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                x = np.asarray(model(part[text].fillna("").tolist()), dtype=np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list((x / np.where(n > 0, n, 1)).astype(np.float32))})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


_SCORERS: dict[str, Callable[[], Callable]] = {}


def register_scorer(name: str, load: Callable[[], Callable]) -> None:
    """Names a loader of ``score(*columns of a batch) -> numbers``; it is called once per task."""
    _SCORERS[name] = load


def scorer_loader(spark, scorer: str | Callable) -> Callable[[], Callable]:
    """What a task calls to get its scorer: a registered name, ``module:function``, or ``folder/module.py:function``, whose file is
    sent to the executors.  A callable, or a function found by name, scores one row."""
    if isinstance(scorer, str) and scorer in _SCORERS:
        return _SCORERS[scorer]
    if isinstance(scorer, str):
        module, colon, name = scorer.rpartition(":")
        if not colon or not module:
            raise ValueError(f"No scorer is registered as {scorer!r}, and it is not module:function")
        if module.endswith(".py"):
            spark.sparkContext.addPyFile(module)
            module = module.replace("\\", "/").rsplit("/", 1)[-1].removesuffix(".py")

        def load():
            import importlib

            found = getattr(importlib.import_module(module), name)
            return lambda *columns: [found(*row) for row in zip(*columns)]

        return load
    return lambda: lambda *columns: [scorer(*row) for row in zip(*columns)]


def score_with(df: DataFrame, key: str, columns: list[str], scorer: str | Callable) -> DataFrame:
    """(key, score) by a plug-in on columns, which may hold arrays; a row with a null or an empty array among them has no score and
    is not shown to it.  The scorer is loaded once a task and gets whole batches."""
    load = scorer_loader(df.sparkSession, scorer)

    def plain(v):
        return [plain(x) for x in v] if isinstance(v, np.ndarray) else v

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        score = load()
        for part in parts:
            cols = part if isinstance(part, tuple) else (part,)  # one column comes by itself
            there = np.array([all(v is not None and (not hasattr(v, "__len__") or len(v) > 0) for v in row) for row in zip(*cols)], bool)
            out = np.full(len(there), np.nan)
            if there.any():
                out[there] = np.asarray(list(score(*[[plain(v) for v in c[there]] for c in cols])), dtype=np.float64)
            yield pd.Series(out).where(there)

    return df.select(key, number(run(*columns)).alias("score"))


def unit_r_precision(width: int = 256, least: float = 0.5) -> Callable:
    """A scorer of predicted against wanted units: the share of the wanted ones that the best R predictions match one to one, where
    R is their number; units are vectors of hashed words and match from a cosine of ``least`` on, the closest first."""
    import zlib

    def vectors(units) -> np.ndarray:
        out = np.zeros((len(units), width))
        for i, u in enumerate(units):
            for w in str(u).lower().split():
                out[i, zlib.crc32(w.encode()) % width] += 1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def one(predicted, wanted) -> float:
        sims = vectors(predicted) @ vectors(wanted).T
        best = np.argsort(-sims.max(1), kind="stable")[: len(wanted)]
        sims, hits = sims[best], 0
        for _ in range(min(sims.shape)):
            i, j = np.unravel_index(sims.argmax(), sims.shape)
            if sims[i, j] < least:
                break
            hits += 1
            sims[i], sims[:, j] = -1, -1
        return hits / len(wanted)

    return lambda predicted, wanted: [one(p, w) for p, w in zip(predicted, wanted)]


register_scorer("unit-r-precision", unit_r_precision)


def centroid_distance(df: DataFrame, group: str, target: str, columns: list[str]) -> DataFrame:
    """(group, distance): Euclidean distance of group means to the mean of a target group."""
    means = df.groupBy(group).agg(*[F.avg(number(c)).alias(c) for c in columns]).unpivot([group], columns, "feature", "m")
    to = means.where(F.col(group) == target).select("feature", F.col("m").alias("t"))
    return means.join(F.broadcast(to), "feature").groupBy(group).agg(F.sqrt(F.sum((F.col("m") - F.col("t")) ** 2)).alias("distance"))  # one row a feature
