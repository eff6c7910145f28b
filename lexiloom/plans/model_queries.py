"""Queries of models: mixed models of text measures by source, what is read from them, binomial models, parallel analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixed as M
from ..operators.learning import parallel_analysis as chance_components
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


#: Measures of a text that count what matches.
_COUNTS = {"digits": "[0-9]", "capitals": "[A-Z]", "sentence_marks": "[.!?]", "commas": ",", "line_ends": "\n", "spaces": " ", "vowels": "[aeiou]"}
OUTCOMES = ["n_chars", "words", "types", "long_words", *_COUNTS]
MODELS = {
    "m0": M.crossed("good", "english"),
    "m1": [*M.crossed("good", "english"), "toxic"],
    "m2": [*M.crossed("good", "english"), "toxic", "good:toxic", "english:toxic"],
    "m3": M.crossed("good", "english", "toxic"),
}
LEVELS = {f"{'good' if g else 'poor'} {'english' if e else 'other'}": {"good": g, "english": e} for g in (0, 1) for e in (0, 1)}


def _measures(spark, d):
    """Labelled documents with eleven counts, and three 0/1 predictors."""
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").where("quality IS NOT NULL AND toxic IS NOT NULL")
    x = x.withColumn("text", F.coalesce("text", F.lit("")))
    w = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda s: s != "")
    x = x.withColumns({"words": F.size(w), "types": F.size(F.array_distinct(w)), "long_words": F.size(F.filter(w, lambda s: F.length(s) >= 8))})
    x = x.withColumns({k: F.regexp_count("text", F.lit(p)) for k, p in _COUNTS.items()})
    return x.select("doc_id", "source", F.length("text").alias("n_chars"), *OUTCOMES[1:], F.col("quality").alias("good"), "toxic", F.coalesce(F.col("lang") == "en", F.lit(False)).cast("int").alias("english"))


_TERMS = ["good", "english", "toxic"]
_NAMES = ["1.0", *[f"CAST({c} AS DOUBLE)" for c in _TERMS], "y"]
_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
_COUNTED = ", ".join(f"len(regexp_extract_all(t, '{p}')) AS {k}" for k, p in _COUNTS.items())


@query(f"""WITH x AS (SELECT source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS w, quality AS good, toxic, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS english FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
m AS (SELECT source, good, toxic, english, length(t) AS n_chars, len(w) AS words, len(list_distinct(w)) AS types, len(list_filter(w, lambda s: length(s) >= 8)) AS long_words, {_COUNTED} FROM x),
u AS ({" UNION ALL ".join(f"SELECT '{o}' AS outcome, source, good, toxic, english, CAST({o} AS DOUBLE) AS y FROM m" for o in OUTCOMES)}),
c AS (SELECT outcome, source, count(*) AS n, {", ".join(f"sum({_NAMES[i]} * {_NAMES[j]}) AS p{i}_{j}" for i, j in _PAIRS)}, {", ".join(f"sum({c}) AS s{i}" for i, c in enumerate(_NAMES))} FROM u GROUP BY 1, 2)
SELECT outcome, n, count(*) AS clusters, {", ".join(f"sum(p{i}_{j}) AS p{i}_{j}" for i, j in _PAIRS)}, {", ".join(f"sum(s{i} * s{j}) AS q{i}_{j}" for i, j in _PAIRS)} FROM c GROUP BY 1, 2""")
def mixed_statistics(spark, d):
    return M.sufficient_statistics(_measures(spark, d), OUTCOMES, _TERMS, "source")


def _fits(spark, d):
    return M.linear_models(_measures(spark, d), OUTCOMES, MODELS, "source")


@query()
def mixed_models(spark, d):
    """Four nested models of each of eleven measures, with likelihood-ratio tests."""
    r = M.likelihood_ratios(_fits(spark, d))
    return r.select("outcome", "model", "parameters", "degrees", *[F.round(c, 4).alias(c) for c in ("log_likelihood", "aic", "bic", "chi_square", "p")])


@query()
def mixed_coefficients(spark, d):
    return M.coefficients(_fits(spark, d)).select("outcome", "model", "term", *[F.round(c, 4).alias(c) for c in ("estimate", "se", "z", "p")])


@query()
def mixed_contrasts(spark, d):
    """Quality within language and language within quality, at the mean share of toxic texts, in the second model."""
    c = M.contrasts(_fits(spark, d).where("model = 'm1'"), LEVELS, adjust="tukey")
    return c.select("outcome", "level", "minus", *[F.round(c, 4).alias(c) for c in ("estimate", "se", "z", "p", "low", "high")])


@query()
def mixed_means(spark, d):
    return M.marginal_means(_fits(spark, d).where("model = 'm1'"), LEVELS).select("outcome", "level", *[F.round(c, 4).alias(c) for c in ("mean", "se", "low", "high")])


@query()
def binomial_mixed_models(spark, d):
    """Long words out of all words: two nested models with a random intercept per source, by Laplace's approximation."""
    fits = M.binomial_models(_measures(spark, d), "long_words", "words", {"m0": ["good"], "m1": M.crossed("good", "english")}, "source")
    c = M.coefficients(fits).join(M.likelihood_ratios(fits).select("model", "log_likelihood", F.col("p").alias("p_ratio")), "model")
    return c.select("model", "term", *[F.round(c, 4).alias(c) for c in ("estimate", "se", "z", "p", "log_likelihood", "p_ratio")])


@query()
def parallel_components(spark, d):
    """Components of eleven text measures that exceed chance."""
    return chance_components(_measures(spark, d), OUTCOMES).select("component", *[F.round(c, 4).alias(c) for c in ("eigenvalue", "chance_mean", "chance")], "kept")
