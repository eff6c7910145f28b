"""Additive n-gram models as count tables: held-out, by fold, and leaving one document out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, padded


def bigram_perplexity(train: DataFrame, test: DataFrame, key: str, toks: str = "tokens", alpha: float = 0.5) -> DataFrame:
    """(key, steps, perplexity) of token arrays.  The vocabulary is the training types, ``<unk>`` and ``</s>`` (no start mark);
    unknown tokens are ``<unk>`` in both places."""
    types = train.select(F.explode(toks).alias("w")).distinct()
    v = types.agg((F.count("*") + 2).alias("v"))
    pair = lambda df, *k: df.select(*k, F.explode(ngrams(padded(F.col(toks), 2), 2)).alias("g")).select(*k, F.col("g")[0].alias("a"), F.col("g")[1].alias("b"))
    counts = pair(train).groupBy("a", "b").agg(F.count("*").alias("c"))
    context = counts.groupBy("a").agg(F.sum("c").alias("n"))
    known = types.withColumn("k", F.lit(1))
    asked = pair(test, key).groupBy(key, "a", "b").agg(F.count("*").alias("m"))
    asked = asked.join(known.withColumnsRenamed({"w": "a", "k": "ka"}), "a", "left").join(known.withColumnsRenamed({"w": "b", "k": "kb"}), "b", "left")
    asked = asked.withColumn("a", F.when(F.col("ka").isNull() & (F.col("a") != "<s>"), "<unk>").otherwise(F.col("a"))).withColumn("b", F.when(F.col("kb").isNull() & (F.col("b") != "</s>"), "<unk>").otherwise(F.col("b")))
    scored = asked.join(counts, ["a", "b"], "left").join(context, "a", "left").crossJoin(F.broadcast(v))  # one row
    p = F.log((F.coalesce("c", F.lit(0)) + alpha) / (F.coalesce("n", F.lit(0)) + alpha * F.col("v")))
    return scored.groupBy(key).agg(F.sum("m").alias("steps"), F.exp(-F.sum(F.col("m") * p) / F.sum("m")).alias("perplexity"))


def fold_perplexity(df: DataFrame, key: str, fold: str, order: int = 3, utterances: str = "utterance_tokens", alpha: float = 0.5, every_fold: Column | None = None) -> DataFrame:
    """(fold, key, token_count, perplexity): each transcript of a fold under the model of all others; rows with ``every_fold``
    (synthetic ones) are no training text and are scored under the model of every fold.  The vocabulary counts the start
    marks; unknown tokens keep their count of zero."""
    real = df.where(~every_fold) if every_fold is not None else df
    folds = real.select(F.col(fold).alias("_f")).distinct()
    name = lambda k: [c if isinstance(c, str) else c.alias("_f") for c in k]
    gram = lambda d, *k: d.select(*name(k), F.explode(utterances).alias("u")).select(*[c if isinstance(c, str) else "_f" for c in k], F.explode(ngrams(padded(F.col("u"), order), order)).alias("g"))
    mine = gram(real, fold).groupBy(fold, "g").agg(F.count("*").alias("c"))
    total = mine.groupBy("g").agg(F.sum("c").alias("all"))
    # the model without a fold: all counts less the fold's own
    asked = gram(real, F.col(fold), key)
    if every_fold is not None:
        asked = asked.unionByName(gram(df.where(every_fold), key).crossJoin(F.broadcast(folds)).select("_f", key, "g"))  # a handful of folds
    asked = asked.groupBy("_f", key, "g").agg(F.count("*").alias("m"))
    context = lambda c: F.slice(c, 1, order - 1)
    ctx_mine = mine.groupBy(fold, context(F.col("g")).alias("h")).agg(F.sum("c").alias("cn"))
    ctx_all = ctx_mine.groupBy("h").agg(F.sum("cn").alias("alln"))
    last = lambda d, *k: d.select(*k, F.element_at("g", -1).alias("w"), "c")
    vocab_mine = last(mine, fold).groupBy(fold, "w").agg(F.sum("c").alias("c"))
    vocab_all = vocab_mine.groupBy("w").agg(F.sum("c").alias("n"))
    gone = vocab_mine.join(vocab_all, "w").where("c = n").groupBy(F.col(fold).alias("_f")).agg(F.count("*").alias("gone"))
    size = folds.crossJoin(F.broadcast(vocab_all.agg(F.count("*").alias("types")))).join(gone, "_f", "left").select("_f", (F.col("types") - F.coalesce("gone", F.lit(0)) + (1 if order > 1 else 0)).alias("v"))
    s = asked.join(total, "g", "left").join(mine.select(F.col(fold).alias("_f"), "g", "c"), ["_f", "g"], "left").withColumn("h", context(F.col("g")))
    s = s.join(ctx_all, "h", "left").join(ctx_mine.select(F.col(fold).alias("_f"), "h", "cn"), ["_f", "h"], "left").join(F.broadcast(size), "_f")
    zero = lambda c: F.coalesce(c, F.lit(0))
    p = F.log((zero("all") - zero("c") + alpha) / (zero("alln") - zero("cn") + alpha * F.col("v")))
    out = s.groupBy("_f", key).agg(F.sum("m").alias("token_count"), F.exp(-F.sum(F.col("m") * p) / F.sum("m")).alias("perplexity"))
    return out.withColumnRenamed("_f", fold)


def fold_summary(scores: DataFrame, key: str, value: str = "perplexity") -> DataFrame:
    v = F.col(value)
    return scores.groupBy(key).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def leave_one_out_unigram(df: DataFrame, key: str, toks: str = "tokens", alpha: float = 0.5) -> DataFrame:
    """(key, steps, perplexity) of each document under the unigram model of all others: corpus counts less its own, and a
    vocabulary without the types that only it has."""
    own = df.select(key, F.explode(F.concat(F.col(toks), F.array(F.lit("</s>")))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("m"))
    all_ = own.groupBy("w").agg(F.sum("m").alias("c"))
    size = all_.agg(F.sum("c").alias("total"), (F.count_if(F.col("w") != "</s>") + 2).alias("types"))
    j = own.join(all_, "w").withColumn("alone", (F.col("m") == F.col("c")) & (F.col("w") != "</s>"))
    mine = j.groupBy(key).agg(F.sum("m").alias("steps"), F.count_if("alone").alias("gone"), F.sum(F.when(F.col("alone"), F.col("m")).otherwise(0)).alias("unk"), F.collect_list(F.when(~F.col("alone"), F.struct("m", "c"))).alias("cells"))
    mine = mine.crossJoin(F.broadcast(size))  # one row
    den = F.col("total") - F.col("steps") + alpha * (F.col("types") - F.col("gone"))
    logs = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["m"] * F.log((x["c"] - x["m"] + alpha) / den)) + F.col("unk") * F.log(alpha / den)
    return mine.select(key, "steps", F.exp(-logs / F.col("steps")).alias("perplexity"))


def numpy_folds(ids: list[str], folds: int, seed: int) -> dict[str, int]:
    """Fold of each id as a shuffled K-fold over ids in order gives it: min(max(2, folds), n) folds (a driver step over ids)."""
    import numpy as np

    n = len(ids)
    k = min(max(2, folds), n) if n else 0
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    sizes = [n // k + (i < n % k) for i in range(k)] if k else []
    out, at = {}, 0
    for f, size in enumerate(sizes):
        for i in order[at : at + size]:
            out[ids[i]] = f
        at += size
    return out
