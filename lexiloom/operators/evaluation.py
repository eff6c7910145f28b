"""Generated against real texts, slice by slice: nearness, overlap and perplexity, set against how real texts compare with
each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, padded, type_token_ratio
from ..session import kept
from .retrieval import rouge_l
from .stats import join_on, quantiles_of

TERM = r"[\p{L}\p{N}_]{2,}"

#: What a summary tells of each side: its name there, and the column of the metrics.
MEDIANS = {"token_count": "token_count", "type_token_ratio": "type_token_ratio", "nearest_tfidf": "nearest_tfidf_cosine", "nearest_rouge_l": "nearest_rouge_l_f1", "bigram_perplexity": "bigram_perplexity_vs_real"}
#: Of these also the share of generated texts within the real quartiles.
WITHIN = ("nearest_tfidf", "nearest_rouge_l", "bigram_perplexity")
#: What texts are compared by: shared terms, sequences, perplexity of words and of pairs.
MEASURES = ("terms", "sequence", "unigram", "bigram")
BLOCK_ROWS, SEQUENCE_ROWS = 2048, 512  # texts of a slice that a task compares with as many others


def words_and_pairs(text: Column | str) -> Column:
    """Lower-cased words of two characters or more, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    # a name for the words, which would else be cut anew for each pair
    return F.transform(F.array(words), lambda w: F.concat(w, F.transform(ngrams(w, 2), lambda p: F.array_join(p, " "))))[0]


def weights(fit: DataFrame, rows: list[DataFrame], on: list[str], key: str, terms: str) -> list[DataFrame]:
    """(on, key, _id, df, weight) of each of ``rows``: sublinear counts times the smoothed inverse document frequency that ``fit``
    has in the slice, unit length; terms that it does not have are left out.  ``_id`` is the number of a term of the slice."""
    count = lambda d: d.select(*on, key, F.explode(terms).alias("term")).groupBy(*on, key, "term").agg(F.count("*").alias("tf"))
    df = kept(count(fit).groupBy(*on, "term").agg(F.count("*").alias("df")).withColumn("_id", F.monotonically_increasing_id()))
    n = fit.groupBy(*on).agg(F.count("*").alias("n"))
    out = []
    for d in rows:
        w = join_on(join_on(count(d), df, [*on, "term"]), n, on)
        w = w.select(*on, key, "_id", "df", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
        size = w.groupBy(*on, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        out.append(join_on(w, size, [*on, key]).select(*on, key, "_id", "df", (F.col("w") / F.col("size")).alias("weight")))
    return out


def _parts(d: DataFrame, on: list[str], rows: int) -> int:
    """In how many parts of about ``rows`` rows the largest slice goes."""
    return -(-(d.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1) // rows)


def _dealt(rows: DataFrame, real: DataFrame, on: list[str], key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by slice and (``_a``, ``_b``), so that each text meets each real one of its slice once, and no task has a slice whole."""
    a, b = (_parts(d, on, size) for d in (rows, real))
    part = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.withColumn("_a", part(a)).withColumn("_b", every(b)), real.withColumn("_b", part(b)).withColumn("_a", every(a))


def _numbers(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists one after the other, size of each)."""
    c = t[name].combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _cosines(a: tuple, b: tuple, n: int, often: float = 0.05, at_once: int = 512, most: int = 1 << 22):
    """Products of the rows of two sparse tables of (row, column, weight) by blocks of rows of the first: (first row, block), ``n``
    rows in the second.  Columns that many rows of the second have are multiplied as a matrix, others through their rows."""
    (ar, ac, aw), (br, bc, bw) = a, b
    names, bc = np.unique(bc, return_inverse=True)
    where = np.minimum(np.searchsorted(names, ac), max(len(names) - 1, 0))
    known = names[where] == ac if len(names) else np.zeros(len(ac), bool)
    ar, ac, aw = ar[known], where[known], aw[known]
    per = np.bincount(bc, minlength=len(names))
    dense = np.full(len(names), -1)
    many = np.flatnonzero(per > often * n)
    dense[many] = np.arange(len(many))
    of = dense[bc]
    matrix = np.zeros((len(many), n))
    matrix[of[of >= 0], br[of >= 0]] = bw[of >= 0]
    order = np.argsort(bc, kind="stable")
    begin, posted, weight = np.cumsum(per) - per, br[order], bw[order]
    rows = int(ar.max()) + 1 if len(ar) else 0
    cut = np.searchsorted(ar, np.arange(0, rows + at_once, at_once))
    for k, (lo, hi) in enumerate(zip(cut, cut[1:])):
        r, c, w = ar[lo:hi] - k * at_once, ac[lo:hi], aw[lo:hi]
        few = dense[c] < 0
        mine = np.zeros((min(at_once, rows - k * at_once), len(many)))
        mine[r[~few], dense[c[~few]]] = w[~few]
        out = mine @ matrix
        r, c, w = r[few], c[few], w[few]
        total = np.cumsum(per[c])
        for x, y in _ranges(total, most):
            size = per[c[x:y]]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[c[x:y]], size)
            to = np.repeat(r[x:y] * n, size) + posted[at]
            out += np.bincount(to, np.repeat(w[x:y], size) * weight[at], out.size).reshape(out.shape)
        yield k * at_once, out


def _ranges(total: np.ndarray, most: int):
    """Ranges of places with running totals, each of about ``most`` or one place."""
    lo = 0
    while lo < len(total):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + most, "right")))
        yield lo, hi
        lo = hi


def nearest_by_terms(real: DataFrame, rows: DataFrame, on: list[str], key: str, terms: str, leave_out: bool, block: int = BLOCK_ROWS) -> DataFrame:
    """(on, key, n_reference, nearest_id, nearest_tfidf_cosine, mean_tfidf_cosine): against the real texts of the slice, without
    itself where ``leave_out``; ties go to the smaller key, and a text that shares nothing has the first one (the last, if it is
    the first itself) at 0.  All pairs of a slice are compared, in blocks of ``block`` texts by as many: what is written grows
    with texts times blocks, not with the terms that pairs share."""
    a, b = weights(real, [rows, real], on, key, terms)
    if leave_out:  # a term of one text meets no other
        a, b = a.where("df > 1"), b.where("df > 1")
    row = lambda w: kept(w.groupBy(*on, key).agg(F.collect_list(F.struct("_id", "weight")).alias("_w")).select(*on, key, F.col("_w._id").alias("_id"), F.col("_w.weight").alias("_x")))
    a, b = _dealt(row(a), row(b), on, key, block)
    kinds = dict(rows.dtypes)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.schema([*(left.schema.field(c) for c in (*on, key)), ("_top", pa.float64()), ("_total", pa.float64()), left.schema.field(key).with_name("_best")]).empty_table()
        right = right.sort_by(key)  # ties: the first of the largest
        n = right.num_rows
        sides = []
        for t in (left, right):
            ids, size = _numbers(t, "_id")
            sides.append((np.repeat(np.arange(t.num_rows), size), ids, _numbers(t, "_x")[0]))
        own = pc.index_in(left[key], value_set=right[key].combine_chunks()).fill_null(-1).to_numpy() if leave_out else None
        top, total, best = np.zeros(left.num_rows), np.zeros(left.num_rows), np.zeros(left.num_rows, np.int64)
        for lo, s in _cosines(*sides, n):
            s, here = np.round(s, 12), slice(lo, lo + len(s))
            if leave_out:
                self_ = np.flatnonzero(own[here] >= 0)
                s[self_, own[here][self_]] = 0
            best[here] = s.argmax(1)
            top[here], total[here] = s[np.arange(len(s)), best[here]], s.sum(1)
        met = pa.array(top > 0)
        out = left.select([*on, key]).append_column("_top", pa.array(top)).append_column("_total", pa.array(total)).append_column("_best", right[key].take(pa.array(best)))
        return out.filter(met)

    deal = [*on, "_a", "_b"]
    s = a.groupBy(*deal).cogroup(b.groupBy(*deal)).applyInArrow(compare, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*on, key)), "_top double", "_total double", f"_best {kinds[key]}"]))
    best = s.groupBy(*on, key).agg(F.max("_top").alias("top"), F.sum("_total").alias("total"), F.min_by("_best", F.struct(-F.col("_top"), "_best")).alias("_best"))
    pool = real.groupBy(*on).agg(F.count("*").alias("n"), F.min(key).alias("_first"), F.max(key).alias("_other"))
    out = join_on(rows.select(*on, key), pool, on)
    out = join_on(out, best, [*on, key], "left")
    n = F.col("n") - (1 if leave_out else 0)
    first = F.when(F.lit(leave_out) & (F.col("_first") == F.col(key)), F.col("_other")).otherwise(F.col("_first"))
    return out.select(*on, key, n.alias("n_reference_real_texts"), F.when(n > 0, F.coalesce("_best", first)).alias("nearest_real_id"), F.when(n > 0, F.coalesce("top", F.lit(0.0))).alias("nearest_tfidf_cosine"), F.when(n > 0, F.coalesce("total", F.lit(0.0)) / n).alias("mean_tfidf_cosine_to_real"))


def nearest_by_sequence(real: DataFrame, rows: DataFrame, on: list[str], key: str, toks: str, leave_out: bool) -> DataFrame:
    """(on, key, nearest_rouge_l_f1, mean_rouge_l_f1): against all real texts of the slice (all pairs of a slice are compared, as
    each counts in the mean)."""
    a, b = _dealt(rows.select(*on, key, F.col(toks).alias("x")), real.select(*on, key, F.col(toks).alias("y")), on, key, SEQUENCE_ROWS)
    pairs = join_on(a.withColumnRenamed(key, "_q"), b.withColumnRenamed(key, "_c"), [*on, "_a", "_b"])
    pairs = pairs.where("_q <> _c") if leave_out else pairs
    s = pairs.select(*on, F.col("_q").alias(key), rouge_l("x", "y").alias("s")).groupBy(*on, key).agg(F.max("s").alias("nearest_rouge_l_f1"), F.avg("s").alias("mean_rouge_l_f1_to_real"))
    return join_on(rows.select(*on, key), s, [*on, key], "left")


def additive_perplexity(real: DataFrame, rows: DataFrame, on: list[str], key: str, toks: str, order: int, leave_out: bool, alpha: float = 0.5, name: str = "perplexity") -> DataFrame:
    """(on, key, name): perplexity of token arrays under the additive n-gram model of the real texts of the slice.

    Where ``leave_out``, under the model of all others: counts less the text's own, and a vocabulary without the types that
    only it has.  Unknown tokens have a count of zero on both sides; the vocabulary holds the types, ``<unk>`` and ``</s>``."""
    grams = lambda d: d.select(*on, key, F.explode(F.transform(F.array(padded(F.col(toks), order)), lambda w: ngrams(w, order))[0]).alias("g"))
    context = F.slice("g", 1, order - 1)
    all_ = grams(real).groupBy(*on, "g").agg(F.count("*").alias("c"))
    around = all_.groupBy(*on, context.alias("h")).agg(F.sum("c").alias("n"))
    own = grams(rows).groupBy(*on, key, "g").agg(F.count("*").alias("m")).withColumn("h", context)
    types = real.select(*on, key, F.explode(F.array_distinct(toks)).alias("w"))
    texts = types.groupBy(*on, "w").agg(F.count("*").alias("texts"))
    size = texts.groupBy(*on).agg(F.count("*").alias("types"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    asked = join_on(join_on(own, all_, [*on, "g"], "left"), around, [*on, "h"], "left")
    asked = join_on(asked, size, on, "left")
    if leave_out:
        mine = own.groupBy(*on, key, "h").agg(F.sum("m").alias("hm"))
        gone = join_on(types, texts.where("texts = 1"), [*on, "w"]).groupBy(*on, key).agg(F.count("*").alias("gone"))
        asked = join_on(join_on(asked, mine, [*on, key, "h"]), gone, [*on, key], "left")
        c, n, v = zero("c") - F.col("m"), zero("n") - F.col("hm"), zero("types") - zero("gone") + 2
    else:
        c, n, v = zero("c"), zero("n"), zero("types") + 2
    p = F.log((c + alpha) / (n + alpha * v))
    return asked.groupBy(*on, key).agg(F.exp(-F.sum(F.col("m") * p) / F.sum("m")).alias(name))


def _metrics(real: DataFrame, rows: DataFrame, on: list[str], key: str, toks: str, leave_out: bool, measures: tuple) -> DataFrame:
    out = rows.select(*on, key, F.size(toks).cast("long").alias("token_count"), type_token_ratio(F.col(toks)).alias("type_token_ratio"))
    parts = {
        "terms": lambda: nearest_by_terms(real, rows, on, key, "_terms", leave_out),
        "sequence": lambda: nearest_by_sequence(real, rows, on, key, toks, leave_out),
        "unigram": lambda: additive_perplexity(real, rows, on, key, toks, 1, leave_out, name="unigram_perplexity_vs_real"),
        "bigram": lambda: additive_perplexity(real, rows, on, key, toks, 2, leave_out, name="bigram_perplexity_vs_real"),
    }
    for name, part in parts.items():
        out = join_on(out, part(), [*on, key]) if name in measures else out
    return out


def text_metrics(real: DataFrame, synthetic: DataFrame, on: list[str], key: str, text: str, toks: str, measures: tuple = MEASURES) -> tuple[DataFrame, DataFrame]:
    """(metrics of the synthetic texts, baseline of the real ones), one row a text, of the slices that both have.

    The baseline compares each real text with the others of its slice; the synthetic metrics also say how far they lie from
    the baseline's medians (differences of nearness, ratios of perplexity) and from the real means (ratios of length and
    type-token ratio).  Of ``measures`` that are not asked for, there are no columns."""
    slices = lambda d: d.select(*on).distinct()
    real, synthetic = (d.select(*on, key, toks, words_and_pairs(text).alias("_terms")) for d in (real, synthetic))
    # each side is read by several measures
    real, synthetic = kept(join_on(real, slices(synthetic), on)), kept(join_on(synthetic, slices(real), on))
    base = kept(_metrics(real, real, on, key, toks, True, measures))
    middle = base.groupBy(*on).agg(F.avg("token_count").alias("_n"), F.avg("type_token_ratio").alias("_ttr"))
    near = [c for c in ("nearest_tfidf_cosine", "nearest_rouge_l_f1", "bigram_perplexity_vs_real", "unigram_perplexity_vs_real") if c in base.columns]
    middle = join_on(middle, quantiles_of(base, near, {"mid": 0.5}, on).withColumnsRenamed({f"{c}_mid": f"_{c}" for c in near}), on, "left")
    got = join_on(kept(_metrics(real, synthetic, on, key, toks, False, measures)), middle, on)
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    less = lambda c: F.col(c) - F.col(f"_{c}")
    far = {
        "nearest_tfidf_minus_real_baseline_median": (less, "nearest_tfidf_cosine"),
        "nearest_rouge_minus_real_baseline_median": (less, "nearest_rouge_l_f1"),
        "bigram_perplexity_over_real_baseline_median": (lambda c: ratio(c, f"_{c}"), "bigram_perplexity_vs_real"),
        "unigram_perplexity_over_real_baseline_median": (lambda c: ratio(c, f"_{c}"), "unigram_perplexity_vs_real"),
    }
    got = got.withColumns({name: how(c) for name, (how, c) in far.items() if c in near} | {"token_count_over_real_mean": ratio("token_count", "_n"), "type_token_ratio_over_real_mean": ratio("type_token_ratio", "_ttr")})
    return got.drop(*[c for c in got.columns if c.startswith("_")]), base


def slice_report(synthetic: DataFrame, real: DataFrame, group: str = "grp", story: str = "story_id") -> DataFrame:
    """By (group, story), group and overall: counts, medians of both sides, shares within the real quartiles, and the ratio of the
    median bigram perplexities; levels that only one side has are left out, and so are measures that the tables do not have."""
    medians = {n: c for n, c in MEDIANS.items() if c in real.columns}
    inner = [n for n in WITHIN if n in medians]
    out, columns = None, list(medians.values())
    for by, level in (([group, story], "story"), ([group], "group"), ([], "overall")):
        got = join_on(synthetic.groupBy(*by).agg(F.count("*").alias("n_synthetic")), real.groupBy(*by).agg(F.count("*").alias("n_real_baseline")), by)
        mine = quantiles_of(synthetic, columns, {"mid": 0.5}, by).withColumnsRenamed({f"{c}_mid": f"synthetic_{n}_median" for n, c in medians.items()})
        theirs = quantiles_of(real, columns, {"mid": 0.5, "lo": 0.25, "hi": 0.75}, by).withColumnsRenamed({f"{c}_{q}": f"real_{n}_median" if q == "mid" else f"_{n}_{q}" for n, c in medians.items() for q in ("mid", "lo", "hi")})
        got = kept(join_on(join_on(got, mine, by, "left"), theirs, by, "left"))  # one row a slice
        inside = join_on(synthetic, got.select(*by, *[f"_{n}_{e}" for n in inner for e in ("lo", "hi")]), by)
        share = inside.groupBy(*by).agg(*[F.avg(F.col(medians[n]).between(F.col(f"_{n}_lo"), F.col(f"_{n}_hi")).cast("int")).alias(f"synthetic_{n}_within_real_iqr_share") for n in inner])
        got = join_on(got, share, by, "left").withColumn("synthetic_bigram_perplexity_over_real_median", F.when(F.col("real_bigram_perplexity_median") != 0, F.col("synthetic_bigram_perplexity_median") / F.col("real_bigram_perplexity_median")))
        names = [(F.col(c) if c in by else F.lit("ALL")).cast("string").alias(c) for c in (group, story)]
        part = got.where("n_synthetic > 0 and n_real_baseline > 0").select(F.lit(level).alias("summary_level"), *names, *[c for c in got.columns if c not in by and not c.startswith("_")])
        out = part if out is None else out.unionByName(part)
    return out
