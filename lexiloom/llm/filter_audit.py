"""How document filters interact: what each would remove first, last, alone or after any others.

Every document gets one failure flag per filter.  ``CUBE`` over the flags and the part of the corpus counts, for each set of
filters, the rows whose flags in the set are all false: the survivors of that set.  Everything else follows from pairs of
sets: a step that applies filter ``f`` after the filters ``P`` removes survivors(P) - survivors(P + f).

The cube is taken of counts by (part, flags), at most 2^n rows a part, so that its expansion does not grow with the corpus.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import NULL_ID, materialise

SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Rows without an id meet no label; they are dealt to so many join keys.
SALTS = 64


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters that look at one text: A short, B repetitive, C capitals, D symbols."""
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, kept, good, toxic): documents by part and flags.

    E fails a document whose text also belongs to a smaller id, anywhere in the table; the rows of the smallest id all pass.  A
    null id is smaller than all others and has no label, a null text is empty, a null language is the part of the empty
    string.  Repeated documents count each; a document is good (toxic) if any of its label rows says 1.  Copies are counted by
    text digest, part and label before they meet, so that a text held by a third of all rows is a few rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        *[c.alias(k) for k, c in text_failures(text).items()],
    )
    rows = rows.groupBy("id", "part", "digest", *"ABCD").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    marks = marks.where(F.col("id").isNotNull() & (F.col("good") | F.col("bad"))).withColumn("salt", F.lit(0).cast("long"))
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    salted = salted.withColumn("id", F.coalesce("id", F.lit(NULL_ID))).join(marks.withColumn("known", F.lit(True)), ["id", "salt"], "left")
    by_text = salted.groupBy("digest", "part", *"ABCD", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad")).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    first = F.expr("min(first.id) over (partition by digest)")
    by_text = by_text.withColumn("passing", F.when(F.col("first.id") == first, F.col("first.n")).otherwise(F.lit(0)))
    split = by_text.select("*", F.inline(F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("m"))))).where("m > 0")
    return split.groupBy("part", *"ABCDE").agg(F.sum("m").alias("kept"), F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), F.col("m")).otherwise(0)).alias("toxic"))


def survivors(counts: DataFrame, flags: str = "ABCDE") -> DataFrame:
    """(part, set, kept, good, toxic) for every set of filters, zeros included; ``set`` has bit i for the i-th flag.

    ``counts`` has columns part, one boolean per flag, kept, good, toxic.  In a row of the cube the flags that are grouped are
    the chosen ones; the row where all of them are false counts the survivors of just that set."""
    names = [*flags, "part"]
    cube = counts.cube(*names).agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")], *[F.grouping(c).alias(f"all_{c}") for c in names])
    all_false = F.lit(True)
    chosen = F.lit(0)
    for i, c in enumerate(flags):
        all_false = all_false & ((F.col(f"all_{c}") == 1) | ~F.coalesce(F.col(c), F.lit(False)))
        chosen = chosen + F.when(F.col(f"all_{c}") == 0, 1 << i).otherwise(0)
    found = cube.where((F.col("all_part") == 0) & all_false).select("part", chosen.alias("set"), "kept", "good", "toxic")
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))).alias("set"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "good", "toxic")]
    return every.join(found, ["part", "set"], "left").select("part", "set", *zero)


def interactions(counts: DataFrame, flags: str = "ABCDE") -> DataFrame:
    """One row per part, order of all filters and step: what the step keeps, removes, finds removed already, removes alone, and
    loses of good and toxic documents, and the filter's removals summed over all orders.  No part gives no rows."""
    spark, n = counts.sparkSession, len(flags)
    full = (1 << n) - 1
    sets = survivors(counts, flags)
    by_part = sets.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", "kept"))).alias("at"))  # 2^n rows a part
    pairs = [(f, p, p | 1 << f, factorial(bin(p).count("1")) * factorial(n - 1 - bin(p).count("1"))) for f in range(n) for p in range(full + 1) if not p >> f & 1]
    pair = spark.createDataFrame(pairs, "filter int, before int, after int, orders long")
    was = sets.select("part", F.col("set").alias("before"), F.col("kept").alias("kept0"), F.col("good").alias("good0"), F.col("toxic").alias("toxic0"))
    now = sets.withColumnRenamed("set", "after")
    step = F.broadcast(pair).join(was, "before").join(now, ["part", "after"]).join(by_part, "part")  # n 2^(n-1) pairs of sets, whatever the input
    removed = F.col("kept0") - F.col("kept")
    alone = F.expr(f"at[{full} - shiftleft(1, filter)] - at[{full}]")
    failing = F.expr("at[0] - at[shiftleft(1, filter)]")
    step = step.select(
        "part", "filter", "before", "orders", "kept", removed.alias("removed"), (failing - removed).alias("redundant"), alone.alias("unique_fails"),
        (F.col("good0") - F.col("good")).alias("good_lost"), (F.col("toxic0") - F.col("toxic")).alias("toxic_lost"),
    )
    shares = step.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    orders = [("".join(flags[f] for f in o), k + 1, o[k], sum(1 << f for f in o[:k])) for o in permutations(range(n)) for k in range(n)]
    walk = spark.createDataFrame(orders, "filter_order string, step int, filter int, before int")
    out = step.drop("orders").join(shares, ["part", "filter"]).join(F.broadcast(walk), ["filter", "before"])  # n! n rows, whatever the input
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def op13(spark, sf_dir: str) -> DataFrame:
    """The five filters over all documents by language: 600 rows a part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return interactions(materialise(failure_counts(docs, labels)))
