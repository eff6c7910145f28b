"""Joins with rules for ambiguous keys, preferred records and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def suffix_join(master: DataFrame, rows: DataFrame, key: str, path: str, suffix: str, features: list[str], order: str, row_id: str, long_prefix: str = "", on_ambiguous: str = "first") -> DataFrame:
    """One row of ``rows`` for each master row with the same ``key``.

    If several fit: with ``on_ambiguous='first'`` the first (by ``order``) whose ``path`` ends in ``long_prefix + suffix``, else the
    first that ends in ``suffix``, else the first; with ``'zero'`` the only one that ends in ``suffix``, else none, and features
    that stay empty are 0."""
    m = master.join(rows.select(F.col(key), F.col(path).alias("_p"), F.col(order).alias("_o"), *[F.col(c).alias(f"_f_{c}") for c in features]), key, "left")
    mine = Window.partitionBy(row_id)
    ends = F.coalesce(F.col("_p").endswith(F.col(suffix)), F.lit(False))
    if on_ambiguous == "first":
        rank = F.when(F.col("_p").endswith(F.concat(F.lit(long_prefix), F.coalesce(suffix, F.lit("")))), 0).when(ends & (F.col(suffix) != ""), 1).otherwise(2)
        m = m.withColumn("_k", F.row_number().over(mine.orderBy(rank, "_o"))).where("_k = 1")
        return m.select(*master.columns, *[F.col(f"_f_{c}").alias(c) for c in features])
    m = m.withColumn("_n", F.count("_p").over(mine)).withColumn("_s", F.sum(ends.cast("int")).over(mine))
    good = (F.col("_n") == 1) | ((F.col("_s") == 1) & ends)
    m = m.withColumn("_k", F.row_number().over(mine.orderBy(F.when(good, 0).otherwise(1), "_o"))).where("_k = 1")
    return m.select(*master.columns, *[F.coalesce(F.when(good, F.col(f"_f_{c}")), F.lit(0)).alias(c) for c in features])


def prefer(df: DataFrame, keys: list[str], preferred, last: str) -> DataFrame:
    """One row per key: preferred rows first, then the largest ``last``."""
    w = Window.partitionBy(*keys).orderBy(F.when(preferred, 0).otherwise(1), F.desc(last))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def excluding(df: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the source rows (children that a generation was prompted with)."""
    return df.join(sources.select(*keys).distinct(), keys, "left_anti")


def first_and_list(df: DataFrame, keys: list[str], order: str, first: list[str], item: str, name: str, sep: str = "|") -> DataFrame:
    """Per key: the first value in order of some columns, and all ``item`` values in order, joined."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("v"))))
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in first], F.array_join(F.transform(cells, lambda c: c["v"]), sep).alias(name))
