"""Feature redundancy: inventory, duplicate columns, pairwise correlations, clusters, exclusions, correlation structure."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import number, safe_corr
from .stats import running_counts


def _stacked(df: DataFrame, parts: list) -> DataFrame:
    """One aggregate row of structs as rows."""
    row = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return row.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(parts))])).alias("r")).select("r.*")


def column_inventory(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, non_null, missing, distinct_non_null, distinct_with_null, constant, id_like) in one pass."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        n, d, m = F.count(c), F.countDistinct(c), F.count_if(F.col(c).isNull())
        out.append(
            F.struct(
                F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), n.alias("non_null"), m.alias("missing"), d.alias("distinct_non_null"), (d + F.when(m > 0, 1).otherwise(0)).alias("distinct_with_null"),
                (d + F.when(m > 0, 1).otherwise(0) <= 1).cast("int").alias("is_constant"), ((d == F.count(F.lit(1))) & (m == 0)).cast("int").alias("is_id_like"),
            )
        )
    return _stacked(df, out)


def duplicate_columns(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(first_column, column_name) of columns that hold the same text in every row: equal sums and exclusive ors of a hash of row
    and value, so that no column is gathered."""
    sig = lambda c: F.struct(F.lit(c).alias("column_name"), F.lit(columns.index(c)).alias("ord"), F.sum(F.xxhash64(F.col(row_id), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(3), F.col(row_id), F.coalesce(F.col(c).cast("string"), F.lit("\x00")))).alias("b"))
    rows = _stacked(df, [sig(c) for c in columns])
    w = Window.partitionBy("a", "b").orderBy("ord")  # one row a column
    return rows.withColumn("first_column", F.first("column_name").over(w)).where("first_column <> column_name").select("first_column", "column_name")


def pair_correlations(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """All pairs of columns in one aggregate: rows both have, Pearson, equality, largest and mean absolute difference."""
    out = []
    for a, b in combinations(columns, 2):
        x, y = number(a), number(b)
        both = x.isNotNull() & y.isNotNull()
        d = F.when(both, F.abs(x - y))
        out.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.count_if(both).alias("n"), safe_corr(x, y).alias("pearson"), F.coalesce(F.max(d) == 0, F.lit(False)).cast("int").alias("exact_equal"), F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff")))
    return _stacked(df, out).where(f"n >= {least}")


def spearman_pairs(df: DataFrame, columns: list[str], row_id: str, least: int = 3) -> DataFrame:
    """(column_a, column_b, n, spearman): Pearson on average ranks over the rows both columns have.  Ranks come from running
    counts over the distinct values of a pair, not from sorting a pair's rows."""
    pairs = F.array(*[F.struct(F.lit(f"{i}").alias("pair"), F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), number(a).alias("x"), number(b).alias("y")) for i, (a, b) in enumerate(combinations(columns, 2))])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null and y is not null")

    def rank(side: str) -> DataFrame:
        per = long.groupBy("pair", F.col(side).alias("v")).agg(F.count("*").alias("c"))
        return running_counts(per, "v", ["c"], ["pair"]).select("pair", F.col("v").alias(side), (F.col("run_c") - (F.col("c") - 1) / 2).alias(f"r{side}"))

    r = long.join(rank("x"), ["pair", "x"]).join(rank("y"), ["pair", "y"])
    return r.groupBy("column_a", "column_b").agg(F.count("*").alias("n"), safe_corr("rx", "ry").alias("spearman")).where(f"n >= {least}")


def strongest_pairs(pairs: DataFrame, threshold: float = 0.0, by: str = "pearson") -> DataFrame:
    """Pairs that correlate at least so much, the strongest first, then by names (a report: one row a pair of columns)."""
    return pairs.where(F.abs(by) >= threshold).orderBy(F.desc(F.abs(by)), "column_a", "column_b")


def most_common(counts: DataFrame, count: str, *names: str) -> DataFrame:
    """Rows with the largest counts first, equal ones by name."""
    return counts.orderBy(F.desc(count), *names)


def shared_columns(a: DataFrame, b: DataFrame, order: list[str] | None = None) -> list[str]:
    """Columns that both tables have, in the stated order or that of the first."""
    return [c for c in (order or a.columns) if c in a.columns and c in b.columns]


def usable_features(real: DataFrame, generated: DataFrame, order: list[str], ids: tuple[str, ...] = ()) -> list[str]:
    """Shared columns that hold at least one number on either side (one aggregate a side); raises if there are none."""
    both = [c for c in shared_columns(real, generated, order) if c not in ids]
    some = [df.agg(*[F.max(number(F.col(_quoted(c))).isNotNull()).alias(c) for c in both]).first().asDict() if both else {} for df in (real, generated)]
    out = [c for c in both if all(x[c] for x in some)]
    if not out:
        raise ValueError("No shared numeric features")
    return out


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def correlation_clusters(pairs: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(column_name, cluster): components of columns that correlate at least so much; the first name stands for a cluster.
    A driver step: the graph has one vertex a column of the schema."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in pairs.where(F.abs("pearson") >= threshold).select("column_a", "column_b").collect():
        a, b = sorted((find(r[0]), find(r[1])))
        root[b] = a
    return pairs.sparkSession.createDataFrame([(c, find(c)) for c in sorted(root)], "column_name string, cluster string")


def recommended_exclusions(inventory: DataFrame, duplicates: DataFrame) -> DataFrame:
    return inventory.where("is_constant = 1 or is_id_like = 1").select("column_name").union(duplicates.select("column_name")).distinct()


def correlation_structure(df: DataFrame, side, columns: list[str]) -> DataFrame:
    """How alike the correlation matrices of two sides are: correlation of the entries, mean and largest absolute difference, and
    Frobenius distance over the pairs."""
    a, b = (pair_correlations(df.where(s), columns).select("column_a", "column_b", F.col("pearson").alias(n)) for s, n in ((side, "ra"), (~side, "rb")))
    d = F.col("ra") - F.col("rb")
    return a.join(b, ["column_a", "column_b"]).where("ra is not null and rb is not null").agg(F.count("*").alias("pairs"), safe_corr("ra", "rb").alias("matrix_corr"), F.avg(F.abs(d)).alias("mean_abs_diff"), F.max(F.abs(d)).alias("max_abs_diff"), F.sqrt(2 * F.sum(d * d)).alias("frobenius"))
