"""Guards and small column helpers: required columns, join cardinality, NaN at the boundary, safe division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: key {dict(zip(keys, twice[0][: len(keys)]))} occurs {twice[0]['count']} times")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """A join that raises where the keys break the stated cardinality (one_to_one, many_to_one, one_to_many)."""
    if validate.startswith("one"):
        assert_unique(left, on, "left side")
    if validate.endswith("one"):
        assert_unique(right, on, "right side")
    return left.join(right, on, how)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and the text ``NA`` become NULL; Spark sorts NaN last and lets it spoil averages."""
    kinds = dict(df.dtypes)
    return df.select(*[F.nullif(F.col(c), F.lit("NA")).alias(c) if kinds[c] == "string" else F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def number(col: Column | str) -> Column:
    """Text to double; what is no number is NULL, as is NaN."""
    x = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_rate(num: Column | str, den: Column | str, empty: float | None = None) -> Column:
    """num / den where den > 0, else ``empty`` (NULL for rates per word, 0.0 for grouped error rates)."""
    num, den = (F.col(c) if isinstance(c, str) else c for c in (num, den))
    return F.when(den > 0, num / den).otherwise(F.lit(empty).cast("double"))


def row_mean(cols: list[Column | str]) -> Column:
    """Mean of the non-null values of a row, NULL if there are none."""
    got = F.filter(F.array(*[F.col(c) if isinstance(c, str) else c for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.size(got))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; NULL where a side does not vary (``corr`` raises there under ANSI)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    n = F.count(x)
    cov = F.covar_pop(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((n >= 2) & (spread > 0), F.try_divide(cov, spread))


def apply_decisions(df: DataFrame, decisions: dict[str, str]) -> DataFrame:
    """The columns marked ``keep``, in the order of the decisions; raises where a column has none (closed world)."""
    open_ = [c for c in df.columns if c not in decisions]
    if open_:
        raise ValueError(f"Columns without a decision: {', '.join(open_)}")
    return df.select(*[c for c, d in decisions.items() if d == "keep" and c in df.columns])
