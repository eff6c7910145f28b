"""Decisions about columns: what a severity table keeps, in which order, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import apply_decisions, require_columns
from .packages import BUNDLE_COLUMNS

# The columns of the severity table, in order.
KEEP = [
    "File_ID",
    "File_kideval",
    "Group",
    "Sex",
    "Age(Month)",
    "#utterances",
    "#words",
    "DSS_tbl_warning_50",
    "MLU_Morphemes",
    "VOCD_D_optimum_average",
    "IPSyn_Total",
    "DSS_tbl_score",
    "Word_Errors_per_utt",
    "retracing_per_utt",
    "repetition_per_utt",
    "DSS_tbl_IP",
    "DSS_tbl_PP",
    "DSS_tbl_MV",
    "DSS_tbl_SV",
    "DSS_tbl_NG",
    "DSS_tbl_CNJ",
    "DSS_tbl_IR",
    "DSS_tbl_WHQ",
    "Syntax_Mean_DepLen",
    "Syntax_Max_DepLen",
    "Syntax_Mean_TreeDepth",
    "Syntax_Max_TreeDepth",
    "Syntax_Subordination_Utt_Prop",
    "Syntax_Coordination_Utt_Prop",
    "Syntax_Subject_Utt_Prop",
    "Syntax_Object_Utt_Prop",
    "Syntax_AuxCop_Utt_Prop",
    "Syntax_Oblique_Utt_Prop",
    "Syntax_ComplexNP_Utt_Prop",
    "Syntax_FiniteVerb_Tokens_per_Utt",
    "bare_marking_errors_per_word",
    "pronoun_errors_per_word",
    "past_overgeneralization_errors_per_past_opp",
]
# Generated tables name these otherwise, or lack them.
RENAMED = {"*-3S": "*-S3", "irr-3S": "irr-S3"}
OPTIONAL = ["IPSyn_Utts", "IPSyn_Total", "irr-PAST"]


def _q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def specification(spark, columns: list[str], decisions: dict[str, tuple[str, str, str]], kept: list[str], metadata: list[str] | None = None) -> DataFrame:
    """(column, action, category, included, reason): one row a column in table order; ``decisions`` maps a column to (action,
    category, reason), and metadata columns are kept as such.  Raises where a column has no decision."""
    meta = set(metadata or [])
    open_ = [c for c in columns if c not in decisions and c not in meta]
    if open_:
        raise ValueError(f"Columns without a decision: {', '.join(open_)}")
    rows = [(c, *(("keep", "generated_metadata") if c in meta else decisions[c][:2]), int(c in kept or c in meta), "Identifies the bundle and what it was prompted with." if c in meta else decisions[c][2]) for c in columns]
    return spark.createDataFrame(rows, "column_name string, action string, category string, included int, reason string")


def severity_table(df: DataFrame, keep: list[str] | None = None, decisions: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """The kept columns in their order; raises where one is missing or, given decisions, where a column has none."""
    keep = KEEP if keep is None else keep
    require_columns(df, keep)
    if decisions is not None:
        apply_decisions(df, {c: d[0] for c, d in decisions.items()})
    return df.select(*[_q(c) for c in keep])


def generated_severity_table(df: DataFrame, keep: list[str] | None = None, metadata: list[str] | None = None) -> DataFrame:
    """The same of a generated table: columns under another name are renamed, ``_mlt`` duplicates go, optional columns that are
    missing are NULL, and the bundle's metadata come first."""
    keep = KEEP if keep is None else keep
    names = set(df.columns)
    out = df.select(*[_q(c) for c in df.columns if not c.endswith("_mlt") and not (c in RENAMED.values())], *[_q(b).alias(a) for a, b in RENAMED.items() if b in names and a not in names])
    out = out.select(*[_q(c) for c in out.columns], *[F.lit(None).cast("string").alias(c) for c in OPTIONAL if c not in out.columns])
    require_columns(out, keep)
    meta = [c for c in (BUNDLE_COLUMNS if metadata is None else metadata) if c in out.columns]
    return out.select(*[_q(c) for c in meta], *[_q(c) for c in keep])


def replace_columns(master: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``master`` with the columns of ``new`` (one row a key) in place of its own of the same names."""
    from ..checks import checked_join

    gone = [c for c in new.columns if c != key and c in master.columns]
    return checked_join(master.drop(*gone), new, [key], "left", "one_to_one")


def contingency(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` by the stated values of ``columns``, 0 where there are none."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)
