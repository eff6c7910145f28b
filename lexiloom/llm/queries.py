"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .ann import op3
from .ball_kmeans import op12
from .decontaminate import op8
from .filter_audit import op13
from .language import op6
from .lm_scoring import op1
from .mixing import op5
from .ngram_join import op9
from .oracle import ORACLE_SQL  # noqa: F401
from .pii import op11
from .quality import op10
from .suffix_dedup import op4
from .toxicity import op7
from .url_filters import op2


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _shipped(f)
    for name, f in {
        "op1_lm_scoring": op1,
        "op2_url_filters": op2,
        "op3_ann": op3,
        "op4_suffix_dedup": op4,
        "op5_mixing": op5,
        "op6_language_id": op6,
        "op7_toxicity": op7,
        "op8_decontamination": op8,
        "op9_ngram_join": op9,
        "op10_quality": op10,
        "op11_pii": op11,
        "op12_ball_kmeans": op12,
        "op13_filter_audit": op13,
    }.items()
}
