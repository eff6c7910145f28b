"""Connected components by rounds of contraction, without collecting edges anywhere.

In each round every vertex points to its smallest neighbour (or itself), pointers are followed once more, and edges are
relabelled and deduplicated; a component shrinks to its smallest vertex.  Minima are pre-aggregated before the shuffle,
and joins are on a unique side, so a hub costs no more than its edges.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex that has an edge to another one; root is the smallest vertex of its component.
    Null ends and loops are ignored.  Vertices without edges are absent."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    maps: list[DataFrame] = []
    done: list[DataFrame] = []
    while True:
        e = materialise(e)
        drop(*done)  # what led to these edges
        if e.isEmpty():
            break
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        low = materialise(low)
        nxt = low.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        step = materialise(low.join(nxt, "m", "left").select("v", F.coalesce("mm", "m").alias("root")))
        maps.append(step)
        done = [e, low]
        left = step.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        e = e.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    if not maps:
        return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("v").alias("root"), F.col("root").alias("r2")), "root", "left").select("v", F.coalesce("r2", "root").alias("root"))
    out = materialise(out)
    drop(e, *maps)
    return out
