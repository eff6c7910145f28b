"""Nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots (the first ``prefix`` of ``pivots``), and posted, with its
rank, in the inverted file of each of them.  For a query the files of its own nearest pivots are read; with
ranks beyond the prefix set to ``prefix``, the footrule distance sum |rank_x - rank_q| is a constant less
2 * sum over shared pivots of (prefix - max(rank_x, rank_q)), so the files alone give it.  The ``share`` of each shard with
the least distance is ranked again by the exact inner product.

Largest inner products are made nearest points by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, which
is 0 for queries.  Queries are a stated set; they meet shards of bounded size in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import NULL_ID, bounded_sample, ids_back, materialise

PIVOTS, PREFIX, SHARE = 512, 64, 0.16
SHARD, QUERIES = 8192, 4096


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, x array<double>) of the vectors that take part: of the commonest dimension (ties: the smaller), all components
    finite, not all zero.  ``row`` tells rows apart: the id, or a number where ids repeat or are null."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(
        F.col("x").isNotNull() & F.expr("forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists(x, v -> v <> 0)")
    )
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("u")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return rows.select(F.col("id").alias("row"), "id", "x")
    rows = rows.where(F.size("x") == sizes["d"])
    if sizes["u"] == sizes["n"]:
        return rows.select(F.col("id").alias("row"), "id", "x")
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "x"))


def _matrix(col: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


class PermutationIndex:
    """Inverted files of a shard's vectors."""

    def __init__(self, pivots: np.ndarray, prefix: int):
        self.pivots, self.prefix = pivots, min(prefix, len(pivots))

    def orders(self, x: np.ndarray) -> np.ndarray:
        near = x @ self.pivots.T
        k = self.prefix
        o = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.broadcast_to(np.arange(k), (len(x), k))
        return np.take_along_axis(o, np.argsort(-np.take_along_axis(near, o, 1), axis=1, kind="stable"), 1)

    def add(self, x: np.ndarray) -> PermutationIndex:
        o = self.orders(x)
        self.n = len(x)
        by = np.argsort(o.ravel(), kind="stable")
        self.row, self.rank = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int32)
        self.begin = np.searchsorted(o.ravel()[by], np.arange(len(self.pivots) + 1))
        return self

    def nearest(self, order: np.ndarray, count: int) -> np.ndarray:
        """Rows with the least footrule distance to a query's pivot order; ties to the smaller row."""
        begin, size = self.begin[order], self.begin[order + 1] - self.begin[order]
        parts = [slice(b, b + s) for b, s in zip(begin, size)]
        row = np.concatenate([self.row[p] for p in parts])
        shared = self.prefix - np.maximum(np.concatenate([self.rank[p] for p in parts]), np.repeat(np.arange(self.prefix), size))
        score = np.bincount(row, shared, self.n).astype(np.int64) * self.n + np.arange(self.n)[::-1]
        return np.argpartition(-score, count - 1)[:count] if count < self.n else np.arange(self.n)


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each vector with ``is_query`` (a condition on column ``id``) its ``k`` nearest
    of all other rows found, largest inner product first, ties to the smaller id (null before all), then by row; all of them
    if there are fewer.  Rows that repeat an id are vectors of their own: each is found, and each that asks has its own
    ranks.  Other columns are not looked at; an empty table gives none."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, key, vector)
    n, top = rows.agg(F.count("*"), F.max(F.expr("aggregate(x, 0d, (a, v) -> a + v * v)"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    queries = rows.where(is_query)
    nq = queries.count()
    sample = bounded_sample(rows, pivots, "row").orderBy("row").collect()
    base = np.array([r["x"] for r in sample])

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])

    index = PermutationIndex(lifted(base), prefix)
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-nq // QUERIES))

    def one(table: pa.Table) -> pa.Table:
        asked = table["q"].to_numpy().astype(bool)
        ids, row, x = table["id"].fill_null(NULL_ID).to_numpy(), table["row"].to_numpy(), _matrix(table["x"], table.num_rows)
        order = np.lexsort((row, ids))
        c = order[~asked[order]]
        q = order[asked[order]]
        out: list = [[], [], [], [], []]
        if len(c) and len(q):
            here = PermutationIndex(index.pivots, index.prefix).add(lifted(x[c]))
            want = min(len(c), max(int(np.ceil(share * len(c))), 8 * k) + 1)
            orders = here.orders(np.column_stack([x[q] / np.sqrt((x[q] ** 2).sum(1, keepdims=True)), np.zeros(len(q))]))
            for i, o in zip(q, orders):
                near = np.sort(here.nearest(o, want))
                near = near[row[c[near]] != row[i]]
                score = x[c[near]] @ x[i]
                best = np.lexsort((near, -score))[:k]
                for column, v in zip(out, (np.full(len(best), row[i]), np.full(len(best), ids[i]), row[c[near[best]]], ids[c[near[best]]], score[best])):
                    column.append(v)
        longs, score = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in out[:4]), np.concatenate(out[4]) if out[4] else np.zeros(0)
        return pa.table([*map(ids_back, longs), pa.array(score, pa.float64())], ["query", "query_id", "row", "vec_id", "score"])

    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda m: F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(m)).cast("int")
    dealt = rows.select("row", "id", "x", F.lit(False).alias("q"), part(shards).alias("shard"), all_of(blocks).alias("block"))
    dealt = dealt.union(queries.select("row", "id", "x", F.lit(True).alias("q"), all_of(shards).alias("shard"), part(blocks).alias("block")))
    found = dealt.groupBy("shard", "block").applyInArrow(one, "query long, query_id long, row long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


