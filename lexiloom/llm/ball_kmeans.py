"""Centroid clustering by ball k-means, in exact integers.

A cluster is a ball: its centroid, and a radius that no member lies beyond.  Two balls are neighbours when their centroids are
closer than twice the radius; only to such a cluster can a member move.  The neighbours of a ball, ordered by distance, split
it into a stable core (members nearer than half way to the nearest neighbour, which stay unseen) and annuli: a member of the
k-th annulus is compared with the k nearest neighbours and no others.  All comparisons are of squared integer distances, so
that no rounding decides and the result is that of comparing everything.

The vectors lie in blocks of packed rows with the cluster each was last in.  A round reads the blocks, assigns, and writes them
again, with the sums, counts and radii of each block's clusters beside them; Spark adds those up by cluster.  The new radius is
bounded by the old one and the way the centroid has gone (triangle inequality), which saves a pass.  What reaches the driver is
one row a cluster.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, ids_back, longs, materialise, narrow, pack, unpack

#: Rows of a block.
BLOCK = 4096
#: Components beyond this are held to it, so that squared distances of 64 components fit a long.
FAR = 1 << 27
_BLOCKS = "ids binary, x binary, cluster binary, d binary, part binary"


def whole(column, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integer components): exactly ``size`` components, none null or not finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    begin = column.offsets.to_numpy()[:-1] if len(column) else np.zeros(0, np.int64)
    rows = np.flatnonzero(valid & (lengths == size))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    x = values[begin[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    fine = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        return rows[fine], np.clip(np.floor(scale * x[fine]), -FAR, FAR).astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, or row by row."""
    return ((x - c) ** 2).sum(1)


class Balls:
    """Centroids, an upper bound of each ball's radius, and each ball's neighbours in order of distance."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None = None):
        self.centroids, self.radii = centroids, radii
        self.gaps = np.stack([distances(centroids, c) for c in centroids]) if len(centroids) else np.zeros((0, 0), np.int64)
        self.neighbours = []
        for i, gap in enumerate(self.gaps):
            # a gap above twice the radius has no member that could change sides; equality may be a tie
            near = [j for j in range(len(gap)) if j != i and (radii is None or int(gap[j]) <= 4 * radii[i] * radii[i])]
            order = np.array(sorted(near, key=lambda j: (gap[j], j)), np.int64)
            self.neighbours.append((order, gap[order]))

    def assign(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest cluster, squared distance, comparisons) of rows that were in the clusters ``last``; ties: smaller number."""
        best, d = last.astype(np.int64), distances(x, self.centroids[last])
        compared = len(x)
        for i in np.unique(last):
            order, gap = self.neighbours[i]
            rows = np.flatnonzero(last == i)
            annulus = np.searchsorted(gap, 4 * d[rows], "right")  # neighbours within twice the member's distance
            rows, annulus = rows[annulus > 0], annulus[annulus > 0]
            by_reach = np.argsort(-annulus, kind="stable")
            rows, annulus = rows[by_reach], annulus[by_reach]
            for k in range(int(annulus[0]) if len(annulus) else 0):
                reach = rows[: int(np.searchsorted(-annulus, -k, "left"))]  # those of annulus k + 1 or farther out
                j = int(order[k])
                to = distances(x[reach], self.centroids[j])
                compared += len(reach)
                nearer = (to < d[reach]) | ((to == d[reach]) & (j < best[reach]))
                best[reach[nearer]], d[reach[nearer]] = j, to[nearer]
        return best, d, compared


def every(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest cluster, squared distance, comparisons) against all centroids, for rows that were in no cluster yet."""
    best, d = np.zeros(len(x), np.int64), distances(x, centroids[0])
    for j in range(1, len(centroids)):
        to = distances(x, centroids[j])
        nearer = to < d
        best[nearer], d[nearer] = j, to[nearer]
    return best, d, len(x) * len(centroids)


def _signed(x: np.ndarray) -> np.ndarray:
    top = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int32 if top < 1 << 31 else np.int64).ravel()


def _sums(x: np.ndarray, cluster: np.ndarray, d: np.ndarray, k: int, compared: int) -> bytes:
    """A block's sums, counts, greatest squared distances and inertia by cluster."""
    order = np.argsort(cluster, kind="stable")
    found, cut = np.unique(cluster[order], return_index=True)
    return pack(
        found.astype(np.int64),
        np.add.reduceat(x[order], cut, axis=0).ravel() if len(found) else np.zeros(0, np.int64),
        np.bincount(cluster, minlength=k)[found].astype(np.int64),
        np.maximum.reduceat(d[order], cut) if len(found) else np.zeros(0, np.int64),
        np.array([compared], np.int64),
        (np.add.reduceat(d[order] >> 32, cut) if len(found) else np.zeros(0, np.int64)),
        (np.add.reduceat(d[order] & 0xFFFFFFFF, cut) if len(found) else np.zeros(0, np.int64)),
    )


def _block(ids, x, cluster, d, part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (pack(ids), pack(_signed(x)), pack(narrow(cluster)), pack(d), part)], ["ids", "x", "cluster", "d", "part"])


def _totals(table: DataFrame, size: int) -> dict[int, dict]:
    """Per cluster, over all blocks: sums, count, greatest squared distance, comparisons and inertia (exact), added up by Spark."""

    def rows(batches):
        total: dict = {}
        for b in batches:  # one row a cluster leaves a task, whatever it read
            for p in b.column(0):
                found, sums, count, far, compared, high, low = unpack(p.as_buffer())
                for i, c in enumerate(found):
                    t = total.setdefault(int(c), [0, 0, 0, 0, 0] + [0] * size)
                    t[0] += int(count[i])
                    t[1] = max(t[1], int(far[i]))
                    t[2] += int(compared[0]) if i == 0 else 0
                    t[3] += int(high[i])
                    t[4] += int(low[i])
                    for f in range(size):
                        t[5 + f] += int(sums[i * size + f])
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[c] for c in keys], pa.list_(pa.int64()))], ["cluster", "t"])

    parts = table.select("part").mapInArrow(rows, "cluster int, t array<long>")
    exact = [F.sum(F.col("t")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(5 + size) if i != 1]
    got = parts.groupBy("cluster").agg(F.max(F.col("t")[1]).alias("s1"), *exact).collect()  # one row a cluster
    return {r["cluster"]: {"count": int(r["s0"]), "far": int(r["s1"]), "compared": int(r["s2"]), "inertia": (int(r["s3"]) << 32) + int(r["s4"]), "sums": [int(r[f"s{5 + f}"]) for f in range(size)]} for r in got}


def first_centroids(vectors: DataFrame, k: int, key: str, column: str, size: int, scale: int, seed: str) -> np.ndarray:
    """The integer components of the ``k`` kept vectors with the smallest sha256 of ``seed:id``, in that order; of rows that
    share an id, the smaller vector comes first; a null id counts as empty text."""

    def fit(batches):
        for b in batches:
            rows, x = whole(b.column(1), size, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(list(x), pa.list_(pa.int64()))], ["i", "x"])

    kept = vectors.select(F.col(key).cast("long").alias("i"), F.col(column).alias("v")).mapInArrow(fit, "i long, x array<long>")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("i").cast("string"), F.lit(""))), 256)
    got = kept.select(by_hash.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in got], np.int64).reshape(len(got), size)


def ball_kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, key: str = "vec_id", column: str = "embedding", size: int = 64, scale: int = 256, seed: str = "2", report: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row.

    Kept are vectors of exactly ``size`` components, none null or not finite; a component x counts as floor(scale * x), held to
    +-2^27.  After ``rounds`` rounds of assigning and averaging (componentwise floor; an empty cluster keeps its centroid) the
    vectors are assigned once more.  Ties go to the smaller number.  Repeated rows count each and get a row each, a null id is
    carried through; with fewer than ``k`` kept rows there are as many clusters; an empty table gives no rows.  Inertia beyond a
    long is held to the greatest long.  Other columns are not looked at.  ``report`` gets the comparisons of each round."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, key, column, size, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def begin(batches):
        held = [np.zeros(0, np.int64)], [np.zeros((0, size), np.int64)]
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                rows, x = whole(part.column(1), size, scale)
                held[0].append(longs(part.column(0))[rows])
                held[1].append(x)
                if sum(map(len, held[0])) >= BLOCK:
                    yield _first(*map(np.concatenate, held))
                    held = [], []
        if sum(map(len, held[0])):
            yield _first(*map(np.concatenate, held))

    def _first(ids, x):
        cluster, d, compared = every(x, centroids)
        return _block(ids, x, cluster, d, _sums(x, cluster, d, len(centroids), compared))

    table = materialise(vectors.select(F.col(key).cast("long").alias("i"), F.col(column).alias("v")).mapInArrow(begin, _BLOCKS))
    for _ in range(rounds):
        totals = _totals(table, size)
        if report is not None:
            report.append(sum(t["compared"] for t in totals.values()))
        moved, radii = centroids.copy(), [0] * len(centroids)
        for c, t in totals.items():
            moved[c] = [s // t["count"] for s in t["sums"]]
            gone = int(distances(moved[c : c + 1], centroids[c])[0])
            radii[c] = isqrt(t["far"]) + 1 + isqrt(gone) + 1
        centroids = moved
        shared = spark.sparkContext.broadcast(Balls(centroids, radii))  # k centroids and k x k gaps

        def again(batches, shared=shared):
            balls = shared.value
            for b in batches:
                for row in zip(*b.columns):
                    ids, x, cluster = (unpack(v.as_buffer())[0] for v in row[:3])
                    x = x.astype(np.int64).reshape(len(ids), size)
                    best, d, compared = balls.assign(x, cluster.astype(np.int64))
                    yield _block(ids, x, best, d, _sums(x, best, d, len(balls.centroids), compared))

        before, table = table, materialise(table.mapInArrow(again, _BLOCKS))
        drop(before)
    totals = _totals(table, size)
    if report is not None:
        report.append(sum(t["compared"] for t in totals.values()))
    top = 2**63 - 1
    inertia = min(sum(t["inertia"] for t in totals.values()), top)
    own = np.array([min(totals[c]["inertia"], top) if c in totals else 0 for c in range(len(centroids))], np.int64)
    digests = pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def rows(batches):
        for b in batches:
            for row in zip(*b.columns):
                ids, cluster, d = (unpack(v.as_buffer())[0] for v in row)
                at = cluster.astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids_back(ids), pa.array(at.astype(np.int32)), pa.array(d), pa.array(own[at]), pa.array(np.full(len(ids), inertia)), digests.take(pa.array(at))], names)

    return table.select("ids", "cluster", "d").mapInArrow(rows, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op12(spark, sf_dir: str) -> DataFrame:
    """40 clusters of all vectors of 64 components after five rounds."""
    return ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
