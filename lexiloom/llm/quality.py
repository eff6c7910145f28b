"""Quality by random-indexing word vectors and a small network.

Every token and every token shape (case, symbols, repetition, length) has a sparse ternary index vector drawn from its
hash.  Random indexing adds up, over the whole corpus, the index vectors of each token's neighbours into a context
vector; tokens share a fixed number of hash buckets, so that the table is bounded whatever the corpus.  A document is
the pooled mean of its tokens' context vectors, with the mean of its shapes' index vectors.  A two-layer numpy network
turns it into a logit, and a temperature fitted on a part of the sample that it was not trained on calibrates it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACE, U64, Words, bounded_sample, ids_back, longs, mix, remainder, text_bytes
from .toxicity import labelled_sample

BUCKETS, DIM, ONES, SLICES = 1 << 13, 32, 4, 16
SHAPES = 256
_CLASS = np.zeros(256, np.uint8)  # bit 1 upper, 2 lower or other script, 4 digit, 8 symbol, 16 sentence mark
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123), *range(128, 256)]] = 2
_CLASS[[*range(48, 58)]] = 4
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8
_CLASS[[*b".,;:'\"()?-"]] = 16


def _index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse ternary vectors of DIM values with ONES entries of +1 or -1."""
    out = np.zeros((n, DIM), np.float32)
    h = mix(np.arange(n, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    for _ in range(ONES):
        h = mix(h + U64(0xD1B54A32D192ED03))
        out[np.arange(n), (h % U64(DIM)).astype(int)] += np.where(h >> U64(63), 1, -1)
    return out


def tokens(data: np.ndarray, offs: np.ndarray):
    """Pieces of (doc, bucket, shape) of the tokens of texts."""
    words = Words(SPACE, fold=False, limit=1 << 18)
    for doc, h, start, end, _ in words(data, offs):
        if not len(doc):
            continue
        at, stop = int(start[0]), int(end[-1])
        cls = np.bitwise_or.reduceat(_CLASS[data[at:stop]], np.ravel(np.column_stack([start - at, end - at]))[:-1])[::2].astype(np.int64)
        size = end - start
        same = np.zeros(len(h), np.int64)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        capital = (_CLASS[data[start]] == 1) & ((cls & 1) > 0)
        bang = data[end - 1] == 33
        shape = cls | (same << 5) | (capital.astype(np.int64) << 6) | ((bang | (size > 20)).astype(np.int64) << 7)
        yield doc, (h >> U64(51)).astype(np.int64), shape


def corpus_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The BUCKETS x DIM context vectors of the whole corpus, scaled to unit length.  Each task adds up its own table (1 MB),
    slices of the tables are summed by key, and the driver gets one table of fixed size."""

    def run(batches):
        word_iv, shape_iv = _index_vectors(BUCKETS, 1), _index_vectors(SHAPES, 2)
        total = np.zeros((BUCKETS, DIM), np.float64)
        for b in batches:
            data, offs = text_bytes(b.column(0))
            for doc, bucket, shape in tokens(data, offs):
                iv = word_iv[bucket] + shape_iv[shape]
                near = np.zeros_like(iv)
                for k in (1, 2):
                    m = (doc[k:] == doc[:-k])[:, None]
                    near[k:] += iv[:-k] * m
                    near[:-k] += iv[k:] * m
                for f in range(DIM):
                    total[:, f] += np.bincount(bucket, near[:, f], BUCKETS)
        step = BUCKETS // SLICES
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([np.round(total[i * step : (i + 1) * step]).astype(np.int32).tobytes() for i in range(SLICES)], pa.binary())], ["s", "t"])

    def add(it):
        for key, batches in _by_slice(it):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([batches.tobytes()], pa.binary())], ["s", "t"])

    def _by_slice(batches):
        sums: dict = {}
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(t.as_buffer(), np.int32).astype(np.int64) if len(t.as_buffer()) == BUCKETS // SLICES * DIM * 4 else np.frombuffer(t.as_buffer(), np.int64)
                sums[s] = sums[s] + x if s in sums else x.copy()
        return sums.items()

    parts = docs.select(text).mapInArrow(run, "s int, t binary").repartition("s").mapInArrow(add, "s int, t binary").collect()  # SLICES rows
    out = np.zeros((BUCKETS, DIM))
    step = BUCKETS // SLICES
    for s, t in parts:
        out[s * step : (s + 1) * step] += np.frombuffer(t, np.int64).reshape(step, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean context vector, mean shape index vector, and the log of the token count."""
    n = len(offs) - 1
    out = np.zeros((n, 2 * DIM + 1))
    per = np.zeros((n, SHAPES))
    count = np.zeros(n)
    for doc, bucket, shape in tokens(data, offs):
        first = int(doc[0])
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[cut], :DIM] += np.add.reduceat(vectors[bucket], cut, axis=0)
        width = int(doc[-1]) - first + 1
        per[first : first + width] += np.bincount((doc - first) * SHAPES + shape, minlength=width * SHAPES).reshape(width, SHAPES)
        count += np.bincount(doc, minlength=n)
    size = np.maximum(count, 1)[:, None]
    out[:, :DIM] /= size
    out[:, DIM : 2 * DIM] = (per / size) @ _index_vectors(SHAPES, 2)
    out[:, -1] = np.log1p(count) / 8
    return out


class TwoLayer:
    """tanh hidden layer and a logistic output; ``temperature`` divides the logit."""

    def __init__(self, width: int, hidden: int = 24, seed: int = 2):
        g = np.random.default_rng(seed)
        self.a, self.c = g.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden)
        self.o, self.b = g.normal(0, 0.3, hidden), 0.0
        self.mean, self.std, self.temperature = np.zeros(width), np.ones(width), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.a + self.c) @ self.o + self.b

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, lr: float = 0.01, decay: float = 1e-4) -> TwoLayer:
        if not len(x) or not 0 < y.mean() < 1:
            self.b = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99) * 8 - 4)
            return self
        last = np.arange(len(x)) % 5 == 4  # for the temperature
        self.mean, self.std = x[~last].mean(0), x[~last].std(0) + 1e-3
        tx, ty = (x[~last] - self.mean) / self.std, y[~last]
        g = np.random.default_rng(4)
        ps = ["a", "c", "o", "b"]
        m = {k: np.zeros_like(getattr(self, k)) for k in ps}
        s = {k: np.zeros_like(getattr(self, k)) for k in ps}
        t = 0
        for _ in range(epochs):
            order = g.permutation(len(tx))
            for at in range(0, len(tx), batch):
                r = order[at : at + batch]
                h = np.tanh(tx[r] @ self.a + self.c)
                e = (1 / (1 + np.exp(-np.clip(h @ self.o + self.b, -30, 30))) - ty[r]) / len(r)
                dh = e[:, None] * self.o * (1 - h * h)
                grads = {"a": tx[r].T @ dh + decay * self.a, "c": dh.sum(0), "o": h.T @ e + decay * self.o, "b": e.sum()}
                t += 1
                for k, v in grads.items():
                    m[k] = m[k] + 0.1 * (v - m[k])
                    s[k] = s[k] + 0.001 * (v * v - s[k])
                    setattr(self, k, getattr(self, k) - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8))
        z, v = self.logits(x[last]), y[last]
        if len(z):
            def loss(temp):
                return np.mean(np.logaddexp(0, -np.where(v > 0, z, -z) / temp))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self


def fit_quality(labelled: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 6000) -> TwoLayer:
    """Trains on at most ``sample`` rows, chosen by a hash of the row, of ``labelled`` (key, text, 0/1 label); rows without label
    are left out, null texts pool to zeros, repeated rows count each and are drawn one by one."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    got = bounded_sample(rows, sample).orderBy(F.xxhash64("k"), F.xxhash64("t"), "y").toArrow()
    data, offs = text_bytes(got["t"])
    return TwoLayer(2 * DIM + 1).fit(pooled(data, offs, vectors), got["y"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: TwoLayer, vectors: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score 0 to 1, predicted) for each row; null and empty texts pool to zero vectors.  Repeated rows are scored each, a
    score at the threshold is predicted, other columns are not looked at, an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast((model, vectors))  # BUCKETS x DIM floats, whatever the input

    def run(batches):
        net, table = shared.value
        for b in batches:
            data, offs = text_bytes(b.column(1))
            p = 1 / (1 + np.exp(-np.clip(net.logits(pooled(data, offs, table)) / net.temperature, -30, 30)))
            yield pa.RecordBatch.from_arrays([ids_back(longs(b.column(0))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, score double, predicted int")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors = corpus_vectors(docs)
    model = fit_quality(labelled_sample(docs, labels, "quality", 6000), vectors)
    return score_quality(docs, model, vectors).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
