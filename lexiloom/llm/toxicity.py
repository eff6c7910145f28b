"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms (whole words of letters and digits, lower-cased, and their first four and five
bytes, which catch inflected stems).  The machine adds a bias, a weight per term, and for every pair of terms the inner
product of their factors, so that two terms can count for more together than apart:

    score = sigmoid(b + sum_i w_i + 1/2 sum_f [(sum_i v_if)^2 - sum_i v_if^2])

It is trained in numpy by AdaGrad on a bounded sample of labelled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NOT_TERM, U64, Words, bounded_sample, distinct_sorted, ids_back, longs, remainder, text_bytes

BITS = 18
PREFIXES = (4, 5)


def terms(data: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(doc index, term) of the distinct hashed terms of each text, sorted; only terms flagged in ``keep``."""
    words = Words(NOT_TERM, fold=True, limit=1 << 18)
    shift = U64(64 - BITS)
    got = [np.zeros(0, U64)]
    for doc, h, start, end, prefix in words(data, offs):
        size = end - start
        doc = doc.astype(U64) << U64(BITS)
        part = [(doc, h >> shift)]
        for k in PREFIXES:
            longer = size > k
            part.append((doc[longer], (prefix(k)[longer] ^ U64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) * U64(0xD6E8FEB86659FD93) >> shift))
        for d, t in part:
            if keep is not None:
                m = keep[t.astype(np.int64)]
                d, t = d[m], t[m]
            x = d | t
            x.sort()
            got.append(distinct_sorted(x))
    x = np.concatenate(got)
    x.sort()
    x = distinct_sorted(x)
    return (x >> U64(BITS)).astype(np.int64), (x & U64((1 << BITS) - 1)).astype(np.int64)


def _in_pairs(doc: np.ndarray, term: np.ndarray, y: np.ndarray, seen: np.ndarray, hits: np.ndarray, chi2: float, least: int = 8, block: int = 1 << 21) -> np.ndarray:
    """Terms that occur in a pair whose label count strays from what its two terms add up to, among all pairs that ``least`` texts
    share (terms in fewer texts form none).

    For a pair that ``both`` texts hold, ``t`` of them toxic, with ``e`` expected: it strays if (t - both e)^2 > chi2 both e (1 - e).
    Too many toxic ones take t > chi2 e / (1 - e), so only pairs of toxic texts are counted for that.  Too few take both >
    chi2 (1 - e) / e, so that either a term is often toxic by itself or both are frequent."""
    n = len(y)
    often = np.flatnonzero(seen >= least)
    if not n or len(often) < 2 or not 0 < y.mean() < 1:
        return often[:0]
    m, rate, own = len(often), y.mean(), hits[often] / seen[often]
    column = np.full(len(seen), -1)
    column[often] = np.arange(m)
    here = column[term] >= 0
    d, t = doc[here], column[term[here]]  # sorted by text, then term
    begin, by_term = np.searchsorted(d, np.arange(n + 1)), np.argsort(t, kind="stable")
    post = np.searchsorted(t[by_term], np.arange(m + 1))
    found, asked = np.zeros(m, bool), own > 2 * rate

    def expected(a, b):
        return np.clip(own[a] + own[b] - rate, 0.02, 0.98)

    # pairs of toxic texts, for a range of first terms at a time
    td, tt = d[y[d] > 0], t[y[d] > 0]
    after = np.searchsorted(td, td, "right") - np.arange(len(td)) - 1  # the terms that follow in the text
    first = np.argsort(tt, kind="stable")
    load = np.cumsum(np.bincount(tt, after, m))  # pairs up to each first term
    low = 0
    while low < m:
        high = min(m, low + max(1, block // m), max(low + 1, int(np.searchsorted(load, (load[low - 1] if low else 0) + block // 2, "right"))))
        rows = first[np.searchsorted(tt[first], low) : np.searchsorted(tt[first], high)]
        second = np.repeat(rows + 1 - np.cumsum(after[rows]) + after[rows], after[rows]) + np.arange(int(after[rows].sum()))
        toxic = np.bincount(np.repeat((tt[rows] - low) * m, after[rows]) + tt[second], minlength=1)
        pair = np.flatnonzero(toxic > 1)
        a, b = pair // m + low, pair % m
        e = expected(a, b)
        asked[a[toxic[pair] > chi2 * e / (1 - e)]] = True
        low = high

    for a in np.flatnonzero(asked):  # all pairs of one term
        texts = d[by_term[post[a] : post[a + 1]]]
        size = begin[texts + 1] - begin[texts]
        at = np.repeat(begin[texts] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        both, toxic = np.bincount(t[at], minlength=m), np.bincount(t[at], np.repeat(y[texts], size), m)
        strays = _strays(both, toxic, expected(a, np.arange(m)), chi2, least, np.arange(m) != a)
        found |= strays
        found[a] |= strays.any()

    top = min(0.98, max(3 * rate, 0.02))  # what two terms that are not often toxic add up to at most
    frequent = np.flatnonzero(~asked & (seen[often] > chi2 * (1 - top) / top))
    at = np.full(m, -1)
    at[frequent] = np.arange(len(frequent))
    fd, ft = d[at[t] >= 0], at[t[at[t] >= 0]]

    def columns(low: int) -> np.ndarray:
        x = np.zeros((n, min(1024, len(frequent) - low)), np.float32)
        own = (ft >= low) & (ft < low + 1024)
        x[fd[own], ft[own] - low] = 1
        return x

    for low in range(0, len(frequent), 1024):
        x, a = columns(low), frequent[low : low + 1024]
        for other in range(low, len(frequent), 1024):
            z, b = columns(other), frequent[other : other + 1024]
            strays = _strays(x.T @ z, x[y > 0].T @ z[y > 0], expected(a[:, None], b[None]), chi2, least, a[:, None] != b[None])
            found[a[strays.any(1)]] = found[b[strays.any(0)]] = True
    return often[found]


def _strays(both, toxic, e, chi2: float, least: int, other) -> np.ndarray:
    return other & (both >= least) & ((toxic - both * e) ** 2 > chi2 * both * e * (1 - e))


class FactorizationMachine:
    def __init__(self, factors: int = 4, seed: int = 11):
        g = np.random.default_rng(seed)
        self.b, self.w = 0.0, np.zeros(1 << BITS, np.float32)
        self.v = g.normal(0, 0.05, (1 << BITS, factors)).astype(np.float32)
        self.keep = np.zeros(1 << BITS, bool)

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = self.b + np.bincount(doc, self.w[term], n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f].astype(np.float64)
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out

    def fit(self, doc: np.ndarray, term: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, lr: float = 0.5, decay: float = 1e-3, chi2: float = 30.0, seed: int = 3) -> FactorizationMachine:
        n = len(y)
        begin = np.searchsorted(doc, np.arange(n + 1))
        seen = np.bincount(term, minlength=1 << BITS)
        # only terms whose label counts stray from chance take part (chi-square with one degree of freedom), alone or in a pair
        hits = np.bincount(term, y[doc] if len(doc) else None, 1 << BITS)
        expect = seen * (y.mean() if n else 0)
        self.keep = (seen >= 4) & ((hits - expect) ** 2 > chi2 * np.maximum(expect * (1 - (y.mean() if n else 0)), 1e-9))
        self.keep[_in_pairs(doc, term, y, seen, hits, 2 * chi2)] = True
        g = np.random.default_rng(seed)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
        self.b = float(np.log(rate / (1 - rate)))
        gw, gv, gb = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1.0
        for _ in range(epochs if n and 0 < y.mean() < 1 else 0):
            order = g.permutation(n)
            for at in range(0, n, batch):
                rows = order[at : at + batch]
                length = begin[rows + 1] - begin[rows]
                idx = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows]) if len(rows) else np.zeros(0, int)
                t, d = term[idx], np.repeat(np.arange(len(rows)), length)
                k = self.keep[t]
                t, d = t[k], d[k]
                s = np.stack([np.bincount(d, self.v[t, f], len(rows)) for f in range(self.v.shape[1])], 1)
                z = self.b + np.bincount(d, self.w[t], len(rows)) + 0.5 * (s**2).sum(1) - 0.5 * np.bincount(d, (self.v[t] ** 2).sum(1), len(rows))
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                order_t = np.argsort(t, kind="stable")
                ts, ds = t[order_t], d[order_t]
                if not len(ts):
                    continue
                cut = np.concatenate([[0], np.flatnonzero(ts[1:] != ts[:-1]) + 1])
                u, es = ts[cut], e[ds]
                dw = np.add.reduceat(es, cut) + decay * self.w[u] / len(rows)
                dv = np.add.reduceat(es[:, None] * (s[ds] - self.v[ts]), cut, axis=0) + decay * self.v[u] / len(rows)
                gw[u] += dw**2
                gv[u] += dv**2
                gb += e.sum() ** 2
                self.w[u] -= lr * dw / np.sqrt(gw[u])
                self.v[u] -= lr * 0.1 * dv / np.sqrt(gv[u])
                self.b -= lr * e.sum() / np.sqrt(gb)
        self.v[~self.keep] = 0
        return self


def fit_toxicity(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 6000) -> FactorizationMachine:
    """Trains on at most ``sample`` rows, chosen by a hash of the row, of ``labelled`` (key, text, 0/1 label); rows without label
    are left out, null texts have no terms, repeated rows count each and are drawn one by one."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    got = bounded_sample(rows, sample).orderBy("k", F.xxhash64("t"), "y").toArrow()
    data, offs = text_bytes(got["t"])
    doc, term = terms(data, offs)
    return FactorizationMachine().fit(doc, term, got["y"].to_numpy().astype(np.float64))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score 0 to 1, predicted) for each row; null and empty texts have no terms and get the bias alone.  Repeated rows
    are scored each, a score at the threshold is predicted, other columns are not looked at, an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the input

    def run(batches):
        fm = shared.value
        for b in batches:
            data, offs = text_bytes(b.column(1))
            n = len(offs) - 1
            doc, term = terms(data, offs, fm.keep)
            p = 1 / (1 + np.exp(-np.clip(fm.logits(doc, term, n), -30, 30)))
            yield pa.RecordBatch.from_arrays([ids_back(longs(b.column(0))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, score double, predicted int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled documents that may be learned from (remainder 5 is not 0; null ids have no label).

    Label rows that have a document are drawn first, by id and label alone, so that only chosen texts are moved; where ids
    repeat, their texts are then drawn by content."""
    may = F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)
    marks = labels.where(may & F.col(label).isNotNull()).select("doc_id", label)
    marks = bounded_sample(marks.join(docs.where(may).select("doc_id"), "doc_id", "left_semi"), sample)
    texts = docs.where(may).select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # ``sample`` rows of id and label
    return bounded_sample(texts, sample)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(labelled_sample(docs, labels, "toxic", 6000))
    return score_toxicity(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
