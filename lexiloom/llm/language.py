"""Language identification by a byte convolutional network.

Filters of several widths slide over fixed-length windows of bytes; each filter keeps its maximum (max pooling) and a
softmax layer turns the pooled values into language probabilities.  The network is trained in numpy with Adam on the
windows of a bounded sample of labelled texts.  For prediction the byte embedding and the filters are folded into
lookup tables over byte pairs, and all windows of a batch of whole texts are evaluated together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_sample, ids_back, longs, remainder, text_bytes

WINDOW = 128
STEPS = 1000  # of training, each on windows drawn from all windows of the sample
WIDTHS = (2, 3, 4)


class ByteCNN:
    """Byte embedding (E) -> filters of WIDTHS (F each) -> max pooling over a window -> softmax over ``langs``."""

    def __init__(self, langs: list[str], filters: int = 8, embed: int = 8, seed: int = 7):
        g = np.random.default_rng(seed)
        self.langs, self.f = list(langs), filters
        k = max(1, len(langs))
        self.p = {"E": g.normal(0, 0.5, (256, embed))} | {f"W{w}": g.normal(0, 1 / np.sqrt(w * embed), (w, embed, filters)) for w in WIDTHS}
        self.p |= {"O": g.normal(0, 0.3, (filters * len(WIDTHS), k)), "b": np.zeros(k)}
        self.tables: list | None = None
        self.least = 0.0  # the score below which a language cannot be told

    def _forward(self, x: np.ndarray):
        e = self.p["E"][x]
        pooled, args = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            z = sum(e[:, j : j + n] @ self.p[f"W{w}"][j] for j in range(w))
            a = z.argmax(1)
            args.append(a)
            pooled.append(np.take_along_axis(z, a[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        logit = np.tanh(h) @ self.p["O"] + self.p["b"]
        logit -= logit.max(1, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(1, keepdims=True)
        return e, args, h, prob

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 128, lr: float = 0.01, seed: int = 5) -> ByteCNN:
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(steps if len(self.langs) > 1 else 0):
            if len(x):
                rows = g.integers(0, len(x), min(batch, len(x)))
                xb, yb = x[rows], y[rows]
                e, args, h, prob = self._forward(xb)
                d = prob
                d[np.arange(len(rows)), yb] -= 1
                d /= len(rows)
                th = np.tanh(h)
                grad = {"O": th.T @ d, "b": d.sum(0), "E": np.zeros_like(self.p["E"])}
                dh = (d @ self.p["O"].T) * (1 - th * th)
                for i, w in enumerate(WIDTHS):
                    dz = dh[:, i * self.f : (i + 1) * self.f]
                    gw = np.zeros_like(self.p[f"W{w}"])
                    for j in range(w):
                        pos = args[i] + j  # batch x filters
                        vec = e[np.arange(len(rows))[:, None], pos]  # batch x filters x embed
                        gw[j] = np.einsum("bfe,bf->ef", vec, dz)
                        np.add.at(grad["E"], xb[np.arange(len(rows))[:, None], pos], dz[:, :, None] * self.p[f"W{w}"][j].T[None])
                    grad[f"W{w}"] = gw
                t += 1
                for k, v in grad.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.001 * (v * v - s[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def compile(self) -> ByteCNN:
        """Folds embedding and filters into int16 tables: what a byte pair adds to each filter, per pair of taps."""
        top = 1e-9
        tabs = []
        for w in WIDTHS:
            taps = [self.p["E"] @ self.p[f"W{w}"][j] for j in range(w)]
            for j in range(0, w, 2):
                if j + 1 < w:
                    tabs.append((w, j, (taps[j][:, None] + taps[j + 1][None]).reshape(65536, self.f)))
                else:
                    tabs.append((w, j, np.repeat(taps[j][:, None], 256, 1).reshape(65536, self.f)))
        top = max(float(np.abs(t).max()) for _, _, t in tabs)
        self.scale = top / 16000
        self.tables = [(w, j, np.round(t / self.scale).astype(np.int16)) for w, j, t in tabs]
        return self

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of each row of ``x`` (windows x WINDOW + 1 bytes)."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 192):
            b = x[at : at + 192]
            pair = (b[:, :-1].astype(np.uint16) << 8) | b[:, 1:]
            n = b.shape[1] - 1
            pooled = []
            for w in WIDTHS:
                z = None
                m = n - w + 1
                for tw, j, t in self.tables:
                    if tw == w:
                        part = np.take(t, pair[:, j : j + m], axis=0, mode="clip")
                        z = part if z is None else np.add(z, part, out=z)
                pooled.append(z.max(1))
            h = np.concatenate(pooled, 1).astype(np.float32) * np.float32(self.scale)
            logit = np.tanh(h) @ self.p["O"].astype(np.float32) + self.p["b"].astype(np.float32)
            logit -= logit.max(1, keepdims=True)
            np.exp(logit, out=logit)
            out[at : at + 192] = logit / logit.sum(1, keepdims=True)
        return out

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, score) of each text; -1 and 0 for texts without a letter.  Log probabilities of a text's windows
        are averaged, weighted by their bytes, so that every byte of a long text counts."""
        n, k = len(offs) - 1, len(self.langs)
        lens = np.diff(offs)
        total = np.zeros((n, k))
        count = -(-lens // WINDOW)
        doc = np.repeat(np.arange(n), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = offs[doc] + nth * WINDOW
        size = np.minimum(WINDOW, offs[doc + 1] - start)
        step = 2048
        for at in range(0, len(doc), step):
            s, m = start[at : at + step], size[at : at + step]
            pos = s[:, None] + np.arange(WINDOW)
            x = np.full((len(s), WINDOW + 1), 32, np.uint8)
            full = m == WINDOW
            x[full, :WINDOW] = data[pos[full]]
            for i in np.flatnonzero(~full):
                x[i, : m[i]] = data[s[i] : s[i] + m[i]]
            np.add.at(total, doc[at : at + step], np.log(self.windows(x) + 1e-7) * m[:, None])
        mean = total / np.maximum(lens, 1)[:, None]
        mean -= mean.max(1, keepdims=True) if k else 0
        prob = np.exp(mean)
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        return best, prob[np.arange(n), best]


def cut_windows(data: np.ndarray, offs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts, the last of each padded with spaces, and the class of each."""
    count = -(-np.diff(offs) // WINDOW)
    doc = np.repeat(np.arange(len(count)), count)
    start = offs[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    pos = start[:, None] + np.arange(WINDOW)
    inside = pos < offs[doc + 1][:, None]
    return np.where(inside, data[np.where(inside, pos, 0)], 32).astype(np.uint8), np.asarray(y)[doc]


def _letters(text: str):
    """Whether a text holds a letter of any script."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = 4000) -> ByteCNN:
    """Trains on at most ``sample`` labelled texts, chosen by a hash of text and language: every window of four in five of them
    can be drawn; on the others the level is set below which a language cannot be told.  Null and empty texts teach nothing,
    repeated rows are drawn one by one, ids are not looked at.  Without any labelled text the model knows no language and
    every text is ``und``."""
    rows = docs.where((F.length(text) > 0) & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    got = bounded_sample(rows, sample).select("*", F.xxhash64(F.lit(5), "t", "l").alias("h")).orderBy("h", "l", "t").toPandas()
    langs = sorted(set(got["l"]))
    held = got.index % 5 == 4
    model = ByteCNN(langs)
    if len(got):
        data, offs = text_bytes(pa.array(got["t"][~held]))
        model.fit(*cut_windows(data, offs, np.searchsorted(langs, got["l"][~held])))
    out = model.compile()
    # half way from chance to what the least sure of labelled texts reaches: below it a language cannot be told
    out.least = 1 / max(1, len(langs))
    known = got["t"][held] if held.any() else got["t"]
    if len(known):
        data, offs = text_bytes(pa.array(known))
        out.least += max(0.0, float(out.predict(data, offs)[1].min()) - out.least) / 2
    return out


def identify(docs: DataFrame, model: ByteCNN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds nothing to ``docs`` but maps each row to (key, lang_pred string, score double); null, empty and letterless
    texts give ``und`` and 0.  Repeated rows are told each, ties between languages go to the first by name, and other columns
    are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB of tables, whatever the input

    def run(batches):
        net = shared.value
        for b in batches:
            data, offs = text_bytes(b.column(1))
            known = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names = ["und"] * len(offs[1:])
            score = np.zeros(len(names))
            if net.langs and len(names):
                best, s = net.predict(data, offs)
                score = np.where(known, s, 0.0)
                names = [net.langs[c] if k else "und" for c, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([ids_back(longs(b.column(0))), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), _letters(text).alias("l")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ByteCNN, text: str = "text", least: float | None = None) -> DataFrame:
    """``docs`` without the rows whose language cannot be told: null, empty or letterless texts, or a score under ``least`` (the
    model's own level, if not given, which is relative to the number of languages and to what labelled texts score).
    Columns keep names, order and values, and repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column, width = docs.columns.index(text), len(docs.columns)
    least = model.least if least is None else least

    def run(batches):
        net = shared.value
        for b in batches:
            data, offs = text_bytes(b.column(column))
            keep = b.column(width).to_numpy(zero_copy_only=False).astype(bool)
            if net.langs and len(keep):
                keep &= net.predict(data, offs)[1] >= least - 1e-9
            else:
                keep = np.zeros(len(keep), bool)
            yield pa.RecordBatch.from_arrays(b.columns[:width], docs_names).filter(pa.array(keep))

    docs_names = docs.columns
    return docs.select("*", _letters(text).alias("letters of " + text)).mapInArrow(run, docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """The digest query: learns from documents whose remainder is not 2, predicts every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language(docs.where(remainder("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
