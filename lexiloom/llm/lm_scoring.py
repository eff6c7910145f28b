"""Log probabilities of texts by a causal self-attention model over subword ids, and by smoothed word counts.

Words (lower-cased, parted by white space) are cut into pieces by the first ``PIECES`` entries of a public byte-pair
vocabulary; an end id closes each text.  The model embeds ids, attends causally over a window with a bias for each
distance, and predicts the next id as two digits (row, then column given the row).

Everything it learns comes from all training texts.  One pass over them counts the id bigrams, from which the output layer
starts, and lays out every window of every text.  The windows, which grow with the corpus, are dealt by a hash of id and
place to shards of bounded size; the attention part is trained in numpy on all
shards at once, in rounds, after each of which the shards' weights are averaged.

To score, windows of ``CONTEXT + STRIDE`` slots overlap by ``CONTEXT``: each id is scored once, with the ids of its
window to its left, and slots before the text or beyond its end are masked.

The word baseline adds log10((c + 1) / (N + V + 1)) over words and the end.  Counts are gathered by hash bucket over
all training texts; what comes back to a document is its part of the sum, so that no vocabulary is held in one place.
"""

from __future__ import annotations

import base64
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import LOWER, SPACE, U64, Words, block_id, buckets_for, drop, ids_back, longs, materialise, mix, narrow, pack, pack_sorted, ranges, remainder, rows_of, runs, text_bytes, unpack, unpack_sorted

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SIDE = 48
VOCAB = SIDE * SIDE
PIECES = VOCAB - 1
SLICES = 16
END = VOCAB - 1
CONTEXT, STRIDE = 8, 16
HEADS = 2
SLOTS = CONTEXT + STRIDE
SHARD, ROUNDS, BATCH = 1 << 17, 4, 32  # windows of a shard; each window is trained on once, in one of the rounds
AT_ONCE = 1 << 20  # bytes of text cut into windows at once
BLOCK, BLOCK_ROWS = 8 << 20, 4096  # bytes and texts of which word counts go out together


class Subwords:
    """Words to ids, with a memory of words by hash: a table of 2^``bits`` places, of which a word takes the one that its hash
    begins with, from whatever word was there."""

    def __init__(self, ranks: dict[bytes, int], bits: int = 21, most: int = 1 << 24):
        import tiktoken

        self.code = tiktoken.Encoding("pieces", pat_str=r" [^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.gap, self.shift, self.most = ranks[b"\n"], U64(64 - bits), most
        self.h, self.at, self.n = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint16)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def _encode(self, data: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Ids of the words data[a:b], where each begins and how many it has; words go to the encoder as `` word`` lines."""
        size = b - a + 2
        end = np.cumsum(size)
        lines = np.full(int(end[-1]), 32, np.uint8)
        lines[end - 1] = 10
        lines[ranges(end - size + 1, size - 2)] = data[ranges(a, size - 2)]
        ids = np.array(self.code.encode_ordinary(lines.tobytes().decode("utf-8", "replace")), np.uint16)
        ends = np.flatnonzero(ids == self.gap)
        begin = np.concatenate([[0], ends[:-1] + 1])
        return ids, begin, ends - begin

    def _keep(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(len(self.ids), len(ids)), np.uint16)])
        self.ids[at : self.used] = ids
        return at

    def __call__(self, h: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, count of each) of the words data[a:b] with hashes ``h``."""
        if self.used > self.most:  # start anew
            self.n[:] = self.used = 0
        slot = h >> self.shift
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        new = np.flatnonzero((self.h[slot] != h) | (n == 0))
        order = new[np.argsort(h[new], kind="stable")]
        s, length = runs(h[order])
        for lo in range(0, len(s), 1 << 15):
            part = slice(lo, lo + (1 << 15))
            lead = order[s[part]]
            ids, begin, count = self._encode(data, a[lead], b[lead])
            begin += self._keep(ids)
            here = order[s[part][0] : s[part][-1] + length[part][-1]]
            at[here], n[here] = np.repeat(begin, length[part]), np.repeat(count, length[part])
            fits = count < 1 << 16  # a word of more ids is cut anew each time
            slot = h[lead[fits]] >> self.shift
            self.h[slot], self.at[slot], self.n[slot] = h[lead[fits]], begin[fits], count[fits]
        return self.ids[ranges(at, n)], n


def load_pieces(path: str = TOKENIZER) -> dict[bytes, int]:
    """The first PIECES entries of a vocabulary of base64 pieces and ranks."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(a): int(b) for a, b in pairs if int(b) < PIECES}


class CausalModel:
    def __init__(self, dim: int = 32, seed: int = 1):
        g = np.random.default_rng(seed)
        s = 1 / np.sqrt(dim)
        shapes = {"E": (VOCAB, dim), "Q": (dim, dim), "K": (dim, dim), "V": (dim, dim), "O": (dim, dim), "U1": (dim, SIDE), "C": (SIDE, dim), "U2": (dim, SIDE)}
        self.p = {k: g.normal(0, 0.3 if k in "EC" else s, v).astype(np.float32) for k, v in shapes.items()}
        self.p["U1"] *= np.float32(0.1)
        self.p["U2"] *= np.float32(0.1)
        self.rows, self.cols = np.zeros((VOCAB, SIDE), np.float32), np.zeros((VOCAB * SIDE, SIDE), np.float32)
        self.p["R"] = np.zeros((HEADS, SLOTS), np.float32)  # a bias for each distance; head h starts out looking h + 1 back
        self.p["R"][np.arange(HEADS), np.arange(HEADS) + 1] = 3
        self.dim = dim

    def copy(self) -> CausalModel:
        return self.with_weights(self.weights())

    def weights(self) -> np.ndarray:
        """All trained weights as one vector."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def with_weights(self, flat: np.ndarray) -> CausalModel:
        """A model of the same counts with other weights."""
        out = copy(self)
        out.p = self._views(flat.copy())
        return out

    def _views(self, flat: np.ndarray, names: list | None = None) -> dict:
        """The weights as parts of one vector."""
        out, at = {}, 0
        for k in names or sorted(self.p):
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape)
            at += n
        return out

    def start_from(self, pairs: np.ndarray, strength: float = 20.0) -> CausalModel:
        """Sets the output layer to the logs of smoothed bigram counts (VOCAB x VOCAB, previous id first)."""
        one = pairs.sum(0) + 0.5
        p = (pairs + strength * one / one.sum()) / (pairs.sum(1, keepdims=True) + strength)
        p = p.reshape(VOCAB, SIDE, SIDE)
        row = p.sum(2)
        self.rows, self.cols = np.log(row).astype(np.float32), np.log(p / row[:, :, None]).astype(np.float32).reshape(VOCAB * SIDE, SIDE)
        return self

    def _split(self, m: np.ndarray) -> np.ndarray:
        return m.reshape(len(m), m.shape[1], HEADS, -1).transpose(0, 2, 1, 3)

    def _join(self, m: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(m.transpose(0, 2, 1, 3)).reshape(len(m), -1, self.dim)

    def ready(self) -> CausalModel:
        """Folds the projections into tables by id: with one layer, what a slot gives to keys, values and queries depends on its
        id alone (places come in as a bias by distance)."""
        p, scale = self.p, np.float32(np.sqrt(HEADS / self.dim))
        self.keys_values, self.queries = np.concatenate([p["E"] @ p["K"], p["E"] @ p["V"]], 1), np.concatenate([p["E"] @ p["Q"] * scale, p["E"]], 1)
        self.first_rows, self.out = self.rows + p["E"] @ p["U1"], np.concatenate([p["O"], p["O"] @ p["U1"]], 1)
        self.bias, self.spaces = p["R"][:, _BACK] + _CAUSAL, {}
        # what scores and outputs cannot exceed: exponentials are only held back where they could overflow
        norm = lambda m: float(np.sqrt((m.reshape(len(m), HEADS, -1) ** 2).sum(2)).max(0).max())
        d = self.dim
        self.tame = norm(self.queries[:, :d]) * norm(self.keys_values[:, :d]) + float(p["R"].max()) < 60
        most = np.abs(self.keys_values[:, d:]).max(0) @ np.abs(p["O"] @ p["U1"])  # a mean of values, projected
        self.tame &= float((self.first_rows.max(0) + most).max()) < 60 and float(self.cols.max() + np.abs(p["U2"]).sum(0).max()) < 60
        return self

    def window_scores(self, ids: np.ndarray, first: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target (windows x STRIDE); ``first`` names the windows that begin a text, whose
        slots before it are masked."""
        p, d, n = self.p, self.dim, len(ids)
        m = n * STRIDE
        prev, y = ids[:, CONTEXT:].ravel(), target.ravel()
        kv = np.take(self.keys_values, ids, 0, out=self._space("kv", n, SLOTS, 2 * d), mode="clip")
        qx = np.take(self.queries, prev, 0, out=self._space("qx", m, 2 * d), mode="clip")
        keys = self._space("keys", n, HEADS, d // HEADS, SLOTS)
        np.copyto(keys, self._split(kv[:, :, :d]).transpose(0, 1, 3, 2))
        s = np.matmul(self._split(qx[:, :d].reshape(n, STRIDE, d)), keys, out=self._space("s", n, HEADS, STRIDE, SLOTS))
        s += self.bias
        if not self.tame:
            np.minimum(s, np.float32(60), out=s)
        np.exp(s, out=s)
        s[first, :, :, :CONTEXT] = 0
        total = (s.reshape(-1, SLOTS) @ _ONES[:SLOTS]).reshape(n, HEADS, STRIDE, 1)
        o = np.matmul(s, self._split(kv[:, :, d:]), out=self._space("o", n, HEADS, STRIDE, d // HEADS))
        seen = self._space("seen", m, d)
        np.divide(o.transpose(0, 2, 1, 3), total.transpose(0, 2, 1, 3), out=seen.reshape(n, STRIDE, HEADS, -1))
        o = np.matmul(seen, self.out, out=self._space("out", m, d + SIDE))
        row, i = y // SIDE, np.arange(m)
        z = np.take(self.first_rows, prev, 0, out=self._space("z", m, SIDE), mode="clip")
        z += o[:, d:]
        out = self._log_share(z, i, row)
        h = np.take(p["C"], row, 0, out=seen, mode="clip")
        h += qx[:, d:]
        h += o[:, :d]
        z = np.matmul(np.tanh(h, out=h), p["U2"], out=z)
        z += np.take(self.cols, prev * SIDE + row, 0, out=self._space("cols", m, SIDE), mode="clip")
        out += self._log_share(z, i, y - row * SIDE)
        return out.reshape(target.shape)

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array to write into, kept from batch to batch."""
        at = self.spaces.get(name)
        if at is None or len(at) < shape[0]:
            at = self.spaces[name] = np.empty(shape, np.float32)
        return at[: shape[0]]

    def _log_share(self, z: np.ndarray, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.tame:
            np.minimum(z, np.float32(60), out=z)
        own = z[i, at].astype(np.float64)
        return own - np.log(np.exp(z, out=z) @ _ONES[:SIDE])

    def step(self, ids, first, target, weight):
        """Mean loss and gradients over a batch of windows."""
        at = np.argsort(ids.ravel(), kind="stable")
        loss, g, seen, rows = self._passes(ids, first, target, (weight / max(weight.sum(), 1)).astype(np.float32), at, True)
        g["E"] = np.zeros_like(self.p["E"])
        g["E"][seen] = rows
        return loss, g

    def _passes(self, ids, first, target, weight, order, with_loss: bool = False):
        """(mean loss if it is asked for, gradients of all weights but the embeddings, the ids of the batch in order, the
        gradients of their embeddings); ``order`` sorts the ids, and weights add up to 1."""
        p, d, n = self.p, self.dim, len(ids)
        split = lambda m, w: self._split(m.reshape(n, w, d))
        y, w, ids, prev = target.ravel(), weight.ravel(), ids.ravel(), ids[:, CONTEXT:].ravel()
        row, own = y // SIDE, np.arange(0, len(y) * SIDE, SIDE)
        # all slots give keys and values, those after the context ask
        x, xq = np.take(p["E"], ids, 0), np.take(p["E"], prev, 0)
        both, scaled = np.concatenate([p["K"], p["V"]], 1), p["Q"] * np.float32(np.sqrt(HEADS / d))
        kv, q = x @ both, split(xq @ scaled, STRIDE)
        k, v = split(kv[:, :d], SLOTS), split(kv[:, d:], SLOTS)
        a = q @ np.ascontiguousarray(k.transpose(0, 1, 3, 2))
        a += np.take(p["R"], _BACK, 1) + _CAUSAL
        np.exp(_at_most(a, 40), out=a)
        a[first, :, :, :CONTEXT] = 0
        a *= (1 / (a.reshape(-1, SLOTS) @ _ONES[:SLOTS])).reshape(n, HEADS, STRIDE, 1)
        o = np.empty_like(xq)
        np.matmul(a, v, out=split(o, STRIDE))
        hs = o @ p["O"]
        hs += xq

        def soft(z, at):
            np.exp(_at_most(z, 60), out=z)
            total, flat = z @ _ONES[:SIDE], z.reshape(-1)
            loss = -(np.log(flat[at] / total + 1e-20) * w).sum() if with_loss else 0.0
            z *= (w / total)[:, None]
            flat[at] -= w
            return loss, z

        z = hs @ p["U1"]
        z += np.take(self.rows, prev, 0)
        l1, d1 = soft(z, own + row)
        t = np.take(p["C"], row, 0)
        t += hs
        np.tanh(t, out=t)
        z = t @ p["U2"]
        z += np.take(self.cols, prev * SIDE + row, 0)
        l2, d2 = soft(z, own + (y - row * SIDE))
        pick = np.zeros((len(y), SIDE), np.float32)
        pick.reshape(-1)[own + row] = 1
        g = {"U1": hs.T @ d1, "U2": t.T @ d2}
        dt = d2 @ p["U2"].T
        t *= t
        dt *= np.subtract(1, t, out=t)
        g["C"] = pick.T @ dt
        dh = d1 @ p["U1"].T
        dh += dt
        g["O"] = o.T @ dh
        do = split(dh @ p["O"].T, STRIDE)
        dkv, dq = np.empty_like(kv), np.empty_like(xq)
        np.matmul(a.transpose(0, 1, 3, 2), do, out=split(dkv[:, d:], SLOTS))
        ds = do @ np.ascontiguousarray(v.transpose(0, 1, 3, 2))
        ds *= a
        a *= (ds.reshape(-1, SLOTS) @ _ONES[:SLOTS]).reshape(n, HEADS, STRIDE, 1)
        ds -= a
        g["R"] = (np.ones(n, np.float32) @ ds.reshape(n, -1)).reshape(HEADS, -1) @ _AWAY
        np.matmul(ds, k, out=split(dq, STRIDE))
        np.matmul(ds.transpose(0, 1, 3, 2), q, out=split(dkv[:, :d], SLOTS))
        g["Q"], gkv = xq.T @ dq * np.float32(np.sqrt(HEADS / d)), x.T @ dkv
        g["K"], g["V"] = gkv[:, :d], gkv[:, d:]
        dx = dkv @ both.T
        dh += dq @ scaled.T
        dx.reshape(n, SLOTS, d)[:, CONTEXT:] += dh.reshape(n, STRIDE, d)
        at = np.take(ids, order)
        s = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        return l1 + l2, g, np.take(at, s), np.add.reduceat(np.take(dx, order, 0), s, axis=0)

    def fit(self, windows: np.ndarray, steps: int, batch: int = BATCH, rate: float = 8e-3, seed: int = 0, share: tuple = (0, 1)) -> CausalModel:
        """Adam over windows as ``Layout.pack`` makes them, in random order again and again; the rate falls to a tenth over the
        whole training, of which this is the part ``share[0]`` of ``share[1]``.

        The means of gradients and of their squares are held as multiples of their shrunken weights, 0.9^t and 0.99^t, so that a
        step only adds to the means of the embeddings that it met."""
        if not len(windows):
            return self
        g = np.random.default_rng(seed)
        names = [*sorted(self.p.keys() - {"E"}), "E"]  # embeddings last
        flat = np.concatenate([self.p[k].ravel() for k in names])
        self.p = self._views(flat, names)
        mean, square, begin = np.zeros_like(flat), np.zeros_like(flat), len(flat) - self.p["E"].size
        mean_rows, square_rows = (x[begin:].reshape(self.p["E"].shape) for x in (mean, square))
        parts = [slice(i, i + _STRIP) for i in range(0, len(flat), _STRIP)]
        t = since = 0
        for w in self._batches(windows, steps, batch, g):
            _, grad, seen, rows = self._passes(*w)
            t += 1
            lr = rate * (1 - 0.9 * (share[0] + t / steps) / share[1])
            if t - since > 256:  # before the multiples leave single precision
                mean *= np.float32(0.9**256)
                square *= np.float32(0.99**256)
                since += 256
            small, little = 0.9 ** (t - since), 0.99 ** (t - since)
            others = np.concatenate([grad[k].ravel() for k in names[:-1]])
            for m, s, at, new in ((mean, square, slice(0, begin), others), (mean_rows, square_rows, seen, rows)):
                m[at] += new * np.float32(0.1 / small)
                new *= new
                new *= np.float32(0.01 / little)
                s[at] += new
            unit = np.sqrt((1 - 0.99**t) / little)
            eps, rise = np.float32(1e-8 * unit), np.float32(lr / (1 - 0.9**t) * small * unit)
            for part in parts:
                far = np.sqrt(square[part])
                far += eps
                np.divide(mean[part], far, out=far)
                far *= rise
                flat[part] -= far
        return self

    def _batches(self, windows: np.ndarray, steps: int, batch: int, g: np.random.Generator):
        """The arguments of ``_passes`` for each step, made for many steps at once."""
        order, at = g.permutation(len(windows)), 0
        while steps > 0:
            if at >= len(windows):
                order, at = g.permutation(len(windows)), 0
            w = windows[order[at : at + _STEPS * batch]]
            at += len(w)
            ids, first = w[:, 2:].astype(np.int64), w[:, 0] == 0
            weight = (np.arange(STRIDE) < w[:, 1, None]).astype(np.float32)
            for lo in range(0, min(len(w), steps * batch), batch):
                part = slice(lo, lo + batch)
                yield ids[part, :-1], np.flatnonzero(first[part]), ids[part, CONTEXT + 1 :], weight[part] / max(weight[part].sum(), 1), np.argsort(w[part, 2:-1].ravel(), kind="stable")
            steps -= -(-len(w) // batch)


_STEPS, _STRIP = 64, 1 << 13  # steps made ready, and weights brought on, at once: as much as caches hold


def _at_most(x: np.ndarray, limit: float) -> np.ndarray:
    """``x`` held to a limit, in place; looking for the largest is cheaper than holding all, and mostly enough."""
    return np.minimum(x, np.float32(limit), out=x) if x.size and x.max() > limit else x


_BACK = np.maximum(np.arange(CONTEXT, SLOTS)[:, None] - np.arange(SLOTS), 0)
_ONES = np.ones(max(SIDE, SLOTS), np.float32)
_CAUSAL = np.where(np.arange(CONTEXT, SLOTS)[:, None] >= np.arange(SLOTS), 0, -1e4).astype(np.float32)
_AWAY = ((_BACK.ravel()[:, None] == np.arange(SLOTS)) & (_CAUSAL.ravel()[:, None] == 0)).astype(np.float32)  # the distance of each pair


class Layout:
    """Texts with CONTEXT + 1 END ids before and END ids up to whole windows after them, so that a window is one slice: its
    inputs, and one on, its targets.  What lies beyond the end of a text comes after all its targets and has no part in
    them.  ``ids[offs[d]:offs[d+1]]`` is a text with its end."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray):
        size = np.diff(offs)
        count = -(-size // STRIDE)
        room = CONTEXT + count * STRIDE
        base = np.cumsum(room) - room
        self.laid = np.full(int(room.sum()) + SLOTS + 1, END, np.int32)
        self.laid[np.arange(len(ids)) + np.repeat(base + CONTEXT + 1 - offs[:-1], size)] = ids
        self.doc = np.repeat(np.arange(len(size)), count)
        self.nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        self.start, self.left = base[self.doc] + self.nth * STRIDE, size[self.doc] - self.nth * STRIDE

    def slices(self, which) -> np.ndarray:
        return self.laid[self.start[which, None] + np.arange(SLOTS + 1)]

    def pack(self, which: np.ndarray) -> np.ndarray:
        """Windows as rows of uint16: whether it is not the first of its text, its targets, its ids."""
        return np.column_stack([self.nth[which] > 0, np.minimum(self.left[which], STRIDE), self.slices(which)]).astype(np.uint16)


def texts_as_ids(data, offs, subwords: Subwords, words: Words, end: int = END):
    """Words (doc, hash) of texts, and their subword ids with END closing every text, with offsets."""
    n = len(offs) - 1
    low = LOWER[data[offs[0] : offs[-1]]]
    base = int(offs[0])
    parts = [(doc.astype(np.int32), h, start - base, end - base) for doc, h, start, end, _ in words(data, offs)]
    none = np.zeros(0, np.int64)
    docs, hashes, a, b = (np.concatenate(x) for x in zip(*parts)) if parts else (none.astype(np.int32), none.astype(U64), none, none)
    flat, count = subwords(hashes, low, a, b)
    per = np.bincount(docs, count, n).astype(np.int64)
    out = np.empty(len(flat) + n, np.uint16)
    ends = np.cumsum(per + 1) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = flat, end
    return docs, hashes, out, np.concatenate([[0], ends + 1])


def score_ids(model: CausalModel, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """log10 probability of each text; ``model`` is ready."""
    out = np.zeros(len(offs) - 1)
    at = Layout(ids, offs)
    for lo in range(0, len(at.doc), 160):
        part = slice(lo, lo + 160)
        w, d = at.slices(part), at.doc[part]
        got = model.window_scores(w[:, :-1], np.flatnonzero(at.nth[part] == 0), w[:, CONTEXT + 1 :])
        got *= np.arange(STRIDE) < at.left[part, None]
        out[d[0] : d[-1] + 1] += np.bincount(d - d[0], got.sum(1))
    return out / np.log(10)


_LEARN = "g int, kind int, round int, weight double, load binary"
_PAIRS, _WINDOWS = range(2)


def _learned(rows: list) -> pa.RecordBatch:
    g, kind, nth, weight, load = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(kind, pa.int32()), pa.array(nth, pa.int32()), pa.array(weight, pa.float64()), pa.array(load, pa.binary())], ["g", "kind", "round", "weight", "load"])


def block_scores(model: CausalModel, data: np.ndarray, offs: np.ndarray, subwords: Subwords, words: Words):
    """Words (doc, hash) and log10 probability of each text.  Windows and ids, many times the size of the texts, are only held for
    ``AT_ONCE`` bytes of them."""
    parts = []
    for lo, hi in stretches(offs, AT_ONCE):
        doc, h, ids, at = texts_as_ids(data, offs[lo : hi + 1], subwords, words)
        parts.append((doc + np.int32(lo), h, score_ids(model, ids, at)))
    return [np.concatenate(x) for x in zip(*parts)]


def stretches(offs: np.ndarray, limit: int, most: int | None = None):
    """Ranges of texts of about ``limit`` bytes, one text at least and ``most`` texts at most, so that memory does not follow the
    size of Arrow batches."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, lo + most) if most else hi
        yield lo, hi
        lo = hi


def _add(total: np.ndarray, pairs: list) -> np.ndarray:
    if pairs:
        total += np.bincount(np.concatenate(pairs), minlength=len(total))
    return total


def gather(train: DataFrame, ranks: dict, share: float, shards: int, text: str = "text", key: str | None = None) -> DataFrame:
    """One pass over all texts: id bigram counts of each task by slices of the previous id, and the windows (or a ``share`` of
    them) by shard and round.  A window goes by a hash of its document's id, its place and its ids, however rows and files lie."""
    g = np.random.default_rng(99)
    weigh = g.integers(1, 1 << 62, SLOTS + 3, dtype=np.uint64) | U64(1)
    shared = train.sparkSession.sparkContext.broadcast(ranks)  # PIECES entries

    def dealt(made):
        name, every = (np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, U64), np.zeros((0, SLOTS + 3), np.uint16))
        shard, turn = mix(name) % U64(shards), (name & U64(0x7FF)) % U64(ROUNDS)
        order = np.argsort(shard * U64(ROUNDS) + turn, kind="stable")
        s, size = runs((shard * U64(ROUNDS) + turn)[order])
        rows = every[order]
        return _learned([(int(shard[order[a]]), _WINDOWS, int(turn[order[a]]), float(n), rows[a : a + n].tobytes()) for a, n in zip(s, size)])

    def run(batches):
        code, words = Subwords(shared.value), Words(SPACE, limit=1 << 18)
        total = np.zeros(VOCAB * VOCAB, np.int64)
        pairs, made = [], []
        for b in batches:
            data, offs = text_bytes(b.column(0))
            owner = mix(b.column(1).to_numpy().astype(np.int64).view(U64) + U64(1))
            for lo, hi in stretches(offs, AT_ONCE):
                _, _, ids, at = texts_as_ids(data, offs[lo : hi + 1], code, words)
                prev = np.empty(len(ids), np.uint32)
                prev[1:] = ids[:-1]
                prev[at[:-1]] = END
                prev *= VOCAB
                prev += ids
                pairs.append(prev)
                lay = Layout(ids, at)
                every = lay.pack(np.arange(len(lay.doc)))
                name = owner[lo:hi][lay.doc] + mix(lay.nth.astype(U64))
                for c, w in zip(every.T, weigh):
                    name += c.astype(U64) * w
                name = mix(name)
                drawn = (name >> U64(11)).astype(np.float64) < share * (1 << 53)
                made.append((name[drawn], every[drawn]))
                if sum(map(len, pairs)) > 1 << 22:
                    total, pairs = _add(total, pairs), []
                if sum(len(x) for x, _ in made) > 1 << 18:
                    yield dealt(made)
                    made = []
        yield dealt(made)
        total = _add(total, pairs)
        used = np.flatnonzero(total)
        cut = np.searchsorted(used, np.arange(SLICES + 1) * (VOCAB * VOCAB // SLICES))
        yield _learned([(g, _PAIRS, 0, 0.0, pack(used[a:b].astype(np.uint32), narrow(total[used[a:b]]))) for g, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])

    owner = F.lit(0).cast("long") if key is None else F.xxhash64(key)
    return materialise(train.select(F.col(text).alias("t"), owner.alias("o")).mapInArrow(run, _LEARN))


def bigram_counts(gathered: DataFrame) -> np.ndarray:
    """The table of id bigrams, previous id first: slices are summed by key, and the driver gets one table of fixed size."""
    width = VOCAB * VOCAB // SLICES

    def add(batches):
        sums: dict = {}
        for g, load in rows_of(batches):
            at, n = unpack(load)
            x = sums.setdefault(g, np.zeros(width, np.int64))
            x[at.astype(np.int64) - g * width] += n.astype(np.int64)
        for g, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([pack(narrow(x))], pa.binary())], ["g", "load"])

    out = np.zeros((SLICES, width), np.int64)
    for g, load in gathered.where(F.col("kind") == _PAIRS).select("g", "load").repartition("g").mapInArrow(add, "g int, load binary").collect():
        out[g] += unpack(load)[0].astype(np.int64)
    return out.reshape(VOCAB, VOCAB)


def train_round(model: CausalModel, gathered: DataFrame, nth: int, shared=None) -> CausalModel:
    """Trains on every shard's windows of this round from the same weights, and takes the mean of what comes out, weighted
    by windows.  Shards are trained where they lie; the weights are averaged in slices, by key.  ``shared`` is a broadcast of
    a model with the same counts, so that a round sends its weights alone."""
    shared, start = shared or gathered.sparkSession.sparkContext.broadcast(model), model.weights()  # fixed size

    def run(batches):
        by: dict = {}
        for g, load in rows_of(batches):
            by.setdefault(g, []).append(np.frombuffer(load, np.uint16).reshape(-1, SLOTS + 3))
        total, seen = 0.0, 0
        for g in sorted(by):
            parts = by.pop(g)
            windows = np.ascontiguousarray(np.concatenate(parts))
            windows = windows[np.argsort(windows.view(f"S{2 * (SLOTS + 3)}").ravel(), kind="stable")]  # in the order of their bytes
            net = shared.value.with_weights(start)
            net.fit(windows, -(-len(windows) // BATCH), seed=nth * 1000 + g, share=(nth, ROUNDS))
            total, seen = total + net.weights().astype(np.float64) * len(windows), seen + len(windows)
        if seen:  # the sum over the shards of a task
            yield _learned([(i, 0, 0, float(seen), x.tobytes()) for i, x in enumerate(np.array_split(total, SLICES))])

    def mean(batches):
        sums: dict = {}
        for g, weight, load in rows_of(batches):
            w, x = sums.get(g, (0.0, 0.0))
            sums[g] = w + weight, x + np.frombuffer(load)
        for g, (w, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([(x / w).astype(np.float32).tobytes()], pa.binary())], ["g", "load"])

    part = gathered.where((F.col("kind") == _WINDOWS) & (F.col("round") == nth)).select("g", "load")
    got = part.repartition("g").mapInArrow(run, _LEARN).select("g", "weight", "load").repartition("g").mapInArrow(mean, "g int, load binary").collect()
    return model.with_weights(np.concatenate([np.frombuffer(load, np.float32) for _, load in sorted((r[0], r[1]) for r in got)])) if got else model


def fit_model(train: DataFrame, ranks: dict, text: str = "text", key: str | None = None, shard: int = SHARD) -> CausalModel:
    """A model of all texts of ``train``: every window of every text is trained on once, whatever the size of the corpus."""
    texts = train.select(F.coalesce(F.col(text), F.lit("")).alias("t"), *([F.col(key).alias("k")] if key else []))
    size, rows = texts.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    windows = ((size or 0) / 2 + rows) / STRIDE + 1  # about: two bytes an id
    gathered = gather(texts, ranks, 1.0, max(1, round(windows / shard)), "t", "k" if key else None)
    model = CausalModel().start_from(bigram_counts(gathered))
    shared = train.sparkSession.sparkContext.broadcast(model)  # the counts, many times the size of the weights, go out once
    for nth in range(ROUNDS):
        model = train_round(model, gathered, nth, shared)
    shared.destroy()
    drop(gathered)
    return model.ready()


_ROWS = "dest int, block long, kind int, load binary"
_TABLE, _WORDS, _PART, _TOTAL = range(4)


def _batch(rows: list) -> pa.RecordBatch:
    d, b, k, p = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["dest", "block", "kind", "load"])


def score_texts(docs: DataFrame, model: CausalModel, ranks: dict, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``; ``held_out`` is a
    boolean column: its rows do not count as training text.  A null text is empty: its one token is the end.  Repeated rows
    are scored each and counted each; other columns, whatever their names, are not looked at; an empty table gives none.
    Scores have four decimals, beyond which single precision says nothing."""
    buckets = buckets_for(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model, ranks))  # fixed size

    def scored(batches):
        net, known_pieces = shared.value
        code, words = Subwords(known_pieces), Words(SPACE, limit=1 << 18)
        shift, nth = U64(64 - (buckets.bit_length() - 1)), 0
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            for lo, hi in stretches(offs, BLOCK, BLOCK_ROWS):
                b = batch.slice(lo, hi - lo)
                block = block_id(nth)
                nth += 1
                held = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                doc, h, score = block_scores(net, data, offs[lo : hi + 1], code, words)
                n = len(held)
                rows = [(block % buckets, block, _TABLE, pack(longs(b.column(0)), held.astype(np.uint8), np.bincount(doc, minlength=n), np.round(score, 4)))]
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                s = np.flatnonzero(new)
                count = np.diff(np.append(s, len(h)))
                h, doc = h[s], doc[s]
                cut = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=U64)) if buckets > 1 else np.array([0, len(h)])
                for k in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[k], cut[k + 1])
                    w, per = runs(h[part])
                    known = np.add.reduceat(count[part] * ~held[doc[part]], w)
                    rows.append((int(k), block, _WORDS, pack(pack_sorted(h[part][w]), narrow(per), narrow(known), narrow(doc[part]), narrow(count[part]))))
                yield _batch(rows)

    def counted(batches):
        by, parts, total, distinct = {}, {}, 0, 0
        for dest, block, kind, load in rows_of(batches):
            if kind == _TABLE:
                yield _batch([(dest, block, kind, load.to_pybytes())])
            else:
                by.setdefault(dest, []).append((block, load))
        for dest in sorted(by):
            loads = sorted(by[dest], key=lambda x: x[0])
            got = [unpack(x) for _, x in loads]
            hs = [unpack_sorted(x[0]) for x in got]
            h, c = np.concatenate(hs), np.concatenate([x[2].astype(np.int64) for x in got])
            order = np.argsort(h, kind="stable")
            s, length = runs(h[order])
            sums = np.add.reduceat(c[order], s)
            total += int(sums.sum())
            distinct += int((sums > 0).sum())
            c[order] = np.repeat(sums, length)
            at = 0
            for (block, _), (_, per, _, doc, count), x in zip(loads, got, hs):
                each = np.repeat(c[at : at + len(x)], per)
                at += len(x)
                n = int(doc.max()) + 1
                score = np.bincount(doc, count * np.log10(each + 1.0), n)
                known = np.bincount(doc, count * (each > 0), n).astype(np.int64)
                if block in parts:
                    a, b = parts[block]
                    m = max(len(a), n)
                    parts[block] = np.pad(a, (0, m - len(a))) + np.pad(score, (0, m - n)), np.pad(b, (0, m - len(b))) + np.pad(known, (0, m - n))
                else:
                    parts[block] = score, known
        if by:
            low = min(by)
            for block, (score, known) in parts.items():
                d = np.flatnonzero((score != 0) | (known != 0))
                yield _batch([(low, block, _PART, pack(narrow(d), score[d], narrow(known[d])))])
            yield _batch([(low, -1, _TOTAL, pack(np.array([total, distinct], np.int64)))])

    texts = docs.select(F.col(key).cast("long").alias("k"), held_out.alias("h"), F.col(text).alias("t"))
    told = materialise(texts.mapInArrow(scored, _ROWS).repartition("dest").mapInArrow(counted, _ROWS))

    def sums(batches):
        n = v = ends = 0
        for _, _, kind, load in rows_of(batches):
            x = unpack(load)
            if kind == _TOTAL:
                n, v = n + int(x[0][0]), v + int(x[0][1])
            else:
                ends += int((x[1] == 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (n, v, ends)], ["n", "v", "e"])

    r = told.where(F.col("kind").isin(_TOTAL, _TABLE)).mapInArrow(sums, "n long, v long, e long").agg(F.sum("n"), F.sum("v"), F.sum("e")).first()
    words_n, words_v, ends = (int(x or 0) for x in r)
    train, distinct = words_n + ends, words_v + (ends > 0)

    def finished(batches):
        tables, parts = {}, {}
        for dest, block, kind, load in rows_of(batches):
            if kind == _TABLE:
                tables[block] = unpack(load)
            else:
                parts.setdefault(block, []).append((dest, load))
        for block, (ids, held, count, score) in tables.items():
            base, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for _, load in sorted(parts.get(block, []), key=lambda x: x[0]):
                d, s, k = unpack(load)
                base[d] += s
                known[d] += k.astype(np.int64)
            base += np.log10(ends + 1.0) - (count + 1) * np.log10(train + 1.0 * (distinct + 1))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids_back(ids), pa.array(held.astype(bool)), pa.array(count + 1), pa.array(known + (ends > 0)), pa.array(np.full(n, train)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told.where(F.col("kind").isin(_PART, _TABLE)).repartition("block").mapInArrow(finished, schema)


def op1(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The digest query; the vocabulary is at ``tokenizer``, or where ``spark.lexiloom.tokenizer`` says, or at ``TOKENIZER``."""
    tokenizer = tokenizer or spark.conf.get("spark.lexiloom.tokenizer", TOKENIZER)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranks = load_pieces(tokenizer)
    model = fit_model(docs.where(remainder("doc_id", 7) != 2), ranks, key="doc_id")
    return score_texts(docs, model, ranks, remainder("doc_id", 7) == 2)
