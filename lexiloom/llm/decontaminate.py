"""Benchmark decontamination under edit distance.

A benchmark item is found in a document if some stretch of the text is within ``rate`` * length edits of it (bytes, A-Z
lower-cased, white space as spaces).  The CGK random walk maps strings to longer ones in which near strings have a small
Hamming distance: it copies the current byte to the output and moves on by a random bit that depends on step and byte.
Item-sized windows are embedded by several independent walks, and repeated samples of ``BITS`` coordinates of the
embedding serve as hash keys: a window that shares a key with an item is compared exactly (bit-parallel edit distance
over the stretch around the window).  Sampling repeats until strings at the limit are met with the target recall; a
window that equals its item has all its keys and is always met.

Windows are laid only where they can matter, and this loses nothing: of D + k disjoint pieces of an item, D edits leave k
unchanged, shifted against each other by D at most.  So windows start where that many pieces of eight bytes occur, at
their distances from it; any other window is farther from the item than D.  Items too short for D + 1 such pieces have
shorter ones, and all their windows are compared exactly, without sampling.  Items over ``LONG`` bytes are cut into equal
units: if the item has D edits, one of its k units has D // k at most; the whole item is compared where a unit is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import LOWER, NULL_ID, SPACE, U64, ids_back, longs, ranges, text_bytes

SEED, SPARE, LONG = 8, 3, 1024
WALKS, TABLES, BITS = 3, 12, 3
STEPS = 1 << 12  # the walks' random bits repeat after so many steps
_FOLD = LOWER.copy()
_FOLD[SPACE] = 32


def pieces_of(length: int, edits: int) -> tuple[int, int]:
    """(number, bytes) of the disjoint pieces of a string, more than ``edits`` of them: SPARE more where they can be of SEED
    bytes."""
    size = min(SEED, length // (edits + 1))
    return (min(edits + SPARE, length // SEED) if size == SEED else edits + 1), size


def fold(text: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(text, np.uint8)]


def semi_global(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(edits, end) of the stretch of ``text`` nearest to ``item``, the first of equals; None beyond ``most`` edits."""
    m = len(item)
    eq: dict[int, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = None
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def word_global(pattern: np.ndarray, size: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``semi_global`` for many (pattern of 64 bytes at most, stretch) pairs at once: (least edits, end within the stretch)."""
    n, one = len(size), U64(1)
    eq = np.zeros((n, 256), U64)
    for j in range(int(size.max()) if n else 0):
        live = np.flatnonzero(j < size)
        eq[live, pattern[live, j]] |= one << U64(j)
    top = (size - 1).astype(U64)
    pv, mv, score = np.full(n, ~U64(0)), np.zeros(n, U64), size.copy()
    best, end = size.copy(), np.zeros(n, np.int64)
    for j in range(int((hi - lo).max()) if n else 0):
        live = lo + j < hi
        e = np.where(live, eq[np.arange(n), data[np.minimum(lo + j, len(data) - 1)]], U64(0))
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv), pv & xh
        score += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        less = live & (score < best)
        best[less], end[less] = score[less], j + 1
    return best, end


class Items:
    """The benchmark, ready to be searched for: units of items, seeds, embeddings and sampled keys."""

    def __init__(self, ids: list, texts: list[bytes], rate: float, seed: int = 41):
        self.ids, self.rate = np.array(ids, np.int64), rate
        self.texts = [fold(t).tobytes() for t in texts]
        self.limit = np.array([int(rate * len(t)) for t in self.texts], np.int64)
        self.body = np.frombuffer(b"".join(self.texts) or b"\0", np.uint8)
        units, seeds, base = [], {}, 0
        for k, t in enumerate(self.texts):
            parts = -(-len(t) // LONG)
            for i in range(parts):
                a, b = len(t) * i // parts, len(t) * (i + 1) // parts
                edits = int(self.limit[k]) // parts
                number, size = pieces_of(b - a, edits)
                for j in range(number):
                    at = (b - a) * j // number
                    seeds.setdefault(size, []).append((int.from_bytes(t[a + at : a + at + size], "little"), len(units), at))
                units.append((k, a, base + a, b - a, edits, number - edits, size < SEED))
            base += len(t)
        self.item, self.at, self.begin, self.size, self.most, self.need, self.direct = np.array(units, np.int64).reshape(-1, 7).T
        self.seeds = {}
        for size, found in seeds.items():
            g, u, off = zip(*found)
            order = np.argsort(np.array(g, U64), kind="stable")
            gram = np.array(g, U64)[order]
            bitmap = np.zeros(1 << 21, bool)
            bitmap[self._slot(gram)] = True
            self.seeds[size] = gram, np.array(u, np.int64)[order], np.array(off, np.int64)[order], bitmap
        g = np.random.default_rng(seed)
        self.bits = g.integers(0, 2, (WALKS, min(STEPS, 3 * int(self.size.max())) if len(self.size) else 1, 256), dtype=np.int8)
        self.samples = np.sort(g.random((WALKS, TABLES, BITS)), axis=2)
        self.keys = self.embed(self.body, self.begin, self.begin + self.size, np.arange(len(self.item)))

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * U64(0x9E3779B97F4A7C15) >> U64(43)).astype(np.int64)

    def embed(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Sampled keys (windows x WALKS * TABLES) of the windows lo to hi of ``data``, each as long as its unit; what a walk
        reads beyond a window is 0."""
        n = len(unit)
        keys = np.zeros((n, WALKS, TABLES), np.uint32)
        size = self.size[unit]
        for w in range(WALKS):
            # coordinates are shares of the walk, so that windows of all lengths go together
            at = np.floor(self.samples[w][None] * (3 * size)[:, None, None]).astype(np.int32)
            wanted = at.reshape(n, -1)
            order = np.argsort(wanted, 1, kind="stable")
            walk = np.zeros((n, TABLES * BITS), np.uint8)
            place, nxt = lo.copy(), np.zeros(n, np.int64)
            due = np.take_along_axis(wanted, order[:, :1], 1)[:, 0]
            for j in range(int(wanted.max()) + 1 if n else 0):
                c = data[np.minimum(place, hi - 1)]
                c[place >= hi] = 0
                hit = np.flatnonzero(due == j)
                while len(hit):
                    walk[hit, order[hit, nxt[hit]]] = c[hit]
                    nxt[hit] += 1
                    more = nxt[hit] < TABLES * BITS
                    due[hit[~more]] = -1
                    hit = hit[more]
                    due[hit] = wanted[hit, order[hit, nxt[hit]]]
                    hit = hit[due[hit] == j]
                place += self.bits[w, j % self.bits.shape[1]][c]
            for b in range(BITS):
                keys[:, w] = keys[:, w] << 8 | walk.reshape(n, TABLES, BITS)[:, :, b]
        return keys.reshape(n, -1)

    def windows(self, data: np.ndarray, offs: np.ndarray):
        """(doc, unit, start) of the windows that pieces call for, distinct and in order; ``data`` is folded."""
        out = [np.zeros((3, 0), np.int64)]
        for size, (gram, unit, off, bitmap) in self.seeds.items():
            out.append(self._laid(data, offs, size, gram, unit, off, bitmap))
        x = np.concatenate(out, 1)
        x = x[:, np.lexsort((x[2], x[1], x[0]))]
        new = np.ones(x.shape[1], bool)
        new[1:] = (x[:, 1:] != x[:, :-1]).any(0)
        return tuple(x[:, new])

    def _laid(self, data, offs, size, gram, unit, off, bitmap) -> np.ndarray:
        out = [np.zeros((4, 0), np.int64)]
        for lo in range(int(offs[0]), int(offs[-1]), 1 << 18):
            b = data[lo : min(int(offs[-1]), lo + (1 << 18) + size - 1)]
            if len(b) < size:
                break
            if size == SEED:
                v = np.lib.stride_tricks.as_strided(b, (len(b) - 7, 8), (1, 1)).copy().view(U64)[:, 0]
            else:
                v = np.zeros(len(b) - size + 1, U64)
                for j in range(size):
                    v |= b[j : j + len(v)].astype(U64) << U64(8 * j)
            pos = np.flatnonzero(bitmap[self._slot(v)])
            v = v[pos]
            left, right = np.searchsorted(gram, v, "left"), np.searchsorted(gram, v, "right")
            n = right - left
            j = ranges(left, n)
            pos = np.repeat(pos, n) + lo
            doc = np.searchsorted(offs, pos, "right") - 1
            inside = pos + size <= offs[doc + 1]
            out.append(np.stack([doc[inside], unit[j[inside]], (pos - off[j])[inside], off[j[inside]]]))
        x = np.concatenate(out, 1)
        # pieces that stay together fall into one of two overlapping bins; distinct pieces of a bin are counted
        keep = np.zeros(x.shape[1], bool)
        width = np.maximum(self.most[x[1]], 8)
        for half in (0, 1) if x.shape[1] else ():
            bin_of = (x[2] + (1 << 40) + half * width) // (2 * width)
            order = np.lexsort((x[3], bin_of, x[1], x[0]))
            y = np.stack([x[0], x[1], bin_of, x[3]])[:, order]
            new = np.ones(y.shape[1], bool)
            new[1:] = (y[:3, 1:] != y[:3, :-1]).any(0)
            piece = new.copy()
            piece[1:] |= y[3, 1:] != y[3, :-1]
            s = np.flatnonzero(new)
            many = np.add.reduceat(piece, s, dtype=np.int64) >= self.need[y[1, s]]
            keep[order] |= np.repeat(many, np.diff(np.append(s, y.shape[1])))
        return x[:3, keep]

    def met(self, data: np.ndarray, offs: np.ndarray, doc: np.ndarray, unit: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether a window shares a key with its unit; units compared directly need none."""
        near = self.direct[unit] > 0
        ask = np.flatnonzero(~near)
        ask = ask[np.argsort(self.size[unit[ask]], kind="stable")]  # walks of like length go together
        for at in range(0, len(ask), 8192):
            i = ask[at : at + 8192]
            lo, hi = np.maximum(start[i], offs[doc[i]]), np.minimum(start[i] + self.size[unit[i]], offs[doc[i] + 1])
            near[i] = (self.embed(data, lo, hi, unit[i]) == self.keys[unit[i]]).any(1)
        return near

    def search(self, data: np.ndarray, offs: np.ndarray) -> dict:
        """{(doc, item): (edits, start, end)}: the nearest stretch of each item that is found in a text."""
        base = int(offs[0])
        data, offs = _FOLD[data[base : offs[-1]]], offs - base
        doc, unit, start = self.windows(data, offs)
        near = self.met(data, offs, doc, unit, start)
        doc, unit, start = doc[near], unit[near], start[near]
        if not len(doc):
            return {}
        # windows whose stretches overlap are one stretch, up to some lengths of the unit
        new, cell = np.ones(len(doc), bool), start // (8 * self.size[unit] + 64)
        new[1:] = (doc[1:] != doc[:-1]) | (unit[1:] != unit[:-1]) | (start[1:] - start[:-1] > self.most[unit[1:]] + 1) | (cell[1:] != cell[:-1])
        s = np.flatnonzero(new)
        last = np.append(s[1:], len(doc)) - 1
        doc, unit, lo, hi = doc[s], unit[s], start[s] - self.most[unit[s]], start[last] + (self.size + self.most)[unit[s]]
        lo, hi = np.maximum(lo, offs[doc]), np.minimum(hi, offs[doc + 1])
        found: dict = {}

        def note(d: int, k: int, edits: int, end: int) -> None:
            end -= int(offs[d])
            if (d, k) not in found or edits < found[d, k][0]:
                found[d, k] = (edits, max(0, end - len(self.texts[k]) - edits), end)

        small = self.size[unit] <= 64
        for at in range(0, int(small.sum()), 8192):
            i = np.flatnonzero(small)[at : at + 8192]
            size = self.size[unit[i]]
            pattern = self.body[np.minimum(self.begin[unit[i], None] + np.arange(64), len(self.body) - 1)]
            edits, end = word_global(pattern, size, data, lo[i], hi[i])
            for x in np.flatnonzero(edits <= self.most[unit[i]]).tolist():
                note(int(doc[i[x]]), int(self.item[unit[i[x]]]), int(edits[x]), int(lo[i[x]] + end[x]))
        tried: set = set()
        for i in np.flatnonzero(~small).tolist():
            d, u = int(doc[i]), int(unit[i])
            k, a, b = int(self.item[u]), int(lo[i]), int(hi[i])
            if found.get((d, k), (1,))[0] == 0:
                continue
            t = self.texts[k]
            if self.size[u] < len(t):  # a unit of a long item: the whole one is compared around it
                got = _nearest(t[int(self.at[u]) : int(self.at[u] + self.size[u])], data[a:b].tobytes(), int(self.most[u]))
                if not got:
                    continue
                # the unit ends at a + got[1]; the item lies about it, give or take its limit
                from_ = a + got[1] - int(self.at[u] + self.size[u])
                wide = int(self.limit[k])
                if any((d, k, x) in tried for x in (from_ // (wide + 1) - 1, from_ // (wide + 1), from_ // (wide + 1) + 1)):
                    continue
                tried.add((d, k, from_ // (wide + 1)))
                a, b = max(int(offs[d]), from_ - 4 * wide - 4), min(int(offs[d + 1]), from_ + len(t) + 4 * wide + 4)
            got = _nearest(t, data[a:b].tobytes(), int(self.limit[k]))
            if got:
                note(d, k, got[0], a + got[1])
        return found


def _nearest(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    p = text.find(item)
    return (0, p + len(item)) if p >= 0 else semi_global(item, text, most)


def batches_of_items(benchmark: DataFrame, key: str, text: str, rate: float, most_bytes: int):
    """The benchmark in parts of about ``most_bytes``, small enough to send to every task."""
    items = benchmark.where(F.octet_length(F.col(text)) > 0).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // most_bytes))
    for i in range(parts if total else 0):
        rows = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == i).orderBy("k", "t").collect()
        if rows:
            yield Items([NULL_ID if r["k"] is None else r["k"] for r in rows], [r["t"].encode() for r in rows], rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = 0.1, most_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, edits, start, stop): each item found in a document, with the least number of edits and about where
    (byte offsets; ``stop`` is exact, the first of equally near ones).  Null and empty texts hold nothing; null and empty
    items are found nowhere; items under 1 / ``rate`` bytes must occur as they are.  Rows that repeat an id are searched each;
    repeated items are one, and different items under one id are reported each.  Other columns are not looked at.  Memory
    of a task is bounded by ``most_bytes`` of items, or one item if that is longer, and its batch of texts."""
    out = None
    for items in batches_of_items(benchmark, item_key, item_text, rate, most_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # most_bytes of items at most

        def run(batches, shared=shared):
            known = shared.value
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    b = batch.slice(i, 4096)
                    ids = longs(b.column(0))
                    data, offs = text_bytes(b.column(1))
                    got = sorted(known.search(data, offs).items())
                    if got:
                        d, k = (np.array(x) for x in zip(*(x for x, _ in got)))
                        e, s, t = (pa.array(x, pa.int64()) for x in zip(*(y for _, y in got)))
                        yield pa.RecordBatch.from_arrays([ids_back(ids[d]), ids_back(known.ids[k]), e, s, t], ["doc_id", "item_id", "edits", "start", "stop"])

        part = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, item_id long, edits long, start long, stop long")
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long, start long, stop long") if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = 0.1, most_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the rows in whose text any item is found; one pass over the rows for each part of the benchmark.
    Null and empty texts stay, repeated rows go or stay together, and columns keep names, order and values."""
    column = docs.columns.index(text)
    for items in batches_of_items(benchmark, item_key, item_text, rate, most_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            known = shared.value
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    b = batch.slice(i, 4096)
                    keep = np.ones(b.num_rows, bool)
                    for d, _ in known.search(*text_bytes(b.column(column))):
                        keep[d] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
