"""Removal of repeated byte strings, by bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.  The steps:

1. Anchors.  Every string of ``length`` bytes is filed under the smallest hash of the 16-byte grams inside it, a choice
   that depends on the string alone, so that equal strings meet under one key at one distance from it.  Neighbouring
   strings share their anchor; together they form a context of at most 2 * length bytes.
2. Contexts are dealt by key.  Equal contexts (by digest) are held once, with their first occurrence: the others are
   removed whole.  A key with one context has nothing more to compare.  Of the bytes around the anchor, a string that two
   contexts share covers the nearest half on one side at least; a context that shares neither half with another one of its
   key (by 32 bits of their hashes, which can only let too many through) is compared no further.
3. Where a key has several contexts, their bytes are fetched and a suffix order of depth over ``length`` and its
   Burrows-Wheeler transform are built for each bucket of keys.  Intervals are extended backwards, breadth first: level
   L visits the interval of every string of L bytes that still parts suffixes and thereby sets the common prefix values
   L, in increasing order; after ``length`` levels the values that are not set are those of at least ``length``.
   Suffixes between which none is set share a string of ``length`` bytes; all but the earliest of them are removed.
4. The removed intervals of each document are united, and its remaining bytes are hashed.

Keys with over ``hot`` different contexts are cut into single strings, which are dealt by their own content, so that no
key is gathered in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NULL_ID, U64, _powers, _table, block_id, buckets_for, longs, materialise, mix, narrow, pack, pack_sorted, ranges, rows_of, runs, text_bytes, unpack, unpack_sorted

GRAM, PIECE = 16, 1 << 18
SHARD = (1 << 21) - 2  # bytes of contexts whose suffixes are ordered at once
HOT = 4096
HELD = 1 << 20  # spans, requests, or bytes of contexts / 16 that a task holds before it deals them out
_ROWS = "dest int, kind int, load binary"
_TEXT, _SPANS, _ASKED, _SEEN, _CONTEXT = range(5)


def _batch(rows: list) -> pa.RecordBatch:
    d, k, p = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["dest", "kind", "load"])


def _home(ids: np.ndarray, sub: np.ndarray, homes: int) -> np.ndarray:
    return (mix(ids.view(U64) * U64(0x9E3779B97F4A7C15) + sub.astype(U64)) % U64(homes)).astype(np.int32)


def _by_dest(dest: np.ndarray, kind: int, arrays: list[np.ndarray], first_sorted: bool = False) -> list:
    """Rows that carry each destination's share of parallel arrays."""
    order = np.argsort(dest, kind="stable")
    s, length = runs(dest[order])
    out = []
    for a, n in zip(s, length):
        i = order[a : a + n]
        out.append((int(dest[i[0]]), kind, pack(*(pack_sorted(x[i]) if first_sorted and k == 0 else narrow(x[i]) if x.dtype.kind == "u" and x.dtype.itemsize < 8 else x[i] for k, x in enumerate(arrays)))))
    return out


def anchors(data: np.ndarray, lo: int, hi: int, offs: np.ndarray, length: int):
    """Of the strings of ``length`` bytes that start in data[lo:hi] and end within their text: runs that share an anchor,
    as (first start, last start, anchor position, key, digest of the context, hashes of the anchor with the half before it and with
    the half behind it; 0 where the context does not hold that half)."""
    stop = min(len(data), hi + length - 1)
    b = data[lo:stop]
    n = len(b) - length + 1
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2 + (np.zeros(0, np.uint32),) * 2
    if n <= 0:
        return empty
    v = np.lib.stride_tricks.as_strided(b, (len(b) - 7, 8), (1, 1)).copy().view(U64)[:, 0]
    g = v[:-8] * U64(0xD6E8FEB86659FD93)
    g ^= v[8:] * U64(0x9E3779B97F4A7C15)
    g *= U64(0xFF51AFD7ED558CCD)
    g ^= g >> U64(32)
    width = length - GRAM + 1
    order = (g & U64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U64)
    m = -(-len(order) // width) * width
    padded = np.full(m, U64(0xFFFFFFFFFFFFFFFF))
    padded[: len(order)] = order
    padded = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & U64(0xFFFFFFFF)).astype(np.int64)
    # strings that leave their text do not count
    ok = np.zeros(n + 1, np.int32)
    k0, k1 = np.searchsorted(offs, lo, "right") - 1, np.searchsorted(offs, hi, "left")
    a = np.clip(offs[k0:k1] - lo, 0, n)
    e = np.clip(offs[k0 + 1 : k1 + 1] - length + 1 - lo, 0, n)
    real = e > a
    np.add.at(ok, a[real], 1)
    np.add.at(ok, e[real], -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(starts):
        return empty
    at = at[starts]
    s, count = runs(at)
    first, last, at = starts[s], starts[s + count - 1], at[s]
    p, q = _powers(len(b) + 1)
    cum = np.zeros(len(b) + 1, U64)
    np.cumsum(_table(False)[b] * p[: len(b)], out=cum[1:])
    digest = (cum[last + length] - cum[first]) * q[first]
    digest = mix(digest + (last - first).astype(U64) * U64(0xA0761D6478BD642F) + (at - first).astype(U64) * U64(0xE7037ED1A0B428DB))
    half = width // 2  # of the length - GRAM bytes beside the anchor, rounded up
    sides = []
    for begin, end in ((at - half, at + GRAM), (at, at + GRAM + half)):
        held = (begin >= first) & (end <= last + length)
        begin, end = np.where(held, begin, 0), np.where(held, end, 0)
        name = mix((cum[end] - cum[begin]) * q[begin]) >> U64(32)
        sides.append(np.where(held, np.maximum(name, U64(1)), U64(0)).astype(np.uint32))
    return first + lo, last + lo, at + lo, mix(g[at] + U64(1)), digest, *sides


def _occurrences(length: int, buckets: int, homes: int):
    """Texts -> the contexts of each block by bucket of their key, equal ones once; spans of the others by home."""

    def run(batches):
        shift = U64(64 - (buckets.bit_length() - 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, 1 << 13):
                b = batch.slice(begin, 1 << 13)
                ids, sub = longs(b.column(0)), longs(b.column(1)).astype(U64)
                data, offs = text_bytes(b.column(2))
                got = [anchors(data, lo, min(lo + PIECE, int(offs[-1])), offs, length) for lo in range(int(offs[0]), int(offs[-1]), PIECE)]
                if not got:
                    continue
                first, last, at, key, digest, left, right = (np.concatenate(x) for x in zip(*got))
                doc = np.searchsorted(offs, first, "right") - 1
                start = (first - offs[doc]).astype(np.uint32)
                rank = np.empty(len(ids), np.int64)
                rank[np.lexsort((sub, ids))] = np.arange(len(ids))
                order = np.lexsort((start, rank[doc], digest, key))
                new = np.ones(len(order), bool)
                ko, do = key[order], digest[order]
                new[1:] = (ko[1:] != ko[:-1]) | (do[1:] != do[:-1])
                # repeated rows hold the same strings at the same places: they are one document
                lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
                same = (ids[doc[order]] == ids[doc[lead]]) & (sub[doc[order]] == sub[doc[lead]]) & (start[order] == start[lead])
                rest, keep = order[~new & ~same], order[new]
                rows = []
                if len(rest):
                    rows += _spans(ids[doc[rest]], sub[doc[rest]], start[rest], start[rest] + (last - first)[rest].astype(np.uint32) + np.uint32(length), homes)
                if len(keep):
                    dest = (key[keep] >> shift).astype(np.int32) if buckets > 1 else np.zeros(len(keep), np.int32)
                    rows += _by_dest(dest, _SEEN, [key[keep], digest[keep], ids[doc[keep]], narrow(sub[doc[keep]]), start[keep], (last - first)[keep].astype(np.uint16), left[keep], right[keep]], True)
                yield _batch(rows)

    return run


def _shared(key: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether another row has the same key and name; a name of 0 is none."""
    order = np.lexsort((name, key))
    k, x = key[order], name[order]
    same = (k[1:] == k[:-1]) & (x[1:] == x[:-1]) & (x[1:] > 0)
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _spans(ids, sub, start, end, homes: int) -> list:
    """Rows for the homes of documents that tell removed spans; overlapping ones are united first."""
    order = np.lexsort((start, sub, ids))
    ids, sub, start, end = ids[order], sub[order], start[order].astype(np.int64), end[order].astype(np.int64)
    cut = np.ones(len(ids), bool)
    cut[1:] = (ids[1:] != ids[:-1]) | (sub[1:] != sub[:-1])
    group = np.cumsum(cut)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    cut[1:] |= start[1:] > reach[:-1]
    s = np.flatnonzero(cut)
    ids, sub, start, end = ids[s], sub[s], start[s].astype(np.uint32), np.maximum.reduceat(end, s).astype(np.uint32)
    return _by_dest(_home(ids, sub, homes), _SPANS, [ids, narrow(sub), start, end])


def _told(held: list, deal) -> list:
    """What ``deal`` makes of held tuples of arrays, put together; they are held no longer.  A task that deals out what several
    of its destinations gave makes few rows for each other destination, however many destinations there are."""
    rows = deal(*(np.concatenate(x) for x in zip(*held))) if held else []
    held.clear()
    return rows


def _compare_digests(length: int, homes: int, hot: int):
    """One partition of keys -> spans of contexts that are not the first of their kind; requests for the bytes of the first
    ones where a key has several kinds."""

    def ask(ids, sub, start, more, key, many):
        return _by_dest(_home(ids, sub, homes), _ASKED, [ids, narrow(sub), start, more, key, many])

    def run(batches):
        by: dict = {}
        gone, wanted, count = [], [], 0
        for dest, kind, load in rows_of(batches):
            if kind == _SPANS:
                yield _batch([(dest, kind, load.to_pybytes())])
            else:
                by.setdefault(dest, []).append(unpack(load))
        for loads in by.values():
            key = np.concatenate([unpack_sorted(x[0]) for x in loads])
            digest, ids = (np.concatenate([x[i] for x in loads]) for i in (1, 2))
            sub = np.concatenate([x[3].astype(U64) for x in loads])
            start, more, left, right = (np.concatenate([x[i].astype(np.uint32) for x in loads]) for i in (4, 5, 6, 7))
            order = np.argsort(key, kind="stable")
            _, n = runs(key[order])
            order = order[np.repeat(n > 1, n)]  # a key that is alone cannot repeat
            order = order[np.lexsort((start[order], sub[order], ids[order], digest[order], key[order]))]
            if not len(order):
                continue
            k, d, i, u, t = key[order], digest[order], ids[order], sub[order], start[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            rest = ~new & ~((i == i[lead]) & (u == u[lead]) & (t == t[lead]))
            if rest.any():
                o = order[rest]
                gone.append((ids[o], sub[o], start[o], start[o] + more[o] + np.uint32(length)))
                count += len(o)
            o = order[new]
            o = o[_shared(key[o], left[o]) | _shared(key[o], right[o])]
            _, n = runs(key[o])
            kinds = np.repeat(n, n)
            m = kinds > 1
            if m.any():
                o, kinds = o[m], kinds[m]
                wanted.append((ids[o], sub[o], start[o], more[o].astype(np.uint16), key[o], (kinds > hot).astype(np.uint8)))
                count += len(o)
            if count > HELD:
                yield _batch(_told(gone, lambda *x: _spans(*x, homes)) + _told(wanted, ask))
                count = 0
        if count:
            yield _batch(_told(gone, lambda *x: _spans(*x, homes)) + _told(wanted, ask))

    return run


def _pack_texts(homes: int):
    """Texts by the home of their document, compressed."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1 << 12):
                b = batch.slice(begin, 1 << 12)
                ids, sub = longs(b.column(0)), longs(b.column(1)).astype(U64)
                data, offs = text_bytes(b.column(2))
                dest = _home(ids, sub, homes)
                order = np.argsort(dest, kind="stable")
                s, length = runs(dest[order])
                rows = []
                for a, n in zip(s, length):
                    i = order[a : a + n]
                    size = (offs[i + 1] - offs[i]).astype(np.int64)
                    body = b"".join(data[offs[j] : offs[j + 1]].tobytes() for j in i)
                    rows.append((int(dest[i[0]]), _TEXT, pack(ids[i], narrow(sub[i]), size, np.frombuffer(z.compress(body), np.uint8))))
                yield _batch(rows)

    return run


def _texts(loads: list):
    """(ids, subs, offsets, bytes) of packed texts."""
    z = zstandard.ZstdDecompressor()
    parts = [unpack(x) for x in loads]
    size = np.concatenate([p[2] for p in parts])
    data = np.frombuffer(b"".join(z.decompress(p[3].tobytes(), max_output_size=int(p[2].sum()) or 1) for p in parts), np.uint8)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(U64) for p in parts]), np.concatenate([[0], np.cumsum(size)]), data


def _gather(batches):
    """The rows of a partition by destination, then kind."""
    by: dict = {}
    for dest, kind, load in rows_of(batches):
        by.setdefault(dest, {}).setdefault(kind, []).append(load)
    return by


def _find(ids: np.ndarray, sub: np.ndarray, want: np.ndarray, want_sub: np.ndarray) -> np.ndarray:
    """Index of a text with each wanted (id, sub)."""
    order = np.lexsort((sub, ids))
    names = np.rec.fromarrays([ids[order], sub[order]])
    at = np.searchsorted(names, np.rec.fromarrays([want, want_sub.astype(sub.dtype)]))
    return order[at]


def _names(data: np.ndarray, at: np.ndarray, more: np.ndarray, length: int, block: int = 1 << 12) -> np.ndarray:
    """Hashes of the more + 1 strings of ``length`` bytes from each place on, by prefix sums over blocks of places."""
    out = []
    for i in range(0, len(at), block):
        size = more[i : i + block] + length
        body = data[ranges(at[i : i + block], size)]
        p, q = _powers(len(body) + 1)
        cum = np.zeros(len(body) + 1, U64)
        np.cumsum(_table(False)[body] * p[: len(body)], out=cum[1:])
        first = ranges(np.cumsum(size) - size, more[i : i + block] + 1)
        out.append(mix((cum[first + length] - cum[first]) * q[first]))
    return np.concatenate(out)


def _fetch(length: int, buckets: int):
    """One partition of homes: texts and requests -> the bytes of the contexts asked for, by bucket of their key; contexts
    of hot keys as single strings, by their own hash."""

    shift = U64(64 - (buckets.bit_length() - 1))

    def deal(key, ids, sub, start, more, body):
        begin = np.cumsum(more + length) - more - length
        dest = (key >> shift).astype(np.int32) if buckets > 1 else np.zeros(len(key), np.int32)
        order = np.argsort(dest, kind="stable")
        s, count = runs(dest[order])
        rows = []
        for a, n in zip(s, count):
            i = order[a : a + n]
            rows.append((int(dest[i[0]]), _CONTEXT, pack(key[i], ids[i], narrow(sub[i].astype(U64)), start[i].astype(np.uint32), narrow(more[i].astype(np.uint32)), body[ranges(begin[i], more[i] + length)])))
        return rows

    def run(batches):
        held, count = [], 0
        for kinds in _gather(batches).values():
            if _ASKED not in kinds or _TEXT not in kinds:
                continue
            ids, sub, offs, data = _texts(kinds[_TEXT])
            asked = [unpack(x) for x in kinds[_ASKED]]
            wid = np.concatenate([x[0] for x in asked])
            wsub, start, more, hot = (np.concatenate([x[i].astype(np.int64) for x in asked]) for i in (1, 2, 3, 5))
            key = np.concatenate([x[4] for x in asked])
            at = offs[_find(ids, sub, wid, wsub)] + start
            if hot.any():
                h = np.flatnonzero(hot)
                one = ranges(np.zeros(len(h), np.int64), more[h] + 1)
                j = np.repeat(h, more[h] + 1)
                name = _names(data, at[h], more[h], length)
                c = np.flatnonzero(hot == 0)
                wid, wsub, start, at = (np.concatenate([wid[c], wid[j]]), np.concatenate([wsub[c], wsub[j]]), np.concatenate([start[c], start[j] + one]), np.concatenate([at[c], at[j] + one]))
                more, key = np.concatenate([more[c], np.zeros(len(j), np.int64)]), np.concatenate([key[c], name])
            step = HELD * 16 // (2 * length) + 1
            for i in range(0, len(key), step):
                c = slice(i, i + step)
                held.append((key[c], wid[c], wsub[c], start[c], more[c], data[ranges(at[c], more[c] + length)]))
                count += len(held[-1][-1])
                if count > HELD * 16:
                    yield _batch(_told(held, deal))
                    count = 0
        if count:
            yield _batch(_told(held, deal))

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` bytes at least (prefix doubling; ties stay in text order).
    Up to 2^21 bytes, two ranks and the position are sorted as one number."""
    n = len(text)
    small = n < 1 << 21
    b = np.zeros(n + 5, U64)
    b[:n] = text
    b[:n] += U64(1)
    first = np.zeros(n, U64)
    for j in range(4):
        first = (first << U64(9)) | b[j : n + j]
    rank, h = first, 4
    bits = U64(21)
    mask = U64((1 << 21) - 1)
    pos = np.arange(n, dtype=U64)
    if small:
        x = (rank << bits) | pos
        x.sort()
        order = (x & mask).astype(np.int64)
        value = x >> bits
    else:
        order = np.argsort(rank, kind="stable")
        value = rank[order]
    while True:
        new = np.ones(n, bool)
        new[1:] = value[1:] != value[:-1]
        r = np.cumsum(new).astype(U64)  # from 1; 0 stands beyond the end
        if h >= depth or int(r[-1] if n else 0) == n:
            return order
        rank = np.empty(n, U64)
        rank[order] = r
        second = np.zeros(n, U64)
        second[: n - h] = rank[h:]
        if small:
            x = (rank - U64(1)) << U64(42) | second << bits | pos
            x.sort()
            order = (x & mask).astype(np.int64)
            value = x >> bits
        else:
            pair = rank * U64(n + 1) + second
            order = np.argsort(pair, kind="stable")
            value = pair[order]
        h *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For neighbours in the suffix order: whether suffix i shares ``length`` bytes or more with suffix i - 1.

    Breadth-first backward extension of intervals on the transform: the intervals of level L stand for strings of L
    bytes; extending one by a byte gives an interval of level L + 1, whose end, if it has no value yet, gets the common
    prefix value L.  An interval that sets nothing new is dropped; after ``length`` levels what is unset is long."""
    n = len(text) + 1  # with a last symbol below all others, whose suffix comes first
    sym = np.zeros(n, np.uint16)
    sym[:-1] = text
    sym[:-1] += 1
    bwt = sym[np.concatenate([[n - 1], order]) - 1]
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    head = bwt[by]  # first symbol of each row
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    whole = True
    for _ in range(length):
        if not len(lo):
            break
        size = hi - lo
        rows = np.arange(n) if whole else ranges(lo, size)
        to, of = lf[rows], np.repeat(np.arange(len(lo), dtype=np.int32), size)
        whole = False
        if len(rows) * 4 > n:
            name = np.full(n, -1, np.int32)
            name[to] = of
            p = np.flatnonzero(name >= 0)
            g = name[p]
        else:
            x = np.sort(to.astype(U64) << U64(32) | of.astype(U64))
            p, g = (x >> U64(32)).astype(np.int64), (x & U64(0xFFFFFFFF)).astype(np.int32)
        c = head[p]
        new = np.ones(len(p), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)
        s = np.flatnonzero(new)
        a, b = p[s], p[np.append(s[1:], len(p)) - 1] + 1
        fresh = unset[b]
        unset[b] = False
        lo, hi = a[fresh], b[fresh]
    return unset[1:n]


def _expand(length: int, homes: int):
    """One partition of contexts -> spans of the strings that an earlier place also has."""

    def run(batches):
        held, count = [], 0
        for kinds in _gather(batches).values():
            parts = [unpack(x) for x in kinds[_CONTEXT]]
            key, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            sub, start, more = (np.concatenate([p[i].astype(np.int64) for p in parts]) for i in (2, 3, 4))
            body = np.concatenate([p[5] for p in parts])
            size = more + length
            begin = np.cumsum(size) - size
            by = np.argsort(key, kind="stable")
            total, i = np.cumsum(size[by] + 1), 0
            while i < len(by):  # shards of whole keys
                j = int(np.searchsorted(total, (total[i - 1] if i else 0) + SHARD, "right"))
                j = max(j, i + 1)
                if j < len(by):
                    back = int(np.searchsorted(key[by], key[by[j]], "left"))
                    j = back if back > i else int(np.searchsorted(key[by], key[by[j]], "right"))
                c = by[i:j]
                i = j
                found = _shard(c, ids, sub, start, more, size, begin, body, length)
                if found:
                    held.append(found)
                    count += len(found[0])
                if count > HELD:
                    yield _batch(_told(held, lambda *x: _spans(*x, homes)))
                    count = 0
        if count:
            yield _batch(_told(held, lambda *x: _spans(*x, homes)))

    return run


def _shard(c, ids, sub, start, more, size, begin, body, length) -> tuple | None:
    """(ids, subs, starts, ends) of the strings of contexts ``c`` that an earlier place also has."""
    at = np.cumsum(size[c] + 1) - size[c] - 1  # where each context begins in the shard; 0xFF parts them
    text = np.full(int((size[c] + 1).sum()), 255, np.uint8)
    text[ranges(at, size[c])] = body[ranges(begin[c], size[c])]
    order = suffix_order(text, length)
    long = long_prefixes(text, order, length)
    # the strings that count, with their places
    n = more[c] + 1
    owner = np.repeat(np.arange(len(c)), n)
    shift = ranges(np.zeros(len(c), np.int64), n)
    doc = np.empty(len(c), np.int64)
    name = np.lexsort((sub[c], ids[c]))
    new = np.ones(len(c), bool)
    new[1:] = (ids[c][name][1:] != ids[c][name][:-1]) | (sub[c][name][1:] != sub[c][name][:-1])
    doc[name] = np.cumsum(new)
    place = np.full(len(text), -1, np.int64)
    mine = np.zeros(len(text), np.int64)
    place[at[owner] + shift] = (doc[owner] << 33) | (start[c][owner] + shift)
    mine[at[owner] + shift] = owner
    place = place[order]
    group = np.cumsum(~long)
    real = place >= 0
    place, group, pos = place[real], group[real], order[real]
    s, _ = runs(group)
    if not len(s):
        return None
    low = np.repeat(np.minimum.reduceat(place, s), np.diff(np.append(s, len(group))))
    gone = place > low
    if not gone.any():
        return None
    o = mine[pos[gone]]
    first = (place[gone] & ((1 << 33) - 1)).astype(np.uint32)
    return ids[c][o], sub[c][o].astype(U64), first, first + np.uint32(length)


def _finish(length: int, with_text: bool):
    """One partition of homes: texts and removed spans -> what is left of each text."""

    def run(batches):
        for kinds in _gather(batches).values():
            if _TEXT not in kinds:
                continue
            ids, sub, offs, data = _texts(kinds[_TEXT])
            gone = np.zeros(len(data) + 1, np.int32)
            order = np.lexsort((sub, ids))
            names = np.rec.fromarrays([ids[order], sub[order]])
            for x in kinds.get(_SPANS, []):
                wid, wsub, a, b = unpack(x)
                want = np.rec.fromarrays([wid, wsub.astype(sub.dtype)])
                left, right = np.searchsorted(names, want, "left"), np.searchsorted(names, want, "right")
                rep = right - left  # rows that repeat a document get its spans, each
                base = offs[order[ranges(left, rep)]]
                np.add.at(gone, base + np.repeat(a, rep).astype(np.int64), 1)
                np.add.at(gone, base + np.repeat(b, rep).astype(np.int64), -1)
            gone = np.cumsum(gone[:-1]) > 0
            n = len(ids)
            removed = np.concatenate([[0], np.cumsum(gone)])
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = offs[:-1][offs[:-1] < len(data)]
            edge[inner] = gone[inner]
            edges = np.concatenate([[0], np.cumsum(edge)])
            kept = [data[offs[i] : offs[i + 1]][~gone[offs[i] : offs[i + 1]]].tobytes() for i in range(n)]
            cols = [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(sub.astype(np.int64)), pa.array(np.diff(offs)), pa.array(removed[offs[1:]] - removed[offs[:-1]]), pa.array(edges[offs[1:]] - edges[offs[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names_out = ["doc_id", "sub", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array([k.decode("utf-8", "ignore") for k in kept]))
                names_out.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names_out)

    return run


def _named(docs: DataFrame, key: str, text: str) -> list:
    """Columns (k, s, t) of ``docs``: the id, what tells different texts of one id apart, and the text.  ``s`` is 0, or, where
    any id repeats, 63 bits of the text's hash: no row has to meet the others of its id, of which there may be many."""
    twice = not docs.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    sub = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1) if twice else F.lit(0).cast("long")
    return [F.col(key).cast("long").alias("k"), sub.alias("s"), F.col(text).alias("t")]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, sub, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of ``docs``.

    Texts are taken as UTF-8; a null text is empty.  Rows that repeat id and text are one document and are all cut alike;
    different texts under one id are ordered by their hash, and a null id comes before all others.  Other columns are not
    looked at; an empty table gives none.  ``kept`` drops bytes that no longer form a character.
    """
    return _removed(docs.select(*_named(docs, key, text)), length, with_text, hot, buckets_for(docs))


def _removed(texts: DataFrame, length: int, with_text: bool, hot: int, buckets: int) -> DataFrame:
    homes = buckets
    seen = texts.mapInArrow(_occurrences(length, buckets, homes), _ROWS).repartition("dest")
    told = materialise(seen.mapInArrow(_compare_digests(length, homes, hot), _ROWS))
    packed = texts.mapInArrow(_pack_texts(homes), _ROWS)
    contexts = packed.union(told.where(F.col("kind") == _ASKED)).repartition("dest").mapInArrow(_fetch(length, buckets), _ROWS)
    more = materialise(contexts.repartition("dest").mapInArrow(_expand(length, homes), _ROWS))
    spans = told.where(F.col("kind") == _SPANS).union(more)
    schema = "doc_id long, sub long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return packed.union(spans).repartition("dest").mapInArrow(_finish(length, with_text), schema)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``docs`` with each text reduced to the bytes that are not removed; null texts stay null, rows without anything left
    stay with an empty text, and all other columns keep names, order and values."""
    k, s, t = _named(docs, key, text)
    texts = docs.select(k, s, t)
    kept = _removed(texts, length, True, HOT, buckets_for(docs)).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.col("sub").alias("s"), "kept").dropDuplicates(["k", "s"])
    others = F.struct(*[F.col(_quoted(c)) for c in docs.columns if c != text])  # as one, so that no name of theirs meets ours
    rest = docs.select(others.alias("row"), F.coalesce(k, F.lit(NULL_ID)).alias("k"), s, F.col(text).isNull().alias("none"))
    out = rest.join(kept, ["k", "s"], "left")
    return out.select(*[(F.when(~F.col("none"), F.col("kept")) if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("sub")
