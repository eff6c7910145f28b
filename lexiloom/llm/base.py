"""What the operators share: text as byte buffers, vectorised word hashes, packed exchanges, shared-folder tables.

Documents are identified by ``doc_id``.  A null ``doc_id`` sorts before all others (it is carried as the smallest
long).  Rows that repeat both ``doc_id`` and ``text`` are one document and all of them get its result.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
U64 = np.uint64


# ---------------------------------------------------------------- Spark side
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a temporary one in local mode, and an error
    elsewhere: executors of a cluster would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexiloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


_made: list = []


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` returned, once nothing that is still to be computed reads them."""
    forget([p for p in (getattr(t, "_lexiloom_path", None) for t in tables) if p])


def forget(df_paths: list | None = None) -> None:
    """Deletes tables that ``materialise`` wrote (all of them, or those at the given paths)."""
    for spark, path in [x for x in _made if df_paths is None or x[1] in df_paths]:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone
            pass
    _made[:] = [] if df_paths is None else [x for x in _made if x[1] not in df_paths]


atexit.register(forget)


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df`` (file sizes for a scan); it runs no job."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        return 1 << 30


def buckets_for(df: DataFrame, per: int = 2 << 20, least: int = 64) -> int:
    """Hash buckets for packed exchanges: a power of two that grows with the input, so that a bucket stays small."""
    n = least
    while n * per < size_of(df) and n < 1 << 16:
        n *= 2
    return n


def remainder(col, n: int):
    """crc32 of the id as text, modulo n (null ids: the remainder of the empty string)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, target: int, *on: str) -> DataFrame:
    """Exactly ``target`` rows of ``df`` (all rows, if there are fewer): those of the smallest hash of the columns ``on`` (all
    columns, if none are named).  The hash is of the row, not of an id, so that rows which share an id, or have none, are drawn
    one by one; only where rows are equal in all those columns does it not matter which are taken.  The driver gets
    ``target`` hashes; the choice does not depend on the order of rows or files."""
    h = F.xxhash64(F.lit(17), *[F.col(c) for c in on or df.columns])
    total = df.count()
    if total <= target:
        return df
    hashed, share, least = df.select(h.alias("h")), 4 * target / total, []
    if share < 1:  # few hashes leave a task
        least = [r[0] for r in hashed.where(F.col("h") < int(share * 2**64) - 2**63).orderBy("h").limit(target + 1).collect()]
    if len(least) <= target:  # a small table, or one of many equal rows
        some = hashed.groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(target + 1).collect()
        least = [r["h"] for r in some for _ in range(min(r["n"], target + 1))][: target + 1]
    cut = least[target - 1]
    if least[target] > cut:
        return df.where(h <= cut)
    return df.where(h < cut).unionByName(df.where(h == cut).limit(sum(x == cut for x in least[:target])))


# ---------------------------------------------------------------- Arrow side
def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    kind = col.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        col = col.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    else:
        col = col.cast(pa.large_binary()).fill_null(b"")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs


def longs(col) -> np.ndarray:
    """A long column as numpy; nulls become ``NULL_ID``."""
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The integers of start..start+len for each pair, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lens > 0
    s, n = starts[keep].astype(np.int64), lens[keep].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[0] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """Distinct values of a sorted array."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return s, np.diff(np.concatenate([s, [len(x)]]))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


# ---------------------------------------------------------------- words
_R = 0x9E3779B97F4A7C15 | 1
_pow = [np.ones(1, U64), np.ones(1, U64)]
#: The bytes that part words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
#: For terms made of letters, digits and bytes of other scripts only.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), U64(r))
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow[0], _pow[1]


def _table(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
    return t[LOWER] if fold else t


class Words:
    """Words of many texts at once, as 64-bit hashes: prefix sums of a polynomial over random byte values, mixed.

    ``fold`` lower-cases A-Z.  Calling it yields pieces of at most about ``limit`` bytes: (doc index, hash, start, end,
    prefix function) arrays, in order; long texts are cut at a separator, so that memory is bounded by ``limit`` and
    the longest word.
    """

    def __init__(self, separators: np.ndarray = SPACE, fold: bool = True, limit: int = 1 << 20):
        self.sep, self.table, self.limit = separators, _table(fold), limit

    def __call__(self, data: np.ndarray, offs: np.ndarray):
        at, doc, last = int(offs[0]), 0, int(offs[-1])
        while at < last:
            end = min(at + self.limit, last)
            if end < last:
                cut = int(np.searchsorted(offs, end, "right")) - 1
                if offs[cut] > at:
                    end = int(offs[cut])
                else:  # inside one long text
                    stop, width = int(offs[np.searchsorted(offs, at, "right")]), self.limit
                    end = min(at + width, stop)
                    while end < stop:
                        seps = np.flatnonzero(self.sep[data[at:end]])
                        if len(seps):
                            end = at + int(seps[-1]) + 1
                            break
                        width *= 2
                        end = min(at + width, stop)
            yield self._piece(data, offs, at, end)
            at = end

    def _piece(self, data, offs, at, end):
        b = data[at:end]
        n = len(b)
        word = ~self.sep[b]
        first = word.copy()
        first[1:] &= ~word[:-1]
        lo, hi = np.searchsorted(offs, at, "left"), np.searchsorted(offs, end, "left")
        inner = offs[lo:hi] - at  # where texts begin
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] |= word[inner]
        starts = np.flatnonzero(first)
        final = word.copy()
        final[:-1] &= ~word[1:]
        if len(inner):
            final[inner - 1] |= word[inner - 1]
        ends = np.flatnonzero(final) + 1
        p, q = _powers(n + 1)
        cum = np.zeros(n + 1, U64)
        np.cumsum(self.table[b] * p[:n], out=cum[1:])

        def hashed(s, e):
            h = (cum[e] - cum[s]) * q[s]
            h += (e - s).astype(U64) * U64(0xA0761D6478BD642F)
            return mix(h)

        doc = np.searchsorted(offs, starts + at, "right") - 1
        # empty texts share an offset: searchsorted(right) gives the last, which is the one that holds bytes
        return doc, hashed(starts, ends), starts + at, ends + at, lambda k: hashed(starts, np.minimum(starts + k, ends))


# ---------------------------------------------------------------- packed rows
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string: a header of dtype codes and lengths, then the values."""
    head = np.array([len(arrays), *(x for a in arrays for x in (_CODES[a.dtype.str], len(a)))], np.int32)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


_CODES = {np.dtype(t).str: i for i, t in enumerate((np.uint8, np.uint16, np.uint32, np.uint64, np.int32, np.int64, np.float32, np.float64))}
_TYPES = [np.dtype(s) for s in _CODES]


def unpack(buf) -> list[np.ndarray]:
    n = int(np.frombuffer(buf, np.int32, 1)[0])
    head = np.frombuffer(buf, np.int32, 2 * n, 4)
    at, out = 4 + 8 * n, []
    for code, size in head.reshape(-1, 2):
        t = _TYPES[code]
        out.append(np.frombuffer(buf, t, size, at))
        at += t.itemsize * int(size)
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_sorted(x: np.ndarray) -> np.ndarray:
    """Sorted unsigned values as differences, the first against zero, in a narrow type."""
    return narrow(np.diff(x, prepend=x.dtype.type(0))) if len(x) else x.astype(np.uint8)


def unpack_sorted(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=U64)


def rows_of(batches):
    """All rows of a partition of Arrow batches as lists of Python values, binary columns as buffers."""
    for b in batches:
        cols = [([v.as_buffer() for v in c] if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_pylist()) for c in b.columns]
        yield from zip(*cols)


def block_id(nth: int) -> int:
    """A number for the nth batch of this task: the same when the task runs again over the same split."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ((ctx.partitionId() if ctx else 0) << 24) | nth
