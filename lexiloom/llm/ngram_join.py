"""N-gram Jaccard join as a blocked sparse matrix product.

The documents by n-grams incidence matrix is held as 48-bit hashes.  Three bounds keep the product small and lose no
pair whose Jaccard similarity reaches ``percent``:

1. a column with one document adds nothing to any overlap, so columns are counted first (hash-partitioned exchange of
   packed entries) and only shared columns go on;
2. a document needs at least ceil(percent * size) shared columns, whatever its partner, else it has none;
3. of its shared columns, rarest first, any partner must hold one of the first few (those that may be missing, plus
   one): documents that meet on such a column are put in one cluster (connected components).

Within a cluster the product is computed in blocks: heavy columns as a dense matrix product of row blocks, light ones
by accumulating their pairs; pairs beyond the size ratio or below the required overlap are discarded.  Documents with
equal n-gram sets are one row of the matrix.  Clusters over ``BLOCK`` rows are dealt to several blocks which share
pivot rows; pairs across blocks that are still in different components afterwards, and whose columns from the first
shared one on could be enough, are then compared one by one, so that no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NULL_ID, SPACE, U64, Words, block_id, buckets_for, distinct_sorted, drop, longs, materialise, mix, pack, pack_sorted, rows_of, runs, text_bytes, unpack, unpack_sorted
from .components import components

BLOCK, PIVOTS, HEAVY = 1024, 64, 24


def shingle_keys(data: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct (48-bit shingle hash << 16 | doc index) of at most 65,536 texts; a text of fewer than ``size``
    words has its whole sequence as its one shingle."""
    words = Words(SPACE, fold=True, limit=1 << 18)
    coef = mix(np.arange(1, size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    low, n = U64(0xFFFF), len(offs) - 1
    got = []
    counts, whole = np.zeros(n, np.int64), np.zeros(n, U64)
    tail_doc, tail = np.zeros(0, np.int64), np.zeros(0, U64)
    for doc, h, _, _, _ in words(data, offs):
        if not len(doc):
            continue
        s, length = runs(doc)
        pos = np.arange(len(doc)) - np.repeat(s, length) + counts[doc]
        m = pos < size
        np.add.at(whole, doc[m], h[m] * coef[pos[m]])
        counts[doc[s]] += length
        doc, h = np.concatenate([tail_doc, doc]), np.concatenate([tail, h])
        k = len(h) - size + 1
        if k > 0:
            x = h[:k] * coef[0]
            for j in range(1, size):
                x += h[j : k + j] * coef[j]
            x = (mix(x) & ~low) | doc[:k].astype(U64)
            x = x[doc[:k] == doc[size - 1 :]]
            x.sort()
            got.append(distinct_sorted(x))
        tail_doc, tail = doc[-(size - 1) :] if size > 1 else doc[:0], h[-(size - 1) :] if size > 1 else h[:0]
    short = np.flatnonzero((counts > 0) & (counts < size))
    got.append((mix(whole[short] + counts[short].astype(U64)) & ~low) | short.astype(U64))
    x = np.concatenate(got)
    x.sort()
    return distinct_sorted(x)


_EXCHANGE = "bucket int, block long, kind int, load binary"


def _batch(rows: list) -> pa.RecordBatch:
    b, k, t, p = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int64()), pa.array(t, pa.int32()), pa.array(p, pa.binary())], ["bucket", "block", "kind", "load"])


def _incidence(size: int, buckets: int):
    """Texts -> per hash bucket the packed (hash, doc) entries of a block, and the block's document table."""

    def run(batches):
        nth = 0
        shift = U64(64 - (buckets.bit_length() - 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                b = batch.slice(at, 1 << 12)
                block = block_id(nth)
                nth += 1
                data, offs = text_bytes(b.column(1))
                n = len(offs) - 1
                key = shingle_keys(data, offs, size)
                doc, h = (key & U64(0xFFFF)).astype(np.uint16), key >> U64(16)
                order = np.argsort(doc, kind="stable")
                s, length = runs(doc[order])
                full = mix(h[order] + U64(1))
                d1, d2, count = np.zeros(n, U64), np.zeros(n, U64), np.zeros(n, np.int64)
                if len(s):
                    at_doc = doc[order][s]
                    d1[at_doc], d2[at_doc], count[at_doc] = np.add.reduceat(full, s), np.bitwise_xor.reduceat(mix(full), s), length
                cls = mix(d1 ^ mix(d2 + count.astype(U64))).view(np.int64)
                rows = [(block % buckets, block, 0, pack(longs(b.column(0)), count, cls))]
                cut = np.searchsorted(key >> shift, np.arange(buckets + 1, dtype=U64)) if buckets > 1 else np.array([0, len(key)])
                for i in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[i], cut[i + 1])
                    rows.append((int(i), block, 1, pack(pack_sorted(h[part]), doc[part])))
                yield _batch(rows)

    return run


def rarity(count: np.ndarray) -> np.ndarray:
    """Numbers of documents as bytes in the same order: as they are up to 64, then eight steps for each doubling."""
    return np.where(count <= 64, count, np.minimum(64 + np.log2(np.maximum(count, 64) / 64) * 8, 255)).astype(np.uint8)


def _shared_columns(batches):
    """One partition of buckets -> for each block the entries whose hash has two documents or more, with their rarity."""
    by: dict = {}
    for bucket, block, kind, load in rows_of(batches):
        if kind == 0:
            yield _batch([(bucket, block, 0, load.to_pybytes())])
        else:
            by.setdefault(bucket, []).append((block, load))
    for bucket, loads in by.items():
        parts = [unpack(x) for _, x in loads]
        hs = [unpack_sorted(d) for d, _ in parts]
        size = np.array([len(x) for x in hs])
        h = np.concatenate(hs)
        order = np.argsort(h, kind="stable")
        s, length = runs(h[order])
        df = np.empty(len(h), np.uint8)
        df[order] = np.repeat(rarity(length), length)
        out, at = [], 0
        for (block, _), (_, doc), x, n in zip(loads, parts, hs, size):
            m = df[at : at + n] > 1
            if m.any():
                out.append((bucket, block, 1, pack(pack_sorted(x[m]), doc[m], df[at : at + n][m])))
            at += n
        if out:
            yield _batch(out)


def _documents(percent: int):
    """One partition of blocks -> a row for each document; for those that may have a partner, and are the first of their
    class here, the shared columns and the first of them, rarest first, that any partner must meet."""

    def run(batches):
        tables, entries, seen = {}, {}, set()
        for _, block, kind, load in rows_of(batches):
            (tables.__setitem__(block, unpack(load)) if kind == 0 else entries.setdefault(block, []).append(unpack(load)))
        for block, (ids, count, cls) in tables.items():
            n = len(ids)
            got = entries.pop(block, [])
            h = np.concatenate([unpack_sorted(x[0]) for x in got]) if got else np.zeros(0, U64)
            doc = np.concatenate([x[1] for x in got]) if got else np.zeros(0, np.uint16)
            df = np.concatenate([x[2] for x in got]) if got else np.zeros(0, np.uint8)
            order = np.argsort(doc, kind="stable")
            h, doc, df = h[order], doc[order], df[order]
            s, length = runs(doc)
            need = -(-percent * count // 100)
            have = np.zeros(n, np.int64)
            start = np.zeros(n, np.int64)
            have[doc[s]], start[doc[s]] = length, s
            live = np.flatnonzero((count > 0) & (have >= need))
            columns, first = [None] * n, [None] * n
            for d in live:
                if int(cls[d]) in seen:
                    continue
                seen.add(int(cls[d]))
                x, f = h[start[d] : start[d] + have[d]], df[start[d] : start[d] + have[d]]
                rare = (f.astype(U64) << U64(48)) | x
                k = int(have[d] - need[d] + 1)
                rare = np.sort(np.partition(rare, k - 1)[:k] if k < len(rare) else rare)  # one order for all documents
                columns[d] = x.tobytes()
                first[d] = (rare & U64((1 << 48) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((block << 16) + np.arange(n)), pa.array(ids), pa.array(count), pa.array(cls), pa.array(columns, pa.binary()), pa.array(first, pa.list_(pa.int64()))],
                ["row", "id", "n", "cls", "columns", "first"],
            )

    return run


def _links(n: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The link matrix of one block of documents, from accumulated overlaps."""
    m = len(n)
    size = np.array([len(x) for x in sets])
    h, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    s, length = runs(h)
    overlap = np.zeros((m, m), np.float32)
    heavy = length > HEAVY
    light = np.repeat(~heavy & (length > 1), length)
    lr, lh = row[light], h[light]
    pairs = []
    for d in range(1, HEAVY):
        if d >= len(lr):
            break
        same = lh[d:] == lh[:-d]
        if not same.any():
            break
        a, b = lr[:-d][same], lr[d:][same]
        pairs.append(np.minimum(a, b) * m + np.maximum(a, b))
    if pairs:
        at = np.concatenate(pairs)
        at.sort()
        s2, n2 = runs(at)
        overlap.ravel()[at[s2]] = n2
    if heavy.any():
        cols = np.repeat(np.arange(int(heavy.sum())), length[heavy])
        rows = row[np.repeat(heavy, length)]
        width = int(heavy.sum())
        for c in range(0, width, 2048):
            w = min(2048, width - c)
            x = np.zeros((m, w), np.float32)
            k = (cols >= c) & (cols < c + w)
            x[rows[k], cols[k] - c] = 1
            for i in range(0, m, 256):
                overlap[i : i + 256, i:] += x[i : i + 256] @ x[i:].T
    linked = np.zeros((m, m), bool)
    for i in range(0, m, 256):
        o = overlap[i : i + 256].astype(np.float64)
        lo, hi = np.minimum(n[i : i + 256, None], n[None]), np.maximum(n[i : i + 256, None], n[None])
        linked[i : i + 256] = (o > 0) & (lo * 100 >= percent * hi) & (100 * o >= percent * (lo + hi - o))
    linked &= np.tri(m, k=-1, dtype=bool).T
    return linked | linked.T


def _roots(linked: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a symmetric boolean matrix."""
    m = len(linked)
    label = np.full(m, -1)
    for i in range(m):
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                reach = linked[front].any(0) & (label < 0)
                front = np.flatnonzero(reach)
                label[front] = i
    return label


def _meetings(batches):
    """Rows (cls, first) -> within each batch, documents that meet on a column are contracted to one of them before anything
    is shuffled: (cls, rep, null) for those that were, and each column of a contracted set once, as (null, rep, h)."""
    for b in batches:
        cls = b.column(0).to_numpy(zero_copy_only=False)
        first = b.column(1)
        h = first.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(cls)), pa.compute.list_value_length(first).to_numpy(zero_copy_only=False))
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        s, length = runs(h)
        home = np.argsort(cls, kind="stable")  # a contracted set is named by its smallest class: place in order -> document
        label = np.empty(len(cls), np.int64)
        label[home] = np.arange(len(cls))
        name = cls[home]
        while len(s):
            low = np.repeat(np.minimum.reduceat(label[doc], s), length)
            new = label.copy()
            np.minimum.at(new, doc, low)
            new = np.minimum(new, new[home[new]])
            if (new == label).all():
                break
            label = new
        rep = name[label] if len(cls) else cls
        moved = rep != cls
        pair = np.lexsort((label[doc], h))
        ph, pl = h[pair], label[doc][pair]
        keep = np.ones(len(ph), bool)
        keep[1:] = (ph[1:] != ph[:-1]) | (pl[1:] != pl[:-1])
        none = pa.nulls(int(keep.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(cls[moved]), none]), pa.array(np.concatenate([rep[moved], name[pl[keep]]])), pa.concat_arrays([pa.nulls(int(moved.sum()), pa.int64()), pa.array(ph[keep])])],
            ["cls", "rep", "h"],
        )


def _block_product(percent: int):
    """A group of (cluster, block) rows -> (cls, root cls) links that span each block's components."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["cluster"].to_pylist(), table["part"].to_pylist(), table["cls"].to_pylist(), table["n"].to_pylist(), table["columns"].to_pylist()), key=lambda r: r[:3])
        a, b, i = [], [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][:2] == rows[i][:2]:
                j += 1
            if j - i > 1:
                part = rows[i:j]
                label = _roots(_links(np.array([r[3] for r in part]), [np.frombuffer(r[4], U64) for r in part], percent))
                for k, r in enumerate(label):
                    if r != k:
                        a.append(part[k][2])
                        b.append(part[r][2])
            i = j
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verify(percent: int):
    def run(batches):
        for t in batches:
            keep = []
            for i, (na, nb, ca, cb) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4), t.column(5))):
                x = np.concatenate([np.frombuffer(ca.as_buffer(), U64), np.frombuffer(cb.as_buffer(), U64)])
                x.sort()
                o = int((x[1:] == x[:-1]).sum())
                if 100 * o >= percent * (na + nb - o):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(keep, pa.int64())), t.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their distinct ``size``-word shingles;
    component_id is the smallest doc_id reachable by links.  Null texts and texts without words have an empty set and
    link with nothing, not even each other.  Rows that repeat an id are documents of their own; a null id is smaller than
    all others.  Other columns are not looked at, and an empty table gives none.
    """
    buckets = buckets_for(docs)
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    entries = texts.mapInArrow(_incidence(size, buckets), _EXCHANGE).repartition("bucket").mapInArrow(_shared_columns, _EXCHANGE)
    table = materialise(entries.repartition("block").mapInArrow(_documents(percent), "row long, id long, n long, cls long, columns binary, first array<long>"))
    # documents with equal sets are one row of the matrix: one of those that carry it is chosen by number, and only it is sent on
    live = table.where("columns is not null")
    classes = table.where("n > 0").groupBy("cls").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    chosen = live.groupBy("cls").agg(F.min("row").alias("row")).select("row")
    rows = materialise(live.join(chosen, "row", "left_semi").select("cls", "n", "columns", "first"))
    met = materialise(rows.select("cls", "first").mapInArrow(_meetings, "cls long, rep long, h long"))
    on = met.where("h is not null").select("h", "rep")
    low = on.groupBy("h").agg(F.min("rep").alias("m"), F.count("*").alias("c")).where("c > 1").select("h", "m")
    meet = on.join(low, "h").where("rep <> m").select(F.col("rep").alias("a"), F.col("m").alias("b"))
    clusters = components(meet.union(met.where("cls is not null").select("cls", "rep")))
    sizes = clusters.groupBy("root").count()
    big = sizes.where(F.col("count") > block)
    parts = clusters.join(sizes, "root").select(F.col("v").alias("cls"), F.col("root").alias("cluster"), F.ceil(F.col("count") / block).cast("int").alias("parts"))
    member = rows.drop("first").join(parts, "cls").withColumn("h", F.xxhash64("cls"))
    dealt = member.withColumn("part", F.pmod("h", F.col("parts").cast("long")))
    pivots = member.where("parts > 1").where(F.pmod(F.shiftright("h", 20), F.ceil(F.col("parts") * block / PIVOTS).cast("long")) == 0)
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).where("part <> pmod(h, cast(parts as bigint))")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    dealt = dealt.unionByName(pivots).select("cluster", F.col("part").cast("long").alias("part"), "cls", "n", "columns", F.pmod(F.xxhash64("cluster", "part"), F.lit(groups)).alias("g"))
    links = materialise(dealt.groupBy("g").applyInArrow(_block_product(percent), "a long, b long"))
    roots = components(links)
    if not big.isEmpty():
        # pairs across blocks, in clusters of several blocks, whose ends are not yet in one component
        wide = rows.join(parts.where("parts > 1").select("cls"), "cls").select("cls", "n", (F.octet_length("columns") / 8).cast("long").alias("have"), F.posexplode("first").alias("at", "h"))
        # of the first column that two documents share, what follows it in each bounds their overlap
        wide = wide.select("cls", "n", "h", (F.col("have") - F.col("at")).alias("after"))
        wide = materialise(wide.join(roots.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
        left = wide.select("h", F.col("cls").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("after").alias("fa"))
        right = wide.select("h", F.col("cls").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("after").alias("fb"))
        enough = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * least(fa, fb) >= {percent} * (na + nb)"
        pairs = left.join(right, "h").where(f"a < b and ra <> rb and {enough}").select("a", "b", "na", "nb").distinct()
        cols = rows.select(F.col("cls"), F.col("columns"))
        pairs = pairs.join(cols.toDF("a", "ca"), "a").join(cols.toDF("b", "cb"), "b").select("a", "b", "na", "nb", "ca", "cb")
        more = materialise(links.union(pairs.mapInArrow(_verify(percent), "a long, b long")))
        drop(wide, links, roots)
        links = more
        roots = components(links)
    drop(rows, met, clusters, links)  # the roots are written, and the table of documents stays
    label = classes.join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = label.groupBy("root").agg(F.min("low").alias("low"))
    label = label.join(lowest.withColumnRenamed("low", "component"), "root").where("component <> low or copies > 1").select("cls", "component")
    none = lambda c: F.when(F.col(c) != F.lit(-9223372036854775808), F.col(c))
    out = table.select("id", "n", "cls").join(label, "cls", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    return out.select(none("id").alias("doc_id"), F.col("n").alias("n_shingles"), none("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id (a null id is smallest; of different texts
    under one id the one of the smallest hash).  Texts without words all stay, repeated or not; columns keep names, order
    and values."""
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        found = jaccard_components(docs, key, text, size, percent)
        keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"))
        mine = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"))
        return mine.join(materialise(keep), "id", "left_semi").select("row.*")
    # an id does not tell rows apart: they are numbered, and the number stands for the row
    rows = materialise(docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("t")).withColumn("nth", F.monotonically_increasing_id()))
    found = materialise(jaccard_components(rows, "nth", "t", size, percent))
    order = F.struct(F.coalesce("id", F.lit(NULL_ID)), F.xxhash64("t"), "nth")
    named = rows.select("nth", order.alias("o")).join(found.withColumnRenamed("doc_id", "nth"), "nth")
    keep = named.where("n_shingles > 0").groupBy("component_id").agg(F.min("o")["nth"].alias("nth")).select("nth").union(found.where("n_shingles = 0").select("doc_id"))
    return rows.join(materialise(keep), "nth", "left_semi").select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
