"""Mixing sources to target weights by Pfair scheduling.

The documents of each source are cut into blocks of equal size.  A source of weight w (its share of the active weights)
releases its j-th block (from 0) at slot floor(j / w) and must have placed it before slot ceil((j + 1) / w); slots are
given earliest deadline first among released blocks.  At any slot each source then has its share of the slots so far,
give or take less than one block.  Weights are exact fractions, so the schedule repeats after their common denominator: a
table of that many slots, or of the phase where that is shorter, made on the driver for each set of sources that are still
active, places block j of a source in closed form, and the documents are numbered and placed without any sequential pass.
When a source runs out the phase ends, and the next one shares its weight among those left, so that every document is
placed exactly once.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import NULL_ID, materialise, size_of

BLOCK = 16
MOST_SLOTS = 1 << 22
BROADCAST_SLOTS = 1 << 16  # a longer slot table is joined by exchange


def fraction(w: float) -> Fraction:
    """The simple fraction that the number stands for (0.75 / 19 is 3/76), its binary value where there is none."""
    near = Fraction(w).limit_denominator(1 << 20)
    return near if float(near) == float(w) else Fraction(w)


def exact_quotas(weights: Mapping[str, float]) -> dict[str, int]:
    """Slots of each source in the shortest period in which every weight is a whole number of slots."""
    live = {s: fraction(w) for s, w in weights.items() if w > 0}
    total = sum(live.values())
    share = {s: w / total for s, w in live.items()}
    period = lcm(*[x.denominator for x in share.values()]) if share else 0
    return {s: int(x * period) for s, x in share.items()}


def one_period(quota: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot: released blocks, earliest deadline first (ties to the longer block queue, then by name)."""
    period = sum(quota.values())
    coming = [(0, s, 0) for s in sorted(quota)]  # release, source, block
    heapq.heapify(coming)
    ready: list = []
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            _, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * period // quota[s]), -quota[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        if j + 1 < quota[s]:
            heapq.heappush(coming, ((j + 1) * period // quota[s], s, j + 1))
        yield s


def phases(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple]:
    """(first slot, {source: first block}, slots of the period, length in slots) of each phase.  A phase repeats its period
    while all its sources can fill it, then runs into a last one up to the slot whose source has nothing left; of a period
    longer than the phase only the phase is made."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    at, out = 0, []
    while left:
        share = {s: weights.get(s, 0) for s in left}
        if not any(w > 0 for w in share.values()):
            share = dict.fromkeys(left, 1.0)  # sources without a target come last, in equal parts
        share = {s: w for s, w in share.items() if w > 0}
        quota = exact_quotas(share)
        slots = list(_within(one_period(quota), left))
        whole = min(left[s] // n for s, n in quota.items()) if len(slots) == sum(quota.values()) else 0
        used = {s: whole * n for s, n in quota.items()}
        length = whole * len(slots)
        for s in slots:
            if used[s] == left[s]:
                break
            used[s] += 1
            length += 1
        out.append((at, {s: done[s] for s in quota}, slots, length))
        at += length
        for s in used:
            done[s] += used[s]
            left[s] -= used[s]
        left = {s: n for s, n in left.items() if n > 0}
    return out


def _within(slots: Iterator[str], left: Mapping[str, int]) -> Iterator[str]:
    """The slots before the first whose source has nothing left."""
    used: Counter = Counter()
    for s in slots:
        if used[s] == left[s]:
            return
        used[s] += 1
        yield s


def block_size(documents: Mapping[str, int], weights: Mapping[str, float], block: int = BLOCK) -> int:
    """``block``, doubled while neither the period of the weights nor the mix itself fits a table of ``MOST_SLOTS``."""
    period = sum(exact_quotas({s: w for s, w in weights.items() if s in documents}).values())
    while min(period, sum(-(-n // block) for n in documents.values())) > MOST_SLOTS:
        block *= 2
    return block


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``mix_block`` (number of the document's block within its source), ``mix_slot`` (the block's place in
    the mix, from 0) and ``mix_place`` (the document's place within its block); columns of these names that ``docs`` has
    are replaced.

    ``weights`` are target shares by source; without them all sources count alike.  A null source is a source of its own
    (named by a null key in ``weights``).  Documents of a source come in the order of a hash of id, ties by id, then by
    the hash of all columns, so that repeated rows are placed one after the other; texts are not looked at but for that.
    An empty table gives none.

    The driver holds one number per source and the slots of one period per phase, or of the phase where that is shorter.  The
    size of the input does not matter to that: only where the weights have no common denominator up to ``MOST_SLOTS``, and
    the mix has more blocks than that, is ``block`` doubled until it has not.  Numbers within a source come from counts per
    hash range, never from one task per source.
    """
    cols = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_place")]
    target = {("\x00null" if k is None else k): v for k, v in weights.items()} if weights is not None else None
    ranges_n = 64  # hash ranges of a source: they grow with the input, so that a range fits a task
    while ranges_n * (4 << 20) < size_of(docs):
        ranges_n *= 2
    told = [F.col(_quoted(c)) for c in cols if "map<" not in docs.schema[c].dataType.simpleString()]
    h = F.xxhash64(F.lit(5), F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)))
    # the columns of ``docs`` go along as one, so that no name of theirs meets a name of ours
    marked = docs.select(F.struct(*[F.col(_quoted(c)) for c in cols]).alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("\x00null")).alias("s"), h.alias("h"), F.xxhash64(*told).alias("t"), F.col(key).alias("id"))
    marked = marked.withColumn("r", F.pmod(F.shiftrightunsigned("h", 20), F.lit(ranges_n)).cast("int"))
    counts = materialise(marked.groupBy("s", "r").agg(F.count("*").alias("n")))
    before = counts.select("s", "r", "n", (F.sum("n").over(Window.partitionBy("s").orderBy("r")) - F.col("n")).alias("before"))  # one row a range
    totals = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row a source
    if target is None:
        target = dict.fromkeys(totals, 1.0)
    block = block_size(totals, target, block)
    plan = phases({s: -(-n // block) for s, n in totals.items()}, target)
    names: list = []
    numbers: list = [[] for _ in range(5)]
    spans = []
    for first_slot, first_block, slots, length in plan:
        quota = Counter(slots)
        whole, rest = divmod(length, len(slots))
        last = Counter(slots[:rest])
        spans += [(s, n, first_block[s], first_block[s] + whole * n + last[s]) for s, n in quota.items()]
        nth: Counter = Counter()
        names += slots
        for i, s in enumerate(slots):
            for column, v in zip(numbers, (quota[s], nth[s], first_block[s], first_slot + i, len(slots))):
                column.append(v)
            nth[s] += 1
    spark = docs.sparkSession
    sent = lambda df, n: F.broadcast(df) if n <= BROADCAST_SLOTS else df
    table = sent(spark.createDataFrame(pa.table([pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in numbers]], names=["s", "q", "k", "first", "slot", "len"])), len(names))
    # a span is a source in a phase; each range of a source is given the spans that its blocks touch, so that documents meet
    # their spans where they are numbered, by source and range
    spans = spark.createDataFrame(pa.table([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(zip(*spans) if spans else [()] * 4)], names=["s", "q", "first", "end"]))
    touched = (F.col("end") * block > F.col("before")) & (F.col("first") * block < F.col("before") + F.col("n"))
    before = before.join(spans, "s").where(touched).drop("n")  # sources, ranges and phases: no documents
    order = Window.partitionBy("s", "r").orderBy("h", "id", "t")
    placed = marked.withColumn("i", F.row_number().over(order) - 1).join(before, ["s", "r"]).withColumn("i", F.col("i") + F.col("before"))
    placed = placed.withColumn("b", F.floor(F.col("i") / block).cast("long")).withColumn("place", (F.col("i") % block).cast("int"))
    placed = placed.where("b >= first and b < end").withColumn("k", F.pmod(F.col("b") - F.col("first"), F.col("q")))
    placed = placed.join(table, ["s", "q", "first", "k"])
    slot = (F.col("slot") + F.floor((F.col("b") - F.col("first")) / F.col("q")) * F.col("len")).cast("long")
    return placed.select("row.*", F.col("b").alias("mix_block"), slot.alias("mix_slot"), F.col("place").alias("mix_place"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op5(spark, sf_dir: str) -> DataFrame:
    """Production parameters: web crawl ``src0`` at a quarter of the mix, every other source at an equal part of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    names = [r[0] for r in docs.select("source").distinct().collect()]  # one row a source
    return mix_sources(docs, targets(names))


def targets(names: list) -> dict:
    rest = [s for s in names if s != "src0"]
    return {s: 0.25 if s == "src0" else 0.75 / max(1, len(rest)) for s in names}
