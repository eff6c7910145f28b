"""Experiment design: rosters, matching, rounds, schedules, held-out pools, balanced assignment."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import numbered

# Fixed value: the stories in their order.
STORIES = ["A1", "A2", "A3", "B1", "B2", "B3"]


def story_rank(col: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STORIES]), F.col(col) if isinstance(col, str) else col)


def prompt_rounds(roster: DataFrame, per_round: int, order: list[str]) -> DataFrame:
    """``round_index`` from 1 in blocks of ``per_round`` rows in order, and how many pairs prompt and evaluate in it (the last
    round may be short)."""
    w = Window.orderBy(*order)  # a roster: one row a pair of children
    r = roster.withColumn("pair_order", F.row_number().over(w)).withColumn("round_index", (F.floor((F.col("pair_order") - 1) / per_round) + 1).cast("int"))
    n = F.count(F.lit(1)).over(Window.partitionBy("round_index"))
    return r.withColumn("prompt_pair_count", n).withColumn("eval_pair_count", F.count(F.lit(1)).over(Window.partitionBy()) - n)


def story_schedule(roster: DataFrame, rules: DataFrame, replicates: int) -> DataFrame:
    """Pair x replicate x story with the counterbalance variant (replicate + pair order, modulo the variants of the story).
    ``roster`` has pair_order; ``rules`` has target_story, variant_index from 0, e1_story, e2_story."""
    spark = roster.sparkSession
    total = rules.groupBy("target_story").agg(F.count("*").alias("variant_total"))
    reps = spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate_id"))
    # replicates, stories and rules are a handful of rows each
    s = roster.crossJoin(F.broadcast(reps)).crossJoin(F.broadcast(total))
    s = s.withColumn("variant_index", F.pmod(F.col("replicate_id") - 1 + F.col("pair_order") - 1, F.col("variant_total")).cast("int"))
    return s.join(F.broadcast(rules), ["target_story", "variant_index"]).withColumn("story_slot_order", story_rank("target_story").cast("int"))


def eval_manifest(rounds: DataFrame, pair: str = "pair_id", groups: dict[str, str] | None = None) -> DataFrame:
    """Round x pair of every other round: who may be evaluated in it, one row for each group's child."""
    groups = groups or {"TD": "td_child_id", "SLI": "sli_child_id"}
    index = rounds.select("round_index").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(c).cast("string").alias("child")) for g, c in groups.items()]))
    pool = rounds.select(F.col("round_index").alias("own_round"), F.col(pair).alias("eval_pair_id"), each.alias("e")).select("own_round", "eval_pair_id", F.col("e.grp").alias("eval_group"), F.col("e.child").alias("eval_child_id"))
    # rounds are numbered in one task; the list, which grows with their square, is made in all, and a count keeps it so
    pool = pool.repartition(4 * rounds.sparkSession.sparkContext.defaultParallelism)
    m = pool.crossJoin(F.broadcast(index)).where("round_index <> own_round")  # one row a round
    return m.select("round_index", "eval_pair_id", "eval_group", "eval_child_id")


def held_out(real: DataFrame, prompts: DataFrame, rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Real rows of each round without those it was prompted with."""
    return real.crossJoin(F.broadcast(rounds.select("round_index").distinct())).join(prompts.select("round_index", *keys), ["round_index", *keys], "left_anti")  # one row a round


def bundle_index(schedule: DataFrame, key: list[str]) -> DataFrame:
    """One row per bundle with its stories in slot order; raises unless they are the six stories in order."""
    cells = F.array_sort(F.collect_list(F.struct("story_slot_order", "target_story")))
    out = schedule.groupBy(*key).agg(F.array_join(F.transform(cells, lambda c: c["target_story"]), "|").alias("story_slots"))
    ok = F.col("story_slots") == "|".join(STORIES)
    return out.withColumn("story_slots", F.when(ok, F.col("story_slots")).otherwise(F.raise_error(F.concat(F.lit("stories out of order: "), "story_slots"))))


def cohort_bins(df: DataFrame, value: str, bins: list[tuple[str, float, float]]) -> DataFrame:
    """Rows with the name of the inclusive bin they fall in."""
    label = F.lit(None).cast("string")
    for name, lo, hi in reversed(bins):
        label = F.when(F.col(value).between(lo, hi), name).otherwise(label)
    return df.withColumn("cohort", label).where("cohort is not null")


def candidate_cells(df: DataFrame, strata: list[str], key: str, least: int) -> DataFrame:
    """Distinct candidates per stratum, joined in text order, and whether there are enough."""
    ids = F.array_sort(F.collect_set(F.col(key).cast("string")))
    return df.groupBy(*strata).agg(F.size(ids).cast("long").alias("candidates"), F.array_join(ids, "/").alias("ids")).withColumn("status", F.when(F.col("candidates") >= least, "usable").otherwise("sparse"))


def config_ids(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("config_id", F.format_string("cfg_%04d", F.row_number().over(Window.orderBy(*order))))  # one row a design cell


def template(df: DataFrame, columns: list[str], features: list[str]) -> DataFrame:
    """Stated columns in order, then the measures to be filled in."""
    return df.select(*columns, *[F.lit(None).cast("double").alias(f) for f in features])


def _pairs_schema(df: DataFrame, cohort: str, key: str) -> str:
    kinds = dict(df.dtypes)
    return f"{cohort} {kinds[cohort]}, target_id {kinds[key]}, control_id {kinds[key]}, gap double"


def optimal_match(df: DataFrame, cohort: str, key: str, age: str, is_target: str) -> DataFrame:
    """Each target with one control, none twice, so that the sum of absolute age gaps is least (per cohort).

    Of equal sums the one with the smaller sum of control ids is kept; sums are exact, of ages in units of 1 / 30,000,000,000 (of
    decimals and of thirtieths, days of a month).  With the controls that are used known, both sides pair in age order.  A cohort
    is one task, whose memory and time grow with its children, and not with their pairs."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf[pdf[is_target]].sort_values([age, key])
        c = pdf[~pdf[is_target]].sort_values([age, key])
        if len(t) > len(c):
            raise ValueError("fewer controls than targets")
        whole = lambda d: [int(v) for v in np.rint(d[age].to_numpy(dtype=float) * 3e10)]
        c = c.iloc[best_controls(whole(t), whole(c), c[key].astype(int).tolist())]
        gap = np.abs(t[age].to_numpy(dtype=float) - c[age].to_numpy(dtype=float))
        return pd.DataFrame({cohort: t[cohort].to_numpy(), "target_id": t[key].to_numpy(), "control_id": c[key].to_numpy(), "gap": gap})

    return df.select(cohort, key, age, is_target).groupBy(cohort).applyInPandas(match, _pairs_schema(df, cohort, key))


def best_controls(targets: list[int], controls: list[int], weights: list[int]) -> list[int]:
    """Places of the controls, one for each target, whose sum of distances is least, and of those whose sum of weights is.

    Both sides are in order.  Points are met from left to right; each may be undone by a later one at the price of the change: a
    target takes the cheapest control so far, free or made free by a chain of changes, and a control takes over a target where
    that lowers the sum.  Two heaps hold these offers, one or two a point.  A cost is one integer, distance times more than all
    weights together, plus weight."""
    low = min(weights, default=0)
    weights = [w - low for w in weights]  # each target takes one: a shift changes nothing
    unit = sum(weights) + 1
    n, m = len(targets), len(controls)
    span = max(targets + controls, default=0) - min(targets + controls, default=0) + 1
    never = (2 * (n + 1) * span + 1) * unit  # over any sum of costs; a control that does not exist
    used = bytearray(m + 1)  # the last one: none
    free: list = []  # (price less place, control that it takes into use)
    held: list = []  # (change less place, control that it gives up)
    i = j = 0
    while i < n or j < m:
        if i < n and (j == m or targets[i] <= controls[j]):
            x = targets[i] * unit
            i += 1
            price, k = heappop(free) if free and free[0][0] + x < never else (never - x, m)
            used[k] = 1
            heappush(held, (-2 * x - price, k))
        else:
            y, w = controls[j] * unit, weights[j]
            if held and held[0][0] + y + w < 0:
                change, k = heappop(held)
                used[k] = 0
                used[j] = 1
                heappush(free, (-2 * y - change, k))
                heappush(held, (-y - w, j))
            else:
                heappush(free, (w - y, j))
            j += 1
    return [k for k in range(m) if used[k]]


def greedy_match(df: DataFrame, cohort: str, key: str, age: str, is_target: str) -> DataFrame:
    """Targets in age and id order take the nearest control that is left (ties: younger, then smaller id)."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        t, c = pdf[pdf[is_target]].sort_values([age, key]), pdf[~pdf[is_target]].sort_values([age, key])
        ta, ca = t[age].to_numpy(dtype=float), c[age].to_numpy(dtype=float)
        at = nearest_left(ta, ca)
        t = t.iloc[: len(at)]
        return pd.DataFrame({cohort: t[cohort].to_numpy(), "target_id": t[key].to_numpy(), "control_id": c[key].to_numpy()[at], "gap": np.abs(ta[: len(at)] - ca[at])})

    return df.select(cohort, key, age, is_target).groupBy(cohort).applyInPandas(match, _pairs_schema(df, cohort, key))


def nearest_left(targets: np.ndarray, controls: np.ndarray) -> list[int]:
    """For each target in turn the place of the nearest control that is left, of equally near ones the first; controls are in
    order, those without a value last and taken last.  The next place that is left is found along shortened paths, so that no
    target looks at all controls."""
    m = len(controls)
    known = int(np.count_nonzero(~np.isnan(controls)))
    up, down = list(range(m + 1)), list(range(m + 1))  # next place that is left from here on; one more than the last one before it
    run = np.searchsorted(controls, controls, "left").tolist()  # where the run of a value begins
    value = controls.tolist()

    def root(path: list, i: int) -> int:
        while path[i] != i:
            path[i] = path[path[i]]
            i = path[i]
        return i

    out = []
    for a, place in zip(targets.tolist(), np.searchsorted(controls[:known], targets, "left").tolist()):
        if len(out) == m:
            break
        right, left = (root(up, 0), 0) if a != a else (root(up, place), root(down, place))
        if left:
            gap = a - value[left - 1]
            if right >= known or gap <= value[right] - a:
                first = run[left - 1]
                while first and a - value[first - 1] == gap:  # other values that are as near in floating point
                    first = run[first - 1]
                right = root(up, first)
        out.append(right)
        up[right], down[right + 1] = right + 1, right
    return out


def balanced_stories(df: DataFrame, stratum: str, key: str, available: str) -> DataFrame:
    """In key order each row of a stratum gets, of the stories it has, the one given least so far (ties in story order)."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        used, rows = dict.fromkeys(STORIES, 0), []
        for _, r in pdf.sort_values(key).iterrows():
            has = [s for s in STORIES if s in set(r[available])]
            if has:
                s = min(has, key=lambda x: used[x])
                used[s] += 1
                rows.append((r[stratum], r[key], s))
        return pd.DataFrame(rows, columns=[stratum, key, "story"])

    k = dict(df.dtypes)
    return df.select(stratum, key, available).groupBy(stratum).applyInPandas(assign, f"{stratum} {k[stratum]}, {key} {k[key]}, story string")


def balanced_prompts(slots: DataFrame, candidates: DataFrame, fold: str, slot: str, want: str, key: str, value: str) -> DataFrame:
    """Per fold, for each slot in order: the candidate used least so far, then nearest in ``value`` to ``want``, then smallest id."""

    def choose(s: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(key).reset_index(drop=True)
        used, rows = np.zeros(len(c), np.int64), []
        for _, r in s.sort_values(slot).iterrows():
            if len(c):
                j = int(np.lexsort((c[key].to_numpy(), (c[value] - r[want]).abs().to_numpy(), used))[0])
                used[j] += 1
                rows.append((r[fold], r[slot], c.at[j, key]))
        return pd.DataFrame(rows, columns=[fold, slot, "chosen"])

    k, kc = dict(slots.dtypes), dict(candidates.dtypes)
    return slots.groupBy(fold).cogroup(candidates.groupBy(fold)).applyInPandas(choose, f"{fold} {k[fold]}, {slot} {k[slot]}, chosen {kc[key]}")


def fold_overview(prompts: DataFrame, evals: DataFrame, fold: str, prompt_id: str) -> DataFrame:
    """Per fold: its distinct prompts in numeric order, and how many rows it evaluates; folds without rows count 0."""
    p = prompts.groupBy(fold).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.col(prompt_id).cast("long"))), lambda x: x.cast("string")), "|").alias("prompt_ids"))
    e = evals.groupBy(fold).agg(F.count("*").alias("eval_rows"))
    return p.join(e, fold, "left").na.fill(0, ["eval_rows"])


def with_exemplar(df: DataFrame, narratives: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """The narrative of the same keys as ``name``, empty where there is none."""
    return df.join(narratives.select(*keys, F.col(text).alias(name)), keys, "left").na.fill("", [name])


def prompt_text(items: str, lead: str) -> Column:
    """A lead and a numbered list of an array column."""
    return F.concat(F.lit(lead + "\n"), numbered(items))
