"""Line editors on (path, line_no, line): pauses, quotation ends, tiers, repairs, bundling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ending, jaccard, lemmas, speaker_body, tier_body, tier_tokens
from ..sources.chat import blocks_of


def normalise_pauses(lines: DataFrame) -> DataFrame:
    """``( . )`` after the speaker becomes ``(.)``, for one to three dots."""
    return lines.withColumn("line", F.regexp_replace("line", r"^(\*[^:\n]+:\s*)\(\s*(\.{1,3})\s*\)", "$1($2)"))


# Quotation and break marks before a full stop, as (pattern, replacement), in order of precedence.
QUOTE_ENDS = [
    (r'(^\*[^:\n]+:.*)\+\"\/\s+(\.)', r'$1+"/$2'),
    (r'(^\*[^:\n]+:.*)\+\"\s+(\.)', r'$1+"$2'),
    (r'(^\*[^:\n]+:.*)\+\/\/\s+(\.)', r'$1+//$2'),
    (r'(^\*[^:\n]+:.*)\+\/\s+(\.)', r'$1+/$2'),
]


def normalise_quote_ends(lines: DataFrame) -> DataFrame:
    """No space between a quotation or break mark and its full stop; the last of the marks in a line, and one kind only."""
    out = F.lit(None).cast("string")
    for pattern, to in reversed(QUOTE_ENDS):
        out = F.when(F.col("line").rlike(pattern), F.regexp_replace("line", pattern, to)).otherwise(out)
    return lines.withColumn("line", F.coalesce(out, F.col("line")))


def promote_tiers(lines: DataFrame) -> DataFrame:
    """``%umor`` two lines above a ``%mor``, and ``%ugra`` above a ``%gra``, take its place."""
    back = F.lag("line", 2).over(Window.partitionBy("path").orderBy("line_no"))
    return lines.withColumn("line", F.when(F.col("line").startswith("%mor:") & back.startswith("%umor:"), F.regexp_replace(back, "^%umor:", "%mor:")).when(F.col("line").startswith("%gra:") & back.startswith("%ugra:"), gra_from_ugra(back)).otherwise(F.col("line")))


def strip_tiers(lines: DataFrame, tiers: tuple[str, ...] = ("mor", "gra")) -> DataFrame:
    return lines.where(~F.col("line").rlike(f"^%(?:{'|'.join(tiers)}):"))


def gra_from_ugra(line: Column) -> Column:
    """Dependency tier whose root has head 0."""
    toks = F.transform(F.filter(F.split(F.trim(tier_body(line)), r"\s+"), lambda t: t != ""), lambda t: F.when(t.rlike(r"^[^|]*\|[^|]*\|ROOT$"), F.regexp_replace(t, r"^([^|]*)\|[^|]*\|ROOT$", "$1|0|ROOT")).otherwise(t))
    return F.concat(F.when(line.contains("\t"), F.lit("%gra:\t")).otherwise(F.lit("%gra:")), F.array_join(toks, " "))


def fallback_gra(mor: Column) -> Column:
    """A flat parse: the first verb or auxiliary is root, else the first word; the rest hangs on it."""
    toks = F.filter(F.split(F.trim(tier_body(mor)), r"\s+"), lambda t: t != "")
    punct = lambda t: t.isin(".", "!", "?")
    # tokens and their kinds are made once: 2 for a verb or auxiliary, 1 for another word, 0 for an end mark
    known = F.struct(toks.alias("t"), F.transform(toks, lambda t: F.when(t.rlike(r"^(?:verb|aux)\|"), 2).when(~punct(t), 1).otherwise(0)).alias("k"))
    place = lambda k, n: F.nullif(F.array_position(k, n), F.lit(0))
    rooted = F.transform(F.array(known), lambda s: F.struct(s["t"].alias("t"), F.coalesce(place(s["k"], 2), place(s["k"], 1)).cast("string").alias("r")))

    def parse(s: Column) -> Column:
        arc = lambda t, i: F.concat_ws("|", (i + 1).cast("string"), F.when(punct(t), s["r"]).when((i + 1).cast("string") == s["r"], "0").otherwise(s["r"]), F.when(punct(t), "PUNCT").when((i + 1).cast("string") == s["r"], "ROOT").when(t.startswith("intj|"), "DISCOURSE").otherwise("DEP"))
        return F.when(s["r"].isNull(), "").otherwise(F.array_join(F.transform(s["t"], arc), " "))

    return F.concat(F.when(mor.contains("\t"), F.lit("%gra:\t")).otherwise(F.lit("%gra:")), F.element_at(F.transform(rooted, parse), 1))


def _tier_of(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^(%\w+):", 1), F.lit(""))


def repair_candidates(lines: DataFrame) -> DataFrame:
    """Blocks that have all four tiers, with lengths, lemma overlap, and whether they look misaligned or end otherwise than the
    speaker's line: (path, block_id, umor_len, mor_len, lemma_jaccard, suspicious, delimiter_mismatch, tier lines)."""
    b = blocks_of(lines).where("in_block").withColumn("tier", _tier_of(F.col("line")))
    pick = lambda t: F.max_by(F.when(F.col("tier") == t, F.col("line")), F.when(F.col("tier") == t, F.col("line_no")))
    g = b.groupBy("path", "block_id").agg(F.min_by("line", "line_no").alias("said"), *[pick("%" + t).alias(t) for t in ("umor", "ugra", "mor", "gra")]).where("umor is not null and ugra is not null and mor is not null and gra is not null")
    u, m = tier_tokens(F.col("umor")), tier_tokens(F.col("mor"))
    g = g.withColumn("umor_len", F.size(u)).withColumn("mor_len", F.size(m)).withColumn("lemma_jaccard", jaccard(lemmas(u), lemmas(m)))
    g = g.withColumn("suspicious", (F.least("umor_len", "mor_len") >= 4) & ((F.col("lemma_jaccard") <= 0.25) | ((F.col("umor_len") != F.col("mor_len")) & (F.col("lemma_jaccard") < 0.15))))
    s, un, mn = (ending(speaker_body(F.col(c))) for c in ("said", "umor", "mor"))
    return g.withColumn("delimiter_mismatch", (s == un) & (s != mn))


def repair_tiers(lines: DataFrame) -> DataFrame:
    """Blocks that ``repair_candidates`` flags get their morphology and dependency tiers from the ``u`` tiers."""
    fix = repair_candidates(lines).where("suspicious or delimiter_mismatch").select("path", "block_id", F.regexp_replace("umor", "^%umor:", "%mor:").alias("new_mor"), gra_from_ugra(F.col("ugra")).alias("new_gra"))
    b = blocks_of(lines).join(fix, ["path", "block_id"], "left")
    hit = F.col("in_block") & F.col("new_mor").isNotNull()
    return b.select("path", "line_no", F.when(hit & F.col("line").startswith("%mor:"), F.col("new_mor")).when(hit & F.col("line").startswith("%gra:"), F.col("new_gra")).otherwise(F.col("line")).alias("line"))


def insert_missing_tiers(lines: DataFrame) -> DataFrame:
    """Blocks without ``%mor`` get it from ``%umor``, blocks without ``%gra`` from ``%ugra`` or a flat parse; the new lines stand
    after the tiers they come from, and lines are numbered anew."""
    b = blocks_of(lines).withColumn("tier", F.when(F.col("in_block"), _tier_of(F.col("line"))))
    w = Window.partitionBy("path", "block_id", "in_block")
    first = lambda t, c: F.min_by(F.when(F.col("tier") == t, F.col(c)), F.when(F.col("tier") == t, F.col("line_no"))).over(w)
    b = b.withColumns({f"{t}_{k}": first("%" + t, c) for t in ("umor", "ugra", "mor", "gra") for k, c in (("at", "line_no"), ("line", "line"))})
    new_mor = F.when(F.col("mor_at").isNull(), F.regexp_replace("umor_line", "^%umor:", "%mor:"))
    mor_after = F.greatest("umor_at", F.when(F.col("ugra_at") > F.col("umor_at"), F.col("ugra_at")))
    mor = F.coalesce("mor_line", new_mor)
    new_gra = F.when(F.col("gra_at").isNull() & mor.isNotNull(), F.coalesce(gra_from_ugra(F.col("ugra_line")), fallback_gra(mor)))
    gra_after = F.coalesce("mor_at", mor_after)
    extra = lambda new, after: F.when(F.col("in_block") & (F.col("line_no") == after), new)
    out = b.withColumn("out", F.filter(F.array(F.col("line"), extra(new_mor, mor_after), extra(new_gra, gra_after)), lambda x: x.isNotNull()))
    out = out.select("path", "line_no", F.posexplode("out").alias("k", "line"))
    return out.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("line_no", "k")) - 1).select("path", "line_no", "line")


def add_gram_mark(lines: DataFrame) -> DataFrame:
    """`` [+ gram]`` after the final mark of lines with a morphology, replacement or omission code."""
    due = F.col("line").rlike(r"\[\* m:|\[\* s:r:| 0|CHI:\t0(?:subj|det)") & ~F.col("line").contains("[+ gram]") & F.col("line").rlike(r"[.!?]\s*$")
    return lines.withColumn("line", F.when(due, F.concat(F.rtrim("line"), F.lit(" [+ gram]"))).otherwise(F.col("line")))


def remove_code(lines: DataFrame, code: str = "m:03s:a") -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", r"\s*\[\* " + code + r"\]", ""))


def rebundle(prefix: DataFrame, bodies: DataFrame) -> DataFrame:
    """(bundle_id, content): the prefix lines of a bundle, then the lines of its stories in slot order, then the end mark.
    ``prefix`` (bundle_id, line_no, line), ``bodies`` (bundle_id, slot, line_no, line)."""
    parts = prefix.select("bundle_id", F.lit(0).alias("slot"), "line_no", "line").unionByName(bodies.select("bundle_id", "slot", "line_no", "line"))
    cells = F.array_sort(F.collect_list(F.struct("slot", "line_no", "line")))
    return parts.where("line <> '@End'").groupBy("bundle_id").agg(F.concat(F.array_join(F.transform(cells, lambda c: c["line"]), "\n"), F.lit("\n@End\n")).alias("content"))
