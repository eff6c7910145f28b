"""Counts of annotated errors, past verbs and syntax per transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import safe_rate
from ..functions.text import code_name

ERROR = r"\[\*\s+([^\]]+)\]"

# Which error columns make up each group.
GROUPS = {
    "bare_marking_errors": ["err_m_c_03s_c_a", "err_m_c_vsg_c_a", "err_m_c_vun_c_a", "err_m_c_0ed", "err_m_c_base_c_ed", "err_m_c_0_apos_s", "err_m_c_0s", "err_m_c_0s_c_a", "err_m_c_0es"],
    "determiner_errors": ["err_s_c_r_c_gc_c_det"],
    "pronoun_errors": ["err_s_c_r_c_gc_c_pro"],
    "rule_generalization_errors": [
        "err_m_c_plus_3s",
        "err_m_c_plus_3s_c_a",
        "err_m_c_plus_plus_3s",
        "err_m_c_eq_ed",
        "err_m_c_eq_ed_c_i",
        "err_m_c_eq_en",
        "err_m_c_plus_ed",
        "err_m_c_plus_plus_ed",
        "err_m_c_plus_plus_ed_c_i",
        "err_m_c_plus_plus_en",
        "err_m_c_plus_plus_en_c_i",
        "err_m_c_plus_es",
    ],
}
PAST_OVERGENERALIZATION = ["err_m_c_eq_ed", "err_m_c_eq_ed_c_i", "err_m_c_plus_ed", "err_m_c_plus_plus_ed", "err_m_c_plus_plus_ed_c_i"]
BARE_PAST = ["err_m_c_0ed", "err_m_c_base_c_ed"]
FAMILIES = {"morphology": "^m[:-]", "syntax": "^s:", "phonology": "^p:"}
RELATIONS = {
    "Subordination": ["CCOMP", "XCOMP", "ADVCL", "ACL", "CSUBJ"],
    "Coordination": ["CONJ", "CC"],
    "Subject": ["NSUBJ", "CSUBJ"],
    "AuxCop": ["AUX", "COP"],
    "Oblique": ["OBL"],
    "ComplexNP": ["AMOD", "NUMMOD", "COMPOUND", "NMOD", "APPOS", "ACL"],
}
OBJECTS = ["OBJ", "IOBJ"]


def code_counts(df: DataFrame, key: str, text: str, pattern: str = ERROR) -> DataFrame:
    """(key, code, n): occurrences of the pattern's first group, trimmed."""
    return df.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("code")).groupBy(key, F.trim("code").alias("code")).agg(F.count("*").alias("n"))


def family(code: Column) -> Column:
    out = F.lit("other")
    for name, pat in reversed(FAMILIES.items()):
        out = F.when(code.rlike(pat), name).otherwise(out)
    return out


def family_totals(counts: DataFrame, key: str) -> DataFrame:
    fam = family(F.col("code"))
    return counts.groupBy(key).agg(F.sum("n").alias("error_total_annotations"), *[F.coalesce(F.sum(F.when(fam == f, F.col("n"))), F.lit(0)).alias(f"error_{f}_total") for f in (*FAMILIES, "other")])


def wide_codes(counts: DataFrame, key: str, codes: list[str]) -> DataFrame:
    """key x ``err_*`` columns, for a stated list of codes."""
    named = counts.withColumn("col", F.concat(F.lit("err_"), code_name("code")))
    return named.groupBy(key).pivot("col", codes).agg(F.sum("n")).na.fill(0)


def error_table(lines: DataFrame, key: str = "path") -> DataFrame:
    """Per transcript: target-child lines, those with a code, and totals by family."""
    said = lines.where(F.col("line").startswith("*CHI:"))
    base = said.groupBy(key).agg(F.count("*").alias("chi_utterances"), F.count_if(F.col("line").rlike(ERROR)).alias("chi_utterances_with_error_code"))
    return base.join(family_totals(code_counts(said, key, "line"), key), key, "left").na.fill(0)


def grouped_errors(counts: DataFrame, sizes: DataFrame, key: str, per: str, groups: dict[str, list[str]] = GROUPS, digits: int = 6) -> DataFrame:
    """Sums of code groups per key and their rate per ``per`` (0.0 where that is 0)."""
    col = F.concat(F.lit("err_"), code_name("code"))
    sums = counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(col.isin(c), F.col("n"))), F.lit(0)).alias(g) for g, c in groups.items()])
    out = sizes.select(key, per).join(sums, key, "left").na.fill(0, list(groups))
    return out.select(key, per, *groups, *[F.round(safe_rate(g, per, 0.0), digits).alias(f"{g}_per_utt") for g in groups])


def past_verbs(utterances: DataFrame, counts: DataFrame, key: str = "path", speaker: str | None = "CHI") -> DataFrame:
    """Overt past finite verbs, bare past errors, their sum, overgeneralisations and their rate per opportunity.  The
    ``%umor`` tiers of one speaker count (None: of all)."""
    u = utterances.where(F.col("speaker") == speaker) if speaker else utterances
    toks = F.split(F.trim(F.coalesce(F.col("tiers")["%umor"], F.lit(""))), r"\s+")
    overt = u.groupBy(key).agg(F.sum(F.size(F.filter(toks, lambda t: t.startswith("verb|") & t.contains("-Fin-") & t.contains("-Past-")))).alias("overt_past_finite_verbs"))
    col = F.concat(F.lit("err_"), code_name("code"))
    errs = counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(col.isin(c), F.col("n"))), F.lit(0)).alias(n) for n, c in (("bare_past_error_tokens", BARE_PAST), ("past_overgeneralization_errors", PAST_OVERGENERALIZATION))])
    out = overt.join(errs, key, "left").na.fill(0).withColumn("past_verb_opportunities", F.col("overt_past_finite_verbs") + F.col("bare_past_error_tokens"))
    return out.withColumn("past_overgeneralization_rate", safe_rate("past_overgeneralization_errors", "past_verb_opportunities", 0.0))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once, also where it is read inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _walked(idx: Column, arcs: Column) -> Column:
    """Steps from a token to its root; arcs is a map token -> head (0: root).  A token whose way runs into a cycle counts the
    steps up to where it comes back to one it has passed."""
    start = F.struct(idx.alias("at"), F.lit(0).alias("d"), F.array(idx).alias("seen"), F.lit(False).alias("end"))

    def step(a: Column, _: Column) -> Column:
        head = F.coalesce(F.try_element_at(arcs, a["at"]), F.lit(0))
        stop = a["end"] | (head == 0)
        back = F.array_contains(a["seen"], head)
        return F.struct(F.when(stop, a["at"]).otherwise(head).alias("at"), (a["d"] + F.when(stop, 0).otherwise(1)).alias("d"), F.when(stop, a["seen"]).otherwise(F.array_append(a["seen"], head)).alias("seen"), (stop | back).alias("end"))

    return F.aggregate(F.map_keys(arcs), start, step, lambda a: a["d"])


def _jumped(heads: Column) -> Column:
    """(p, d) arrays: where each token's pointer is after doubling its steps a dozen times, and how many steps that was; a root
    and a head that no token has are 0."""
    start = F.struct(heads.alias("p"), F.transform(heads, lambda h: F.when(h == 0, 0).otherwise(1)).alias("d"))

    def double(s: Column, _: Column) -> Column:
        at = lambda xs, x: F.coalesce(F.get(xs, x - 1), F.lit(0))
        return F.struct(
            F.transform(s["p"], lambda x: F.when(x <= 0, 0).otherwise(at(s["p"], x))).alias("p"),
            F.zip_with(s["d"], s["p"], lambda d, x: F.when(x <= 0, d).otherwise(d + at(s["d"], x))).alias("d"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, double)


def _depths(dep: Column, kept: Column) -> Column:
    """Depths of the kept tokens.  Tokens numbered 1, 2, ... without cycles, as nearly all are, go by pointer doubling; others are
    walked one by one."""
    root = lambda d: (d["r"] == "ROOT") | (d["h"] == d["i"]) | (d["h"] == 0)
    heads = F.transform(dep, lambda d: F.when(root(d), F.lit(0)).otherwise(d["h"]))
    plain = (F.transform(dep, lambda d: d["i"]) == F.sequence(F.lit(1), F.size(dep))) & (F.size(dep) <= 4096) & ~F.exists(dep, lambda d: d["h"] < 0)

    def by_jumps(j: Column) -> Column:
        return F.when(~F.exists(j["p"], lambda x: x != 0), F.transform(kept, lambda t: F.get(j["d"], t["dep"]["i"] - 1)))

    # the last of equal indices counts, as in a dictionary
    entries = F.aggregate(dep, F.array().cast("array<struct<i:int,h:int>>"), lambda a, d: F.array_append(F.filter(a, lambda x: x["i"] != d["i"]), F.struct(d["i"].alias("i"), F.when(root(d), F.lit(0)).otherwise(d["h"]).alias("h"))))
    walked = _once(F.map_from_entries(entries), lambda arcs: F.transform(kept, lambda t: _walked(t["dep"]["i"], arcs)))
    return F.coalesce(F.when(plain, _once(_jumped(heads), by_jumps)), walked)


def syntax_utterances(utterances: DataFrame, speaker: str = "CHI") -> DataFrame:
    """Per utterance: status (missing, parse, mismatch, empty, ok) and, if ok, token depths, dependency lengths, relations and
    finite verbs."""
    u = utterances.where(F.col("speaker") == speaker)
    words = lambda t: F.filter(F.split(F.trim(F.coalesce(F.col("tiers")[t], F.lit(""))), r"\s+"), lambda x: x != "")
    arc = lambda t: F.when(t.rlike(r"^[+-]?\d+\|[+-]?\d+\|[^|]*$"), F.struct(F.split(t, r"\|")[0].try_cast("int").alias("i"), F.split(t, r"\|")[1].try_cast("int").alias("h"), F.upper(F.split(t, r"\|")[2]).alias("r")))
    skipped = lambda p: (p["dep"]["r"] == "PUNCT") | ~p["mor"].contains("|") | (F.lower(F.substring_index(p["mor"], "|", 1)) == "cm")
    root = lambda d: (d["r"] == "ROOT") | (d["h"] == d["i"]) | (d["h"] == 0)
    finite = lambda s: F.lower(F.substring_index(s, "|", 1)).isin("verb", "aux") & s.contains("|") & F.regexp_replace(s, r"^[^|]*\|", "").contains("-Fin-")

    def read(s: Column) -> Column:
        state = F.when((F.size(s["mor"]) == 0) | (F.size(s["dep"]) == 0), "missing").when(F.exists(s["dep"], lambda d: d.isNull()), "parse").when(F.size(s["mor"]) != F.size(s["dep"]), "mismatch").otherwise("ok")
        kept = F.filter(F.arrays_zip(s["dep"].alias("dep"), s["mor"].alias("mor")), lambda p: ~skipped(p))
        return F.struct(state.alias("status"), s["mor"].alias("mor"), s["dep"].alias("dep"), F.when(state == "ok", kept).alias("kept"))

    def measured(s: Column) -> Column:
        live = (s["status"] == "ok") & (F.size(s["kept"]) > 0)
        return F.struct(
            F.when((s["status"] == "ok") & ~live, "empty").otherwise(s["status"]).alias("status"),
            F.when(live, _depths(s["dep"], s["kept"])).alias("depths"),
            F.when(live, F.transform(F.filter(s["kept"], lambda p: ~root(p["dep"])), lambda p: F.abs(p["dep"]["i"] - p["dep"]["h"]))).alias("lengths"),
            F.when(live, F.array_distinct(F.transform(s["kept"], lambda p: p["dep"]["r"]))).alias("relations"),
            F.when(live, F.size(F.filter(F.flatten(F.transform(s["mor"], lambda t: F.split(t, "~"))), finite))).alias("finite_verbs"),
        )

    tokens = F.struct(words("%umor").alias("mor"), F.transform(words("%ugra"), arc).alias("dep"))
    return u.select("path", "block_id", _once(_once(tokens, read), measured).alias("m")).select("path", "block_id", "m.*")


def syntax_table(utterances: DataFrame, speaker: str = "CHI") -> DataFrame:
    """Fourteen syntax features and five quality counts per transcript."""
    u = syntax_utterances(utterances, speaker)
    has = lambda names: F.exists("relations", lambda r: r.rlike("^(?:" + "|".join(names) + ")(?:-|$)"))
    total = lambda c: F.sum(F.aggregate(c, F.lit(0), lambda a, x: a + x))
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status = lambda s: F.count_if(F.col("status") == s)
    g = u.groupBy("path").agg(
        F.count("*").alias("chi_blocks_total"),
        status("ok").alias("chi_blocks_analyzed"),
        status("missing").alias("chi_blocks_skipped_missing_tiers"),
        status("parse").alias("chi_blocks_skipped_parse_errors"),
        status("mismatch").alias("chi_blocks_skipped_token_mismatch"),
        F.coalesce(F.sum(F.size("depths")), F.lit(0)).alias("_n"),
        F.coalesce(F.sum(F.size("lengths")), F.lit(0)).alias("_l"),
        total("depths").alias("_d"),
        total("lengths").alias("_len"),
        F.max(F.array_max("depths")).alias("_dm"),
        F.max(F.array_max("lengths")).alias("_lm"),
        F.sum("finite_verbs").alias("_v"),
        *[flag(has(v)).alias(f"_{k}") for k, v in RELATIONS.items()],
        flag(F.exists("relations", lambda r: r.isin(OBJECTS))).alias("_Object"),
    )
    per = lambda a, b: F.coalesce(safe_rate(a, b, 0.0), F.lit(0.0))
    utt = "chi_blocks_analyzed"
    cols = {
        "Syntax_Utts_Analyzed": F.col(utt).cast("double"),
        "Syntax_Tokens_Analyzed": F.col("_n").cast("double"),
        "Syntax_Mean_DepLen": per("_len", "_l"),
        "Syntax_Max_DepLen": F.coalesce(F.col("_lm").cast("double"), F.lit(0.0)),
        "Syntax_Mean_TreeDepth": per("_d", "_n"),
        "Syntax_Max_TreeDepth": F.coalesce(F.col("_dm").cast("double"), F.lit(0.0)),
    } | {f"Syntax_{k}_Utt_Prop": per(f"_{k}", utt) for k in ("Subordination", "Coordination", "Subject", "Object", "AuxCop", "Oblique", "ComplexNP")}
    cols["Syntax_FiniteVerb_Tokens_per_Utt"] = per("_v", utt)
    return g.select("path", *[c.alias(n) for n, c in cols.items()], *[c for c in g.columns if c.startswith("chi_blocks")])
