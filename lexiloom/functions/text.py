"""Text functions on columns: transcript cleaners, tokens, n-grams, tier tokens, names.

All are built-in expressions; no Python runs per row.  Cleaners are lists of (pattern, replacement) applied in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and annotation patterns of the transcription format.
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
ALNUM = r"[A-Za-z0-9']+"
PLACEHOLDERS = ["xxx", "xx", "yyy", "yy", "www"]
TIMING = r"\x15[^\x15]*\x15"

# The substitutions of each cleaner, in order.
CLEANERS: dict[str, list[tuple[str, str]]] = {
    # drops fillers and omitted words, keeps what stands in angle brackets
    "surface": [
        (TIMING, " "),
        (r"<([^<>]*)>", "$1"),
        (r"\[[^\]]*\]", " "),
        (r"[\x15\t]", " "),
        (r"\+\.\.\.", " "),
        (r"\+/{1,2}\.?", " "),
        (r"\+\s*,", " "),
        (r"&[+-][A-Za-z:']+", " "),
        (r"\b0[A-Za-z']+", " "),
        (r"\s+", " "),
    ],
    # keeps fillers as words, and omitted words without their zero
    "spoken": [
        (TIMING, " "),
        (r"<([^<>]*)>", "$1"),
        (r"\[[^\]]*\]", " "),
        (r"\x15", " "),
        (r"\b0([A-Za-z']+)", "$1"),
        (r"(?i)&-(um|uh|er|ah|oh)\b", " $1 "),
        (r"&=(\w+)", " "),
        (r"&[+-][A-Za-z:']+", " "),
        (r"\+[/.!?]+", " "),
        (r"[<>]", " "),
        (r"\s+", " "),
    ],
    # annotations off, round and angle brackets opened
    "plain": [(r"\b0\w+\b", ""), (r"&[+-]\w+", ""), (r"\[.*?\]", ""), (r"[<>]", ""), (r"[()]", ""), (r"\s+", " ")],
    # training pair, raw side
    "raw_pair": [
        (r"^\*[A-Z]{3}\d*:\s+", ""),
        (r"^\*\d+:\s+", ""),
        (r"\[\*.*?\]", ""),
        (r"\[:.*?\]", ""),
        (r"0\w+", ""),
        (r"\[.*?\]", ""),
        (r"\(.*?\)", ""),
        (r"\s+", " "),
        (r"\x15.*?\x15", ""),
        (r"[\x15<>]", ""),
        (r"\s+", " "),
    ],
    # training pair, annotated side
    "annotated_pair": [(r"^\*[A-Z]{3}\d*:\s+", ""), (r"^\*\d+:\s+", ""), (r"\[\+.*?\]", ""), (r"\x15?\d+[_\-]\d+\x15?", ""), (r"\s+", " ")],
    # angle brackets go with what they hold, and so does punctuation
    "embedding": [
        (r"^[^:]*:", ""),
        (r"\[.*?\]", ""),
        (r"<.*?>", ""),
        (r"&[a-z]+", ""),
        (r"[+\d.]+", ""),
        (r"xxx|yyy", ""),
        (r"_", " "),
        (r"[^\w\s]", ""),
    ],
    # disfluencies stay
    "natural": [
        (r"^[^:]*:", ""),
        (r"\[//\]", "..."),
        (r"\[/\]", ""),
        (r"&([a-z]+)", "$1"),
        (r"\[.*?\]", ""),
        (r"[<>]", ""),
        (r"xxx|yyy", ""),
        (r"\(\.\)", ","),
        (r"\(\.\.\)", "..."),
        (r"\s+", " "),
        (r" ([.?])", "$1"),
    ],
    # the target child's words, all annotation off, lengthened sounds joined
    "child": [
        (r"\[[^\]]*\]", ""),
        (r"<[^>]*>", ""),
        (r"\{[^}]*\}", ""),
        (r"\([^)]*\)", ""),
        (r"\^.*$", ""),
        (r"[+&|\\]\S*", ""),
        (r"([a-zA-Z]+):+([a-zA-Z]+)", "$1$2"),
        (r"([a-zA-Z]):+", "$1"),
        (r"\s+", " "),
    ],
    # omitted words and angle brackets
    "training": [(r"\b0\w+", ""), (r"[<>]", ""), (r"\s+", " ")],
    # free text on its way into a transcript
    "for_transcript": [
        (r"[\n\r\t]", " "),
        (r"\"", ""),
        (r",", " "),
        (r"(^|\W)'|'(\W|$)", "$1$2"),
        (r"\bLil\b", "Little"),
        (r"(?i)\blil\b", "little"),
        (r"[^\w\s.?!]", ""),
        (r"\s+", " "),
    ],
}


# Patterns that match the same and cost the regex engine less.  A single space is what white space becomes, so it is
# left alone; words and marks are looked for by their first character; a class that negates others gets ten times slower once
# another pattern of the same query has one, so it is spelled out.
QUICK: dict[tuple[str, str], tuple[str, str]] = {
    (r"\s+", " "): (r"\s(?:\s+|(?<=[^ ]))", " "),
    (r"[^\w\s.?!]", ""): (r"[\x00-\x08\x0E-\x1F\"-\x2D/:->@\[-\x5E`{-\x{10FFFF}]", ""),
    (r"[^\w\s]", ""): (r"[\x00-\x08\x0E-\x1F!-/:-@\[-\x5E`{-\x{10FFFF}]", ""),
    (r"\b0\w+\b", ""): (r"0(?<=\b0)\w+\b", ""),
    (r"\b0\w+", ""): (r"0(?<=\b0)\w+", ""),
    (r"\b0([A-Za-z']+)", "$1"): (r"0(?<=\b0)([A-Za-z']+)", "$1"),
    (r"xxx|yyy", ""): (r"[xy](?:(?<=x)xx|(?<=y)yy)", ""),
    (r"([a-zA-Z]):+", "$1"): (r":(?<=[a-zA-Z]:):*", ""),
}

# Cleaners as fewer substitutions, where some delete or blank marks that have no part in one another, or do again
# what a later one does.
FEWER: dict[str, list[tuple[str, str]]] = {
    # \x15, events, fillers, line ends and brackets are blanked at once
    "spoken": [*CLEANERS["spoken"][:3], *CLEANERS["spoken"][4:6], (r"[&+<>\x15](?:(?<=[<>\x15])|(?<=&)(?:=\w+|[+-][A-Za-z:']+)|(?<=\+)[/.!?]+)", " "), CLEANERS["spoken"][10]],
    "plain": [*CLEANERS["plain"][:3], (r"[<>()]", ""), CLEANERS["plain"][5]],
    # white space is squeezed once; ``.`` would stop at the line ends that squeezing leaves
    "raw_pair": [*CLEANERS["raw_pair"][:7], (r"\x15[^\x15\u0085\u2028\u2029]*\x15", ""), *CLEANERS["raw_pair"][9:]],
    # a colon between letters is one after a letter
    "child": [*CLEANERS["child"][:6], *CLEANERS["child"][7:]],
    "for_transcript": [(r"[\n\r\t,]", " "), CLEANERS["for_transcript"][1], *CLEANERS["for_transcript"][3:]],
}


def clean(col: Column | str, cleaner: str = "surface") -> Column:
    """``CLEANERS`` in order, by way of their equals in ``FEWER`` and ``QUICK``."""
    out = F.col(col) if isinstance(col, str) else col
    for rule in FEWER.get(cleaner, CLEANERS[cleaner]):
        out = F.regexp_replace(out, *QUICK.get(rule, rule))
    return F.trim(out)


def tokens(col: Column | str, pattern: str = WORD, digits: bool = True) -> Column:
    """Lower-cased matches without placeholders for unintelligible speech; without pure numbers if ``digits`` is False."""
    got = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), F.lower)
    keep = F.filter(got, lambda t: ~t.isin(PLACEHOLDERS))
    return keep if digits else F.filter(keep, lambda t: ~t.rlike(r"^\d+$"))


def type_token_ratio(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.size(F.array_distinct(toks)) / F.size(toks)).otherwise(0.0)


def ngrams(toks: Column, n: int) -> Column:
    """Arrays of n neighbouring tokens; empty where there are fewer than n."""
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(0), F.size(toks) - n), lambda i: F.slice(toks, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def padded(toks: Column, n: int) -> Column:
    """n - 1 start marks, the tokens, one end mark."""
    return F.concat(F.array_repeat(F.lit("<s>"), n - 1), toks, F.array(F.lit("</s>")))


def sentences(col: Column | str) -> Column:
    """Sentences split after . ! ? and white space; a last one without a mark gets a full stop."""
    parts = F.filter(F.transform(F.split(normal_surface(col), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))


def sentence_marks(col: Column | str) -> Column:
    """Number of sentence ends that white space follows, plus one for the last stretch."""
    return F.size(F.regexp_extract_all(col, F.lit(r"[.!?]+\s"), F.lit(0))) + 1


def normal_surface(col: Column | str) -> Column:
    """Curly quotes straightened, white space squeezed."""
    return F.trim(F.regexp_replace(F.translate(col, "\u201c\u201d\u2018\u2019", "\"\"''"), r"\s+", " "))


def strip_clause_edges(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(normal_surface(col), r"[\s,.;:!?]+$", ""))


def space_punctuation(col: Column | str) -> Column:
    """A space before each . ! ?, and commas as words of their own."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"\s*([.!?,])", " $1"), r"\s+", " "))


def mark_repeats(col: Column | str) -> Column:
    """``word word`` becomes ``word [/] word``."""
    return F.regexp_replace(col, r"(\b\w+)\s+\1\b", "$1 [/] $1")


def code_name(col: Column | str) -> Column:
    """An error code as a column name."""
    out = F.lower(col)
    for a, b in ((":", "_c_"), (r"\+", "_plus_"), ("=", "_eq_"), ("'", "_apos_"), ("-", "_dash_"), (r"[^\p{L}\p{N}_]", "_"), ("_+", "_"), ("^_|_$", "")):
        out = F.regexp_replace(out, a, b)
    return F.when(out == "", "unknown").otherwise(out)


def safe_name(col: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"[^0-9A-Za-z]+", "_"), "^_+|_+$", "")


def tier_body(line: Column) -> Column:
    """What follows the first tab, else the first colon."""
    return F.when(line.contains("\t"), F.regexp_extract(line, r"(?s)^[^\t]*\t(.*)$", 1)).otherwise(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))


def tier_tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(tier_body(line)), r"\s+"), lambda t: ~t.isin("", ".", "?", "!"))


def lemmas(toks: Column) -> Column:
    """pos|lemma-features~clitic -> lemma; tokens without a bar stay."""
    return F.transform(toks, lambda t: F.when(t.contains("|"), F.split(F.split(F.substring_index(F.regexp_replace(t, r"^[^|]*\|", ""), "-", 1), "~")[0], "-")[0]).otherwise(t))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; two empty sets share nothing."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def speaker_body(line: Column) -> Column:
    body = F.trim(F.regexp_replace(tier_body(line), TIMING + "$", ""))
    return F.trim(F.regexp_replace(body, r"(\s*(\[[^\]]+\]|&=\S+))*\s*$", ""))


def ending(text: Column) -> Column:
    """Whether a quotation is announced, and the last sentence mark."""
    bare = F.rtrim(F.replace(text, F.lit('+"/'), F.lit("")))
    return F.struct(text.contains('+"/').alias("quote"), F.regexp_extract(bare, r"([.?!])$", 1).alias("mark"))


def age_months(col: Column | str, day_divisor: float | None = 30.0) -> Column:
    """``Y;MM.DD`` in months; days count 1 / ``day_divisor`` (None: not at all).  The three uses differ in that."""
    part = lambda i: F.regexp_extract(col, r"^(\d+);(\d*)\.?(\d*)", i)
    n = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("double"), F.lit(0.0))
    whole = n(part(1)) * 12 + n(part(2))
    return F.when(part(1) != "", whole + n(part(3)) / day_divisor if day_divisor else whole)


def normal_id(col: Column | str) -> Column:
    """``482.0`` -> ``482``; NaN and NULL -> empty."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    x = c.try_cast("double")
    return F.when(c.isNull() | F.isnan(x), "").when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.trim(c))


def age_years(col: Column | str) -> Column:
    """``Y;MM.DD`` in years, months as twelfths; 0.0 where there is no age."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(col, r"^(\d+);(\d*)", i), F.lit("")).try_cast("double"), F.lit(0.0))
    return part(1) + part(2) / 12


def age_year(col: Column | str) -> Column:
    """Whole years of ``Y;MM.DD`` (what comes before the semicolon), NULL where that is no number."""
    return F.split_part(F.col(col) if isinstance(col, str) else col, F.lit(";"), F.lit(1)).try_cast("int")


# Words that an unfinished line ends in, and what marks a line as annotated.
HANGING = ["and", "the", "a", "an", "but", "or", "so", "in", "on", "at"]
MARKED = r"\[\*|\[/+\]|\b0\w+|[<>]|xxx|\(\.+\)"


def is_fragment(col: Column | str) -> Column:
    """Two words or fewer, or a last word that leaves the line open."""
    words = F.filter(F.split(col, r"\s+"), lambda w: w != "")
    last = F.regexp_replace(F.lower(F.element_at(words, -1)), r"^[.,?!]+|[.,?!]+$", "")
    return F.when(F.size(words) <= 2, True).otherwise(last.isin(HANGING))


def is_marked(col: Column | str) -> Column:
    """Whether a line has codes, retracings, omitted words, scope marks or pauses."""
    return (F.col(col) if isinstance(col, str) else col).rlike(MARKED)


def transcript_sentences(col: Column | str) -> Column:
    """Sentences as speaker lines: a trailing ellipsis is ``+...``, one inside is a pause, and the end mark stands apart."""

    def line(s: Column) -> Column:
        inner = F.regexp_replace(s, r"\.\.\.", " (...) ")
        body = F.when(s.endswith("..."), F.concat(F.trim(F.substr(s, F.lit(1), F.length(s) - 3)), F.lit(" +..."))).when(s.contains("..."), inner).otherwise(s)
        ended = (
            F.when(body.endswith("+..."), body)
            .when(body.endswith("?"), F.concat(F.trim(F.regexp_replace(body, r"\?$", "")), F.lit(" ?")))
            .when(body.endswith("!"), F.concat(F.trim(F.regexp_replace(body, "!$", "")), F.lit(" !")))
            .otherwise(F.concat(F.trim(F.regexp_replace(body, r"\.+$", "")), F.lit(" .")))
        )
        return F.trim(F.regexp_replace(ended, r"\s+", " "))

    return F.transform(F.filter(F.split(F.trim(col), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != ""), line)


def numbered(items: Column | str) -> Column:
    """An array as a numbered list, one item a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def ascii_json(col: Column | str) -> Column:
    """JSON with every character beyond ASCII as ``\\uXXXX`` (two of them beyond the basic plane)."""
    text = F.to_json(F.col(col) if isinstance(col, str) else col)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n.cast("long")), 4, "0")))

    def char(c: Column) -> Column:
        # the code point from UTF-32, as ``ascii`` ends at the basic plane
        n = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + ((n - 0x10000) % 1024)
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    chars = F.regexp_extract_all(text, F.lit(r"(?s)[\x{10000}-\x{10FFFF}]|."), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(chars, char), "")).otherwise(text)
