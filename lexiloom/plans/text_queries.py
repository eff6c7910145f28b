"""Queries over texts: tokens, cleaners, models, neighbours, markers, stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checks import safe_rate
from ..functions import text as T
from ..operators import annotation as A
from ..operators import joins as J
from ..operators import language_model as LM
from ..operators import lines as L
from ..operators import retrieval as R
from ..operators.evaluation import additive_perplexity, slice_report, text_metrics, words_and_pairs
from ..operators import detectability as X
from ..operators.detectability import detectability
from ..operators.learning import centroid_distance, score_with
from ..operators.quotes import utterances as quote_lines
from ..operators.stats import describe, slice_summary
from ..sources import chat

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_TOK = "list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: lower(x)), lambda x: x NOT IN ('xxx','xx','yyy','yy','www'))"
_SURFACE = [("x15[^\\x15]*\\x15", " "), ("<([^<>]*)>", "\\1"), ("\\[[^\\]]*\\]", " "), ("[\\x15\\t]", " "), ("\\+\\.\\.\\.", " "), ("\\+/{1,2}\\.?", " "), ("\\+\\s*,", " "), ("&[+-][A-Za-z:'']+", " "), ("\\b0[A-Za-z'']+", " "), ("\\s+", " ")]


def _chain(col: str, steps) -> str:
    out = col
    for p, to in steps:
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return f"trim({out})"


def _said(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.tokens("text").alias("tokens"))


_BIGRAM_SQL = f"""
WITH said AS (SELECT conv_id, turn, {_TOK.format(c="text")} AS toks FROM conversations WHERE role = 'user'),
toks AS (SELECT conv_id, turn, unnest(list_concat(list_concat(['<s>'], toks), ['</s>'])) AS w, generate_subscripts(list_concat(list_concat(['<s>'], toks), ['</s>']), 1) AS i FROM said),
pairs AS (SELECT a.conv_id, a.w AS a, b.w AS b FROM toks a JOIN toks b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i = a.i + 1),
train AS (SELECT a, b, count(*) AS c FROM pairs WHERE conv_id % 5 <> 0 GROUP BY 1, 2),
types AS (SELECT DISTINCT w FROM toks WHERE conv_id % 5 <> 0 AND w NOT IN ('<s>', '</s>')),
v AS (SELECT count(*) + 2 AS v FROM types),
ctx AS (SELECT a, sum(c) AS n FROM train GROUP BY 1),
asked AS (SELECT conv_id, CASE WHEN a = '<s>' OR a IN (SELECT w FROM types) THEN a ELSE '<unk>' END AS a, CASE WHEN b = '</s>' OR b IN (SELECT w FROM types) THEN b ELSE '<unk>' END AS b FROM pairs WHERE conv_id % 5 = 0)
SELECT conv_id, CAST(count(*) AS BIGINT) AS steps, round(exp(-sum(ln((coalesce(c, 0) + 0.5) / (coalesce(n, 0) + 0.5 * v))) / count(*)), 6) AS perplexity
FROM asked LEFT JOIN train USING (a, b) LEFT JOIN ctx USING (a) CROSS JOIN v GROUP BY conv_id
"""


@query(_BIGRAM_SQL)
def heldout_bigram_perplexity(spark, d):
    said = _said(spark, d)
    out = LM.bigram_perplexity(said.where("conv_id % 5 <> 0"), said.where("conv_id % 5 = 0"), "conv_id")
    return out.select("conv_id", F.col("steps").cast("long").alias("steps"), F.round("perplexity", 6).alias("perplexity"))


_TRIGRAM_SQL = f"""
WITH said AS (SELECT conv_id, conv_id % 5 AS fold, turn, {_TOK.format(c="text")} AS toks FROM conversations WHERE role = 'user'),
toks AS (SELECT conv_id, fold, turn, unnest(list_concat(list_concat(['<s>', '<s>'], toks), ['</s>'])) AS w, generate_subscripts(list_concat(list_concat(['<s>', '<s>'], toks), ['</s>']), 1) AS i FROM said),
tri AS (SELECT a.conv_id, a.fold, a.w AS a, b.w AS b, c.w AS c FROM toks a JOIN toks b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i = a.i + 1 JOIN toks c ON a.conv_id = c.conv_id AND a.turn = c.turn AND c.i = a.i + 2),
folds AS (SELECT DISTINCT fold FROM tri),
model AS (SELECT f.fold AS k, a, b, c, count(*) AS n FROM folds f JOIN tri ON tri.fold <> f.fold GROUP BY 1, 2, 3, 4),
ctx AS (SELECT k, a, b, sum(n) AS m FROM model GROUP BY 1, 2, 3),
v AS (SELECT k, count(DISTINCT c) + 1 AS v FROM model GROUP BY 1)
SELECT tri.fold AS fold, conv_id, CAST(count(*) AS BIGINT) AS token_count, round(exp(-sum(ln((coalesce(n, 0) + 0.5) / (coalesce(m, 0) + 0.5 * v))) / count(*)), 6) AS perplexity
FROM tri LEFT JOIN model ON model.k = tri.fold AND model.a = tri.a AND model.b = tri.b AND model.c = tri.c
LEFT JOIN ctx ON ctx.k = tri.fold AND ctx.a = tri.a AND ctx.b = tri.b JOIN v ON v.k = tri.fold GROUP BY 1, 2
"""


def _folded(spark, d):
    said = _said(spark, d).groupBy("conv_id").agg(F.collect_list("tokens").alias("utterance_tokens")).withColumn("fold", F.col("conv_id") % 5)
    return LM.fold_perplexity(said, "conv_id", "fold", 3)


@query(_TRIGRAM_SQL)
def heldout_trigram_perplexity_by_fold(spark, d):
    return _folded(spark, d).select("fold", "conv_id", F.col("token_count").cast("long").alias("token_count"), F.round("perplexity", 6).alias("perplexity"))


@query(f"SELECT fold, round(avg(perplexity), 5) AS mean, round(quantile_cont(perplexity, 0.5), 5) AS median, round(stddev_samp(perplexity), 5) AS sd, round(min(perplexity), 5) AS min, round(max(perplexity), 5) AS max FROM ({_TRIGRAM_SQL}) GROUP BY fold")
def fold_aggregate(spark, d):
    s = LM.fold_summary(heldout_trigram_perplexity_by_fold(spark, d), "fold")
    return s.select("fold", *[F.round(c, 5).alias(c) for c in ("mean", "median", "sd", "min", "max")])


@query(
    f"""WITH toks AS (SELECT conv_id, unnest(list_concat({_TOK.format(c="string_agg(text, ' ' ORDER BY turn)")}, ['</s>'])) AS w FROM conversations GROUP BY conv_id),
own AS (SELECT conv_id, w, count(*) AS m FROM toks GROUP BY 1, 2), corpus AS (SELECT w, sum(m) AS c FROM own GROUP BY 1), tot AS (SELECT sum(c) AS total, count(*) FILTER (w <> '</s>') + 2 AS types FROM corpus),
j AS (SELECT own.*, c, (m = c AND own.w <> '</s>') AS alone FROM own JOIN corpus ON own.w = corpus.w),
s AS (SELECT conv_id, sum(m) AS steps, count(*) FILTER (alone) AS gone FROM j GROUP BY 1)
SELECT j.conv_id, CAST(s.steps AS BIGINT) AS steps, round(exp(-sum(m * ln((CASE WHEN alone THEN 0 ELSE c - m END + 0.5) / (total - s.steps + 0.5 * (types - gone)))) / s.steps), 5) AS perplexity
FROM j JOIN s USING (conv_id) CROSS JOIN tot GROUP BY j.conv_id, s.steps"""
)
def loo_unigram_perplexity(spark, d):
    c = t(spark, d, "conversations")
    whole = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("x")).select("conv_id", T.tokens(F.array_join("x", " ")).alias("tokens"))
    return LM.leave_one_out_unigram(whole, "conv_id").select("conv_id", F.col("steps").cast("long").alias("steps"), F.round("perplexity", 5).alias("perplexity"))


@query(f"WITH x AS (SELECT doc_id, {_TOK.format(c='text')} AS k FROM documents) SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, CAST(len(list_distinct(k)) AS BIGINT) AS n_types, round(CASE WHEN len(k) > 0 THEN len(list_distinct(k)) / len(k) ELSE 0.0 END, 6) AS ttr FROM x")
def utterance_token_stats(spark, d):
    k = T.tokens("text")
    return t(spark, d, "documents").select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_types"), F.round(T.type_token_ratio(F.col("k")), 6).alias("ttr"))


@query(f"SELECT doc_id, {_chain('text', [(chr(92) + _SURFACE[0][0], _SURFACE[0][1]), *_SURFACE[1:]])} AS cleaned FROM documents")
def surface_clean(spark, d):
    return t(spark, d, "documents").select("doc_id", T.clean("text", "surface").alias("cleaned"))


def _sql_chain(col: str, cleaner: str) -> str:
    """A cleaner as nested ``regexp_replace`` calls; its patterns have no look-around, so that both engines read them alike."""
    out = col
    for pattern, to in T.CLEANERS[cleaner]:
        out = f"regexp_replace({out}, '" + pattern.replace("'", "''") + "', '" + to.replace("$", chr(92)).replace("'", "''") + "', 'g')"
    return f"trim({out})"


_CLEAN = ("spoken", "plain", "training", "for_transcript", "natural", "child", "embedding", "raw_pair", "annotated_pair")
# text with the marks of the transcription format, put on top of the documents
_MARKED = "translate(text, 'áàâäãåéèêëíìîïóòôöõúùûüñçßÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncsAAAAAAEEEEIIIIOOOOOUUUUNC')"


def _ascii(spark, d):
    plain = F.translate("text", "áàâäãåéèêëíìîïóòôöõúùûüñçßÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncsAAAAAAEEEEIIIIOOOOOUUUUNC")
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("*CHI:\t<oh> [/] &-um "), F.regexp_replace(plain, r"[^\x20-\x7E]", " "), F.lit(" (be)cause [: went] [* m:+ed] 0det go:ed +... \x151_20\x15 [+ gram]")).alias("text"))


_ASCIISQL = f"a AS (SELECT doc_id, '*CHI:' || chr(9) || '<oh> [/] &-um ' || regexp_replace({_MARKED}, '[^\\x20-\\x7E]', ' ', 'g') || ' (be)cause [: went] [* m:+ed] 0det go:ed +... ' || chr(21) || '1_20' || chr(21) || ' [+ gram]' AS text FROM documents)"


@query(f"WITH {_ASCIISQL} SELECT doc_id, {', '.join(_sql_chain('text', c) + ' AS ' + c for c in _CLEAN)} FROM a")
def chat_normalize(spark, d):
    return _ascii(spark, d).select("doc_id", *[T.clean("text", c).alias(c) for c in _CLEAN])


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?]+\\s')) + 1 AS BIGINT) AS sentences FROM documents")
def sentence_count(spark, d):
    return t(spark, d, "documents").select("doc_id", T.sentence_marks("text").cast("long").alias("sentences"))


_SQUEEZED = "trim(regexp_replace(translate(text, '\u201c\u201d\u2018\u2019', '\"\"' || chr(39) || chr(39)), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, list_transform(list_filter(list_transform(string_split(regexp_replace({_SQUEEZED}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END) AS sentences FROM documents")
def sentence_split(spark, d):
    return t(spark, d, "documents").select("doc_id", T.sentences("text").alias("sentences"))


@query(f"SELECT doc_id, {_SQUEEZED} AS squeezed, trim(regexp_replace({_SQUEEZED}, '[\\s,.;:!?]+$', '')) AS bare, trim(regexp_replace(regexp_replace({_SQUEEZED}, '\\s*([.!?,])', ' \\1', 'g'), '\\s+', ' ', 'g')) AS spaced FROM documents")
def surface_helpers(spark, d):
    x = t(spark, d, "documents").select("doc_id", T.normal_surface("text").alias("squeezed"))
    return x.select("doc_id", "squeezed", T.strip_clause_edges("squeezed").alias("bare"), T.space_punctuation("squeezed").alias("spaced"))


@query()
def repeat_marking(spark, d):
    return t(spark, d, "documents").select("doc_id", T.mark_repeats("text").alias("marked"))


def _sql_parts(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(trim({x}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '')"


def _sql_spaced(p: str) -> str:
    return f"trim(regexp_replace(regexp_replace(CASE WHEN regexp_matches({p}, '[.!?]$') THEN {p} ELSE {p} || '.' END, '\\s*([,.;:!?])', ' \\1', 'g'), '\\s+', ' ', 'g'))"


def _sql_sentences(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[A-Za-z0-9]') THEN list_transform({_sql_parts(x)}, lambda p: {_sql_spaced('p')}) ELSE [] END"


_CLAUSE_END, _CLAUSE_START = "'[,:;.!?]+$'", "'^[,.;:!?]+\\s*'"

#: One quotation after the other is taken off the front of the text; the engine folds over its pieces instead.
QUOTED = f"""WITH RECURSIVE n AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '“”' || chr(1), '"" '), '\\s+', ' ', 'g')) AS t FROM documents),
r(doc_id, rest, lines, more) AS (SELECT doc_id, t, CAST([] AS VARCHAR[]), true FROM n
UNION ALL SELECT doc_id, CASE WHEN NOT closed THEN '' WHEN opened THEN regexp_replace(trim(after), {_CLAUSE_START}, '') ELSE trim(regexp_replace(trim(substr(ahead, length(first) + 1)), {_CLAUSE_START}, '')) END,
  list_concat(lines, CASE WHEN NOT closed THEN {_sql_sentences("plain")} ELSE list_concat(list_concat(list_filter(parts, lambda p: regexp_matches(p, '[.!?]$')),
    CASE WHEN opened AND regexp_matches(announced, '[A-Za-z0-9]') THEN [announced || ' +"/.'] ELSE [] END), list_concat(list_transform(list_filter({_sql_parts("said")}, lambda p: regexp_matches(p, '[A-Za-z0-9]')), lambda p: '+" ' || {_sql_spaced("p")}),
    CASE WHEN NOT opened AND regexp_matches(closing, '[A-Za-z0-9]') THEN [closing || ' +".'] ELSE [] END)) END), closed
FROM (SELECT *, trim(regexp_replace(trim(coalesce(parts[-1], '')), {_CLAUSE_END}, '')) AS announced, replace(trim(regexp_replace(trim(first), {_CLAUSE_END}, '')), '"', '') AS closing
  FROM (SELECT *, {_sql_parts("before")} AS parts, trim(before) <> '' AND NOT regexp_matches(trim(before), '[.!?]$') AS opened, trim(regexp_replace(trim(after), {_CLAUSE_START}, '')) AS ahead,
      CASE WHEN regexp_matches(trim(regexp_replace(trim(after), {_CLAUSE_START}, '')), '[.!?]\\s') THEN regexp_extract(trim(regexp_replace(trim(after), {_CLAUSE_START}, '')), '^(.*?[.!?])\\s', 1) ELSE trim(regexp_replace(trim(after), {_CLAUSE_START}, '')) END AS first
    FROM (SELECT *, split_part(rest, '"', 1) AS before, split_part(rest, '"', 2) AS said, substr(rest, length(split_part(rest, '"', 1)) + length(split_part(rest, '"', 2)) + 3) AS after, length(rest) - length(replace(rest, '"', '')) >= 2 AS closed, trim(replace(rest, '"', ' ')) AS plain FROM r WHERE more))))
SELECT doc_id, list_filter(lines, lambda x: x <> '') AS lines FROM r WHERE NOT more"""


@query(QUOTED)
def quoted_utterances(spark, d):
    return t(spark, d, "documents").select("doc_id", quote_lines("text").alias("lines"))


_TAG = "<([a-z0-9]+)[ >]"


@query(f"SELECT page_id, code, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS code FROM pages) GROUP BY 1, 2")
def marker_counts(spark, d):
    return A.code_counts(t(spark, d, "pages"), "page_id", "html", _TAG)


@query(f"""SELECT page_id, {", ".join(f"CAST(count(*) FILTER (code = '{c}') AS BIGINT) AS {c}" for c in ("a", "li", "p", "title"))} FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS code FROM pages) GROUP BY 1""")
def marker_counts_pivot(spark, d):
    m = marker_counts(spark, d)
    return m.groupBy("page_id").pivot("code", ["a", "li", "p", "title"]).agg(F.sum("n")).na.fill(0)


@query(f"""SELECT page_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (code IN ('p','a','h1')) AS BIGINT) AS body, CAST(count(*) FILTER (code IN ('li','ul')) AS BIGINT) AS lists,
CAST(count(*) FILTER (code NOT IN ('p','a','h1','li','ul')) AS BIGINT) AS other FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS code FROM pages) GROUP BY 1""")
def code_family_totals(spark, d):
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    body, lists = F.col("code").isin("p", "a", "h1"), F.col("code").isin("li", "ul")
    return marker_counts(spark, d).groupBy("page_id").agg(F.sum("n").alias("total"), s(body).alias("body"), s(lists).alias("lists"), s(~body & ~lists).alias("other"))


@query(f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS code FROM pages), g AS (SELECT page_id, count(*) FILTER (code = 'li') AS li, count(*) FILTER (code = 'p') AS p, count(*) FILTER (code = 'script') AS s FROM c GROUP BY 1)
SELECT page_id, round(CASE WHEN p > 0 THEN li / p ELSE 0.0 END, 6) AS li_per_p, round(CASE WHEN s > 0 THEN p / s ELSE NULL END, 6) AS p_per_script FROM g""")
def grouped_error_rates(spark, d):
    s = lambda c: F.coalesce(F.sum(F.when(F.col("code") == c, F.col("n"))), F.lit(0))
    g = marker_counts(spark, d).groupBy("page_id").agg(s("li").alias("li"), s("p").alias("p"), s("script").alias("s"))
    return g.select("page_id", F.round(safe_rate("li", "p", 0.0), 6).alias("li_per_p"), F.round(safe_rate("p", "s"), 6).alias("p_per_script"))


@query("""WITH x AS (SELECT d.lang, d.source, d.n_chars AS v, l.quality FROM documents d JOIN labels l USING (doc_id)),
k AS (SELECT * FROM (SELECT lang AS g, source AS s, v, quality FROM x UNION ALL SELECT lang, '*', v, quality FROM x UNION ALL SELECT '*', '*', v, quality FROM x)),
r AS (SELECT g, s, count(*) AS n_real, quantile_cont(v, 0.5) AS real_median, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM k WHERE quality = 1 GROUP BY 1, 2)
SELECT k.g, k.s, CAST(n_real AS BIGINT) AS n_real, real_median, CAST(count(*) AS BIGINT) AS n_synthetic, quantile_cont(v, 0.5) AS synthetic_median, round(avg(CASE WHEN lo IS NULL THEN NULL WHEN v BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS share_in_iqr,
round(CASE WHEN real_median <> 0 THEN quantile_cont(v, 0.5) / real_median END, 6) AS median_ratio FROM k LEFT JOIN r ON k.g = r.g AND k.s = r.s WHERE quality = 0 GROUP BY k.g, k.s, n_real, real_median""")
def slice_rollup(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    out = slice_summary(x.where("quality = 1"), x.where("quality = 0"), "lang", "source", "n_chars")
    return out.select("g", "s", "n_real", "real_median", "n_synthetic", "synthetic_median", F.round("share_in_iqr", 6).alias("share_in_iqr"), F.round("median_ratio", 6).alias("median_ratio"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS max FROM documents GROUP BY lang")
def distribution_summary(spark, d):
    s = describe(t(spark, d, "documents"), "n_chars", ["lang"])
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("""WITH q AS (SELECT source, quantile_cont(n_chars, 0.25) AS lo, quantile_cont(n_chars, 0.75) AS hi, quantile_cont(n_chars, 0.5) AS m FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT d.source, round(avg(CASE WHEN n_chars BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS share, round(quantile_cont(n_chars, 0.5) / any_value(m), 6) AS median_ratio FROM documents d JOIN q USING (source) WHERE lang <> 'en' GROUP BY 1""")
def share_within_iqr(spark, d):
    docs = t(spark, d, "documents")
    p = lambda x: F.percentile("n_chars", F.lit(x))
    q = docs.where("lang = 'en'").groupBy("source").agg(p(0.25).alias("lo"), p(0.75).alias("hi"), p(0.5).alias("m"))
    j = docs.where("lang <> 'en'").join(q, "source")
    return j.groupBy("source").agg(F.round(F.avg(F.col("n_chars").between(F.col("lo"), F.col("hi")).cast("int")), 6).alias("share"), F.round(p(0.5) / F.first("m"), 6).alias("median_ratio"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, first(id ORDER BY round(s, 12) DESC, id) AS nearest_id, round(max(s), 6) AS nearest, round(avg(s), 6) AS mean, round(avg(s) FILTER (s >= 0), 6) AS mean_nonnegative FROM s GROUP BY 1""")
def embedding_nn(spark, d):
    e = t(spark, d, "embeddings")
    n = R.embedding_neighbours(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", "label")
    return n.select("query_id", "nearest_id", *[F.round(c, 6).alias(c) for c in ("nearest", "mean", "mean_nonnegative")])


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2)
SELECT vec_id, round(sum(CAST(v AS DOUBLE) * m) / sqrt(sum(CAST(v AS DOUBLE) * v) * sum(m * m)), 6) AS similarity FROM x JOIN c USING (label, i) GROUP BY vec_id""")
def centroid_similarity(spark, d):
    e = t(spark, d, "embeddings")
    c = R.centroids(e.select("label", F.transform("embedding", lambda v: v.cast("double")).alias("embedding")), "label", "embedding")
    return e.join(F.broadcast(c), "label").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))  # one row a label


_TERMS = "WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark), k AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w)"


@query(_TERMS + """, tf AS (SELECT item_id, term, count(*) AS tf FROM k GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark),
x AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN n), u AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM x),
s AS (SELECT a.item_id AS query_id, b.item_id AS id, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY 1, 2)
SELECT query_id, first(id ORDER BY round(s, 9) DESC, id) AS nearest_id, round(max(s), 6) AS nearest, round(sum(s), 6) AS total FROM s GROUP BY 1""")
def tfidf_nn(spark, d):
    b = t(spark, d, "benchmark").select("item_id", words_and_pairs("text").alias("terms"))
    w = R.tfidf(b, "item_id", "terms")
    return R.tfidf_neighbours(w, w, "item_id").select("query_id", "nearest_id", F.round("nearest", 6).alias("nearest"), F.round("total", 6).alias("total"))


@query()
def unit_scores(spark, d):
    """What the assistant says of each conversation against what the user says, by a registered scorer."""
    said = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
    units = t(spark, d, "conversations").groupBy("conv_id").agg(*[F.transform(said(r), lambda u: u["text"]).alias(r) for r in ("user", "assistant")])
    return score_with(units, "conv_id", ["assistant", "user"], "unit-r-precision").select("conv_id", F.round("score", 6).alias("score"))


@query()
def rouge_l_nearest(spark, d):
    """The nearest benchmark item of each by ROUGE-L, through bounds; how many pairs were bounded and compared."""
    b = t(spark, d, "benchmark").select("item_id", T.tokens("text").alias("tokens"))
    return R.nearest_rouge(b, b, "item_id", "tokens")


@query()
def rouge_l_nn(spark, d):
    b = t(spark, d, "benchmark").select("item_id", T.tokens("text").alias("tokens"))
    return R.rouge_neighbours(b, "item_id", "tokens")


@query(f"""WITH x AS (SELECT item_id, list_distinct({_TOK.format(c='text')}) AS k FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.k, b.k)) / greatest(len(list_distinct(list_concat(a.k, b.k))), 1), 6) AS jaccard FROM x a JOIN x b ON a.item_id < b.item_id""")
def lemma_jaccard(spark, d):
    x = t(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens("text")).alias("k"))
    a, b = x.select(F.col("item_id").alias("a"), F.col("k").alias("ka")), x.select(F.col("item_id").alias("b"), F.col("k").alias("kb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(T.jaccard(F.col("ka"), F.col("kb")), 6).alias("jaccard"))


@query("SELECT conv_id, first(role ORDER BY turn) AS first_role, string_agg(role, '|' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordered_concat(spark, d):
    return J.first_and_list(t(spark, d, "conversations").withColumn("first_role", F.col("role")), ["conv_id"], "turn", ["first_role"], "role", "roles")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS story FROM conversations")
def story_forward_fill(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w).alias("story"))


def _as_files(spark, d, code=None):
    """Conversations as transcripts: user turns by the child, assistant turns by an investigator, every third turn a story mark."""
    c = t(spark, d, "conversations")
    mark = F.lit("") if code is None else F.coalesce(code, F.lit(""))
    line = F.concat(F.when(F.col("role") == "user", "*CHI:\t").otherwise("*INV:\t"), F.regexp_replace("text", r"\s+", " "), mark, F.lit(" ."))
    tier = F.concat(F.lit("\n%umor:\t"), F.array_join(F.transform(T.tokens("text"), lambda w: F.concat(F.when(F.length(w) % 3 == 0, "verb|").otherwise("noun|"), w, F.when(F.length(w) % 2 == 0, "-Fin-Ind-Past-S3").otherwise(""))), " "))
    gra = F.concat(F.lit("\n%ugra:\t"), F.array_join(F.transform(T.tokens("text"), lambda w, i: F.concat((i + 1).cast("string"), F.lit("|"), i.cast("string"), F.when(i == 0, "|ROOT").when(F.length(w) % 4 == 0, "|NSUBJ").otherwise("|OBJ"))), " "))
    cells = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("@G:\tA"), (F.col("turn") / 3 + 1).cast("int").cast("string"), F.lit("\n"))).otherwise(""), line, tier, gra).alias("l"))))
    return c.groupBy("conv_id").agg(F.concat(F.lit("@UTF8\n@Begin\n@ID:\teng|X|CHI|4;06.15|male|TD||Target_Child|||\n"), F.array_join(F.transform(cells, lambda x: x["l"]), "\n"), F.lit("\n@End\n")).alias("content")).select(F.concat(F.lit("/TD/"), F.col("conv_id").cast("string"), F.lit(".cha")).alias("path"), "content")


_TURNS = f"u AS (SELECT conv_id, turn, text, {_TOK.format(c='text')} AS k FROM conversations WHERE role = 'user')"


@query(f"""WITH {_TURNS}, a AS (SELECT conv_id, len(k) AS n, len(list_filter(k[2:], lambda w: len(w) % 4 = 0)) AS subj, len(list_filter(k[2:], lambda w: len(w) % 4 <> 0)) AS obj, len(list_filter(k, lambda w: len(w) % 6 = 0)) AS fin FROM u),
g AS (SELECT conv_id, count(*) AS total, count(*) FILTER (n > 0) AS ok, coalesce(sum(n), 0) AS toks, coalesce(sum(n - 1) FILTER (n > 0), 0) AS arcs, coalesce(sum(n * (n - 1) / 2) FILTER (n > 0), 0) AS depth, max(n) AS longest, count(*) FILTER (subj > 0) AS subj, count(*) FILTER (obj > 0) AS obj, coalesce(sum(fin), 0) AS fin FROM a GROUP BY conv_id)
SELECT '/TD/' || conv_id || '.cha' AS path, CAST(ok AS DOUBLE) AS Syntax_Utts_Analyzed, CAST(toks AS DOUBLE) AS Syntax_Tokens_Analyzed, CAST(CASE WHEN arcs > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS Syntax_Mean_DepLen, CAST(CASE WHEN arcs > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS Syntax_Max_DepLen, CASE WHEN toks > 0 THEN depth / toks ELSE 0.0 END AS Syntax_Mean_TreeDepth, CAST(greatest(longest - 1, 0) AS DOUBLE) AS Syntax_Max_TreeDepth,
0.0::DOUBLE AS Syntax_Subordination_Utt_Prop, 0.0::DOUBLE AS Syntax_Coordination_Utt_Prop, CASE WHEN ok > 0 THEN subj / ok ELSE 0.0 END AS Syntax_Subject_Utt_Prop, CASE WHEN ok > 0 THEN obj / ok ELSE 0.0 END AS Syntax_Object_Utt_Prop, 0.0::DOUBLE AS Syntax_AuxCop_Utt_Prop, 0.0::DOUBLE AS Syntax_Oblique_Utt_Prop, 0.0::DOUBLE AS Syntax_ComplexNP_Utt_Prop, CASE WHEN ok > 0 THEN fin / ok ELSE 0.0 END AS Syntax_FiniteVerb_Tokens_per_Utt,
total AS chi_blocks_total, ok AS chi_blocks_analyzed, total - ok AS chi_blocks_skipped_missing_tiers, CAST(0 AS BIGINT) AS chi_blocks_skipped_parse_errors, CAST(0 AS BIGINT) AS chi_blocks_skipped_token_mismatch FROM g""")
def syntax_features(spark, d):
    return A.syntax_table(chat.utterances(chat.lines_of(_as_files(spark, d))))


@query("""SELECT '/TD/' || conv_id || '.cha' AS path, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS child, CAST(count(*) FILTER (role <> 'user') AS BIGINT) AS others FROM conversations GROUP BY conv_id""")
def speaker_blocks(spark, d):
    u = chat.utterances(chat.lines_of(_as_files(spark, d)))
    return u.groupBy("path").agg(F.count_if(F.col("speaker") == "CHI").alias("child"), F.count_if(F.col("speaker") != "CHI").alias("others"))


_STORY_SQL = "m AS (SELECT conv_id, turn, text, role, 'A' || last_value(CASE WHEN turn % 3 = 0 THEN CAST(floor(turn / 3) + 1 AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS story_id FROM conversations)"
_UNIT = _sql_chain("regexp_replace(text, '\\s+', ' ', 'g') || ' .'", "surface")


@query(f"""WITH {_STORY_SQL}, s AS (SELECT conv_id, story_id, turn, {_UNIT} AS u FROM m WHERE role = 'user' AND story_id IS NOT NULL), g AS (SELECT conv_id, story_id, count(*) AS n, string_agg(u, ' ' ORDER BY turn) AS story_text FROM s WHERE u <> '' GROUP BY 1, 2),
k AS (SELECT *, list_filter(list_transform(regexp_extract_all(story_text, '[A-Za-z0-9'']+'), lambda x: lower(x)), lambda x: x NOT IN ('xxx', 'xx', 'yyy', 'yy', 'www') AND NOT regexp_matches(x, '^[0-9]+$')) AS k FROM g)
SELECT '/TD/' || conv_id || '.cha' AS path, story_id, CAST(n AS INTEGER) AS story_unit_count, story_text, CAST(len(k) AS BIGINT) AS n_tokens FROM k""")
def story_narratives(spark, d):
    n = chat.narratives(_as_files(spark, d))
    return n.select("path", "story_id", "story_unit_count", "story_text", F.size("tokens").cast("long").alias("n_tokens"))


@query("SELECT '/TD/' || conv_id || '.cha' AS path, CAST(4 + 5 * count(*) + count(*) FILTER (turn % 3 = 0) AS BIGINT) AS n, CAST(4 + 5 * count(*) + count(*) FILTER (turn % 3 = 0) - 1 AS INTEGER) AS last FROM conversations GROUP BY conv_id")
def tier_repairs(spark, d):
    """Every block gets two tiers, and lines are numbered anew."""
    lines = chat.lines_of(_as_files(spark, d))
    out = L.insert_missing_tiers(L.normalise_quote_ends(L.normalise_pauses(lines)))
    return out.groupBy("path").agg(F.count("*").alias("n"), F.max("line_no").cast("int").alias("last"))


@query(f"""WITH {_TURNS}, g AS (SELECT conv_id, sum(len(list_filter(k, lambda w: len(w) % 6 = 0))) AS fin, count(*) FILTER (turn % 4 = 0) AS over, count(*) FILTER (turn % 4 = 2) AS bare FROM u GROUP BY conv_id)
SELECT '/TD/' || conv_id || '.cha' AS path, CAST(fin AS BIGINT) AS overt_past_finite_verbs, CAST(bare AS BIGINT) AS bare_past_error_tokens, CAST(over AS BIGINT) AS past_overgeneralization_errors, CAST(fin + bare AS BIGINT) AS past_verb_opportunities, round(CASE WHEN fin + bare > 0 THEN over / (fin + bare) ELSE 0.0 END, 6) AS past_overgeneralization_rate FROM g""")
def past_verb_rates(spark, d):
    """Every fourth turn of the child over-applies the past, every other even one lacks it."""
    code = F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, " [* m:=ed]").when(F.col("turn") % 4 == 2, " [* m:0ed]")).otherwise(F.lit(None))
    lines = chat.lines_of(_as_files(spark, d, code))
    out = A.past_verbs(chat.utterances(lines), A.code_counts(lines.where(F.col("line").startswith("*CHI:")), "path", "line"))
    return out.withColumn("past_overgeneralization_rate", F.round("past_overgeneralization_rate", 6))


_CODES = ["m:+ed", "m:=ed", "m:0ed", "s:r:gc:pro", "s:r:gc:det", "p:w", "d:x"]


def _coded(spark, d):
    """Customers as speakers, their orders as annotated lines."""
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("o_orderkey") % 9).cast("int"))
    line = F.concat(F.lit("*CHI:\tit goed"), F.when(code.isNotNull(), F.concat(F.lit(" [* "), code, F.lit("]"))).otherwise(""), F.lit(" ."))
    return t(spark, d, "orders").select(F.col("o_custkey").alias("path"), line.alias("line"))


_CODED = "c AS (SELECT o_custkey AS path, CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END AS code FROM orders)"


@query(f"WITH {_CODED} SELECT path, CAST(count(*) AS BIGINT) AS chi_utterances, CAST(count(code) AS BIGINT) AS chi_utterances_with_error_code, CAST(count(code) AS BIGINT) AS error_total_annotations, CAST(count(*) FILTER (code LIKE 'm:%') AS BIGINT) AS error_morphology_total, CAST(count(*) FILTER (code LIKE 's:%') AS BIGINT) AS error_syntax_total, CAST(count(*) FILTER (code LIKE 'p:%') AS BIGINT) AS error_phonology_total, CAST(count(*) FILTER (code LIKE 'd:%') AS BIGINT) AS error_other_total FROM c GROUP BY path")
def error_code_table(spark, d):
    return A.error_table(_coded(spark, d))


@query(f"WITH {_CODED}, g AS (SELECT path, count(*) AS n, count(*) FILTER (code = 'm:0ed') AS b, count(*) FILTER (code = 's:r:gc:det') AS de, count(*) FILTER (code = 's:r:gc:pro') AS pr, count(*) FILTER (code IN ('m:+ed', 'm:=ed')) AS ru FROM c GROUP BY path) SELECT path, CAST(n AS BIGINT) AS utterances, CAST(b AS BIGINT) AS bare_marking_errors, CAST(de AS BIGINT) AS determiner_errors, CAST(pr AS BIGINT) AS pronoun_errors, CAST(ru AS BIGINT) AS rule_generalization_errors, round(b / n, 6) AS bare_marking_errors_per_utt, round(de / n, 6) AS determiner_errors_per_utt, round(pr / n, 6) AS pronoun_errors_per_utt, round(ru / n, 6) AS rule_generalization_errors_per_utt FROM g")
def grouped_error_table(spark, d):
    x = _coded(spark, d)
    return A.grouped_errors(A.code_counts(x, "path", "line"), x.groupBy("path").agg(F.count("*").alias("utterances")), "path", "utterances")


@query(f"WITH {_CODED} SELECT path, " + ", ".join(f"CAST(count(*) FILTER (code = '{c}') AS BIGINT) AS {n}" for c, n in (("m:+ed", "err_m_c_plus_ed"), ("m:=ed", "err_m_c_eq_ed"), ("p:w", "err_p_c_w"))) + " FROM c WHERE code IS NOT NULL GROUP BY path")
def wide_error_codes(spark, d):
    return A.wide_codes(A.code_counts(_coded(spark, d), "path", "line"), "path", ["err_m_c_plus_ed", "err_m_c_eq_ed", "err_p_c_w"])


@query(f"WITH {_CODED}, n AS (SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1) SELECT code, n, CAST(row_number() OVER (ORDER BY n DESC, code) AS INTEGER) AS place FROM n")
def most_common_codes(spark, d):
    from pyspark.sql.window import Window

    from ..operators.audit import most_common

    n = A.code_counts(_coded(spark, d), "path", "line").groupBy("code").agg(F.sum("n").alias("n"))
    return most_common(n, "n", "code").withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "code")))  # one row a code


@query("""WITH RECURSIVE e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
hot AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND b.vec_id < a.vec_id WHERE list_cosine_similarity(a.v, b.v) > 0.3),
g(label, k, kept) AS (SELECT DISTINCT label, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM e UNION ALL SELECT g.label, e.k, CASE WHEN EXISTS (SELECT 1 FROM hot WHERE hot.a = e.vec_id AND list_contains(g.kept, hot.b)) THEN g.kept ELSE list_append(g.kept, e.vec_id) END FROM g JOIN e ON e.label = g.label AND e.k = g.k + 1)
SELECT label, unnest(kept) AS vec_id FROM (SELECT label, kept, row_number() OVER (PARTITION BY label ORDER BY k DESC) AS last FROM g) WHERE last = 1""")
def near_duplicate_greedy(spark, d):
    return R.greedy_distinct(t(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3)


_FOLDS = "l AS (SELECT doc_id, quality, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents JOIN labels USING (doc_id)), o AS (SELECT *, (strpos('0123456789abcdef', h[1]) - 1) * 16 + strpos('0123456789abcdef', h[2]) - 1 AS part FROM l), f AS (SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality, part ORDER BY h) + part) % 5 AS INTEGER) AS fold FROM o)"
_CHAR_GRAMS = "w AS (SELECT doc_id, fold, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM documents JOIN f USING (doc_id)), g AS (SELECT DISTINCT doc_id, fold, unnest(CASE WHEN length(w) >= n THEN list_transform(range(1, CAST(length(w) - n + 2 AS BIGINT)), lambda i: substr(w, i, n)) ELSE [] END) AS term FROM w, (VALUES (3), (4), (5)) k(n))"


@query(f"""WITH {_FOLDS}, {_CHAR_GRAMS}, n AS (SELECT fold, count(*) AS held, sum(count(*)) OVER () - count(*) AS n FROM f GROUP BY 1), c AS (SELECT term, fold, count(*) AS d FROM g GROUP BY 1, 2), a AS (SELECT term, sum(d) AS d FROM c GROUP BY 1),
v AS (SELECT n.fold, n.n, a.term, a.d - coalesce(c.d, 0) AS df FROM a CROSS JOIN n LEFT JOIN c ON c.term = a.term AND c.fold = n.fold)
SELECT fold, length(term) AS size, CAST(df AS BIGINT) AS df, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf, CAST(count(*) AS BIGINT) AS terms FROM v WHERE df >= 2 GROUP BY 1, 2, 3, 4""")
def detectability_vocabulary(spark, d):
    """The vocabulary of each fold, by length of term and document frequency."""
    rows = X.stratified_folds(_gram_rows(spark, d).select("doc_id", "quality", "text"), "doc_id", ["quality"], 5)
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row a fold
    if not sizes:
        return spark.createDataFrame([], "fold int, size long, df long, idf double, terms long")
    index = X.gram_index(X.gram_holders(rows, "doc_id", "text", R.word_char_ngrams), sizes)
    per = F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"df{f}").alias("df"), F.round(f"idf{f}", 9).alias("idf")) for f in sorted(sizes)]))
    return index.select(F.length("term").cast("long").alias("size"), per).where("idf IS NOT NULL").groupBy("fold", "size", "df", "idf").agg(F.count("*").alias("terms"))


def _gram_rows(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("grams", R.word_char_ngrams(F.col("text")))


@query()
def detectability_report(spark, d):
    """All texts judged by models of the other folds, in one row."""
    p = X.told_apart(_gram_rows(spark, d), "doc_id", "grams", "quality", text="text")
    r = X.detectability_summary(p, "quality", spark)
    return r.select("ran", "n_rows", "n_splits", *[F.round(c, 3).alias(c) for c in r.columns[3:]])


@query()
def detectability_auc(spark, d):
    out = detectability(_gram_rows(spark, d), "doc_id", "grams", "quality", text="text")
    return out.select("fold", F.round("auc", 3).alias("auc"), F.round("accuracy", 3).alias("accuracy"))


@query("""WITH m AS (SELECT l_returnflag AS g, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem GROUP BY 1), r AS (SELECT * FROM m WHERE g = 'A')
SELECT m.g AS l_returnflag, round(sqrt((m.a - r.a) ** 2 + (m.b - r.b) ** 2 + (m.c - r.c) ** 2), 6) AS distance FROM m CROSS JOIN r""")
def centroid_to_target(spark, d):
    out = centroid_distance(t(spark, d, "lineitem"), "l_returnflag", "A", ["l_quantity", "l_discount", "l_tax"])
    return out.select("l_returnflag", F.round("distance", 6).alias("distance"))


@query("SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def slice_counts(spark, d):
    return t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)copyright|license')) > 0 AS INTEGER) AS flagged FROM documents WHERE n_chars BETWEEN 100 AND 5000 AND NOT regexp_matches(text, '(?i)all rights reserved')")
def phrase_filter(spark, d):
    x = t(spark, d, "documents").where(F.col("n_chars").between(100, 5000) & ~F.col("text").rlike("(?i)all rights reserved"))
    return x.select("doc_id", F.col("text").rlike("(?i)copyright|license").cast("int").alias("flagged"))


@query("SELECT doc_id, lower(regexp_replace(source || ':' || lang, '[^0-9A-Za-z]+', '_', 'g')) AS name FROM documents")
def safe_names(spark, d):
    return t(spark, d, "documents").select("doc_id", F.lower(T.safe_name(F.concat_ws(":", "source", "lang"))).alias("name"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY CASE WHEN n_chars > 2000 THEN 0 ELSE 1 END, doc_id DESC) AS k FROM documents) SELECT source, lang, doc_id FROM r WHERE k = 1")
def dedupe_prefer_split(spark, d):
    return J.prefer(t(spark, d, "documents"), ["source", "lang"], F.col("n_chars") > 2000, "doc_id").select("source", "lang", "doc_id")


def _short(spark, d):
    """Conversations as told stories: what the user says, in six slices, four in five of them real."""
    c = t(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("x"))
    text = F.array_join("x", " ")
    return c.select("conv_id", (F.col("conv_id") % 2).alias("grp"), (F.col("conv_id") % 3).alias("story_id"), text.alias("text"), T.tokens(text).alias("tokens"), (F.col("conv_id") % 5 != 1).alias("real"))


_SHORT = f"s AS (SELECT conv_id, conv_id % 2 AS grp, conv_id % 3 AS story_id, string_agg(text, ' ' ORDER BY turn) AS text, conv_id % 5 <> 1 AS real FROM conversations WHERE role = 'user' GROUP BY conv_id), k AS (SELECT *, {_TOK.format(c='text')} AS k FROM s)"
# additive bigrams of the slice; own counts are taken off where ``own``
_BIGRAMS = "p AS (SELECT conv_id, grp, story_id, real, unnest(list_concat(['<s>'], k)) AS a, unnest(list_concat(k, ['</s>'])) AS b FROM k), m AS (SELECT conv_id, grp, story_id, real, a, b, count(*) AS m FROM p GROUP BY ALL), c AS (SELECT grp, story_id, a, b, sum(m) AS c FROM m WHERE real GROUP BY ALL), h AS (SELECT grp, story_id, a, sum(c) AS n FROM c GROUP BY ALL), oh AS (SELECT conv_id, a, sum(m) AS hm FROM m GROUP BY ALL), ty AS (SELECT DISTINCT conv_id, grp, story_id, b AS w FROM p WHERE real AND b <> '</s>'), tw AS (SELECT grp, story_id, w, count(*) AS texts FROM ty GROUP BY ALL), v AS (SELECT grp, story_id, count(*) AS types FROM tw GROUP BY ALL), gone AS (SELECT conv_id, count(*) AS gone FROM ty JOIN tw USING (grp, story_id, w) WHERE texts = 1 GROUP BY 1)"


@query(f"WITH {_SHORT}, {_BIGRAMS} SELECT m.conv_id, round(exp(-sum(m * ln((coalesce(c, 0) - m + 0.5) / (coalesce(n, 0) - hm + 0.5 * (types - coalesce(gone, 0) + 2)))) / sum(m)), 5) AS perplexity FROM m LEFT JOIN c USING (grp, story_id, a, b) LEFT JOIN h USING (grp, story_id, a) JOIN oh ON oh.conv_id = m.conv_id AND oh.a = m.a JOIN v USING (grp, story_id) LEFT JOIN gone ON gone.conv_id = m.conv_id WHERE real GROUP BY m.conv_id")
def loo_bigram_perplexity(spark, d):
    real = _short(spark, d).where("real")
    return additive_perplexity(real, real, ["grp", "story_id"], "conv_id", "tokens", 2, True).select("conv_id", F.round("perplexity", 5).alias("perplexity"))


@query(f"WITH {_SHORT}, {_BIGRAMS} SELECT m.conv_id, round(exp(-sum(m * ln((coalesce(c, 0) + 0.5) / (coalesce(n, 0) + 0.5 * (types + 2)))) / sum(m)), 5) AS perplexity FROM m LEFT JOIN c USING (grp, story_id, a, b) LEFT JOIN h USING (grp, story_id, a) JOIN v USING (grp, story_id) WHERE NOT real GROUP BY m.conv_id")
def slice_bigram_perplexity(spark, d):
    x = _short(spark, d)
    return additive_perplexity(x.where("real"), x.where("not real"), ["grp", "story_id"], "conv_id", "tokens", 2, False).select("conv_id", F.round("perplexity", 5).alias("perplexity"))


_WEIGHTS = "x AS (SELECT conv_id, grp, story_id, real, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM k), e AS (SELECT conv_id, grp, story_id, real, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM x), tf AS (SELECT conv_id, grp, story_id, real, term, count(*) AS tf FROM e GROUP BY ALL), df AS (SELECT grp, story_id, term, count(*) AS df FROM tf WHERE real GROUP BY ALL), nn AS (SELECT grp, story_id, count(*) AS n, min(conv_id) AS low, max(conv_id) AS high FROM k WHERE real GROUP BY ALL), w0 AS (SELECT conv_id, grp, story_id, real, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (grp, story_id, term) JOIN nn USING (grp, story_id)), w1 AS (SELECT conv_id, grp, story_id, real, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id)) AS w FROM w0), sim AS (SELECT a.conv_id, b.conv_id AS other, round(sum(a.w * b.w), 12) AS s FROM w1 a JOIN w1 b ON a.grp = b.grp AND a.story_id = b.story_id AND a.term = b.term AND b.real AND a.conv_id <> b.conv_id GROUP BY ALL), best AS (SELECT conv_id, first(other ORDER BY s DESC, other) AS best, max(s) AS top, sum(s) AS total FROM sim GROUP BY 1), near AS (SELECT k.conv_id, k.grp, k.story_id, k.real, len(k) AS token_count, CASE WHEN len(k) > 0 THEN len(list_distinct(k)) / len(k) ELSE 0.0 END AS ttr, n - CASE WHEN k.real THEN 1 ELSE 0 END AS n_ref, coalesce(best, CASE WHEN k.real AND low = k.conv_id THEN high ELSE low END) AS nearest_id, coalesce(top, 0.0) AS nearest, coalesce(total, 0.0) / (n - CASE WHEN k.real THEN 1 ELSE 0 END) AS mean FROM k JOIN nn USING (grp, story_id) LEFT JOIN best ON best.conv_id = k.conv_id)"
_PPL = "ppl AS (SELECT m.conv_id, exp(-sum(m * ln((coalesce(c, 0) - CASE WHEN m.real THEN m ELSE 0 END + 0.5) / (coalesce(n, 0) - CASE WHEN m.real THEN hm ELSE 0 END + 0.5 * (types - CASE WHEN m.real THEN coalesce(gone, 0) ELSE 0 END + 2)))) / sum(m)) AS bigram FROM m LEFT JOIN c USING (grp, story_id, a, b) LEFT JOIN h USING (grp, story_id, a) JOIN oh ON oh.conv_id = m.conv_id AND oh.a = m.a JOIN v USING (grp, story_id) LEFT JOIN gone ON gone.conv_id = m.conv_id GROUP BY m.conv_id), t AS (SELECT near.*, bigram FROM near JOIN ppl USING (conv_id) JOIN (SELECT grp, story_id FROM k GROUP BY ALL HAVING bool_or(real) AND bool_or(NOT real)) USING (grp, story_id))"


@query(f"WITH {_SHORT}, {_BIGRAMS}, {_WEIGHTS}, {_PPL}, base AS (SELECT grp, story_id, quantile_cont(nearest, 0.5) AS near_mid, quantile_cont(bigram, 0.5) AS ppl_mid, avg(token_count) AS n_mid, avg(ttr) AS ttr_mid FROM t WHERE real GROUP BY ALL) SELECT conv_id, CAST(n_ref AS BIGINT) AS n_reference_real_texts, nearest_id AS nearest_real_id, round(nearest, 6) AS nearest_tfidf_cosine, round(mean, 6) AS mean_tfidf_cosine_to_real, round(bigram, 5) AS bigram_perplexity_vs_real, round(nearest - near_mid, 6) AS nearest_tfidf_minus_real_baseline_median, round(bigram / ppl_mid, 5) AS bigram_perplexity_over_real_baseline_median, round(token_count / n_mid, 6) AS token_count_over_real_mean, round(ttr / ttr_mid, 6) AS type_token_ratio_over_real_mean FROM t JOIN base USING (grp, story_id) WHERE NOT real")
def generated_text_metrics(spark, d):
    x = _short(spark, d)
    got, _ = text_metrics(x.where("real"), x.where("not real"), ["grp", "story_id"], "conv_id", "text", "tokens", ("terms", "bigram"))
    six = ("nearest_tfidf_cosine", "mean_tfidf_cosine_to_real", "nearest_tfidf_minus_real_baseline_median", "token_count_over_real_mean", "type_token_ratio_over_real_mean")
    return got.select("conv_id", "n_reference_real_texts", "nearest_real_id", *[F.round(c, 6).alias(c) for c in six], *[F.round(c, 5).alias(c) for c in ("bigram_perplexity_vs_real", "bigram_perplexity_over_real_baseline_median")])


_LEVELS = " UNION ALL ".join(
    f"SELECT '{level}' AS summary_level, {g} AS grp, {s} AS story_id, count(*) FILTER (NOT real) AS n_synthetic, count(*) FILTER (real) AS n_real_baseline, "
    + ", ".join(f"round(quantile_cont({c}, 0.5) FILTER ({'NOT ' * (side == 'synthetic')}real), 5) AS {side}_{n}_median" for n, c in (("token_count", "token_count"), ("type_token_ratio", "ttr"), ("nearest_tfidf", "nearest"), ("bigram_perplexity", "bigram")) for side in ("synthetic", "real"))
    + ", round(quantile_cont(bigram, 0.5) FILTER (NOT real) / quantile_cont(bigram, 0.5) FILTER (real), 5) AS ratio, quantile_cont(nearest, 0.25) FILTER (real) AS nlo, quantile_cont(nearest, 0.75) FILTER (real) AS nhi, quantile_cont(bigram, 0.25) FILTER (real) AS blo, quantile_cont(bigram, 0.75) FILTER (real) AS bhi "
    + f"FROM t {by}"
    for level, g, s, by in (("story", "CAST(grp AS VARCHAR)", "CAST(story_id AS VARCHAR)", "GROUP BY t.grp, t.story_id"), ("group", "CAST(grp AS VARCHAR)", "'ALL'", "GROUP BY t.grp"), ("overall", "'ALL'", "'ALL'", ""))
)


@query(f"WITH {_SHORT}, {_BIGRAMS}, {_WEIGHTS}, {_PPL}, l AS ({_LEVELS}) SELECT l.* EXCLUDE (ratio, nlo, nhi, blo, bhi), ratio AS synthetic_bigram_perplexity_over_real_median, round((SELECT avg(CASE WHEN nearest BETWEEN nlo AND nhi THEN 1.0 ELSE 0.0 END) FROM t WHERE NOT real AND (l.grp = 'ALL' OR CAST(t.grp AS VARCHAR) = l.grp) AND (l.story_id = 'ALL' OR CAST(t.story_id AS VARCHAR) = l.story_id)), 6) AS synthetic_nearest_tfidf_within_real_iqr_share, round((SELECT avg(CASE WHEN bigram BETWEEN blo AND bhi THEN 1.0 ELSE 0.0 END) FROM t WHERE NOT real AND (l.grp = 'ALL' OR CAST(t.grp AS VARCHAR) = l.grp) AND (l.story_id = 'ALL' OR CAST(t.story_id AS VARCHAR) = l.story_id)), 6) AS synthetic_bigram_perplexity_within_real_iqr_share FROM l")
def generated_text_report(spark, d):
    x = _short(spark, d)
    got, base = text_metrics(x.where("real"), x.where("not real"), ["grp", "story_id"], "conv_id", "text", "tokens", ("terms", "bigram"))
    out = slice_report(got, base)
    return out.select(*[F.round(c, 5).alias(c) if c.endswith("median") else F.round(c, 6).alias(c) if c.endswith("share") else F.col(c) for c in out.columns])


@query(_TRIGRAM_SQL.replace("WHERE role = 'user'),", "WHERE role = 'user' AND conv_id % 7 <> 3),", 1).split("SELECT tri.fold AS fold")[0] + f""", other AS (SELECT conv_id, turn, {_TOK.format(c="text")} AS toks FROM conversations WHERE role = 'user' AND conv_id % 7 = 3),
ot AS (SELECT conv_id, turn, unnest(list_concat(list_concat(['<s>', '<s>'], toks), ['</s>'])) AS w, generate_subscripts(list_concat(list_concat(['<s>', '<s>'], toks), ['</s>']), 1) AS i FROM other),
otri AS (SELECT f.fold, a.conv_id, a.w AS a, b.w AS b, c.w AS c FROM folds f CROSS JOIN ot a JOIN ot b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i = a.i + 1 JOIN ot c ON a.conv_id = c.conv_id AND a.turn = c.turn AND c.i = a.i + 2)
SELECT otri.fold AS fold, conv_id, CAST(count(*) AS BIGINT) AS token_count, round(exp(-sum(ln((coalesce(n, 0) + 0.5) / (coalesce(m, 0) + 0.5 * v))) / count(*)), 5) AS perplexity
FROM otri LEFT JOIN model ON model.k = otri.fold AND model.a = otri.a AND model.b = otri.b AND model.c = otri.c LEFT JOIN ctx ON ctx.k = otri.fold AND ctx.a = otri.a AND ctx.b = otri.b JOIN v ON v.k = otri.fold GROUP BY 1, 2""")
def synthetic_fold_perplexity(spark, d):
    said = _said(spark, d).groupBy("conv_id").agg(F.collect_list("tokens").alias("utterance_tokens")).withColumn("fold", F.col("conv_id") % 5)
    other = F.col("conv_id") % 7 == 3
    out = LM.fold_perplexity(said, "conv_id", "fold", 3, every_fold=other).where(other)
    return out.select("fold", "conv_id", F.col("token_count").cast("long").alias("token_count"), F.round("perplexity", 5).alias("perplexity"))
