"""Personal data: fixed patterns first, then candidates judged by gradient-boosted trees.

The base spans (mail addresses, IPv4 addresses, card and phone numbers) follow from patterns and checks alone and always stay.
Generators with a wide mesh then propose overlapping candidates: disguised addresses ("name at host dot org"), defanged IP
addresses, cards in unusual groups, phones without plus.  Each becomes a row of features of its format (digits, groups,
checksum, octets, marks) and of its context (neighbouring characters, cue words, capitals).  Trees boosted on the logistic loss
give a probability, calibrated by Platt scaling on documents that the trees have not seen, and per kind the threshold is the
least probability at which those documents show the wanted precision.  Accepted candidates are taken by falling probability
where they touch no span of theirs or of the base.

There are no labels of disguised data.  The trees learn from base spans of sampled documents: as they stand and rewritten the
ways people disguise them (positive), spoilt so that their check fails (negative), and from all other candidates there
(negative, at a quarter of the weight, since some of them may be personal data).
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_sample

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
NAMES = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "scores"]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, scores array<double>"

# ---------------------------------------------------------------- base spans
# Possessive runs and the look-behinds keep every scan linear; a match that they rule out would fail in the plain pattern too.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in span.split("."))


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order of start and kind."""
    found = [(s, EMAIL, e) for s, e in _emails(text)]
    found += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
    found += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


# ---------------------------------------------------------------- candidates
_AT = re.compile(r"@|[\[({<] ?[aA][tT] ?[\])}>]|(?<= )(?:at|AT)(?= )")
_DOT = r"(?: ?[\[({] ?(?:\.|dot|DOT) ?[\])}] ?| (?:dot|DOT) |\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}")
_BROAD = [
    (IP, re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,4}}(?:(?:{_DOT}|, ?)[0-9]{{1,4}}){{3}}(?![0-9])")),
    (CARD, re.compile(r"(?<![0-9])[0-9](?:[ ._/\u00a0-]{0,2}[0-9]){11,18}(?![0-9])")),
    (CARD, re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")),  # beside another number the one above takes both
    (CARD, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/\u00a0-]{1,2}[0-9]{4}){3}(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9A-Za-z])(?:\+ ?|00 ?)?\(?[0-9]{1,5}\)?(?:[ ./\u00a0-]{1,2}\(?[0-9]{2,8}\)?){1,5}(?![0-9A-Za-z])")),
    (PHONE, re.compile(r"(?<![0-9A-Za-z])(?:\+|00)[0-9]{1,3} ?\(?[0-9]{1,5}\)?[ ./\u00a0-]{1,2}[0-9]{3,4}(?:[ ./\u00a0-][0-9]{4})?(?![0-9A-Za-z])")),
]


def candidates(text: str):
    """(start, kind, end) of everything that the generators propose; spans of different kinds overlap."""
    for m in _AT.finditer(text):
        start = m.start()
        while start > m.start() - 2 and start and text[start - 1] == " ":
            start -= 1
        stop = max(0, start - 64)  # no longer local part is valid
        local = start
        while local > stop and text[local - 1] in _LOCAL_CHARS:
            local -= 1
        at = m.end()
        while at < m.end() + 2 and at < len(text) and text[at] == " ":
            at += 1
        host = _HOST.match(text, at) if local < start else None
        if host:
            yield local, EMAIL, host.end()
    seen: set = set()
    for kind, pattern in _BROAD:
        for m in pattern.finditer(text):
            if (kind != PHONE or 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 15) and (m.start(), kind, m.end()) not in seen:
                seen.add((m.start(), kind, m.end()))
                yield m.start(), kind, m.end()


#: Words before a span that tell its kind.
CUES = (
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo|escrib)"),
    re.compile(r"(?i)\b(?:ip|host|server|address|gateway|dns|adresse|servidor)\b"),
    re.compile(r"(?i)\b(?:card|visa|credit|debit|karte|carte|tarjeta|pan|account)\b"),
    re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|ring|telefon|t[eé]l[eé]fono?|anruf)"),
)
_GROUPS = re.compile(r"[0-9]+")
_MARKS = re.compile(r"[\[({]|\b(?:dot|DOT|at|AT)\b")
WIDTH = 32
FEATURES = 24


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start:end]
    groups = _GROUPS.findall(span)
    digits = "".join(groups)
    letters = sum(c.isalpha() for c in span)
    left, right = text[max(0, start - WIDTH) : start], text[end : end + WIDTH]
    context = left + right
    numbers = [int(g[-4:]) for g in groups] or [0]
    tail = re.split(r"[^A-Za-z0-9]+", span.rstrip("])}> "))[-1]
    separators = re.sub(r"[A-Za-z0-9]+", "", span)

    def near(c: str) -> float:
        return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isdigit() else 3.0 if c.isalpha() else 4.0

    return [
        float(kind),
        float(len(digits)),
        float(end - start),
        float(letters),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(max(numbers)),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(len(set(separators))),
        float(separators.count(" ")),
        float("@" in span),
        float(len(_MARKS.findall(span))),
        float(span.startswith("+") or span.startswith("00")),
        float("(" in span),
        float(len(tail)) if tail.isalpha() and tail.islower() else 0.0,
        float(span[:1].isupper()),
        near(left[-1:]),
        near(right[:1]),
        float(bool(CUES[kind].search(left[-24:]))),
        sum(c.isupper() for c in context) / max(len(context), 1),
        sum(c.isdigit() for c in context) / max(len(context), 1),
        float(len(set(digits))),
        float(any(c.isdigit() or c in "._" for c in re.split(r"@| ?[\[({<] ?(?i:at)| (?i:at) ", span)[0])) if kind == EMAIL else -1.0,
    ]


# ---------------------------------------------------------------- learning
def _disguised(kind: int, span: str, n: int) -> str:
    digits = _NOT_DIGIT.sub("", span)
    if kind == EMAIL:
        name, host = span.split("@", 1)
        at, dot = ((" at ", " dot "), ("[at]", "."), ("(at)", "(dot)"), (" @ ", "."), (" [at] ", "[.]"))[n % 5]
        return name + at + host.replace(".", dot)
    if kind == IP:
        return span.replace(".", ("[.]", "(.)", " dot ", "[dot]")[n % 4])
    if kind == CARD:
        return (".", "_", " ", "/", " - ")[n % 5].replace(" - ", "--").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = _GROUPS.findall(span)
    return ("-".join(groups), "00" + " ".join(groups), ".".join(groups), "(" + groups[0] + ") " + "-".join(groups[1:]) if len(groups) > 1 else span, "/".join(groups))[n % 5]


def _spoilt(kind: int, span: str, n: int) -> str:
    digits = _NOT_DIGIT.sub("", span)
    if kind == EMAIL:
        name, host = span.split("@", 1)
        return (_GROUPS.sub("", name).strip("._%+-") or "we") + " at " + _GROUPS.sub("", host.split(".")[0]).strip("-") + "." + ("The", "It", "And")[n % 3]
    if kind == IP:
        parts = span.split(".")
        return (".".join([*parts[:3], str(300 + n % 600)]), ", ".join(p[-2:] for p in parts), ".".join([str(256 + n % 700), *parts[1:]]))[n % 3]
    if kind == CARD:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + n % 9) % 10)
        return (wrong, " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), ".".join(wrong[i : i + 3] for i in range(0, len(wrong), 3)))[n % 3]
    return (f"{1900 + n % 130}-{1 + n % 12:02d}-{1 + n % 28:02d}", f"{1 + n % 28}.{1 + n % 12:02d}.{1900 + n % 130}", f"{digits[:2]} {digits[2:5]} {digits[5:7]}")[n % 3]


def examples(text: str) -> list[tuple[list[float], float, float]]:
    """(features, label, weight) that one document teaches."""
    found, base = [], base_spans(text)
    same = {(k, s, e) for s, k, e in base}
    for s, k, e in candidates(text):
        if (k, s, e) in same:
            found.append((features(text, s, k, e), 1.0, 1.0))
        elif not any(b[0] < e and s < b[2] for b in base):
            found.append((features(text, s, k, e), 0.0, 0.25))
    for s, k, e in base:
        n = zlib.crc32(text[s:e].encode())
        left, right = text[max(0, s - WIDTH) : s], text[e : e + WIDTH]
        for label, made in ((1.0, _disguised(k, text[s:e], n)), (1.0, _disguised(k, text[s:e], n // 5)), (0.0, _spoilt(k, text[s:e], n))):
            whole = left + made + right
            for cs, ck, ce in candidates(whole):
                if cs < len(left) + len(made) and ce > len(left):  # of another kind, or of a part of it: not what it is
                    right_one = ck == k and cs <= len(left) and ce >= len(left) + len(made) - 1
                    found.append((features(whole, cs, ck, ce), label * right_one, 1.0))
    return found


class BoostedTrees:
    """Second-order boosting of shallow trees on the logistic loss, over at most 32 bins a feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.a, self.c = 0.0, 1.0, 0.0
        self.thresholds = np.full(len(KINDS), np.inf)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            mid = (v[1:] + v[:-1]) / 2
            self.edges.append(mid if len(mid) < 32 else np.unique(mid[np.linspace(0, len(mid) - 1, 31).astype(int)]))
        b = self._bins(x)
        rate = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.start)
        nodes = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = w * (p - y), w * p * (1 - p)
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -self.rate * gs / (hs + self.ridge)
                best, split = 1e-6, None
                for f in range(x.shape[1]) if 2 * node + 2 < nodes else ():
                    n = len(self.edges[f]) + 1
                    if n < 2:
                        continue
                    gl, hl = (np.cumsum(np.bincount(b[rows, f], v[rows], n))[:-1] for v in (g, h))
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(hl < self.least * 0.1) | (hs - hl < self.least * 0.1)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, split = float(gain[i]), (f, i)
                if split:
                    feature[node], cut[node] = split
                    at[rows] = 2 * node + 1 + (b[rows, split[0]] > split[1])
            z += value[at]
            self.trees.append((feature, cut, value))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, z = self._bins(x), np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (b[every, np.maximum(f, 0)] > cut[at]), at)
            z += value[at]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, precision: float) -> BoostedTrees:
        """Platt scaling by Newton steps, then per kind the least probability from a half up with the wanted precision."""
        z = self.logits(x)
        a, c = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            g = np.array([(w * (p - y) * z).sum() + 1e-2 * (a - 1), (w * (p - y)).sum() + 1e-2 * c])
            v = w * p * (1 - p)
            m = np.array([[(v * z * z).sum() + 1e-2, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-2]])
            step = np.linalg.solve(m, g)
            a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -2, 2)
        self.a, self.c = float(max(a, 0.05)), float(c)
        p = self.probability(x)
        for kind in range(len(KINDS)):
            own = np.flatnonzero(x[:, 0] == kind)
            own = own[np.argsort(-p[own], kind="stable")]
            right, all_ = np.cumsum(w[own] * y[own]), np.cumsum(w[own])
            good = np.flatnonzero((right >= precision * all_) & (right > 0) & np.append(p[own][1:] != p[own][:-1], True)) if len(own) else own
            if len(good):  # half way to the next one, but not below a half
                least, below = p[own[good[-1]]], p[own[good[-1] + 1]] if good[-1] + 1 < len(own) else 0.0
                self.thresholds[kind] = max(0.5, (least + below) / 2)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.logits(x) + self.c, -30, 30)))


def fit_pii(docs: DataFrame, text: str = "text", sample: int = 20000, precision: float = 0.98) -> BoostedTrees | None:
    """Trees, calibration and thresholds from at most ``sample`` documents, chosen by a hash of their text (all, if there are
    fewer); a document in five, by another hash, calibrates.  None where the sample holds no base span or nothing else."""

    def run(batches):
        for b in batches:
            rows = [(*e, zlib.crc32(t.encode()) % 5 == 4) for t in b.column(0).to_pylist() for e in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), *(pa.array([float(r[i]) for r in rows], pa.float64()) for i in (1, 2, 3))], ["x", "y", "w", "late"])

    texts = bounded_sample(docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")), sample)
    got = texts.mapInArrow(run, "x array<double>, y double, w double, late double").orderBy("x", "y").toArrow()  # candidates of the sample
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, FEATURES)
    y, w, late = (got[c].to_numpy() for c in ("y", "w", "late"))
    early = late == 0
    if not 0 < (w * y)[early].sum() < w[early].sum():
        return None
    held = ~early if 0 < (w * y)[~early].sum() < w[~early].sum() else early
    return BoostedTrees().fit(x[early], y[early], w[early]).calibrate(x[held], y[held], w[held], precision)


def added_spans(text: str, base: list[tuple[int, int, int]], model: BoostedTrees | None) -> list[tuple[float, int, int, int]]:
    """(probability, start, kind, end) of the accepted candidates, most probable first; none touches another or the base."""
    proposed = sorted({c for c in candidates(text) if not any(b[0] < c[2] and c[0] < b[2] for b in _around(base, c))}) if model else []
    if not proposed:
        return []
    p = model.probability(np.array([features(text, *c) for c in proposed]))
    taken: list = []
    for q, (s, k, e) in sorted(((float(q), c) for q, c in zip(p, proposed) if q >= model.thresholds[c[1]]), key=lambda c: (-c[0], c[1])):
        taken.append((q, s, k, e))
    return _apart(taken)


def _around(base, c):
    """Base spans that may touch a candidate: those that start before its end, the last few of them."""
    from bisect import bisect_left

    at = bisect_left(base, (c[2],))
    return base[max(0, at - 2 * len(KINDS) - 40) : at]


def _apart(spans: list) -> list:
    from bisect import bisect_left, insort

    kept, starts, ends = [], [], []
    for p, s, k, e in spans:
        i = bisect_left(starts, e)  # spans that start before the end; the last of them ends last, as none overlap
        if i == 0 or ends[i - 1] <= s:
            insort(starts, s)
            ends.insert(starts.index(s), e)
            kept.append((p, s, k, e))
    return kept


def find_pii(docs: DataFrame, model: BoostedTrees | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, scores) of every row.

    The counts and ``base_sha256`` are those of the base spans; ``spans`` has all spans as kind:start:end by start, then kind
    (code points, end exclusive), ``n_added`` counts those that the trees added, ``scores`` has their probabilities in order of
    start.  Null texts are empty, an empty text has no spans, repeated rows get a row each, a null id is carried through; other
    columns are not looked at, an empty table gives no rows.  Without a model nothing is added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # rounds x 2^depth nodes

    def said(spans) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))

    def run(batches):
        trees = shared.value
        for b in batches:
            out: list = [[] for _ in NAMES]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                base = base_spans(t)
                more = added_spans(t, base, trees)
                row = [i, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(said(base).encode()).hexdigest(), said([*base, *(m[1:] for m in more)]), len(more), [m[0] for m in sorted(more, key=lambda m: m[1:])]]
                for column, v in zip(out, row):
                    column.append(v)
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], NAMES)

    return docs.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, model: BoostedTrees | None, text: str = "text", column: str = "redacted") -> DataFrame:
    """``docs`` with ``column``: the text with every span, base and added, replaced by its kind in angle brackets.  Spans that
    overlap are replaced together, by the kind that starts first.  A null text stays null; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def replaced(texts):
        def one(t):
            if t is None:
                return None
            base, out, end = base_spans(t), [], 0
            for s, k, e in sorted([*base, *(m[1:] for m in added_spans(t, base, shared.value))]):
                if s >= end:
                    out += [t[end:s], f"<{KINDS[k]}>"]
                end = max(end, e)
            return "".join(out) + t[end:]

        return texts.map(one, na_action=None)

    return docs.withColumn(column, replaced(F.col(text)))


def op11(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents; the trees learn from 20,000 of them at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs, fit_pii(docs))
