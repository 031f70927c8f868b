"""Find keyword-stuffed pages, link lists and tag lists among documents of many languages.

Each document becomes four features: the density of links, tags and bare numbers (share of its letters), the entropy of its
words and how many of them are repetitions (both over windows of WINDOW words, so that long texts don't look repetitive),
and the rate of function words on the page. Location and scatter of each language are those of the half of its documents that lies
closest together (concentration steps from medians and deviations, until the centre stays), so spam doesn't widen what
counts as usual even where it is nearly half of a language. A document is flagged if

* its Mahalanobis distance is an outlier's (quantile 0.975 of chi-square), and
* it lies in a spam-directed direction, at least half way: ``side`` is its place, in the metric of the scatter, on the
  line from the language's centre (0) to a page of nothing but keywords or nothing but links (1), whichever is closer.

There is no other rule beside these two. Short texts say little, so their deviation is shrunk by letters / (letters +
SHORT); languages with few documents are drawn to the pooled figures by PRIOR documents' weight,
and documents without a word of any language have those figures. All statistics cover all
documents; what reaches the driver is some 20 numbers for each of at most ten languages and step.

Defined results: null and blank texts are never flagged; repeated rows give one row; null ids give none; texts are read
whole; extra columns are ignored; ties of the half go to both; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionframe.session import cut_lineage, spread

WINDOW, SHORT, PRIOR, STEPS = 50, 30.0, 50.0, 8
FEATURES = ("density", "entropy", "repetition", "function")
#: Quantile 0.975 of chi-square with 4 degrees of freedom, and how far towards spam a page must lie.
OUTLIER, HALF_WAY = 11.14, 0.5
#: The covariance of the closest half of a normal sample in 4 dimensions is too small by this factor.
CONSISTENCY = 2.1
#: Least deviation of each feature, below which differences say nothing.
FLOOR = (0.05, 0.05, 0.05, 0.1)
#: Pages of nothing but keywords (every second word a repetition) and of nothing but links; None is the language's centre.
POLES = ((None, 0.7, 0.45, 0.0), (1.0, None, None, 0.0))

# Frequent closed-class words (for scripts without spaces, particles).
FUNCTION_WORDS = {
    "ru": "и в во не на с со что а но по за из к у о от до для как так это то же бы или если чтобы при без под над мы он она они его её их мой весь все уже ещё был была нет",
    "en": "the a an and or but if of to in on with for by at from as into after before than that this it its is are was were be has had not we i you he she they my our which who when while",
    "de": "der die das den dem des ein eine einen einem und oder aber wenn dass von für in im auf mit zu zum zur an am aus bei nach vor über als wie so ist war hat ich wir sie er es nicht",
    "hi": "यह वह ये का के की में से को ने पर और या है हैं था थी थे हो नहीं भी तो ही कि",
    "ar": "من في على إلى عن مع هذا هذه التي الذي لا لم ما كان قد تم أن أو ثم بعد قبل هو هي",
}
PARTICLES = {
    "zh": "的 了 是 在 和 不 有 也 都 就 很 我 这 那 没 会 到 说 着 过 把 被 让 比",
    "ja": "は が の を に で と も へ から まで です ます した ない",
    "th": "ที่ ใน และ ไม่ เป็น มี ได้ ให้ ไป มา จะ กับ แต่ หรือ แล้ว มาก กว่า นี้ จาก หลัง ก่อน ตอน",
}
_FUNCTION = frozenset(w for v in FUNCTION_WORDS.values() for w in v.split())
_OF = {k: frozenset(FUNCTION_WORDS[k].split()) for k in ("en", "de")}
_PARTICLE = re.compile("|".join(sorted((w for v in PARTICLES.values() for w in v.split()), key=lambda w: (-len(w), w))))
_NO_SPACES = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
_LINK = re.compile(r"""<a\s[^>]*>|\]\([^)\s]*\)|(?:https?://|www\.)[^\s"'<>)\]]+|\b[a-z0-9][a-z0-9-]*\.(?:[a-z]{2,}/[^\s"'<>)\]]*|[a-z]{2,}\b(?!\.\w))""")
_TAG = re.compile(r"#\w+")
_MARKUP = re.compile(r"</?[a-z][^>]*>|&[a-z#0-9]+;")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")
#: Letters with the vowel signs of Arabic, Devanagari and Thai, which aren't letters to ``re``.
_WORD = re.compile(r"(?:[^\W\d_]|[ً-ٟऀ-ः़-ॏा-ॗัิ-ฺ็-๎])+")
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
#: Where scripts begin, and which one; their letters count by the length of what they write.
_BOUNDS = (0x61, 0x250, 0x400, 0x530, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x3040, 0x3100, 0x3400, 0xA000)
_SCRIPTS = ("", "en", "", "ru", "", "ar", "", "hi", "", "th", "", "ja", "", "zh", "")
_WEIGHT = {"ja": 4, "zh": 4}
_PLOGP = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def language_of(words: Counter) -> str:
    """The language by most letters of a script, without a model; Latin is German or English by its function words."""
    sizes: dict[str, int] = {}
    for w, n in words.items():
        k = _SCRIPTS[bisect_right(_BOUNDS, ord(w[0]))]
        if k:
            sizes[k] = sizes.get(k, 0) + n * len(w) * _WEIGHT.get(k, 1)
    if not sizes:
        return "none"
    best = max(sizes, key=lambda k: (sizes[k], k))
    if best == "zh" and sizes.get("ja", 0) * 20 > sizes["zh"]:
        return "ja"
    return "de" if best == "en" and sum(words[w] for w in _OF["de"]) > sum(words[w] for w in _OF["en"]) else best


def features(text: str) -> tuple[str, int, float, float, float, float]:
    """Language, letters (with those of links, tags and numbers) and the four features."""
    low = text.translate(_INVISIBLE).lower()
    links = _LINK.findall(low)
    rest = _LINK.sub(" ", low) if links else low
    tags = _TAG.findall(rest)
    if tags:
        rest = _TAG.sub(" ", rest)
    if "<" in rest or "&" in rest:
        rest = _MARKUP.sub(" ", rest)
    packed = sum(map(len, links)) + sum(map(len, tags)) + sum(map(len, _NUMBER.findall(rest)))
    ws = _WORD.findall(rest)
    letters = sum(map(len, ws))
    counts = Counter(ws)
    hits = sum(n for w, n in counts.items() if w in _FUNCTION or w[:2] == "ال")
    if _NO_SPACES.search(rest):
        hits += len(_PARTICLE.findall(rest))
        ws = [x for w in ws for x in ([w[i : i + 2] for i in range(0, len(w), 2)] if _NO_SPACES.match(w) else [w])]
    ws += tags
    n, found, most, again = len(ws), 0.0, 0.0, 0
    for s in range(0, n, WINDOW):
        c = Counter(ws[s : s + WINDOW])
        k = min(WINDOW, n - s)
        found += k * math.log2(k) - sum(map(_PLOGP.__getitem__, c.values()))
        most += k * math.log2(k)
        again += k - len(c)
    size = packed + letters
    return language_of(counts), size, packed / max(1, size), found / most if most else 1.0, again / max(1, n), min(1.0, 5 * hits / max(1, size))


_SCHEMA = "id bigint, lang string, size int, density double, entropy double, repetition double, function double"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(int(i), *features(t)) for i, t in zip(b["id"], b["text"], strict=True)]
        yield pd.DataFrame(out, columns=["id", "lang", "size", *FEATURES])


def document_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The features of every document with a text that isn't blank."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL AND length(trim(text)) > 0")
    return spread(rows, "id").mapInPandas(_rows, _SCHEMA)


Fit = tuple[np.ndarray, np.ndarray]  # centre and inverse scatter


_K = len(FEATURES)
_PAIRS = [(i, j) for i in range(_K) for j in range(i, _K)]
_FACTS = [*(f"m{i}" for i in range(_K)), *(f"f{i}{j}" for i, j in _PAIRS), *(f"a{p}{i}" for p in range(len(POLES)) for i in range(_K))]


def _joined(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """``df`` with numbers of its language, which come as a table: so every step runs the same compiled code."""
    facts = df.sparkSession.createDataFrame([(k, *(float(x) for x in v)) for k, *v in rows], "lang string, " + ", ".join(f"{c} double" for c in names))
    return df.join(F.broadcast(facts), "lang")  # a row a language


def with_distances(df: DataFrame, fits: dict[str, Fit]) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance from the language's centre, and ``side``, how far a row lies towards the
    closer pole: 0 at the centre, 1 at a page of spam only."""
    rows = []
    for lang, (m, inv) in fits.items():
        along = []
        for pole in POLES:
            to = np.array([0.0 if p is None else p - c for p, c in zip(pole, m, strict=True)])
            along += list(inv @ to / max(float(to @ inv @ to), 1e-12))
        rows.append((lang, *m, *(inv[i, j] * (1 if i == j else 2) for i, j in _PAIRS), *along))
    x = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    d2 = sum((x[i] * x[j] * F.col(f"f{i}{j}") for i, j in _PAIRS), F.lit(0.0))
    sides = [sum((x[i] * F.col(f"a{p}{i}") for i in range(_K)), F.lit(0.0)) for p in range(len(POLES))]
    return _joined(df, rows, _FACTS).select(*df.columns, d2.alias("d2"), F.greatest(*sides).alias("side"))


def _moments(rows: DataFrame) -> dict[str, Fit]:
    """Centre and inverse scatter of each language's ``rows``, drawn to those of all by PRIOR rows."""
    k, pairs = _K, _PAIRS
    sums = rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in pairs)
    ).collect()  # a row a language
    got = {}
    for r in sums:
        q = np.zeros((k, k))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        got[r["lang"]] = (r["n"], np.array([r[f"s{i}"] for i in range(k)]), q)
    n = sum(x[0] for x in got.values())
    mean, second = sum(x[1] for x in got.values()) / n, sum(x[2] for x in got.values()) / n
    out = {}
    for lang, (c, s, q) in got.items():
        if lang == "none":  # no word outside links and tags, so no language: the figures of all
            c, s, q = 0, 0.0, 0.0
        m = (s + PRIOR * mean) / (c + PRIOR)
        scatter = (q + PRIOR * second) / (c + PRIOR) - np.outer(m, m)
        out[lang] = (m, np.linalg.inv(scatter * CONSISTENCY + np.diag(np.square(FLOOR))))
    return out


def robust_fits(feats: DataFrame) -> dict[str, Fit]:
    """Per language, centre and inverse scatter of its closest half, after at most STEPS concentration steps."""
    middle = lambda c, name: F.percentile_approx(c, 0.5, 1000).alias(name)
    mids = {r["lang"]: np.array([r[f] for f in FEATURES]) for r in feats.groupBy("lang").agg(*(middle(f, f) for f in FEATURES)).collect()}
    away = _joined(feats, [(k, *m) for k, m in mids.items()], [f"m{i}" for i in range(_K)]).select("lang", *(F.abs(F.col(f) - F.col(f"m{i}")).alias(f) for i, f in enumerate(FEATURES)))
    mads = {r["lang"]: np.array([r[f] for f in FEATURES]) for r in away.groupBy("lang").agg(*(middle(f, f) for f in FEATURES)).collect()}
    fits = {k: (m, np.diag(1 / np.maximum(np.square(1.4826 * mads[k]), np.square(FLOOR)))) for k, m in mids.items()}
    for _ in range(STEPS):
        near = with_distances(feats, fits)
        cuts = [(r["lang"], r["c"]) for r in near.groupBy("lang").agg(F.percentile_approx("d2", 0.5, 1000).alias("c")).collect()]
        before, fits = fits, _moments(_joined(near, cuts, ["cut"]).filter("d2 <= cut"))
        if max(np.abs(fits[k][0] - before[k][0]).max() for k in fits) < 1e-3:
            break
    return fits


def spam_scores(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, lang, size, features, d2, side, is_spam`` of every document with a text."""
    feats = cut_lineage(document_features(docs, key, text))
    if feats.isEmpty():
        return feats.selectExpr("*", "0D AS d2", "0D AS side", "false AS is_spam")
    known = F.col("size") / (F.col("size") + SHORT)
    scored = with_distances(feats, robust_fits(feats)).withColumn("d2", F.col("d2") * known * known).withColumn("side", F.col("side") * known)
    return scored.withColumn("is_spam", (F.col("d2") > OUTLIER) & (F.col("side") >= HALF_WAY))
