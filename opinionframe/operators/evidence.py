"""Where in a text a piece of evidence stands: sentences, windows, phrase occurrences, negations and premises.

A word's lemma comes from an analyser, any function from a word to its lemma; without one a word in lower case is its own.
The functions work on one text; the DataFrame operators run them in Arrow batches, or stay in the JVM where they can.

Defined results: null and blank texts have no sentences, tokens or occurrences and resolve to null; offsets count code
points, the end is exclusive, and -1 means unknown; ties of the best sentence go to the first; repeated phrases count
once; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Lemma = Callable[[str], str]
_WORD = re.compile(r"\w+")
_BREAK = re.compile(r"(?<=[.!?;])\s+")

# Things whose absence is good news.
GOOD_WHEN_ABSENT = frozenset(
    "аромат брак вонь горечь грязь дефект задержка запах мусор насекомое ожидание очередь плесень повреждение поломка проблема пыль пятно ржавчина скол таракан царапина шум".split()
)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the pieces between white space that follows ``. ! ? ;``, without outer white space."""
    cuts = [0, *(x for m in _BREAK.finditer(text) for x in m.span()), len(text)]
    out = []
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        piece = text[a:b]
        if inner := piece.strip():
            start = a + piece.index(inner[0])
            out.append((start, start + len(inner)))
    return out


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def lemmas_of(text: str, lemma: Lemma = str.lower) -> list[str]:
    return [lemma(w) for w in _WORD.findall(text.lower()) if any(map(str.isalpha, w))]


def _found_at(text: str, evidence: str) -> int:
    evidence = evidence.strip().casefold()
    return text.casefold().find(evidence) if evidence else -1


def sentence_of(text: str, evidence: str, start: int = -1, lemma: Lemma = str.lower) -> str | None:
    """The sentence that holds the offset; else the one that holds the evidence's letters; else the one that shares most
    lemmas with it."""
    spans = sentence_spans(text)
    if not spans:
        return None
    for at in (start, _found_at(text, evidence)):
        if at >= 0:
            for a, b in spans:
                if a <= at < b:
                    return text[a:b]
    wanted = set(lemmas_of(evidence, lemma))
    a, b = max(spans, key=lambda s: len(wanted & set(lemmas_of(text[s[0] : s[1]], lemma))))
    return text[a:b]


def window_of(text: str, evidence: str, start: int = -1, end: int = -1, around: int = 6, lemma: Lemma = str.lower) -> str | None:
    """``around`` tokens on both sides of the evidence, found by offsets, letters or lemmas; else its sentence."""
    tokens = token_spans(text)
    at = _found_at(text, evidence)
    hits: list[int] = []
    for a, b in ((start, end), (at, at + len(evidence.strip()))):
        if not hits and 0 <= a < b:
            hits = [k for k, (x, y) in enumerate(tokens) if x < b and y > a]
    if not hits:
        wanted = set(lemmas_of(evidence, lemma))
        hits = [k for k, (x, y) in enumerate(tokens) if lemma(text[x:y].lower()) in wanted]
    if not hits:
        return sentence_of(text, evidence, start, lemma)
    return text[tokens[max(0, hits[0] - around)][0] : tokens[min(len(tokens) - 1, hits[-1] + around)][1]]


def occurrences(text: str, phrases: Iterable[str]) -> list[tuple[int, int, str]]:
    """``start, end, phrase`` of every occurrence from left to right; of those that overlap the earlier stays, and of
    those that start together the one with more words, then letters, then the one given first."""
    low = text.casefold()
    given = list({p.strip().casefold(): p.strip() for p in reversed(list(phrases)) if p and p.strip()}.values())[::-1]
    hits = []
    for rank, p in enumerate(given):
        at = low.find(p.casefold())
        while at >= 0:
            hits.append((at, -len(_WORD.findall(p)), -len(p), rank, p))
            at = low.find(p.casefold(), at + 1)
    out, free = [], 0
    for at, _, size, _, p in sorted(hits):
        if at >= free:
            out.append((at, at - size, p))
            free = at - size
    return out


def negation(text: str, aspect: Iterable[str], good_when_absent: frozenset[str] = GOOD_WHEN_ABSENT, lemma: Lemma = str.lower) -> tuple[bool, str, str]:
    """Whether the text denies something of the aspect whose absence is good, by which pattern, and of what (the first in
    order of letters). The first token with a pattern decides, and of its patterns the first of the list."""
    wanted = set(aspect) & good_when_absent
    t = lemmas_of(text, lemma)
    for i, w in enumerate(t) if wanted else ():
        before, after = t[max(0, i - 4) : i], t[i + 1 : i + 5]
        verb = t[i + 1] if i + 1 < len(t) else ""
        patterns = (
            (w in ("нет", "без"), w, after),
            (w == "нет", "reverse нет", before),
            (w == "не" and verb == "быть", "не было", t[i + 2 : i + 6] + before),
            (w == "не" and verb == "иметь", "не имеет", t[i + 2 : i + 7]),
            (w == "отсутствовать", "отсутствует", after + before),
            (w == "никакой", "никакой", after),
        )
        for applies, name, near in patterns:
            if applies and (hit := wanted & set(near)):
                return True, name, min(hit)
    return False, "", ""


def with_sentences(df: DataFrame, text: str, evidence: str, start: str, end: str, around: int = 6, lemma: Lemma = str.lower) -> DataFrame:
    """``df`` with the ``sentence`` and the ``window`` of its evidence."""

    @F.pandas_udf("struct<sentence:string,window:string>")
    def resolve(t: pd.Series, e: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if x is None else (sentence_of(x, y or "", i, lemma), window_of(x, y or "", i, j, around, lemma)) for x, y, i, j in zip(t, e, a, b, strict=True)]
        return pd.DataFrame(rows, columns=["sentence", "window"])

    unknown = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1))
    return df.withColumn("x_", resolve(F.col(text), F.col(evidence), unknown(start), unknown(end))).select(*df.columns, "x_.sentence", "x_.window")


def premises(assignments: DataFrame, evidence: DataFrame, mode: str) -> DataFrame:
    """``assignment_id, premise`` by mode: A the whole text of the assignment, B the sentence of its first evidence, C that
    evidence's window, D the sentence of each evidence.

    ``assignments``: assignment_id, text; ``evidence``: assignment_id, evidence_id, start_offset, end_offset, sentence,
    window. The first evidence is the one with a known offset, lowest start, greatest length, smallest id.
    """
    if mode == "A":
        return assignments.select("assignment_id", F.col("text").alias("premise"))
    if mode == "D":
        return evidence.select("assignment_id", F.col("sentence").alias("premise"))
    if mode not in ("B", "C"):
        raise ValueError(mode)
    known = F.coalesce(F.col("start_offset") < 0, F.lit(True))
    first = evidence.groupBy("assignment_id").agg(F.min(F.struct(known.alias("u"), "start_offset", (F.col("start_offset") - F.col("end_offset")).alias("l"), "evidence_id", "sentence", "window")).alias("x"))
    return first.select("assignment_id", F.col("x.sentence" if mode == "B" else "x.window").alias("premise"))
