"""Map freely typed values to a reference list by a prefix-filter set-similarity join.

Every distinct value becomes one set of tokens per reading (look-alike letters undone; Latin text both as a
transliteration and as typed on the wrong keyboard; the parts beside a free-standing slash also alone): the pairs of neighbouring letters within words and each word's first
letter, all in Latin. Tokens are ordered from rare to frequent over all values. Two sets of Jaccard at least t share a
token within their first ``n - ceil(t n) + 1``, so only these rare prefixes are joined; the length filter and the
positional filter cut the pairs further, Jaccard is computed exactly, and the best entry is kept. The join runs at a
high threshold first and again, lower, for the values it left unmatched: a best match above the high threshold is found
by the first. Matches of low similarity must pass an exact check, word against word by edit distance.

Defined results: null, blank, ``none`` and ``nan`` are no values and give no row; values without letters are unmatched;
ties go to the smaller Jaccard-tied name, then id; repeated rows give one row; an empty reference leaves every value
unmatched; extra columns are ignored; values are used whole, however long.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionframe.llm import textnorm as tn
from opinionframe.session import cut_lineage

#: Words that people put around a value without meaning them (fixed values: "aspect", "seems to be").
AROUND = frozenset({"аспект", "вроде", "бы", "aspekt", "vrode", "by"})
_AROUND = re.compile(r"\b(?:" + "|".join(sorted(AROUND)) + r")\b[:,]?", re.I)
HIGH, LOW, SURE, WORDS_ALIKE = 0.45, 0.28, 0.5, 0.6
#: Up to so many names are broadcast (counted first).
BROADCAST_NAMES = 20_000
TOKENS = T.ArrayType(T.ArrayType(T.StringType()))


def reading_words(text: str) -> list[list[str]]:
    """The words of each reading, in Latin letters; of a text with free-standing slashes also those of each part alone."""
    parts, out = re.split(r"\s/\s", text), []
    for part in [text, *parts] if len(parts) > 1 else [text]:
        for r in tn.readings(_AROUND.sub(" ", part)):
            ws = [tn.to_latin(w) for w in tn.words_of(r) if w not in AROUND]
            if ws := [w for w in ws if w]:
                out.append(ws)
    return out


def letter_pairs(words: list[str]) -> set[str]:
    out: set[str] = set()
    for w in words:
        out.add("^" + w[0])
        out.update(w[i : i + 2] for i in range(len(w) - 1))
    return out


@F.pandas_udf(TOKENS)
def _token_sets(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [sorted(letter_pairs(ws)) for ws in reading_words(t)] if t is not None else [])


def words_alike(value: str, name: str) -> float:
    """How well the value's words are found among the name's, by edits a letter; a shorter word may be a beginning."""
    best = 0.0
    ref = reading_words(name)[0]
    for ws in reading_words(value):
        total = weight = 0.0
        for w in ws:
            s = max(max(1 - tn.edit_distance(w, c) / max(len(w), len(c)) for c in {r, r[: len(w)]}) for r in ref)
            total, weight = total + s * len(w), weight + len(w)
        best = max(best, total / weight if weight else 0.0)
    return best


@F.pandas_udf(T.DoubleType())
def _words_alike(value: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([words_alike(v, n) for v, n in zip(value, name, strict=True)], dtype="float64")


def _sets(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return df.withColumn("sets", _token_sets(F.col(text))).select(*keys, F.posexplode("sets").alias("reading", "toks")).filter(F.size("toks") > 0)


def _ordered(df: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Tokens from rare to frequent, by a table of a fixed size."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def order(toks: pd.Series) -> pd.Series:
        rank: dict[str, int] = {}

        def place(t: str) -> tuple[int, str]:
            if t not in rank:
                rank[t] = int(rarity[zlib.crc32(t.encode()) % len(rarity)])
            return rank[t], t

        return toks.map(lambda x: sorted(x, key=place))

    return df.withColumn("toks", order("toks")).withColumn("n", F.size("toks"))


def _prefix(df: DataFrame, t: float, tag: str) -> DataFrame:
    p = F.col("n") - F.ceil(F.col("n") * t - 1e-9).cast("int") + 1
    kept = df.withColumn("pre", F.slice("toks", F.lit(1), p))
    return kept.select(*(F.col(c).alias(f"{c}_{tag}") for c in kept.columns), F.posexplode("pre").alias(f"pos_{tag}", "tok"))


def best_entries(values: DataFrame, entries: DataFrame, t: float, few: bool = False) -> DataFrame:
    """``value, name, entry_id, jaccard``: for each value with an entry of Jaccard >= t the best one.

    ``values``: value, toks, n (one row a reading); ``entries``: entry_id, name, toks, n. Tokens ordered alike. ``few``
    entries are sent to the values instead of meeting them by token.
    """
    v, r = _prefix(values.select("value", "toks", "n"), t, "v"), _prefix(entries.select("entry_id", "name", "toks", "n"), t, "r")
    need = F.ceil(t / (1 + t) * (F.col("n_v") + F.col("n_r")) - 1e-9)
    pairs = v.join(F.broadcast(r) if few else r, "tok").filter(
        (F.col("n_r") >= t * F.col("n_v")) & (F.col("n_v") >= t * F.col("n_r"))
        & (1 + F.least(F.col("n_v") - F.col("pos_v") - 1, F.col("n_r") - F.col("pos_r") - 1) + F.least("pos_v", "pos_r") >= need)
    ).filter(F.element_at(F.array_intersect("pre_v", "pre_r"), 1) == F.col("tok"))
    both = F.size(F.array_intersect("toks_v", "toks_r"))
    scored = pairs.select(F.col("value_v").alias("value"), F.col("name_r").alias("name"), F.col("entry_id_r").alias("entry_id"), (both / (F.col("n_v") + F.col("n_r") - both)).alias("jaccard"))
    best = scored.filter(F.col("jaccard") >= t).groupBy("value").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "name", "entry_id")).alias("b"))
    return best.select("value", F.col("b.name").alias("name"), F.col("b.entry_id").alias("entry_id"), (-F.col("b.j")).alias("jaccard"))


def match_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """``value, entry_id, jaccard``: every distinct ``value`` of ``values``, with ``entry_id`` null where unmatched.

    ``entries`` has ``entry_id, name``, one row for each name or synonym.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work a row: spread them evenly
    distinct = values.select("value").filter("value IS NOT NULL").distinct().repartition(parts, "value")
    sets = cut_lineage(_sets(distinct, "value", ["value"]))
    rarity = tn.rarity_table(sets.select(F.explode("toks").alias("t")).select(F.crc32("t").alias("t")), "t")
    sets = cut_lineage(_ordered(sets, rarity).repartition(parts, "value"))
    names = cut_lineage(_ordered(_sets(entries.filter("name IS NOT NULL"), "name", ["entry_id", "name"]).filter("reading = 0"), rarity))
    few = names.count() <= BROADCAST_NAMES
    high = cut_lineage(best_entries(sets, names, HIGH, few))
    low = best_entries(sets.join(high.select("value"), "value", "left_anti").repartition(parts, "value"), names, LOW, few)
    found = high.unionByName(low).withColumn("alike", F.when(F.col("jaccard") < SURE, _words_alike("value", "name")).otherwise(F.lit(1.0))).filter(F.col("alike") >= WORDS_ALIKE)
    return distinct.join(found.select("value", "entry_id", "jaccard"), "value", "left")
