"""Joins that check what they assume, and joins on shared words.

Defined results: null keys match nothing and don't count as repeated; ties of a best match go to the first in order;
empty tables give no matches; columns with clashing names must be renamed first, which is an error otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionframe.functions.text import tokens
from opinionframe.operators.heavy_keys import skew_join


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` of the keys without nulls that occur more than once."""
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], kind: str = "many_to_one", how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, after a check that the side said to hold each key once does; else an error.

    ``kind``: ``many_to_one``, ``one_to_many`` or ``one_to_one``.
    """
    sides = {"many_to_one": [("right", right)], "one_to_many": [("left", left)], "one_to_one": [("left", left), ("right", right)]}[kind]
    if clash := (set(left.columns) & set(right.columns)) - set(keys):
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    for name, df in sides:
        if bad := repeated_keys(df, keys).head(3):  # three rows for the message
            raise ValueError(f"{name} side holds keys more than once: {[tuple(r) for r in bad]}")
    if how in ("left", "inner") and len(keys) == 1 and kind != "one_to_many":
        return skew_join(left, right.dropna(subset=keys), keys[0], how=how)
    return left.join(right, keys, how)


def word_matches(a: DataFrame, b: DataFrame, key_a: list[str], key_b: list[str], text_a: Column, text_b: Column, within: list[str] = ()) -> DataFrame:
    """``key_a, key_b, shared, jaccard``: pairs of rows of ``a`` and ``b`` that share a word, and columns ``within`` if given.

    Both sides are reduced to distinct keys and words before they meet.
    """
    x = a.select(*within, *key_a, F.array_distinct(tokens(text_a)).alias("wa")).distinct()
    y = b.select(*within, *key_b, F.array_distinct(tokens(text_b)).alias("wb")).distinct()
    one = x.select(*within, *key_a, F.size("wa").alias("na"), F.explode("wa").alias("w"))
    two = y.select(*within, *key_b, F.size("wb").alias("nb"), F.explode("wb").alias("w"))
    met = one.join(two, [*within, "w"]).groupBy(*within, *key_a, *key_b, "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return met.select(*within, *key_a, *key_b, "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))
