"""Scores of text pairs by any provider, with a table of what was scored before.

Only distinct pairs the cache doesn't hold reach the provider, so a premise shared by a million rows is scored once.

Defined results: pairs with a null text get null scores and never enter the cache; another model signature finds nothing
in the cache; repeated pairs are scored once and give a row each; an empty cache scores all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def model_signature(**parts: object) -> str:
    """A stable text of a model's name and settings, as a key of its cache entries."""
    return "|".join(f"{k}={parts[k]}" for k in sorted(parts))


def pair_key(signature: str, premise: Column, hypothesis: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(signature), premise, hypothesis), 256)


def score_pairs(pairs: DataFrame, cache: DataFrame, provider: Callable[[Column, Column], Column], signature: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (``premise, hypothesis`` and more) with ``score`` and whether it was a ``hit``, and the entries (``pair,
    score``) to append to the cache."""
    keyed = pairs.withColumn("pair", F.when(F.col("premise").isNotNull() & F.col("hypothesis").isNotNull(), pair_key(signature, F.col("premise"), F.col("hypothesis"))))
    known = cache.select("pair", F.col("score").alias("known")).dropDuplicates(["pair"])
    once = keyed.filter("pair IS NOT NULL").groupBy("pair").agg(F.first("premise").alias("premise"), F.first("hypothesis").alias("hypothesis"))
    fresh = once.join(known, "pair", "left_anti").select("pair", provider(F.col("premise"), F.col("hypothesis")).alias("score"))
    both = known.withColumn("hit", F.lit(True)).withColumnRenamed("known", "score").unionByName(fresh.withColumn("hit", F.lit(False)))
    return keyed.join(both, "pair", "left").drop("pair"), fresh
