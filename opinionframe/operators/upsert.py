"""Upserts on snapshots: the latest row of every key wins, as an aggregate that combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """One row a key: the greatest by ``latest`` (nulls lowest). Null keys form one key; repeated rows count once."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(latest)), *(F.col(c) for c in rest))).alias("x_"))
    return best.select(*keys, *(F.col(f"x_.{c}").alias(c) for c in rest))


def merge(old: DataFrame, new: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in or replaced where they are later."""
    return upsert_latest(old.unionByName(new, allowMissingColumns=True), keys, latest)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it doesn't hold, each key once."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(upsert_latest(fresh, keys, [c for c in fresh.columns if c not in keys]).select(*old.columns))
