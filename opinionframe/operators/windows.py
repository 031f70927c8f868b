"""Ordered picks per group. Ties are always broken by the given order, so results are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def head_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every group, as an aggregate: it combines before the shuffle, however large a group is.

    Nulls of the order come first, as in an ascending sort.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c) for c in rest))).alias("x_"))
    return picked.select(*keys, *(F.col(f"x_.{c}").alias(c) for c in rest))


def share_of_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, share``: rows of every group and their share of all rows. The total is one row, joined by broadcast."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total_")))).withColumn("share", F.col("n") / F.col("total_")).drop("total_")
