"""Ranks over all rows without sorting them in one task.

Rows are first counted per distinct value, which combines before the shuffle, so a value that many rows share costs as
one. The values are then cut into at most PARTS ranges by approximate quantiles; the rows below a range come from a sum
over the ranges, those below a value within its range from a window over the range.

Defined results: null values have no rank; equal values share the mean of their places; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 256


def value_ranks(df: DataFrame, col: str, **sums: Column) -> DataFrame:
    """``col, n, below, avg_rank`` and the ``sums`` of each distinct value of the numeric column ``col``."""
    values = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    cuts = sorted({float(x) for x in (values.agg(F.percentile_approx(F.col(col).cast("double"), [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0] or [])})  # PARTS numbers
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(col).cast("double"))) if cuts else F.lit(0)
    ranged = values.withColumn("part_", at)
    over = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    lower = ranged.groupBy("part_").agg(F.sum("n").alias("m")).select("part_", F.coalesce(F.sum("m").over(over), F.lit(0)).alias("lower_"))  # PARTS rows
    within = Window.partitionBy("part_").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("lower_") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return ranged.join(F.broadcast(lower), "part_").withColumn("below", below).withColumn("avg_rank", F.col("below") + (F.col("n") + 1) / F.lit(2.0)).drop("part_", "lower_")
