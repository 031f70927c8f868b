"""Per-key results without imbalance when a few keys hold most rows.

Heavy hitters come from a frequent-items sketch merged over all partitions (a superset of the keys above the wanted
share) and are then counted exactly. Rows of heavy keys meet their per-key facts through a broadcast join, which moves
none of them; the rest goes through an ordinary shuffle join; the two parts are united.

Bounds: at most ``1 / share`` keys can hold ``share`` of the rows, so what is broadcast never grows with the data.

Defined results: a null key is an ordinary group of ``per_key_profile`` but never a heavy key; an empty table gives no
rows; repeated rows count as delivered; extra columns are ignored or carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items the sketch tracks. Its error is about 3.5 / SKETCH_ITEMS of all rows, so shares down to 0.2 % are safe.
SKETCH_ITEMS = 4096


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key, n_rows``: the keys with at least ``share`` of the rows of ``df``, counted exactly. At most 1/share rows."""
    if not 0.002 <= share <= 1:
        raise ValueError("share must lie between 0.002 and 1")
    k = int(2 / share) + 2
    tops = df.select(F.col(key).alias("k")).agg(
        F.expr(f"approx_top_k(k, {k}, {SKETCH_ITEMS})").alias("top"), F.count(F.lit(1)).alias("total")
    )
    cands = tops.select(F.explode("top").alias("t"), "total").select(F.col("t.item").alias("k"), "total")
    counted = (
        df.select(F.col(key).alias("k"))
        .join(F.broadcast(cands.filter("k IS NOT NULL")), "k")  # at most 2/share + 2 rows
        .groupBy("k", "total")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return counted.filter(F.col("n_rows") >= F.lit(share) * F.col("total")).select(F.col("k").alias(key), "n_rows")


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, how: str = "left") -> DataFrame:
    """Equi-join of ``left`` with ``right`` (one row per key) in which no heavy key of ``left`` is shuffled.

    ``how`` is ``left`` or ``inner``. A null key matches nothing. The heavy keys (at most 1/share) are decided once on
    the driver; the rows of ``right`` for them are broadcast, which is bounded as ``right`` holds a key once.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    hot = [r[0] for r in heavy_keys(left, key, share).select(key).collect()]  # at most 1/share values
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    heavy = left.filter(is_hot).join(F.broadcast(right.filter(is_hot).dropDuplicates([key])), key, how)
    rest = left.filter(~is_hot).join(right.filter(~is_hot), key, how)
    return heavy.unionByName(rest)


def per_key_profile(df: DataFrame, key: str, value: Column, share: float = 0.01, z: float = 2.0) -> DataFrame:
    """Per key: rows, mean, population deviation and the rows further than ``z`` deviations from the key's mean.

    The first pass (moments) is combined before the shuffle; the second needs the mean beside every row, which is where
    a plain join would send a heavy key's rows to one task; ``skew_join`` doesn't. Null values count as rows only.
    """
    rows = df.select(F.col(key).alias("k"), value.cast("double").alias("v"))
    facts = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_values"), F.avg("v").alias("mean_value"),
        F.stddev_pop("v").alias("sd_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"),
    )
    far = (
        skew_join(rows.filter("k IS NOT NULL AND v IS NOT NULL"), facts.filter("k IS NOT NULL").select("k", "mean_value", "sd_value"), "k", share, "inner")
        .filter((F.col("sd_value") > 0) & (F.abs(F.col("v") - F.col("mean_value")) > z * F.col("sd_value")))
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n_far"))
    )
    return facts.join(far, "k", "left").select(
        F.col("k").alias(key), "n_rows", "n_values", "mean_value", "sd_value", "min_value", "max_value", F.coalesce("n_far", F.lit(0)).alias("n_far")
    )
