"""Structured Streaming plans over event and rating streams. Each takes and returns a DataFrame, streaming or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionframe.functions.text import normal_form


def windowed_totals(events: DataFrame, ts: str, key: str, value: str, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are left out of a stream."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), key, "n", "total")


def session_totals(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), key, "n")


def first_deliveries(events: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark; state is bounded by it."""
    marked = events.withWatermark(ts, late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def running_scores(ratings: DataFrame, keys: list[str], value: str, strength: float = 1.0, prior: float = 3.0) -> DataFrame:
    """Smoothed scores per key from running sums; for a stream in update mode."""
    n, s = F.count(value), F.sum(value)
    return ratings.groupBy(*keys).agg(n.alias("n"), F.greatest(F.lit(1.0), F.least(F.lit(5.0), (F.coalesce(s, F.lit(0.0)) + strength * prior) / (n + strength))).alias("score"))


def lexical_matches(stream: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """Rows of a stream with the ids of ``terms`` (``term, id``) their normal form equals; a term table is a static side."""
    known = terms.select(F.col("term").alias("term_"), "id").distinct()
    return stream.withColumn("term_", normal_form(F.col(text))).join(known, "term_").drop("term_")


def fold_profile(batch: DataFrame, path: str, key: str, value: str) -> None:
    """Adds a batch's counts and sums per key to the table at ``path``: read, united, added up, written beside and swapped.

    For ``foreachBatch``; each batch is folded once if the sink's checkpoint is kept.
    """
    spark = batch.sparkSession
    new = batch.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration())
    both = spark.read.parquet(path).unionByName(new) if fs.exists(fs_path(path)) else new
    both.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.mode("overwrite").parquet(path + ".next")
    fs.delete(fs_path(path), True)
    fs.rename(fs_path(path + ".next"), fs_path(path))
