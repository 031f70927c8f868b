"""Matching items to few anchors by cosine: scores, margins, softmax ranks, routing, and cluster quality without pairs.

Anchors (class centroids, aspects) are counted first and broadcast only up to MOST_ANCHORS; beyond that the scores are a
plain join. Sums over clusters come from sums of unit vectors, so no two members are ever compared with each other.

Defined results: null vectors have no scores; a zero vector has similarity 0 to all; ties go to the smaller anchor (scores
are compared to nine decimals); a single anchor has no competitor, which counts as -1; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionframe.functions.vectors import dot, mean_vectors, unit

MOST_ANCHORS = 20_000


def centroids(df: DataFrame, key: str, vec: str, name: str = "anchor") -> DataFrame:
    """``name, w``: the unit vector of the mean of a key's unit vectors."""
    m = mean_vectors(df.filter(F.col(vec).isNotNull()).select(key, unit(F.col(vec)).alias("u")), key, "u")
    return m.select(F.col(key).alias(name), unit(F.col("centroid")).alias("w"))


def anchor_scores(items: DataFrame, vec: str, anchors: DataFrame) -> DataFrame:
    """``items`` without ``vec`` x ``anchors`` (``anchor, w``) with their cosine ``s``, to nine decimals."""
    few = anchors.limit(MOST_ANCHORS + 1).count() <= MOST_ANCHORS
    rows = items.filter(F.col(vec).isNotNull()).withColumn("u_", unit(F.col(vec))).drop(vec)
    return rows.join(F.broadcast(anchors) if few else anchors).withColumn("s", F.round(dot(F.col("u_"), F.col("w")), 9)).drop("u_", "w")


def best_two(scores: DataFrame, keys: list[str], anchor: str = "anchor") -> DataFrame:
    """``keys, best, s1, second, s2``: the two most similar anchors, by aggregates; -1 without a second."""
    one = scores.groupBy(*keys).agg(F.min(F.struct((-F.col("s")).alias("m"), F.col(anchor).alias("a"))).alias("x"))
    rest = scores.join(one, keys).filter(F.col(anchor) != F.col("x.a")).groupBy(*keys).agg(F.min(F.struct((-F.col("s")).alias("m"), F.col(anchor).alias("a"))).alias("y"))
    return one.join(rest, keys, "left").select(*keys, F.col("x.a").alias("best"), (-F.col("x.m")).alias("s1"), F.col("y.a").alias("second"), F.coalesce(-F.col("y.m"), F.lit(-1.0)).alias("s2"))


def softmax_ranks(scores: DataFrame, keys: list[str], temperature: float = 0.1, anchor: str = "anchor") -> DataFrame:
    """``scores`` with the probability ``p`` of each anchor of an item and its ``rank`` (an item's anchors are few)."""
    w = Window.partitionBy(*keys)
    e = F.exp((F.col("s") - F.max("s").over(w)) / temperature)
    return scores.withColumn("p", e / F.sum(e).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("s"), anchor)))


def route(general: Column, general2: Column, domain: Column, domain2: Column, noise: Column, t_general: float = 0.6, m_general: float = 0.03, t_domain: float = 0.6, m_domain: float = 0.03, t_conflict: float = 0.55, band: float = 0.05, domain_first: bool = False) -> Column:
    """The layer an item goes to by its two best scores in the general and the domain layer: noise, general, domain,
    overlap where both claim it, or residual where none does."""
    ok_general = (general >= t_general) & (general - general2 >= m_general)
    ok_domain = (domain >= t_domain) & (domain - domain2 >= m_domain)
    conflict = (general >= t_conflict) & (domain >= t_conflict) & (F.abs(general - domain) <= band)
    out = F.when(noise, "noise")
    if domain_first:
        out = out.when(conflict & ok_domain, "domain")
    return out.when(ok_general & ~conflict, "general").when(ok_domain & ~conflict, "domain").when(conflict, "overlap").otherwise("residual")


def medoids(df: DataFrame, key: str, item: str, vec: str) -> DataFrame:
    """``key, item, mean_s``: each cluster's member with the greatest mean cosine to the others, 1 for a single member."""
    rows = df.filter(F.col(vec).isNotNull()).select(key, item, unit(F.col(vec)).alias("u"))
    sums = mean_vectors(rows, key, "u").join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)
    near = rows.join(sums, key).select(key, item, F.round(F.when(F.col("n") > 1, (dot(F.col("u"), F.col("centroid")) * F.col("n") - dot(F.col("u"), F.col("u"))) / (F.col("n") - 1)).otherwise(1.0), 9).alias("m"))
    return near.groupBy(key).agg(F.min(F.struct((-F.col("m")).alias("m"), F.col(item).alias("i"))).alias("x")).select(key, F.col("x.i").alias(item), (-F.col("x.m")).alias("mean_s"))


def cluster_quality(df: DataFrame, key: str, item: str, vec: str) -> DataFrame:
    """``n_clusters, cohesion, separation, silhouette``: mean cosine within clusters, of their centroids with one another,
    and the mean cosine silhouette (members of single clusters count as 0). Clusters are anchors here, see MOST_ANCHORS."""
    rows = df.filter(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(item).alias("i"), unit(F.col(vec)).alias("u"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    means = mean_vectors(rows, "k", "u").join(sizes, "k")
    few = means.limit(MOST_ANCHORS + 1).count() <= MOST_ANCHORS
    other = means.select(F.col("k").alias("c"), "n", "centroid")
    met = rows.join(F.broadcast(other) if few else other).withColumn("t", dot(F.col("u"), F.col("centroid")))
    own = F.col("k") == F.col("c")
    near = F.when(F.col("n") > 1, (F.col("t") * F.col("n") - dot(F.col("u"), F.col("u"))) / (F.col("n") - 1))
    per = met.groupBy("k", "i").agg(F.max(F.when(own, near)).alias("in"), F.max(F.when(~own, F.col("t"))).alias("out"), F.max(F.when(own, F.col("n"))).alias("n"))
    a, b = 1 - F.col("in"), 1 - F.col("out")
    sil = F.when(F.col("n") > 1, (b - a) / F.greatest(a, b)).otherwise(0.0)
    q = per.groupBy("k").agg(F.coalesce(F.avg("in"), F.lit(1.0)).alias("coh"), F.sum(sil).alias("sil"), F.count(F.lit(1)).alias("m"))
    units = means.select(F.col("k").alias("c"), unit(F.col("centroid")).alias("w"))
    total = mean_vectors(units.withColumn("g", F.lit(1)), "g", "w").select(dot(F.col("centroid"), F.col("centroid")).alias("d"))
    t = q.agg(F.count(F.lit(1)).alias("k"), F.avg("coh").alias("coh"), (F.sum("sil") / F.sum("m")).alias("sil")).crossJoin(F.broadcast(total))  # one row
    k = F.col("k")
    return t.select(k.alias("n_clusters"), F.round("coh", 6).alias("cohesion"), F.round(F.when(k > 1, (F.col("d") * k * k - k) / (k * (k - 1))).otherwise(0.0), 6).alias("separation"), F.round(F.when(k > 1, F.col("sil")), 6).alias("silhouette"))
