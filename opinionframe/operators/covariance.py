"""Shrunken covariance of topics per product, and selection of varied items; all in the JVM.

Nothing gathers a group in one task: the covariance is made of sums per pair of topics, which combine before the shuffle,
and the selection keeps, for each item, only its greatest similarity to what is chosen so far.

Defined results: null values and null vectors are left out; repeated rows of a row and topic are averaged; a null group is
a group of the covariance and none of the selection; ties go to the smaller item; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionframe.functions.vectors import dot, unit
from opinionframe.operators.heavy_keys import skew_join
from opinionframe.session import cut_lineage

#: Topics of a group that a topic meets at once.
BLOCK = 128


def topic_covariance(scores: DataFrame, group: str, row: str, topic: str, value: str, least_rows: int = 5) -> DataFrame:
    """``group, topic_a, topic_b, cov`` in long form, shrunk to a multiple of the identity by the published optimal weight.

    Rows (a review's topics) with one topic are left out; gaps take the topic's mean, so they add nothing to the sums.
    Groups with fewer than ``least_rows`` such rows, or with a topic that none of them holds, get the topics' own
    variances (1 where there is one value); groups with one topic give no rows.

    The result has every pair of a group's topics, most of them 0. They are made last, each topic meeting blocks of about
    ``BLOCK`` others, and are not shuffled; before that there are only pairs of topics that some row holds together.
    """
    g = F.coalesce(F.col(group).cast("string"), F.lit("\0")).alias("g")
    means = cut_lineage(scores.select(g, F.col(group).alias("name"), F.col(row).alias("r"), F.col(topic).alias("t"), value).groupBy("g", "name", "r", "t").agg(F.avg(value).alias("v")).filter("v IS NOT NULL AND t IS NOT NULL"), in_loop=True)
    topics = means.groupBy("g", "t").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("c"), F.var_pop("v").alias("var"))
    several = means.groupBy("g", "r").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select("g", "r")
    full = means.join(several, ["g", "r"])
    rows = several.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    centre = full.groupBy("g", "t").agg(F.avg("v").alias("m"))
    sizes = topics.groupBy("g").agg(F.count(F.lit(1)).alias("k")).join(centre.groupBy("g").agg(F.count(F.lit(1)).alias("held")), "g", "left").join(rows, "g", "left").filter("k >= 2")
    dense = F.coalesce((F.col("n") >= least_rows) & (F.col("held") == F.col("k")), F.lit(False))
    sizes = cut_lineage(sizes.select("g", "k", "n", dense.alias("dense"), F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), in_loop=True)
    known = sizes.filter("dense").select("g", "k", "n")
    centred = full.join(known.select("g"), "g", "left_semi").join(centre, ["g", "t"]).select("g", "r", "t", (F.col("v") - F.col("m")).alias("x"))
    other = centred.select("g", "r", F.col("t").alias("u"), F.col("x").alias("y"))
    sums = centred.join(other, ["g", "r"]).filter("t <= u").groupBy("g", "t", "u").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.sum(F.col("x") * F.col("x") * F.col("y") * F.col("y")).alias("q"))
    same = F.col("t") == F.col("u")
    cell = cut_lineage(sums.join(known, "g").select("g", "t", "u", "k", "n", (F.col("s") / F.col("n")).alias("s"), (F.col("q") / F.col("n")).alias("q")), in_loop=True)
    twice = F.when(same, 1.0).otherwise(2.0)
    mean = cell.groupBy("g").agg(F.sum(F.when(same, F.col("s")).otherwise(0.0)).alias("trace"), F.sum(twice * F.col("s") * F.col("s")).alias("ss"), F.sum(twice * (F.col("q") - F.col("s") * F.col("s"))).alias("noise"), F.first("k").alias("k"), F.first("n").alias("n"))
    d2 = (F.col("ss") - F.col("trace") * F.col("trace") / F.col("k")) / F.col("k")
    shrink = mean.select("g", (F.col("trace") / F.col("k")).alias("mean"), F.when(d2 > 1e-15, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("noise") / F.col("k") / F.col("n") / d2))).otherwise(0.0).alias("w"))
    sized = topics.join(sizes.select("g", "dense", "blocks"), "g")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int").alias("block")
    others = sized.select("g", "t", block("t")).groupBy("g", "block").agg(F.collect_list("t").alias("others"))
    both = F.when(same, F.array(F.struct("t", "u"))).otherwise(F.array(F.struct("t", "u"), F.struct(F.col("u").alias("t"), F.col("t").alias("u"))))
    held = cell.join(sizes.select("g", "blocks"), "g").select("g", "blocks", "s", F.explode(both).alias("p")).select("g", "p.t", block("p.u"), F.struct("p.u", "s").alias("e")).groupBy("g", "t", "block").agg(F.map_from_entries(F.collect_list("e")).alias("held"))
    own = F.when(F.col("c") > 1, F.col("var")).otherwise(1.0).alias("own")
    each = sized.join(shrink, "g", "left").select("g", "name", "t", "dense", "mean", "w", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(held, ["g", "t", "block"], "left")
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows before the pairs, many after
    grid = each.repartition(parts, "g", "block").join(others, ["g", "block"]).withColumn("u", F.explode("others"))
    cov = F.when(F.col("dense"), F.col("w") * F.when(same, F.col("mean")).otherwise(0.0) + (1 - F.col("w")) * F.coalesce(F.element_at("held", F.col("u")), F.lit(0.0))).otherwise(F.when(same, F.col("own")).otherwise(0.0))
    return grid.select(F.col("name").alias(group), F.col("t").alias("topic_a"), F.col("u").alias("topic_b"), cov.alias("cov"))


def varied_selection(items: DataFrame, group: str, item: str, vec: str, score: str, k: int = 5, weight: float = 0.6) -> DataFrame:
    """``group, item, pick``: up to ``k`` items a group by maximal marginal relevance; ties keep the smaller item.

    Each of the ``k`` rounds finds every group's best item by an aggregate and sends it to the group's other items.
    """
    state = cut_lineage(items.filter(F.col(vec).isNotNull() & F.col(score).isNotNull() & F.col(group).isNotNull()).select(group, item, unit(F.col(vec)).alias("v"), F.col(score).cast("double").alias("rel"), F.lit(None).cast("double").alias("near")))
    out = None
    for i in range(1, k + 1):
        gain = F.when(F.col("near").isNull(), F.col("rel")).otherwise(weight * F.col("rel") - (1 - weight) * F.col("near"))
        best = cut_lineage(state.groupBy(group).agg(F.min(F.struct((-F.round(gain, 12)).alias("g"), F.col(item).alias("i"), F.col("v").alias("v"))).alias("b")).select(group, F.col("b.i").alias("chosen"), F.col("b.v").alias("w")))
        picked = best.select(group, F.col("chosen").alias(item), F.lit(i).alias("pick"))
        out = picked if out is None else out.unionByName(picked)
        if i < k:
            met = skew_join(state, best, group, how="inner").filter(F.col(item) != F.col("chosen"))
            state = cut_lineage(met.select(group, item, "v", "rel", F.greatest(F.coalesce("near", F.lit(-2.0)), dot(F.col("v"), F.col("w"))).alias("near")))
    return out
