"""References to records that do not exist (missing, deleted, or arriving later than the reference).

Parent and child keys are united in one long form tagged with the parent table, and grouped by (parent table, key).
The groups keep the parent's first arrival and first deletion beside the earliest and latest reference, all of which
combine before the shuffle, so a key that holds a third of the rows costs no more than any other. Groups that lack the
parent flag, or whose times can't rule out an orphan, are kept; only their references are looked at one by one.

Defined results: keys are compared without outer white space and case; null, blank, ``none`` and ``nan`` refer to
nothing; a parent without an arrival time counts as always there; a reference without a time of its own is an orphan
only if its key is missing, and its period is null; repeated rows give one row per record key (its earliest orphaned
delivery); empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionframe.operators.heavy_keys import skew_join

NOTHING = ("", "none", "nan")


def norm_key(col: Column) -> Column:
    """Lower case, without outer white space (any Unicode kind); null if it refers to nothing."""
    k = F.lower(F.regexp_replace(col.cast("string"), r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$", ""))
    return F.when(~k.isin(*NOTHING), k)


@dataclass(frozen=True)
class Reference:
    """One kind of reference: child rows (named, with key, record key and time) pointing to a parent table."""

    src_table: str
    parent_table: str
    child: DataFrame
    child_key: Column
    record_key: Column
    at: Column
    parent: DataFrame
    parent_key: Column
    arrived: Column
    deleted: Column


def _children(refs: Sequence[Reference]) -> DataFrame:
    parts = [
        r.child.select(
            F.lit(r.src_table).alias("src_table"), F.lit(r.parent_table).alias("parent_table"), norm_key(r.child_key).alias("k"),
            r.record_key.cast("string").alias("record_key"), r.at.cast("timestamp").alias("at"),
        )
        for r in refs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("k IS NOT NULL").withColumn("pk", F.concat_ws("|", "parent_table", "k"))


def orphan_references(refs: Sequence[Reference]) -> DataFrame:
    """``src_table, record_key, period``: each reference without a target at its own time, once per record key."""
    children = _children(refs)
    parents = None
    for r in refs:
        p = r.parent.select(
            F.concat_ws("|", F.lit(r.parent_table), norm_key(r.parent_key)).alias("pk"), norm_key(r.parent_key).alias("k"),
            F.coalesce(r.arrived.cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("arrived"), r.deleted.cast("timestamp").alias("deleted"),
        ).filter("k IS NOT NULL").drop("k")
        parents = p if parents is None else parents.unionByName(p)
    none = F.lit(None).cast("timestamp")
    long = parents.select("pk", F.lit(True).alias("is_parent"), "arrived", "deleted", none.alias("at")).unionByName(
        children.select("pk", F.lit(False).alias("is_parent"), none.alias("arrived"), none.alias("deleted"), "at")
    )
    groups = long.groupBy("pk").agg(
        F.max("is_parent").alias("has_parent"), F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_if(~F.col("is_parent")).alias("n_refs"),
    )
    suspect = groups.filter(
        (F.col("n_refs") > 0)
        & (~F.col("has_parent") | (F.col("arrived") > F.col("first_at")) | (F.col("deleted") <= F.col("last_at")))
    ).select("pk", "has_parent", "arrived", "deleted")
    looked = skew_join(children, suspect, "pk", how="inner")
    orphan = looked.filter(~F.col("has_parent") | (F.col("arrived") > F.col("at")) | (F.col("deleted") <= F.col("at")))
    return orphan.groupBy("src_table", "record_key").agg(F.date_format(F.min("at"), "yyyy-MM").alias("period"))


def orphan_report(refs: Sequence[Reference]) -> DataFrame:
    """``src_table, period, n_orphans``: the orphans counted per table and month."""
    return orphan_references(refs).groupBy("src_table", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
