"""Orphan references and heavy keys: nulls, ties, repeated rows, empty tables and clashing columns."""

from datetime import datetime

from pyspark.sql import functions as F

from opinionframe.operators.heavy_keys import heavy_keys, per_key_profile, skew_join
from opinionframe.operators.orphans import Reference, orphan_references, orphan_report

T = lambda day: datetime(2024, 3, day)
CHILD, PARENT = "rid string, ref string, at timestamp, pk string", "id string, arrived timestamp, deleted timestamp, pk string"


def _ref(spark, children, parents):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    return [Reference("child", "parent", c, c["ref"], c["rid"], c["at"], p, p["id"], p["arrived"], p["deleted"])]


def test_orphans_by_time_case_and_white_space(spark):
    parents = [("a", T(1), None, "x"), ("A ", T(5), None, "x"), ("b", T(10), None, "x"), ("d", T(1), T(4), "x"), ("n", None, None, "x"), (None, T(1), None, "x")]
    children = [
        ("ok", " A", T(2), "y"), ("late", "b", T(3), "y"), ("later", "b", T(11), "y"), ("gone", "d", T(4), "y"), ("before", "d", T(3), "y"),
        ("missing", "zz", T(2), "y"), ("missing", "zz", T(2), "y"), ("none", "None", T(2), "y"), ("nan", " NaN ", T(2), "y"), ("blank", "  ", T(2), "y"), ("null", None, T(2), "y"),
        ("untimed", "zz", None, "y"), ("untimed2", "a", None, "y"), ("anytime", "n", T(1), "y"),
    ]
    got = {(r.record_key, r.period) for r in orphan_references(_ref(spark, children, parents)).collect()}
    assert got == {("late", "2024-03"), ("gone", "2024-03"), ("missing", "2024-03"), ("untimed", None)}
    report = {(r.src_table, r.period, r.n_orphans) for r in orphan_report(_ref(spark, children, parents)).collect()}
    assert report == {("child", "2024-03", 3), ("child", None, 1)}


def test_orphans_of_empty_tables(spark):
    assert orphan_references(_ref(spark, [], [])).count() == 0
    assert orphan_references(_ref(spark, [("r", "a", T(1), "y")], [])).count() == 1


def test_orphans_with_a_hot_key(spark):
    children = [(f"r{i}", "hot" if i % 3 else f"k{i}", T(2), "y") for i in range(900)]
    parents = [("hot", T(3), None, "x")] + [(f"k{i}", T(1), None, "x") for i in range(900)]
    assert orphan_references(_ref(spark, children, parents)).count() == sum(1 for i in range(900) if i % 3)


def test_heavy_keys_are_exact(spark):
    df = spark.createDataFrame([(1,)] * 40 + [(2,)] * 30 + [(k,) for k in range(100, 125)] + [(None,)] * 5, "k int")
    assert {tuple(r) for r in heavy_keys(df, "k", 0.3).collect()} == {(1, 40), (2, 30)}
    assert heavy_keys(df.limit(0), "k", 0.1).count() == 0


def test_skew_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    left = left.unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).unionByName(spark.createDataFrame([(7, 70)], "k long, w long"))
    for how in ("left", "inner"):
        assert sorted(map(str, skew_join(left, right, "k", how=how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_profile_handles_nulls_and_constant_groups(spark):
    rows = [("a", 1.0)] * 20 + [("a", 9.0), ("a", None), ("b", 2.0), ("b", 2.0), (None, 3.0), ("c", None)]
    got = {r.k: r.asDict() for r in per_key_profile(spark.createDataFrame(rows, "k string, v double"), "k", F.col("v")).collect()}
    assert got["a"]["n_rows"] == 22 and got["a"]["n_values"] == 21 and got["a"]["n_far"] == 1
    assert got["b"]["n_far"] == 0 and got["c"]["mean_value"] is None and got[None]["n_rows"] == 1
    assert per_key_profile(spark.createDataFrame([], "k string, v double"), "k", F.col("v")).count() == 0
