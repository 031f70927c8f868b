"""Sources, streams, covariance, selection, upserts and the column expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionframe.functions import rating as R
from opinionframe.functions import text as X
from opinionframe.operators.covariance import topic_covariance, varied_selection
from opinionframe.operators.ranks import value_ranks
from opinionframe.operators.upsert import insert_or_ignore, merge
from opinionframe.sources.files import read_reviews_csv, require_columns, write_sorted
from opinionframe.streaming.events import first_deliveries, running_scores, session_totals, windowed_totals


def test_csv_and_sorted_parquet(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,nm_id,rating,full_text,true_labels,source,category\n007,1,5.0,"да,\nи нет",{},a,b\n8,x,4,  ,{},a,b\n')
    got = read_reviews_csv(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.id, r.nm_id, r.full_text) for r in got] == [("007", 1, "да,\nи нет")]
    with pytest.raises(ValueError, match="other"):
        require_columns(spark.range(1), ["other"])
    df = spark.createDataFrame([(2, float("nan")), (1, 0.5)], "k int, v double")
    write_sorted(df, str(tmp_path / "out"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0.5), (2, None)}


def test_streams_equal_batches(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "u", 1, 2.0), ("2024-01-01 00:20:00", "u", 1, 3.0), ("2024-01-01 03:00:00", "u", 2, 4.0)], "t string, k string, i int, v double").withColumn("t", F.to_timestamp("t"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("q").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{len(list(tmp_path.iterdir()))}")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table("q").collect()))

    assert run(windowed_totals(stream, "t", "k", "v"), "complete") == sorted(map(tuple, windowed_totals(e, "t", "k", "v").collect()))
    assert run(running_scores(stream, ["k"], "v"), "complete") == [("u", 3, 3.0)]
    assert len(run(first_deliveries(stream, "t", ["i"]), "append")) == 2 and first_deliveries(e, "t", ["i"]).count() == 2
    assert session_totals(e, "t", "k").count() == 2


def ledoit_wolf(x):
    """The published estimator, on a full matrix."""
    n, k = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    mean = np.trace(s) / k
    d2 = ((s - mean * np.eye(k)) ** 2).sum() / k
    b2 = min(d2, (((c**2).T @ (c**2) / n) - s**2).sum() / k / n)
    w = b2 / d2 if d2 > 0 else 0.0
    return w * mean * np.eye(k) + (1 - w) * s


def test_ranks_equal_sorting(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=700), 1).tolist() + [5.0] * 300
    got = {r.x: (r.n, r.avg_rank, r.hits) for r in value_ranks(spark.createDataFrame([(v,) for v in x] + [(None,)], "x double"), "x", hits=F.lit(2)).collect()}
    order = np.sort(x)
    assert got == {v: (int((order == v).sum()), float(np.mean(np.flatnonzero(order == v) + 1)), 2 * int((order == v).sum())) for v in set(x)}
    assert value_ranks(spark.createDataFrame([], "x double"), "x").count() == 0


def test_shrunken_covariance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    c, s = ledoit_wolf(x), np.cov(x.T, bias=True)
    assert np.allclose(np.trace(c), np.trace(s)) and np.linalg.norm(c - np.diag(np.diag(c))) < np.linalg.norm(s - np.diag(np.diag(s)))
    rows = [(1, f"r{i}", t, float(x[i, j])) for i in range(40) for j, t in enumerate("abc")] + [(2, "r", "a", 1.0), (2, "s", "a", 3.0), (2, "s", "b", 2.0), (3, "r", "a", None)]
    got = {(r.nm, r.topic_a, r.topic_b): r.cov for r in topic_covariance(spark.createDataFrame(rows, "nm int, rid string, topic string, v double"), "nm", "rid", "topic", "v").collect()}
    assert np.isclose(got[(1, "a", "b")], c[0, 1]) and np.isclose(got[(1, "b", "b")], c[1, 1]) and got[(2, "a", "a")] == 1.0 and got[(2, "b", "b")] == 1.0 and (3, "a", "a") not in got


def test_varied_selection(spark):
    rows = [("g", "a", [1.0, 0.0], 0.9), ("g", "b", [1.0, 0.01], 0.89), ("g", "c", [0.0, 1.0], 0.5), ("g", "d", None, 0.9)]
    got = varied_selection(spark.createDataFrame(rows, "g string, i string, v array<double>, s double"), "g", "i", "v", "s", k=2).orderBy("pick").collect()
    assert [r.i for r in got] == ["a", "c"]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 0, "w"), ("c", 1, None), ("c", 1, None)], "k string, t int, v string")
    assert sorted(map(tuple, merge(old, new, ["k"], ["t"]).select("k", "t", "v").collect()), key=str) == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, None)]
    assert insert_or_ignore(old, new, ["k"]).count() == 3


def test_expressions_on_nulls_and_edges(spark):
    df = spark.createDataFrame([(None, None), (2.5, 3.5), (9.0, -1.0)], "a double, b double")
    got = df.select(R.clip(F.col("a")).alias("c"), R.half_even(F.col("a")).alias("h"), R.error_type(F.col("a"), F.col("b")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (2.5, 2, "too_high"), (5.0, 5, "strong_wrong_polarity")]
    t = spark.createDataFrame([("Да!Нет…  ёж\\nи,тут",), ("",), (None,)], "t string")
    got = t.select(X.clean_text(F.col("t")).alias("c"), X.words(F.col("t")).alias("w"), X.plain_sentences(F.col("t")).alias("s")).collect()
    assert spark.createDataFrame([("Нет…ёж «да»...ок\n\nтак",)], "t string").select(X.clean_text(F.col("t"))).first()[0] == "Нет ёж да . . . ок так"
    assert got[0].c == "Да! Нет ёж и, тут" and got[1].w == [] and got[1].s == [""]
    labels = spark.createDataFrame([("{'а': 1.0, '': 2.0, 'б': None}",), ("мусор",), (None,)], "t string").select(X.label_map(F.col("t")).alias("m")).collect()
    assert [r.m for r in labels] == [{"а": 1.0}, {}, {}]
