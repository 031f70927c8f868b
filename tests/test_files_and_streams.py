"""Sources, sinks and streams: what is read, refused, late, matched and folded."""

import json

import pytest
from pyspark.sql import functions as F

from opinionframe.sources import files as S
from opinionframe.streaming.events import fold_profile, lexical_matches, session_totals, windowed_totals

GOOD = {"id": "a", "canonical_name": "Прочность швов", "synonyms": ["крепость строчки", " "], "level": "specific", "domains": ["clothes"]}


def test_vocabulary_is_checked(spark, tmp_path):
    def read(*rows):
        (tmp_path / "v.json").write_text(json.dumps(rows), encoding="utf-8")
        return S.read_vocabulary(spark, str(tmp_path / "v.json"))

    v = read(GOOD, GOOD | {"id": "b", "canonical_name": "Цена", "synonyms": []})
    assert {tuple(r) for r in S.term_index(v).collect()} == {("прочность швов", "a"), ("крепость строчки", "a"), ("цена", "b")}
    for bad, message in (([{"id": "x"}], "missing"), ([GOOD | {"level": "odd"}], "level"), ([GOOD, GOOD], "repeated")):
        with pytest.raises(ValueError, match=message):
            read(*bad)
    core, domain = v.select("id", "canonical_name"), spark.createDataFrame([("shoes", "b", "Цена обуви"), ("shoes", "c", "Подошва")], "category string, id string, canonical_name string")
    got = {tuple(r) for r in S.layered_vocabulary(core, domain, spark.createDataFrame([("shoes",), ("food",)], "category string")).select("category", "id", "canonical_name").collect()}
    assert got == {("shoes", "a", "Прочность швов"), ("shoes", "b", "Цена"), ("shoes", "c", "Подошва"), ("food", "a", "Прочность швов"), ("food", "b", "Цена")}


def test_runs_snapshots_and_exports(spark, tmp_path):
    with pytest.raises(ValueError, match="no run"):
        S.run_kind(spark, str(tmp_path))
    (tmp_path / "run_summary.json").write_text("{}")
    assert S.run_kind(spark, str(tmp_path)) == "summary"
    (tmp_path / "MANIFEST.json").write_text("{}")
    assert S.run_kind(spark, str(tmp_path)) == "traced"
    df = spark.createDataFrame([("b", 'да, "так"\nи так'), ("a", None)], "k string, t string")
    for _ in range(2):
        S.write_snapshot(df, str(tmp_path), 3, "texts", ["k"])
    assert S.read_snapshot(spark, str(tmp_path), 3, "texts", ["k", "t"]).count() == 2
    with pytest.raises(ValueError, match="missing"):
        S.read_snapshot(spark, str(tmp_path), 3, "texts", ["other"])
    S.export_csv({"t": df}, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv" / "t"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    S.create_tables(spark, str(tmp_path / "db"), S.AUDIT_TABLES | S.CACHE_TABLES)
    spark.createDataFrame([("k", "v")], "key string, value string").write.mode("append").parquet(str(tmp_path / "db" / "app_meta"))
    S.create_tables(spark, str(tmp_path / "db"), S.AUDIT_TABLES)
    assert spark.read.parquet(str(tmp_path / "db" / "app_meta")).count() == 1
    (tmp_path / "doc.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert S.read_json_documents(spark, str(tmp_path / "doc.json")).count() == 2


def test_labels_by_position(spark):
    batch = spark.createDataFrame([(1, ["x", "y", "z", "w"])], "batch_id int, items array<string>")
    labels = spark.createDataFrame([(1, '[9, "2", null, "n/a"]')], "batch_id int, scores string")
    assert [(r.item, r.score) for r in S.aligned_labels(labels, batch).collect()] == [("x", 5), ("y", 2), ("z", 3), ("w", 3)]
    for wrong in ("[1]", "oops"):
        with pytest.raises(ValueError, match="differ"):
            S.aligned_labels(labels.withColumn("scores", F.lit(wrong)), batch)


def _run(spark, tmp_path, name, batches, schema, plan):
    """What a stream gives to which the batches come one after the other."""
    folder = tmp_path / name
    folder.mkdir()
    typed = lambda rows: spark.createDataFrame(rows, schema).withColumn("t", F.to_timestamp("t"))
    s = spark.readStream.schema(typed([]).schema).option("recursiveFileLookup", True).parquet(str(folder))
    q = plan(s).option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    for i, rows in enumerate(batches):
        typed(rows).coalesce(1).write.parquet(str(folder / f"b{i}"))
        q.processAllAvailable()
    q.stop()


def _rows(spark, tmp_path, name, batches, schema, plan):
    _run(spark, tmp_path, name, batches, schema, lambda s: plan(s).writeStream.format("memory").queryName(name).outputMode("append"))
    return sorted(map(tuple, spark.table(name).collect()), key=str)


SCHEMA = "t string, k string, v double"


def test_late_rows_are_left_out(spark, tmp_path):
    batches = [[("2024-01-01 00:10:00", "u", 1.0)], [("2024-01-01 09:00:00", "u", 1.0)], [("2024-01-01 00:20:00", "u", 5.0)], [("2024-01-01 15:00:00", "u", 1.0)], [("2024-01-01 15:01:00", "u", 1.0)]]
    got = _rows(spark, tmp_path, "late", batches, SCHEMA, lambda s: windowed_totals(s, "t", "k", "v"))
    assert [(r[3], r[4]) for r in got][0] == (1, 1.0)  # the window of midnight without the row that came eight hours late


def test_sessions_of_a_stream(spark, tmp_path):
    batches = [[("2024-01-01 00:00:00", "u", 1.0), ("2024-01-01 00:10:00", "u", 1.0)], [("2024-01-01 02:00:00", "u", 1.0)], [("2024-01-01 20:00:00", "u", 1.0)], [("2024-01-01 20:01:00", "u", 1.0)]]
    got = _rows(spark, tmp_path, "sess", batches, SCHEMA, lambda s: session_totals(s, "t", "k"))
    assert [r[3] for r in got][:2] == [2, 1]


def test_stream_meets_terms_and_folds(spark, tmp_path):
    batches = [[("2024-01-01 00:00:00", "Прочность-швов", 1.0)], [("2024-01-01 00:10:00", "цена ", 2.0), ("2024-01-01 00:11:00", None, 9.0), ("2024-01-01 00:12:00", "мимо", 9.0)]]
    terms = spark.createDataFrame([("прочность швов", "a"), ("цена", "b")], "term string, id string")
    got = _rows(spark, tmp_path, "lex", batches, SCHEMA, lambda s: lexical_matches(s, "k", terms).select("v", "id"))
    assert [r[-1] for r in got] == ["a", "b"]
    _run(spark, tmp_path, "fold", batches, SCHEMA, lambda s: s.writeStream.foreachBatch(lambda df, _: fold_profile(df, str(tmp_path / "index"), "k", "v")))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {("Прочность-швов", 1, 1.0), ("цена ", 1, 2.0), (None, 1, 9.0), ("мимо", 1, 9.0)}
