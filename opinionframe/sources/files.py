"""Readers with required columns and writers in a stable order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW_SCHEMA = "id string, nm_id bigint, rating double, full_text string, true_labels string, source string, category string"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, if it has all ``columns``; else an error that names the missing ones."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reviews from CSV with a header, quoted line breaks and ids kept as text; rows without text are dropped."""
    head = require_columns(spark.read.option("header", True).csv(path), [c.split()[0] for c in REVIEW_SCHEMA.split(", ")])
    types = dict(c.split() for c in REVIEW_SCHEMA.split(", "))
    full = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return full.select(*(F.expr(f"try_cast(`{c}` AS {types.get(c, 'string')})").alias(c) for c in head.columns)).filter("full_text IS NOT NULL AND trim(full_text) <> ''")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one row a file or array element."""
    return spark.read.option("multiLine", True).json(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], kind: str = "parquet") -> None:
    """Writes ``df`` in the order of ``keys`` (a range partitioning, not one task). NaN becomes null."""
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))
    clean.sort(*keys).write.mode("overwrite").format(kind).save(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Aspects from a YAML or JSON file of a list of mappings; missing or unknown fields, levels and repeated ids are errors.

    YAML needs the package ``yaml``; the file is a reference list, read on the driver.
    """
    from pathlib import Path

    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the package yaml; JSON works without") from e
        rows = yaml.safe_load(text)
    else:
        rows = json.loads(text)
    fields = {"id", "canonical_name", "synonyms", "level", "domains"}
    seen: set[str] = set()
    for r in rows:
        if missing := fields - set(r):
            raise ValueError(f"aspect {r.get('id')}: missing {', '.join(sorted(missing))}")
        if r["level"] not in ("general", "specific"):
            raise ValueError(f"aspect {r['id']}: level {r['level']}")
        if r["id"] in seen:
            raise ValueError(f"aspect {r['id']}: repeated id")
        seen.add(r["id"])
    out = [(r["id"], r["canonical_name"], list(r["synonyms"]), r["level"], list(r["domains"]), r.get("hypothesis_template")) for r in rows]
    return spark.createDataFrame(out, "id string, canonical_name string, synonyms array<string>, level string, domains array<string>, hypothesis_template string")


def layered_vocabulary(core: DataFrame, domain: DataFrame, categories: DataFrame) -> DataFrame:
    """``category`` and the aspects of ``core`` for all ``categories`` with those of ``domain`` (which has ``category``); of
    equal ids the core's comes first. Categories are few."""
    every = core.withColumn("layer", F.lit(0)).crossJoin(F.broadcast(categories.select("category").distinct()))  # a row a category
    both = every.unionByName(domain.withColumn("layer", F.lit(1)))
    rest = [c for c in both.columns if c not in ("category", "id", "layer")]
    return both.groupBy("category", "id").agg(F.min_by(F.struct(*rest), "layer").alias("x")).select("category", "id", "x.*")


def term_index(vocabulary: DataFrame) -> DataFrame:
    """``term, id`` of every name and synonym in lower case."""
    names = F.concat(F.array("canonical_name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return vocabulary.select(F.explode(names).alias("t"), "id").select(F.lower(F.trim("t")).alias("term"), "id").filter("term <> ''").distinct()


def run_kind(spark: SparkSession, folder: str) -> str:
    """``traced`` if the folder holds MANIFEST.json, ``summary`` if it holds run_summary.json, else an error."""
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sparkContext().hadoopConfiguration()
    for name, kind in (("MANIFEST.json", "traced"), ("run_summary.json", "summary")):
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if at.getFileSystem(conf).exists(at):
            return kind
    raise ValueError(f"no run in {folder}")


def write_snapshot(df: DataFrame, folder: str, stage: int, name: str, keys: list[str]) -> str:
    """One sorted table a stage, ``NN_name``; writing again replaces it."""
    path = f"{folder}/{stage:02d}_{name}"
    write_sorted(df, path, keys)
    return path


def read_snapshot(spark: SparkSession, folder: str, stage: int, name: str, columns: list[str]) -> DataFrame:
    return require_columns(spark.read.parquet(f"{folder}/{stage:02d}_{name}"), columns)


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header, quotes doubled, line breaks kept."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


#: The tables of a score cache and of an audit, as columns.
CACHE_TABLES = {"model_signatures": "signature string, created_at timestamp", "texts": "text_key string, text string", "entries": "pair string, signature string, score double, hits bigint, last_hit_at timestamp"}
AUDIT_TABLES = {
    "review_status": "review_id string, status string, committed int, updated_at timestamp",
    "system_decisions": "prediction_id string, review_id string, manual_decision string, mapped_gold_aspect string, committed int, updated_at timestamp",
    "gold_decisions": "review_id string, gold_aspect string, status string, matched_system_prediction_id string, committed int, updated_at timestamp",
    "app_meta": "key string, value string",
}


def create_tables(spark: SparkSession, folder: str, tables: dict[str, str]) -> None:
    """Empty parquet tables where there are none yet; what exists stays as it is."""
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def aligned_labels(labels: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch_id, item, score``: the scores of a JSON array put to the items of their batch by position, as whole numbers
    within 1..5, 3 where there is none; batches of another length than their labels are an error.

    ``labels``: batch_id, scores (a JSON array as text); ``batch``: batch_id, items (an array).
    """
    x = batch.join(labels.withColumn("s", F.from_json("scores", "array<string>")), "batch_id", "left")
    if bad := x.filter(F.coalesce(F.size("s"), F.lit(-1)) != F.size("items")).select("batch_id").head(3):  # three rows for the message
        raise ValueError(f"labels and items differ in number: {[r[0] for r in bad]}")
    at = x.select("batch_id", F.posexplode(F.arrays_zip("items", "s")).alias("pos", "z"))
    score = F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(try_cast(z.s AS double) AS int)"), F.lit(3))))
    return at.select("batch_id", F.col("z.items").alias("item"), score.alias("score"))
