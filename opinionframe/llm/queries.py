"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionframe.llm.canonical import match_values
from opinionframe.llm.clusters import phrase_clusters
from opinionframe.llm.mixing import language_key, marginal_report, mixture, mixture_report, source_key
from opinionframe.llm.near_dup import class_links, linked_ids, near_duplicate_documents, text_classes
from opinionframe.llm.packing import pack_summary, packs
from opinionframe.llm.sentences import sentences
from opinionframe.llm.spam import FEATURES, spam_scores
from opinionframe.llm.textnorm import blank
from opinionframe.llm.tokens import with_token_counts
from opinionframe.operators.heavy_keys import skew_join
from opinionframe.session import cut_lineage, table


def _typed_values(spark: SparkSession, d: str) -> DataFrame:
    parts = [("nli_predictions", "aspect_name"), ("system_decisions", "mapped_gold_aspect")]
    nli, system = (table(spark, d, t).select(F.lit(t).alias("src_table"), "prediction_id", F.col(c).alias("value")) for t, c in parts)
    return nli.unionByName(system).filter(~blank(F.col("value")))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "aspect_reference")
    names = refs.select("aspect_id", "canonical_name")
    rows = _typed_values(spark, d).join(names.select(F.col("canonical_name").alias("value")), "value", "left_anti")
    entries = refs.select(F.col("aspect_id").alias("entry_id"), F.explode(F.concat(F.array("canonical_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    best = cut_lineage(match_values(rows, entries))
    return skew_join(rows, best, "value", how="inner")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).groupBy("src_table", "prediction_id").agg(F.coalesce(F.min("entry_id"), F.lit("none")).alias("aspect_id"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).filter("entry_id IS NULL").groupBy("src_table", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_scores(table(spark, d, "documents"), "doc_id", "text").filter("is_spam").select(F.col("id").alias("doc_id")).distinct()


def p9_by_language(spark: SparkSession, d: str) -> DataFrame:
    means = (F.round(F.avg(f), 4).alias(f"mean_{f}") for f in FEATURES)
    return spam_scores(table(spark, d, "documents"), "doc_id", "text").groupBy("lang", "is_spam").agg(F.count(F.lit(1)).alias("n_docs"), *means)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members = cut_lineage(text_classes(table(spark, d, "reviews"), "id", "full_text"))
    return linked_ids(members, class_links(members))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_documents(table(spark, d, "reviews"), "id", "full_text")


def _phrases(spark: SparkSession, d: str, with_typicality: bool) -> DataFrame:
    named = table(spark, d, "clusters").select(F.col("cluster_id").alias("name_id"), F.col("medoid_phrase").alias("phrase")).filter("phrase IS NOT NULL")
    return cut_lineage(phrase_clusters(table(spark, d, "candidates").select("candidate_id", "text").distinct(), named, with_typicality))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of the clusters that ``clusters`` names, one row each."""
    named = _phrases(spark, d, False).filter("name_id IS NOT NULL").select("text", "name_id")
    rows = table(spark, d, "candidates").select("candidate_id", "text").filter("candidate_id IS NOT NULL")
    return skew_join(rows, named, "text", how="inner").groupBy("candidate_id").agg(F.min("name_id").alias("cluster_id"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size, its number of wordings and its three most typical phrases."""
    rows = _phrases(spark, d, True).filter("cluster IS NOT NULL AND n > 0")
    first = Window.partitionBy("cluster").orderBy(F.col("typicality").desc(), F.col("n").desc(), "text")
    top = rows.withColumn("r", F.row_number().over(first)).filter("r <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " / ").alias("typical"))
    return rows.groupBy("cluster").agg(F.sum("n").alias("n_candidates"), F.count(F.lit(1)).alias("n_wordings"), F.min("name_id").alias("cluster_id")).join(top, "cluster")


def _all_sentences(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    parts = [("reviews", "id", "full_text"), ("parsed_chunks", "chunk_id", "sentence")]
    a, b = (sentences(table(spark, d, t), key, text, with_text).withColumn("src_table", F.lit(t)) for t, key, text in parts)
    return a.unionByName(b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _all_sentences(spark, d, False).select("src_table", "record_id", "start_offset", "end_offset")


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _all_sentences(spark, d, True).select("src_table", "record_id", "seq", "sentence", "list_level").distinct()


def _capacities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pack_sizes").select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity"))


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sized = cut_lineage(with_token_counts(docs.filter("doc_id IS NOT NULL"), "text", [F.col("doc_id").alias("id"), F.md5("text").alias("m")]))
    return packs(sized.dropDuplicates(["id", "m"]).drop("m"), _capacities(spark, d)).withColumnRenamed("id", "doc_id")


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return pack_summary(p7_packs(spark, d), _capacities(spark, d))


def _sized_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts with their size, source, language and topic: the category of the product they are about."""
    docs = table(spark, d, "documents")
    keep = [F.col("doc_id").alias("id"), source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("lang"), "nm_id", F.md5("text").alias("text_key")]
    category = table(spark, d, "reviews").filter("nm_id <> 0 AND category IS NOT NULL").groupBy("nm_id").agg(F.min("category").alias("topic"))
    return cut_lineage(skew_join(cut_lineage(with_token_counts(docs, "text", keep)), category, "nm_id").drop("nm_id"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(_sized_texts(spark, d), table(spark, d, "source_targets")).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "source_targets")
    return mixture_report(cut_lineage(mixture(_sized_texts(spark, d), targets)), targets)


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized_texts(spark, d), table(spark, d, "source_targets")
    return marginal_report(cut_lineage(mixture(sized, targets)), sized, targets)


QUERIES = {"p7_packs": p7_packs, "p7_summary": p7_summary, "p8_mixture": p8_mixture, "p8_report": p8_report, "p8_marginals": p8_marginals, "p2_found": p2_found, "p2_sentences": p2_sentences, "p6_found": p6_found, "p6_clusters": p6_clusters, "p1_found": p1_found, "p1_groups": p1_groups, "p9_found": p9_found, "p9_by_language": p9_by_language, "p4_found": p4_found, "p4_unmatched": p4_unmatched}
#: All pairs by brute force: shared words, the k-th occurrence of a word being a word of its own.
_P1_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY id, full_text) AS doc, id, full_text FROM (SELECT DISTINCT id, full_text FROM reviews WHERE id IS NOT NULL AND full_text IS NOT NULL) x),
w AS (SELECT doc, id, unnest(regexp_extract_all(replace(lower(full_text), 'ё', 'е'), '[a-zªºß-öø-ʯḀ-ỿЀ-ԯᲀ-ᲈⷠ-ⷿꙀ-ꚟ̀-ͯ]+|\p{Nd}+')) AS w FROM d),
t AS (SELECT doc, id, w, row_number() OVER (PARTITION BY doc, w) AS k, count(*) OVER (PARTITION BY doc) AS n FROM w QUALIFY n >= 30)
SELECT DISTINCT id_a, id_b FROM (SELECT a.id AS id_a, b.id AS id_b, a.doc, b.doc FROM t a JOIN t b ON a.w = b.w AND a.k = b.k AND a.id < b.id GROUP BY a.id, b.id, a.doc, b.doc HAVING 5 * count(*) >= 4 * greatest(any_value(a.n), any_value(b.n))) y"""
ORACLE_SQL: dict[str, str] = {"p1_found": _P1_SQL}
