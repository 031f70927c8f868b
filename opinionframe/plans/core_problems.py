"""The queries of the general problems (orphan references, heavy keys) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionframe.operators.heavy_keys import heavy_keys, per_key_profile
from opinionframe.operators.orphans import Reference, orphan_references, orphan_report
from opinionframe.session import table


def _references(spark: SparkSession, d: str) -> list[Reference]:
    nli, gold = table(spark, d, "nli_predictions"), table(spark, d, "gold_decisions")
    reviews, system = table(spark, d, "reviews"), table(spark, d, "system_decisions")
    return [
        Reference("nli_predictions", "reviews", nli, nli["review_id"], nli["prediction_id"], nli["created_at"], reviews, reviews["id"], reviews["ingested_at"], reviews["deleted_at"]),
        Reference(
            "gold_decisions", "system_decisions", gold, gold["matched_system_prediction_id"],
            F.concat(F.coalesce(gold["review_id"], F.lit("")), F.lit("|"), F.coalesce(gold["gold_aspect"], F.lit(""))), gold["updated_at"],
            system, system["prediction_id"], system["ingested_at"], system["deleted_at"],
        ),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_references(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "product_aggregates"), "nm_id", 0.03).select("nm_id")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return per_key_profile(table(spark, d, "product_aggregates"), "nm_id", F.col("raw_mean_rating")).select(
        "nm_id", "n_rows", "n_values", *(F.round(c, 6).alias(c) for c in ("mean_value", "sd_value", "min_value", "max_value")), "n_far"
    )


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_profile": p5_profile}

_KEY = r"nullif(nullif(nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), ''), 'none'), 'nan')"
_ORPHANS = f"""
WITH c AS (
  SELECT 'nli_predictions' AS src_table, 'r' AS t, {_KEY.format(c='review_id')} AS k, prediction_id AS record_key, created_at AS tm FROM nli_predictions
  UNION ALL
  SELECT 'gold_decisions', 's', {_KEY.format(c='matched_system_prediction_id')}, coalesce(review_id, '') || '|' || coalesce(gold_aspect, ''), updated_at FROM gold_decisions
), p AS (
  SELECT 'r' AS t, {_KEY.format(c='id')} AS k, ingested_at AS arrived, deleted_at AS deleted FROM reviews
  UNION ALL SELECT 's', {_KEY.format(c='prediction_id')}, ingested_at, deleted_at FROM system_decisions
), g AS (SELECT t, k, min(arrived) AS arrived, min(deleted) AS deleted FROM p WHERE k IS NOT NULL GROUP BY t, k),
o AS (
  SELECT src_table, record_key, strftime(min(tm), '%Y-%m') AS period
  FROM c LEFT JOIN g ON g.t = c.t AND g.k = c.k
  WHERE c.k IS NOT NULL AND (g.k IS NULL OR g.arrived > c.tm OR g.deleted <= c.tm)
  GROUP BY src_table, record_key
)
"""
ORACLE_SQL = {
    "p3_found": _ORPHANS + "SELECT * FROM o",
    "p3_report": _ORPHANS + "SELECT src_table, period, count(*) AS n_orphans FROM o GROUP BY src_table, period",
    "p5_found": "SELECT nm_id FROM product_aggregates WHERE nm_id IS NOT NULL GROUP BY nm_id HAVING count(*) >= 0.03 * (SELECT count(*) FROM product_aggregates)",
    "p5_profile": """
WITH f AS (SELECT nm_id, count(*) AS n_rows, count(raw_mean_rating) AS n_values, avg(raw_mean_rating) AS m, stddev_pop(raw_mean_rating) AS s, min(raw_mean_rating) AS lo, max(raw_mean_rating) AS hi FROM product_aggregates GROUP BY nm_id),
far AS (SELECT p.nm_id, count(*) AS n_far FROM product_aggregates p JOIN f USING (nm_id) WHERE f.s > 0 AND abs(p.raw_mean_rating - f.m) > 2.0 * f.s GROUP BY p.nm_id)
SELECT f.nm_id, n_rows, n_values, round(m, 6) AS mean_value, round(s, 6) AS sd_value, round(lo, 6) AS min_value, round(hi, 6) AS max_value, coalesce(n_far, 0) AS n_far FROM f LEFT JOIN far USING (nm_id)""",
}
