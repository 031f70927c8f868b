"""What the plans share: pairs of predicted and gold ratings, and SQL over the test tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionframe.session import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings reviews candidates parsed_chunks nli_predictions "
    "product_aggregates system_decisions gold_decisions clusters aspect_reference source_targets pack_sizes"
).split()

PAIRS_SQL = """
WITH g AS (SELECT review_id, gold_aspect, max(gold_rating) AS gold FROM gold_decisions GROUP BY review_id, gold_aspect),
n AS (SELECT DISTINCT prediction_id, review_id, nm_id, aspect_name, aspect_source, p_entailment AS pe, p_neutral AS pn, p_contradiction AS pc, raw_rating AS raw, final_rating AS pred, has_negation_match AS neg FROM nli_predictions),
pairs AS (SELECT n.*, g.gold FROM n JOIN g ON n.review_id = g.review_id AND n.aspect_name = g.gold_aspect WHERE g.gold IS NOT NULL AND n.pred IS NOT NULL)
"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every prediction with a rating beside the gold rating of its review and aspect; repeated rows once."""
    g = table(spark, d, "gold_decisions").groupBy("review_id", "gold_aspect").agg(F.max("gold_rating").alias("gold"))
    n = table(spark, d, "nli_predictions").select(
        "prediction_id", "review_id", "nm_id", "aspect_name", "aspect_source", F.col("p_entailment").alias("pe"), F.col("p_neutral").alias("pn"), F.col("p_contradiction").alias("pc"),
        F.col("raw_rating").alias("raw"), F.col("final_rating").alias("pred"), F.col("has_negation_match").alias("neg"),
    ).filter("pred IS NOT NULL").distinct()
    return n.join(g.filter("gold IS NOT NULL").withColumnRenamed("gold_aspect", "aspect_name"), ["review_id", "aspect_name"])


def sql_plan(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A plan given as SQL: Catalyst optimises it as any other. Tables are found by their names."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def r6(*cols: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def counted(text: str) -> str:
    """``count_if(x)`` written as a count of cases, whose type is the same in every engine."""
    out, i = "", 0
    while (k := text.find("count_if(", i)) >= 0:
        depth, j = 1, k + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        out += text[i:k] + f"count(CASE WHEN {text[k + 9 : j - 1]} THEN 1 END)"
        i = j
    return out + text[i:]
