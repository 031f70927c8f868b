"""Rating, metric and aggregation plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionframe.functions import rating as R
from opinionframe.operators.heavy_keys import skew_join
from opinionframe.operators.windows import head_by
from opinionframe.plans.base import PAIRS_SQL, counted, pairs, r6, sql_plan
from opinionframe.session import cut_lineage, table

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, fn, sql: str | None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = counted(sql)


def _same(name: str, sql: str) -> None:
    _add(name, sql_plan(sql), sql)


_CLIP = "least(5.0, greatest(1.0, {0}))".format
_VEC = "CASE WHEN {0} <= 3 THEN (3 - {0}) / 2 ELSE 0 END, CASE WHEN {0} <= 3 THEN ({0} - 1) / 2 ELSE (5 - {0}) / 2 END, CASE WHEN {0} <= 3 THEN 0 ELSE ({0} - 3) / 2 END"


def i_errors(spark: SparkSession, d: str) -> DataFrame:
    g, p = F.col("gold"), R.clip(F.col("pred"))
    return pairs(spark, d).select(
        "prediction_id", p.alias("clipped"), R.half_even(F.col("pred")).alias("rounded"), F.round(F.abs(p - g), 6).alias("abs_error"), F.round(p - g, 6).alias("signed_error"),
        R.gold_direction(g).alias("gold_direction"), R.predicted_direction(p).alias("pred_direction"), R.wrong_polarity(g, p).alias("wrong"), R.strong_wrong_polarity(g, p).alias("strong"), R.error_type(g, p).alias("error_type"),
    )


_DIRS = "CASE WHEN gold <= 2 THEN 'negative' WHEN gold >= 4 THEN 'positive' ELSE 'neutral' END AS gd, CASE WHEN p < 2.75 THEN 'negative' WHEN p <= 3.25 THEN 'neutral' ELSE 'positive' END AS pd, (gold >= 4 AND p < 2.75) OR (gold <= 2 AND p > 3.25) AS wrong, (gold >= 4 AND p <= 2) OR (gold <= 2 AND p >= 4) AS strong"
_ENRICHED = PAIRS_SQL + f", c AS (SELECT *, {_CLIP('pred')} AS p FROM pairs), e AS (SELECT *, {_DIRS} FROM c)"
_add("i11_pair_errors", i_errors, _ENRICHED + """
SELECT prediction_id, p AS clipped, CAST(least(5, greatest(1, round_even(pred, 0))) AS INTEGER) AS rounded, round(abs(p - gold), 6) AS abs_error, round(p - gold, 6) AS signed_error, gd AS gold_direction, pd AS pred_direction, wrong, strong,
 CASE WHEN strong THEN 'strong_wrong_polarity' WHEN wrong THEN 'wrong_polarity' WHEN p - gold <= -2 THEN 'large_too_low' WHEN p - gold >= 2 THEN 'large_too_high' WHEN p - gold <= -1 THEN 'too_low' WHEN p - gold >= 1 THEN 'too_high' ELSE 'near_miss' END AS error_type FROM e""")


def i_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = R.vector_distances(F.col("gold"), F.col("pred"))
    return pairs(spark, d).select("prediction_id", *(F.round(c, 6).alias(k) for k, c in v.items()), *(F.round(c, 6).alias(k) for k, c in zip(("neg_part", "neu_part", "pos_part"), R.sentiment_vector(F.col("pred")), strict=True)))


_G, _P = _VEC.format("gold").split(", "), _VEC.format("p").split(", ")
_add("i12_vector_distances", i_vectors, _ENRICHED + f", v AS (SELECT prediction_id, {_G[0]} AS a0, {_G[1]} AS a1, {_G[2]} AS a2, {_P[0]} AS b0, {_P[1]} AS b1, {_P[2]} AS b2 FROM e)" + """
SELECT prediction_id, round(abs(a0-b0)+abs(a1-b1)+abs(a2-b2), 6) AS l1, round(sqrt((a0-b0)*(a0-b0)+(a1-b1)*(a1-b1)+(a2-b2)*(a2-b2)), 6) AS l2,
 round((a0*b0+a1*b1+a2*b2)/(sqrt(a0*a0+a1*a1+a2*a2)*sqrt(b0*b0+b1*b1+b2*b2)), 6) AS cosine, round(b0, 6) AS neg_part, round(b1, 6) AS neu_part, round(b2, 6) AS pos_part FROM v""")


#: The tables hold one hypothesis a prediction; in place of the negative one stands the review's other prediction, the
#: first by id that has all three probabilities.
_TWO_SQL = PAIRS_SQL + """, h AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY prediction_id, e, u, c) AS k FROM (SELECT DISTINCT prediction_id, review_id, p_entailment AS e, p_neutral AS u, p_contradiction AS c FROM nli_predictions WHERE p_entailment IS NOT NULL AND p_neutral IS NOT NULL AND p_contradiction IS NOT NULL) y),
two AS (SELECT p.gold, p.pred, p.pe, p.pn, p.pc, o.e AS ne, o.u AS nu, o.c AS nc FROM pairs p LEFT JOIN h f ON f.review_id = p.review_id AND f.k = 1 LEFT JOIN h o ON o.review_id = p.review_id AND o.k = CASE WHEN f.prediction_id = p.prediction_id THEN 2 ELSE 1 END)
"""


def two_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with ``pe, pn, pc`` of their own hypothesis and ``ne, nu, nc`` of the second one, null where there is none."""
    h = table(spark, d, "nli_predictions").filter("review_id IS NOT NULL AND p_entailment IS NOT NULL AND p_neutral IS NOT NULL AND p_contradiction IS NOT NULL")
    h = h.select("review_id", "prediction_id", F.col("p_entailment").alias("e"), F.col("p_neutral").alias("u"), F.col("p_contradiction").alias("c")).distinct()
    ranked = head_by(h, ["review_id"], [F.col("prediction_id"), F.col("e"), F.col("u"), F.col("c")], 2)
    both = ranked.groupBy("review_id").agg(*(F.max(F.when(F.col("rank") == k, F.struct("prediction_id", "e", "u", "c"))).alias(f"h{k}") for k in (1, 2)))
    o = F.when(F.col("h1.prediction_id") == F.col("prediction_id"), F.col("h2")).otherwise(F.col("h1"))
    return pairs(spark, d).join(both, "review_id", "left").withColumn("o", o).select("gold", "pred", "pe", "pn", "pc", F.col("o.e").alias("ne"), F.col("o.u").alias("nu"), F.col("o.c").alias("nc"))


def formula_table(rows: DataFrame) -> DataFrame:
    """``formula, mae, n`` of the 25 formulas; each over the rows that hold all it needs."""
    f = R.formulas(*(F.col(c) for c in ("pe", "pn", "pc", "ne", "nu", "nc", "pred")))
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("formula"), c.alias("value")) for k, c in f.items()))).alias("x")
    return rows.select("gold", long).groupBy("x.formula").agg(F.round(F.avg(F.abs(F.col("x.value") - F.col("gold"))), 6).alias("mae"), F.count("x.value").alias("n"))


def _formula_sql() -> str:
    num = lambda x: str(x).replace(".", "_")
    up, down, mid = "(pe+nc)", "(ne+pc)", "(0.5*(pn+nu))"
    power = lambda a: f"(5*pow({up},{a})+3*pow({mid},{a})+pow({down},{a}))/(pow({up},{a})+pow({mid},{a})+pow({down},{a})+1e-6)"
    f = {"F0_current": "pred", "F1_pos_full_distribution": "5*pe+3*pn+pc", "F2_neg_full_distribution": "5*nc+3*nu+ne", "F3_avg_full_distribution": f"CASE WHEN pe+pn+pc+ne+nu+nc IS NOT NULL THEN ({_CLIP('5*pe+3*pn+pc')}+{_CLIP('5*nc+3*nu+ne')})/2 END", "F4_dual_diff": "3+2*(pe-ne)", "F5_dual_ratio": "3+2*(pe-ne)/(pe+ne+1e-6)", "F7_dual_full_nli": power(1)}
    f |= {f"F6_dual_logratio_T{num(t)}": f"1+4/(1+exp(-(ln(pe+1e-6)-ln(ne+1e-6))/{t}))" for t in R.TEMPERATURES}
    f |= {f"F8_dual_full_nli_power_alpha{num(a)}": power(a) for a in R.TEMPERATURES}
    f |= {f"F9_center_expansion_gamma{num(g)}": f"3+{g}*(pred-3)" for g in R.GAMMAS}
    one = lambda k, x: f"SELECT '{k}' AS formula, round(avg(abs({_CLIP(x)} - gold)), 6) AS mae, count({x}) AS n FROM two"
    return _TWO_SQL + " UNION ALL ".join(one(k, x).replace(_CLIP(x), f"CASE WHEN ({x}) IS NOT NULL THEN {_CLIP(x)} END") for k, x in f.items())


_add("i5_formula_mae", lambda s, d: formula_table(two_hypotheses(s, d)), _formula_sql())


def i_softmax(spark: SparkSession, d: str) -> DataFrame:
    p = R.softmax3(F.col("p_entailment"), F.col("p_neutral"), F.col("p_contradiction"))
    rows = table(spark, d, "nli_predictions").select("prediction_id", "p_entailment", "p_neutral", "p_contradiction").distinct()
    return rows.select("prediction_id", *(F.round(c, 6).alias(k) for k, c in zip(("s_ent", "s_neu", "s_con"), p, strict=True)), F.round(R.expected_rating(F.col("p_entailment"), F.col("p_neutral"), F.col("p_contradiction")), 6).alias("v4"), F.round(R.dual_rating(F.col("p_entailment"), F.col("p_contradiction")), 6).alias("v5"))


_add("i1_softmax_ratings", i_softmax, """
WITH n AS (SELECT DISTINCT prediction_id, p_entailment AS a, p_neutral AS b, p_contradiction AS c FROM nli_predictions),
m AS (SELECT *, exp((a - greatest(a, b, c)) / 0.7) AS x, exp((b - greatest(a, b, c)) / 0.7) AS y, exp((c - greatest(a, b, c)) / 0.7) AS z FROM n)
SELECT prediction_id, round(x / (x + y + z), 6) AS s_ent, round(y / (x + y + z), 6) AS s_neu, round(z / (x + y + z), 6) AS s_con, round(least(5.0, greatest(1.0, 5*a + 3*b + c)), 6) AS v4, round(least(5.0, greatest(1.0, 1 + 4*a / (a + c + 1e-4))), 6) AS v5 FROM m""")

_METRICS = """count(*) AS n_pairs, count(DISTINCT review_id) AS n_reviews, round(avg(abs(p - gold)), 6) AS mae, round(median(abs(p - gold)), 6) AS median_ae, round(sqrt(avg((p - gold) * (p - gold))), 6) AS rmse, round(avg(p - gold), 6) AS signed_error,
 round(avg(CASE WHEN abs(p - gold) <= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS acc_0_5, round(avg(CASE WHEN abs(p - gold) <= 1.0 THEN 1e0 ELSE 0e0 END), 6) AS acc_1_0, round(avg(CASE WHEN abs(p - gold) <= 1.5 THEN 1e0 ELSE 0e0 END), 6) AS acc_1_5,
 round(avg(CASE WHEN gd = pd THEN 1e0 ELSE 0e0 END), 6) AS direction_accuracy, round(avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END), 6) AS wrong_rate, round(avg(CASE WHEN strong THEN 1e0 ELSE 0e0 END), 6) AS strong_wrong_rate,
 round(avg(CASE WHEN gd <> 'neutral' THEN CASE WHEN pd = 'neutral' THEN 1e0 ELSE 0e0 END END), 6) AS neutral_collapse_rate, round(avg(CASE WHEN gd <> 'neutral' THEN CASE WHEN wrong THEN 1e0 ELSE 0e0 END END), 6) AS polarity_flip_rate"""


def pair_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """All metrics of predicted against gold ratings in one pass, overall or per key."""
    g, p = F.col("gold"), R.clip(F.col("pred"))
    e = F.abs(p - g)
    gd, pd = R.gold_direction(g), R.predicted_direction(p)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    polar = lambda c: F.round(F.avg(F.when(gd != "neutral", c.cast("double"))), 6)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("review_id").alias("n_reviews"), F.round(F.avg(e), 6).alias("mae"), F.round(F.median(e), 6).alias("median_ae"), F.round(F.sqrt(F.avg((p - g) * (p - g))), 6).alias("rmse"), F.round(F.avg(p - g), 6).alias("signed_error"),
        *(share(e <= t).alias(f"acc_{str(t).replace('.', '_')}") for t in (0.5, 1.0, 1.5)), share(gd == pd).alias("direction_accuracy"), share(R.wrong_polarity(g, p)).alias("wrong_rate"), share(R.strong_wrong_polarity(g, p)).alias("strong_wrong_rate"),
        polar(pd == "neutral").alias("neutral_collapse_rate"), polar(R.wrong_polarity(g, p)).alias("polarity_flip_rate"),
    )


_add("d16_pair_metrics", lambda s, d: pair_metrics(pairs(s, d)), _ENRICHED + f"SELECT {_METRICS} FROM e")
_add("d17_pair_metrics_by_source", lambda s, d: pair_metrics(pairs(s, d), "aspect_source"), _ENRICHED + f"SELECT aspect_source, {_METRICS} FROM e GROUP BY aspect_source")


def d_sliced(spark: SparkSession, d: str) -> DataFrame:
    """Slices by source, product and aspect and overall, by grouping sets over one scan."""
    rows = pairs(spark, d).select("aspect_source", "nm_id", "aspect_name", F.abs(R.clip(F.col("pred")) - F.col("gold")).alias("e"))
    keys = ["aspect_source", "nm_id", "aspect_name"]
    sets = rows.groupingSets([[F.col("aspect_source")], [F.col("nm_id")], [F.col("aspect_name")], []], *keys)
    return sets.agg(F.grouping_id(*keys).cast("bigint").alias("slice_id"), F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mae"), F.round(F.max("e"), 6).alias("worst"))


_add("d19_sliced_metrics", d_sliced, PAIRS_SQL + f", c AS (SELECT *, abs({_CLIP('pred')} - gold) AS e FROM pairs)" + "SELECT aspect_source, nm_id, aspect_name, CAST(grouping_id(aspect_source, nm_id, aspect_name) AS BIGINT) AS slice_id, count(*) AS n, round(avg(e), 6) AS mae, round(max(e), 6) AS worst FROM c GROUP BY GROUPING SETS ((aspect_source), (nm_id), (aspect_name), ())")


def d_bayes(spark: SparkSession, d: str, c_max: float = 1.0) -> DataFrame:
    """Product scores: time-weighted means drawn to a neutral prior by the lesser of c_max and the product's median mentions."""
    n = table(spark, d, "nli_predictions").filter("passed_relevance_filter AND final_rating IS NOT NULL").select("prediction_id", "nm_id", "aspect_name", "final_rating", "created_at").distinct()
    w = R.time_weight(F.col("created_at"), F.lit("2026-01-01").cast("timestamp"))
    x = n.withColumn("w", w).filter("w >= 0.01")
    m = x.groupBy("nm_id", "aspect_name").agg(F.count(F.lit(1)).alias("mentions"), F.sum("w").alias("nw"), F.sum(F.col("w") * F.col("final_rating")).alias("ws"), F.sum(F.col("w") * F.col("final_rating") * F.col("final_rating")).alias("wss"))
    m = m.withColumn("c", F.least(F.median("mentions").over(Window.partitionBy("nm_id")), F.lit(c_max))).withColumn("mean", F.col("ws") / F.col("nw"))
    return m.select("nm_id", "aspect_name", "mentions", F.round("nw", 5).alias("effective"), F.round("mean", 5).alias("raw_mean"), F.round(R.bayes(F.col("mean"), F.col("nw"), F.col("c")), 5).alias("score"), F.round(F.when(F.col("mentions") > 1, F.greatest(F.lit(0.0), F.col("wss") / F.col("nw") - F.col("mean") * F.col("mean"))).otherwise(F.lit(0.0)), 5).alias("variance"))


_add("d1_bayes_scores", d_bayes, """
WITH n AS (SELECT DISTINCT prediction_id, nm_id, aspect_name, final_rating AS s, coalesce(exp(-greatest(0, date_diff('day', CAST(created_at AS DATE), DATE '2026-01-01')) / 365.0), 1.0) AS w FROM nli_predictions WHERE passed_relevance_filter AND final_rating IS NOT NULL),
m AS (SELECT nm_id, aspect_name, count(*) AS mentions, sum(w) AS nw, sum(w * s) / sum(w) AS mean, sum(w * s * s) AS wss FROM n WHERE w >= 0.01 GROUP BY nm_id, aspect_name),
c AS (SELECT nm_id, least(median(mentions), 1.0) AS c FROM m GROUP BY nm_id)
SELECT m.nm_id, aspect_name, mentions, round(nw, 5) AS effective, round(mean, 5) AS raw_mean, round(least(5.0, greatest(1.0, nw / (nw + c) * mean + c / (nw + c) * 3.0)), 5) AS score, round(CASE WHEN mentions > 1 THEN greatest(0.0, wss / nw - mean * mean) ELSE 0.0 END, 5) AS variance FROM m JOIN c USING (nm_id)""")


def d_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Product rows with the sorted distinct contributing reviews; nothing is listed twice."""
    n = table(spark, d, "nli_predictions").filter("passed_relevance_filter AND final_rating IS NOT NULL AND review_id IS NOT NULL").select("prediction_id", "review_id", "nm_id", "aspect_name", "aspect_source", "final_rating").distinct()
    return n.groupBy("nm_id", "aspect_name", "aspect_source").agg(F.countDistinct("review_id").alias("n_reviews"), F.round(F.avg("final_rating"), 6).alias("raw_mean"), F.array_join(F.array_sort(F.collect_set("review_id")), "|").alias("review_ids"))


_add("d7_product_aggregates", d_aggregates, "WITH n AS (SELECT DISTINCT prediction_id, review_id, nm_id, aspect_name, aspect_source, final_rating FROM nli_predictions WHERE passed_relevance_filter AND final_rating IS NOT NULL AND review_id IS NOT NULL) SELECT nm_id, aspect_name, aspect_source, count(DISTINCT review_id) AS n_reviews, round(avg(final_rating), 6) AS raw_mean, array_to_string(list_sort(list_distinct(list(review_id))), '|') AS review_ids FROM n GROUP BY nm_id, aspect_name, aspect_source")

_add("d8_review_aspect_scores", lambda s, d: table(s, d, "nli_predictions").filter("final_rating IS NOT NULL").groupBy("review_id", "aspect_name").agg(F.round(F.coalesce(F.sum(F.col("final_rating") * F.col("relevance_filter_value")) / F.nullif(F.sum("relevance_filter_value"), F.lit(0.0)), F.avg("final_rating")), 6).alias("score")),
     "SELECT review_id, aspect_name, round(coalesce(sum(final_rating * relevance_filter_value) / nullif(sum(relevance_filter_value), 0), avg(final_rating)), 6) AS score FROM nli_predictions WHERE final_rating IS NOT NULL GROUP BY review_id, aspect_name")


def d_best_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The most relevant prediction of a review and aspect: relevance, then rating, both from the top, then id."""
    n = table(spark, d, "nli_predictions").filter("relevance_filter_value IS NOT NULL AND final_rating IS NOT NULL")
    best = F.min(F.struct((-F.col("relevance_filter_value")).alias("a"), (-F.col("final_rating")).alias("b"), F.col("prediction_id").alias("id"))).alias("x")
    return n.groupBy("review_id", "aspect_name").agg(best, F.countDistinct("prediction_id").alias("n_evidence")).select("review_id", "aspect_name", F.col("x.id").alias("prediction_id"), (-F.col("x.b")).alias("rating"), "n_evidence")


_add("d9_best_evidence", d_best_evidence, "WITH n AS (SELECT review_id, aspect_name, prediction_id, final_rating, row_number() OVER (PARTITION BY review_id, aspect_name ORDER BY relevance_filter_value DESC, final_rating DESC, prediction_id) AS r, relevance_filter_value FROM nli_predictions WHERE relevance_filter_value IS NOT NULL AND final_rating IS NOT NULL) SELECT review_id, aspect_name, max(CASE WHEN r = 1 THEN prediction_id END) AS prediction_id, max(CASE WHEN r = 1 THEN final_rating END) AS rating, count(DISTINCT prediction_id) AS n_evidence FROM n GROUP BY review_id, aspect_name")


def d_review_prf(spark: SparkSession, d: str) -> DataFrame:
    """Set precision, recall and F1 of a review's predicted against its gold aspects; both empty gives 1, one empty 0."""
    p = table(spark, d, "nli_predictions").filter("review_id IS NOT NULL").groupBy("review_id").agg(F.collect_set("aspect_name").alias("p"))
    g = table(spark, d, "gold_decisions").filter("review_id IS NOT NULL").groupBy("review_id").agg(F.collect_set("gold_aspect").alias("g"))
    none = F.array().cast("array<string>")
    x = p.join(g, "review_id", "full").select("review_id", F.coalesce("p", none).alias("p"), F.coalesce("g", none).alias("g")).withColumn("tp", F.size(F.array_intersect("p", "g")))
    pr, rc = F.col("tp") / F.size("p"), F.col("tp") / F.size("g")
    empty = (F.size("p") == 0) & (F.size("g") == 0)
    x = x.select("review_id", "tp", F.when(empty, 1.0).when(F.size("p") == 0, 0.0).otherwise(pr).alias("precision"), F.when(empty, 1.0).when(F.size("g") == 0, 0.0).otherwise(rc).alias("recall"))
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).select("review_id", F.col("tp").cast("bigint").alias("tp"), *r6("precision", "recall", "f1"))


_add("d10_review_prf", d_review_prf, """
WITH p AS (SELECT DISTINCT review_id, aspect_name AS a FROM nli_predictions WHERE review_id IS NOT NULL), g AS (SELECT DISTINCT review_id, gold_aspect AS a FROM gold_decisions WHERE review_id IS NOT NULL),
i AS (SELECT review_id FROM p UNION SELECT review_id FROM g),
x AS (SELECT i.review_id, (SELECT count(p.a) FROM p WHERE p.review_id = i.review_id) AS np, (SELECT count(g.a) FROM g WHERE g.review_id = i.review_id) AS ng, (SELECT count(*) FROM p JOIN g ON p.review_id = g.review_id AND p.a = g.a WHERE p.review_id = i.review_id) AS tp FROM i),
y AS (SELECT review_id, tp, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE tp / np END AS pr, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS rc FROM x)
SELECT review_id, CAST(tp AS BIGINT) AS tp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM y""")

_same("d12_product_metrics", PAIRS_SQL + ", m AS (SELECT nm_id, aspect_name, count(*) AS n, avg(gold) AS g, avg(pred) AS p FROM pairs GROUP BY nm_id, aspect_name) SELECT nm_id, count(*) AS n_aspects, round(avg(abs(g - p)), 5) AS mae, round(avg(CASE WHEN n >= 3 THEN abs(g - p) END), 5) AS mae_n3 FROM m GROUP BY nm_id")
_same("d13_star_baseline", PAIRS_SQL + ", r AS (SELECT id, max(rating) AS stars FROM reviews GROUP BY id) SELECT count(*) AS n, round(avg(abs(stars - gold)), 6) AS mae_star, round(avg(abs(pred - gold)), 6) AS mae_model, round(avg(abs(3.0 - gold)), 6) AS mae_constant FROM pairs JOIN r ON r.id = pairs.review_id WHERE stars IS NOT NULL")
_same("d15_category_means", "SELECT category_id, count(*) AS n, round(avg(cohesion), 6) AS cohesion, round(avg(CASE WHEN is_novel THEN 1e0 ELSE 0e0 END), 6) AS novel_share FROM clusters GROUP BY category_id")
_same("d18_aggregate_mae", "SELECT aspect_source, count(*) AS n, round(avg(abs_error), 6) AS mae, round(avg(CASE WHEN n_reviews_contributing >= 3 THEN abs_error END), 6) AS mae_n3 FROM (SELECT DISTINCT run_id, nm_id, aspect_name, aspect_source, n_reviews_contributing, abs_error FROM product_aggregates) x GROUP BY aspect_source")
_DEC = "SELECT DISTINCT prediction_id, review_id, system_aspect, aspect_source, coalesce(upper(trim(manual_decision)), 'NONE') AS dec FROM system_decisions"
_same("d21_detection_counts", f"WITH s AS ({_DEC}), g AS (SELECT DISTINCT review_id, gold_aspect, upper(trim(status)) AS st FROM gold_decisions), a AS (SELECT count_if(dec = 'TP') AS tp, count_if(dec IN ('FP', 'DUPLICATE', 'OUT_OF_SCOPE')) AS fp_strict, count_if(dec = 'FP') AS fp_soft FROM s), b AS (SELECT count_if(st IN ('FN', 'UNCLEAR')) AS fn_strict, count_if(st = 'FN') AS fn_soft FROM g) SELECT tp, fp_strict, fp_soft, fn_strict, fn_soft, round(tp / nullif(tp + fp_strict, 0), 6) AS p_strict, round(tp / nullif(tp + fn_soft, 0), 6) AS r_soft FROM a CROSS JOIN b")
_same("d23_error_summary", f"WITH s AS ({_DEC}), c AS (SELECT coalesce(dec, 'NONE') AS dec, count(*) AS n FROM s GROUP BY coalesce(dec, 'NONE')) SELECT dec, n, round(n / sum(n) OVER (), 6) AS share FROM c")
_same("d23_top_fp_aspects", f"WITH s AS ({_DEC}) SELECT system_aspect, count(*) AS n FROM s WHERE dec = 'FP' AND system_aspect IS NOT NULL GROUP BY system_aspect ORDER BY n DESC, system_aspect LIMIT 20")
_same("d24_micro_macro", f"WITH s AS ({_DEC}), r AS (SELECT review_id, count_if(dec = 'TP') AS tp, count_if(dec = 'FP') AS fp FROM s GROUP BY review_id) SELECT round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS micro, round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END), 6) AS macro, count_if(tp + fp = 0) AS uncovered FROM r")
_same("d26_review_macro_mae", PAIRS_SQL + ", r AS (SELECT review_id, avg(abs(pred - gold)) AS e, sqrt(avg((pred - gold) * (pred - gold))) AS q FROM pairs GROUP BY review_id) SELECT count(*) AS n_reviews, round(avg(e), 6) AS macro_mae, round(avg(q), 6) AS macro_rmse FROM r")
def d_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the model, of the constant 3, of the product's mean rating and of the review's stars."""
    p = pairs(spark, d)
    stars = table(spark, d, "reviews").filter("id IS NOT NULL").groupBy(F.col("id").alias("review_id")).agg(F.max("rating").alias("stars"))
    x = skew_join(p, p.groupBy("nm_id").agg(F.avg("gold").alias("product_mean")), "nm_id").join(stars, "review_id", "left")
    e = lambda c: F.round(F.avg(F.abs(c - F.col("gold"))), 6)
    return x.agg(e(F.col("pred")).alias("model"), e(F.lit(3.0)).alias("constant"), e(F.col("product_mean")).alias("product"), e(F.col("stars")).alias("star"))


_add("d27_baselines", d_baselines, PAIRS_SQL + ", r AS (SELECT id, max(rating) AS stars FROM reviews GROUP BY id), m AS (SELECT nm_id, avg(gold) AS product_mean FROM pairs GROUP BY nm_id), x AS (SELECT gold, pred, product_mean, stars FROM pairs LEFT JOIN m USING (nm_id) LEFT JOIN r ON r.id = pairs.review_id) SELECT round(avg(abs(pred - gold)), 6) AS model, round(avg(abs(3 - gold)), 6) AS constant, round(avg(abs(product_mean - gold)), 6) AS product, round(avg(abs(stars - gold)), 6) AS star FROM x")


def d_lopo_calibration(spark: SparkSession, d: str) -> DataFrame:
    """A line fitted to all products but one, for each: sums per product, taken off the total sums; no loop."""
    s = pairs(spark, d).groupBy("nm_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("x"), F.sum("gold").alias("y"), F.sum(F.col("pred") * F.col("gold")).alias("xy"), F.sum(F.col("pred") * F.col("pred")).alias("xx"))
    t = s.agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "x", "y", "xy", "xx")))
    z = s.crossJoin(F.broadcast(t))  # one row of totals
    n, x, y, xy, xx = (F.col(f"t_{c}") - F.col(c) for c in ("n", "x", "y", "xy", "xx"))
    den = n * xx - x * x
    fit = (n >= 5) & (den > 1e-9)
    slope = F.when(fit, (n * xy - x * y) / den).otherwise(1.0)
    return z.select("nm_id", n.alias("n_train"), F.round(slope, 5).alias("slope"), F.round(F.when(fit, (y - slope * x) / n).otherwise(0.0), 5).alias("intercept"))


_add("d29_lopo_calibration", d_lopo_calibration, PAIRS_SQL + ", p AS (SELECT DISTINCT nm_id FROM pairs) SELECT p.nm_id, count(q.gold) AS n_train, round(CASE WHEN count(q.gold) >= 5 THEN regr_slope(q.gold, q.pred) ELSE 1 END, 5) AS slope, round(CASE WHEN count(q.gold) >= 5 THEN regr_intercept(q.gold, q.pred) ELSE 0 END, 5) AS intercept FROM p LEFT JOIN pairs q ON q.nm_id <> p.nm_id GROUP BY p.nm_id")
_same("d31_cooccurrence", "WITH p AS (SELECT DISTINCT review_id, aspect_name AS pa FROM nli_predictions), g AS (SELECT DISTINCT review_id, gold_aspect AS ga FROM gold_decisions) SELECT pa, ga, count(*) AS n FROM p JOIN g ON p.review_id = g.review_id WHERE pa <> ga GROUP BY pa, ga ORDER BY n DESC, pa, ga LIMIT 20")


def d_confusion(spark: SparkSession, d: str) -> DataFrame:
    """5 x 5 counts of rounded ratings with zeros filled in; the pivot's values are given, so there is one pass."""
    cols = [str(i) for i in range(1, 6)]
    x = pairs(spark, d).select(R.half_even(F.col("gold")).alias("g"), R.half_even(F.col("pred")).alias("p")).groupBy("g").pivot("p", list(range(1, 6))).count()
    grid = spark.range(1, 6).select(F.col("id").cast("int").alias("g"))
    return grid.join(x, "g", "left").na.fill(0).select("g", *(F.col(c).alias(f"p{c}") for c in cols))


_add("d32_confusion", d_confusion, PAIRS_SQL + ", x AS (SELECT CAST(least(5, greatest(1, round_even(gold, 0))) AS INTEGER) AS g, CAST(least(5, greatest(1, round_even(pred, 0))) AS INTEGER) AS p FROM pairs), i AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS g) SELECT i.g, count_if(p = 1) AS p1, count_if(p = 2) AS p2, count_if(p = 3) AS p3, count_if(p = 4) AS p4, count_if(p = 5) AS p5 FROM i LEFT JOIN x ON x.g = i.g GROUP BY i.g")
_same("d33_source_profile", "SELECT nm_id, count(*) AS n, count_if(full_text IS NOT NULL AND trim(full_text) <> '') AS n_text, count_if(rating = 1) AS r1, count_if(rating = 2) AS r2, count_if(rating = 3) AS r3, count_if(rating = 4) AS r4, count_if(rating = 5) AS r5, round(avg(rating), 6) AS mean_rating, min(created_date) AS first_at, max(created_date) AS last_at FROM reviews GROUP BY nm_id")


def d_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy (bits) and sample-corrected skewness of a product's ratings, from its five counts."""
    c = table(spark, d, "reviews").filter("rating IS NOT NULL").groupBy("nm_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("rating") == i).alias(f"c{i}") for i in range(1, 6)), F.avg("rating").alias("m"), F.var_pop("rating").alias("m2"), F.skewness("rating").alias("g"))
    h = sum((F.when(F.col(f"c{i}") > 0, -F.col(f"c{i}") / F.col("n") * F.log2(F.col(f"c{i}") / F.col("n"))).otherwise(0.0) for i in range(1, 6)), F.lit(0.0))
    n = F.col("n")
    skew = F.when((n >= 3) & (F.col("m2") > 1e-12), F.sqrt(n * (n - 1)) / (n - 2) * F.col("g")).otherwise(0.0)
    return c.select("nm_id", "n", F.round(F.abs(h), 5).alias("entropy"), (F.round(skew, 5) + 0.0).alias("skew"), F.round(1 - F.col("c5") / n, 6).alias("non5_share"))


_add("d34_rating_entropy", d_entropy, """
WITH c AS (SELECT nm_id, rating, count(*) AS k FROM reviews WHERE rating IS NOT NULL GROUP BY nm_id, rating), t AS (SELECT nm_id, sum(k) AS n FROM c GROUP BY nm_id),
h AS (SELECT c.nm_id, abs(sum(-(k / n) * log2(k / n))) AS h FROM c JOIN t USING (nm_id) GROUP BY c.nm_id),
s AS (SELECT nm_id, count(*) AS n, var_pop(rating) AS m2, skewness(rating) AS g, avg(CASE WHEN rating = 5 THEN 0e0 ELSE 1e0 END) AS non5 FROM reviews WHERE rating IS NOT NULL GROUP BY nm_id)
SELECT s.nm_id, s.n, round(h, 5) AS entropy, round(CASE WHEN s.n >= 3 AND m2 > 1e-12 THEN g ELSE 0.0 END, 5) + 0.0 AS skew, round(non5, 6) AS non5_share FROM s JOIN h USING (nm_id)""")
_same("d48_group_spread", "SELECT aspect_source, count(final_rating) AS n, min(final_rating) AS lo, round(median(final_rating), 6) AS mid, round(avg(final_rating), 6) AS mean, max(final_rating) AS hi, round(stddev_pop(final_rating), 6) AS sd FROM nli_predictions GROUP BY aspect_source")
_same("d47_negation_stats", "SELECT aspect_source, count_if(raw_rating <= 2 AND has_negation_match) AS eligible, count_if(negation_correction_applied) AS applied, round(avg(CASE WHEN has_negation_match THEN 1e0 ELSE 0e0 END), 6) AS match_rate FROM nli_predictions GROUP BY aspect_source")
_same("d50_rollup", "SELECT aspect_source, passed_relevance_filter, count(*) AS n, round(avg(final_rating), 6) AS mean FROM nli_predictions GROUP BY ROLLUP (aspect_source, passed_relevance_filter) HAVING count(*) > 1")
_same("d50_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_TAUS, _PRODUCTS = 20_000, 500


def _best_of_block(products: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """Each product's best threshold of a block: counts of all pairs above it, less the product's own."""
    out = []
    tau, tp, fp, pos = (totals[c].to_numpy() for c in ("tau", "tp", "fp", "pos"))
    for k, nm_id, scores, liked in zip(products["k"], products["nm_id"], products["scores"], products["liked"], strict=True) if len(tau) else ():
        scores, liked = np.asarray(scores, dtype=float), np.asarray(liked, dtype=np.int64)
        order = np.argsort(scores, kind="stable")
        below = np.searchsorted(scores[order], tau, side="right")
        cum = np.r_[0, np.cumsum(liked[order])]
        t, f, n = tp - (cum[-1] - cum[below]), fp - ((len(scores) - below) - (cum[-1] - cum[below])), pos - cum[-1]
        p, r = t / np.maximum(t + f, 1), t / np.maximum(n, 1)
        f1 = 2 * t / np.maximum(t + f + n, 1)
        i = np.lexsort((tau, -p.round(12), -r.round(12), -f1.round(12)))[0]
        out.append((k, nm_id, f1[i], r[i], p[i], tau[i]))
    return pd.DataFrame(out, columns=["k", "nm_id", "f1", "r", "p", "tau"]).astype({"nm_id": "Int64"})


def k_lopo_threshold(spark: SparkSession, d: str) -> DataFrame:
    """For each product, the threshold best for all others: -1 and every distinct score, by F1, recall, precision, lowest.

    A pair is accepted if its score is above the threshold. Blocks of thresholds meet chunks of products.
    """
    x = pairs(spark, d).select("nm_id", "pe", (F.col("gold") >= 4).cast("bigint").alias("y"))
    at = x.filter("pe IS NOT NULL").groupBy("pe").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
    at = at.unionByName(spark.sql("SELECT -1D AS pe, 0L AS t, 0L AS n"))
    part = at.withColumn("part", F.floor(F.col("pe") * 1000).cast("int"))  # sums of the parts above, then within
    parts = part.groupBy("part").agg(F.sum("t").alias("pt"), F.sum("n").alias("pn"), F.count(F.lit(1)).alias("size"))
    over = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c) for c in ("pt", "pn", "size")), F.sum("pt").over(Window.partitionBy()).alias("pos"))  # about a thousand rows
    above = Window.partitionBy("part").orderBy(F.desc("pe"))
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    totals = cut_lineage(part.join(parts, "part").select(
        F.col("pe").alias("tau"), (F.col("pt") + F.coalesce(F.sum("t").over(before), F.lit(0))).alias("tp"), (F.col("pn") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("above"), "pos",
        F.floor((F.col("size") + F.row_number().over(above) - 1) / _TAUS).cast("int").alias("blk"),
    ).withColumn("fp", F.col("above") - F.col("tp")).drop("above"))
    mine = cut_lineage(x.groupBy("nm_id").agg(F.collect_list(F.when(F.col("pe").isNotNull(), F.struct("pe", "y"))).alias("own")))
    chunks = F.ceil(mine.count() / F.lit(_PRODUCTS)).cast("int")
    mine = mine.select(F.coalesce(F.col("nm_id").cast("string"), F.lit("")).alias("k"), "nm_id", F.col("own.pe").alias("scores"), F.col("own.y").alias("liked")).withColumn("chunk", F.pmod(F.xxhash64("k"), chunks).cast("int"))
    left = mine.crossJoin(F.broadcast(totals.select("blk").distinct()))  # a row a block
    right = totals.crossJoin(F.broadcast(mine.select(F.col("chunk").alias("c")).distinct())).withColumnRenamed("blk", "b")
    best = left.groupBy("chunk", "blk").cogroup(right.groupBy("c", "b")).applyInPandas(_best_of_block, "k string, nm_id bigint, f1 double, r double, p double, tau double")
    one = best.groupBy("k").agg(F.first("nm_id").alias("nm_id"), F.min(F.struct(-F.round("f1", 12), -F.round("r", 12), -F.round("p", 12), "tau", "f1")).alias("b"))
    return one.select("nm_id", F.col("b.tau").alias("tau"), F.round("b.f1", 6).alias("f1"))


_add("k19_lopo_threshold", k_lopo_threshold, PAIRS_SQL + """, x AS (SELECT nm_id, pe, CASE WHEN gold >= 4 THEN 1 ELSE 0 END AS y FROM pairs), t AS (SELECT -1e0 AS tau UNION SELECT pe FROM x WHERE pe IS NOT NULL),
s AS (SELECT tau, nm_id, count(CASE WHEN pe > tau AND y = 1 THEN 1 END) AS tp, count(CASE WHEN pe > tau AND y = 0 THEN 1 END) AS fp, sum(y) AS pos FROM x CROSS JOIN t GROUP BY tau, nm_id),
a AS (SELECT tau, sum(tp) AS tp, sum(fp) AS fp, sum(pos) AS pos FROM s GROUP BY tau),
f AS (SELECT s.nm_id, s.tau, a.tp - s.tp AS tp, a.fp - s.fp AS fp, a.pos - s.pos AS pos FROM s JOIN a ON a.tau = s.tau),
r AS (SELECT *, 2e0 * tp / greatest(tp + fp + pos, 1) AS f1, row_number() OVER (PARTITION BY nm_id ORDER BY round(2e0 * tp / greatest(tp + fp + pos, 1), 12) DESC, round(1e0 * tp / greatest(pos, 1), 12) DESC, round(1e0 * tp / greatest(tp + fp, 1), 12) DESC, tau) AS k FROM f)
SELECT nm_id, tau, round(f1, 6) AS f1 FROM r WHERE k = 1""")
