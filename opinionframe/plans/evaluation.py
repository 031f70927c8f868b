"""Coverage, cluster quality, rank statistics, covariance and selection plans, and the streaming plans on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionframe.functions import rating as R
from opinionframe.functions import vectors as V
from opinionframe.operators.covariance import topic_covariance, varied_selection
from opinionframe.operators.ranks import value_ranks
from opinionframe.operators.windows import head_by
from opinionframe.plans.base import PAIRS_SQL, counted, pairs, sql_plan
from opinionframe.plans.ratings import _ENRICHED, _VEC
from opinionframe.session import table
from opinionframe.streaming.events import first_deliveries, running_scores, session_totals, windowed_totals

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, fn, sql: str | None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = counted(sql)


def _same(name: str, sql: str) -> None:
    _add(name, sql_plan(sql), sql)


_G, _P = _VEC.format("gold").split(", "), _VEC.format("p").split(", ")
_same("d22_vector_metrics", _ENRICHED.replace("least(5.0, greatest(1.0, pred))", "least(5e0, greatest(1e0, pred))") + f", v AS (SELECT gd, pd, wrong, gold, p, {_G[0]} AS a0, {_G[1]} AS a1, {_G[2]} AS a2, {_P[0]} AS b0, {_P[1]} AS b1, {_P[2]} AS b2 FROM e)" + """
SELECT count(*) AS n, round(avg(abs(a0 - b0) + abs(a1 - b1) + abs(a2 - b2)), 6) AS mean_l1, round(avg(sqrt((a0-b0)*(a0-b0) + (a1-b1)*(a1-b1) + (a2-b2)*(a2-b2))), 6) AS mean_l2,
 count_if(gd <> 'neutral') AS n_polar, count_if(gd <> 'neutral' AND pd = 'neutral') AS n_collapsed, count_if(gd <> 'neutral' AND wrong) AS n_flipped, count_if(gd = 'positive' AND pd = 'positive' AND p < gold) AS n_underestimated FROM v""")
_same("d30_funnel", """
WITH p AS (SELECT DISTINCT prediction_id, review_id, aspect_name, passed_relevance_filter AS ok FROM nli_predictions), g AS (SELECT DISTINCT review_id, gold_aspect FROM gold_decisions),
x AS (SELECT CASE WHEN g.review_id IS NOT NULL AND p.ok THEN 'found' WHEN g.review_id IS NOT NULL THEN 'filtered' WHEN p.ok THEN 'extra' ELSE 'dropped' END AS stage FROM p LEFT JOIN g ON g.review_id = p.review_id AND g.gold_aspect = p.aspect_name)
SELECT stage, count(*) AS n FROM x GROUP BY stage""")
def d_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per category, how many gold aspects (in lower case) are names or synonyms of the vocabulary, and the first ten missed."""
    a = table(spark, d, "aspect_reference").select(F.explode(F.concat(F.array("canonical_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("t")).select(F.lower("t").alias("label"), F.lit(1).alias("known")).distinct()
    ids = table(spark, d, "reviews").groupBy(F.col("id").alias("review_id")).agg(F.min("category").alias("category"))
    g = table(spark, d, "gold_decisions").filter("gold_aspect IS NOT NULL").select("review_id", F.lower(F.trim("gold_aspect")).alias("label")).join(ids, "review_id").select("category", "label").distinct().join(a, "label", "left")
    n = g.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_covered"), F.round(F.count("known") / F.count(F.lit(1)), 6).alias("share"))
    key = F.coalesce("category", F.lit("")).alias("k")
    missed = head_by(g.filter("known IS NULL").select(key, "label"), ["k"], [F.col("label")], 10).groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("missed"))
    return n.withColumn("k", key).join(missed, "k", "left").drop("k").withColumn("missed", F.coalesce("missed", F.lit("")))


_add("d36_vocabulary_coverage", d_coverage, """WITH a AS (SELECT DISTINCT lower(t) AS t FROM (SELECT canonical_name AS t FROM aspect_reference UNION ALL SELECT unnest(synonyms) FROM aspect_reference) x), i AS (SELECT id, min(category) AS category FROM reviews GROUP BY id), g AS (SELECT DISTINCT category, lower(trim(gold_aspect)) AS label FROM gold_decisions JOIN i ON i.id = review_id WHERE gold_aspect IS NOT NULL),
m AS (SELECT category, label, row_number() OVER (PARTITION BY category ORDER BY label) AS k FROM g WHERE label NOT IN (SELECT t FROM a WHERE t IS NOT NULL)) SELECT g.category, count(*) AS n, count_if(label IN (SELECT t FROM a WHERE t IS NOT NULL)) AS n_covered, round(count_if(label IN (SELECT t FROM a WHERE t IS NOT NULL)) / count(*), 6) AS share, coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM m WHERE m.category IS NOT DISTINCT FROM g.category AND k <= 10), '') AS missed FROM g GROUP BY g.category""")
_add("d42_cluster_sizes", lambda s, d: table(s, d, "clusters").groupBy("nm_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -k)").cast("bigint").alias("upper_median"), F.max("k").alias("hi"), F.min("k").alias("lo")),
     "WITH c AS (SELECT count(*) AS k FROM clusters GROUP BY nm_id) SELECT count(*) AS n, round(avg(k), 6) AS mean, (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) AS r, count(*) OVER () AS n FROM c) x WHERE r = n // 2 + 1) AS upper_median, max(k) AS hi, min(k) AS lo FROM c")


def d_negation_effect(spark: SparkSession, d: str) -> DataFrame:
    """Per category: pairs open to a negation's correction, pairs corrected, and the error before and after."""
    ids = table(spark, d, "reviews").groupBy(F.col("id").alias("review_id")).agg(F.min("category").alias("category"), F.max("rating").alias("stars"))
    x = pairs(spark, d).join(ids, "review_id")
    open_ = F.coalesce((F.col("raw") <= 2) & (F.col("stars") >= 4), F.lit(False))
    return x.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(open_, 1)).alias("n_eligible"), F.count(F.when(open_ & F.col("neg"), 1)).alias("n_matched"),
        F.round(F.avg(F.abs(F.col("raw") - F.col("gold"))), 6).alias("mae_raw"), F.round(F.avg(F.abs(F.when(open_ & F.col("neg"), R.inverted(F.col("raw"))).otherwise(F.col("raw")) - F.col("gold"))), 6).alias("mae_inverted"),
    )


_add("d47_negation_effect", d_negation_effect, PAIRS_SQL + """, r AS (SELECT id, min(category) AS category, max(rating) AS stars FROM reviews GROUP BY id), x AS (SELECT category, gold, raw, coalesce(raw <= 2 AND stars >= 4, false) AS o, neg FROM pairs JOIN r ON r.id = pairs.review_id)
SELECT category, count(*) AS n, count_if(o) AS n_eligible, count_if(o AND neg) AS n_matched, round(avg(abs(raw - gold)), 6) AS mae_raw, round(avg(abs(CASE WHEN o AND neg THEN least(5.0, greatest(1.0, 6 - raw)) ELSE raw END - gold)), 6) AS mae_inverted FROM x GROUP BY category""")


def d_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Per product the variance of a rating that weighs specific aspects double, from the covariance of its topics."""
    cov = QUERIES["d4_topic_covariance"](spark, d)
    w = table(spark, d, "aspect_reference").groupBy(F.col("canonical_name").alias("t")).agg(F.max(F.when(F.col("level") == "specific", 2.0).otherwise(1.0)).alias("w"))
    x = cov.join(w.select(F.col("t").alias("topic_a"), F.col("w").alias("wa")), "topic_a", "left").join(w.select(F.col("t").alias("topic_b"), F.col("w").alias("wb")), "topic_b", "left").na.fill(1.0, ["wa", "wb"])
    return x.groupBy("nm_id").agg(F.round(F.greatest(F.lit(0.0), F.sum(F.col("wa") * F.col("cov") * F.col("wb")) / F.pow(F.sum(F.when(F.col("topic_a") == F.col("topic_b"), F.col("wa"))), F.lit(2))), 4).alias("variance"))


_add("d6_portfolio_variance", d_portfolio, None)
_same("d45_batch_progress", "WITH s AS (SELECT review_id, count(*) AS n, count_if(manual_decision IS NOT NULL AND trim(manual_decision) <> '') AS done FROM (SELECT DISTINCT prediction_id, review_id, manual_decision FROM system_decisions) x GROUP BY review_id) SELECT CASE WHEN done = 0 THEN 'new' WHEN done < n THEN 'partial' ELSE 'done' END AS state, count(*) AS n FROM s GROUP BY 1")
_same("d46_label_profile", "WITH g AS (SELECT gold_aspect, count(*) AS n FROM gold_decisions WHERE gold_aspect IS NOT NULL GROUP BY gold_aspect) SELECT gold_aspect, n, CAST(row_number() OVER (ORDER BY n DESC, gold_aspect) AS BIGINT) AS place FROM g")
_same("d49_majority_aspect", "WITH c AS (SELECT mapped_gold_aspect AS g, system_aspect AS s, count(*) AS n FROM system_decisions WHERE mapped_gold_aspect IS NOT NULL AND system_aspect IS NOT NULL GROUP BY 1, 2), r AS (SELECT g, s, n, row_number() OVER (PARTITION BY g ORDER BY n DESC, s) AS k FROM c) SELECT g, s, n FROM r WHERE k = 1")
_same("b12_hypothesis_kind", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT prediction_id, CASE WHEN lower(hypothesis_text) LIKE '%хорошо%' THEN 'positive' WHEN lower(hypothesis_text) LIKE '%плохо%' THEN 'negative' ELSE 'neutral' END AS kind FROM nli_predictions) x GROUP BY kind")
_same("c3_validated_one_to_one", "WITH a AS (SELECT prediction_id, max(final_rating) AS model FROM nli_predictions GROUP BY prediction_id), b AS (SELECT prediction_id, max(system_rating) AS audit FROM system_decisions GROUP BY prediction_id) SELECT a.prediction_id, model, audit, round(model - audit, 6) AS delta FROM a JOIN b ON a.prediction_id = b.prediction_id")
_same("g6_removed_predictions", "WITH base AS (SELECT DISTINCT prediction_id FROM nli_predictions), kept AS (SELECT DISTINCT prediction_id FROM nli_predictions WHERE passed_relevance_filter), s AS (SELECT prediction_id, max(upper(trim(manual_decision))) AS dec FROM system_decisions GROUP BY prediction_id) SELECT coalesce(s.dec, 'NONE') AS dec, count(*) AS n FROM base LEFT JOIN s ON s.prediction_id = base.prediction_id WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.prediction_id = base.prediction_id) GROUP BY 1")
def k_rank_auc(spark: SparkSession, d: str) -> DataFrame:
    """ROC-AUC of the entailment score for good ratings and its Mann-Whitney U, from mean ranks of distinct scores."""
    x = pairs(spark, d).filter("pe IS NOT NULL").select("pe", F.when(F.col("gold") >= 4, 1).otherwise(0).alias("y"))
    r = value_ranks(x, "pe", pos=F.col("y"))
    t = r.agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("avg_rank")).alias("s"))
    u = F.col("s") - F.col("p") * (F.col("p") + 1) / 2
    both = F.col("p") * (F.col("n") - F.col("p"))
    return t.select("n", F.col("p").alias("n_positive"), F.round(F.when(both > 0, u / both), 6).alias("auc"), F.round(u, 3).alias("mann_whitney_u"))


_add("k22_rank_auc", k_rank_auc, PAIRS_SQL + """, x AS (SELECT pe, CASE WHEN gold >= 4 THEN 1 ELSE 0 END AS y FROM pairs WHERE pe IS NOT NULL),
r AS (SELECT y, rank() OVER (ORDER BY pe) + (count(*) OVER (PARTITION BY pe) - 1) / 2e0 AS rk FROM x), s AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS p, sum(CASE WHEN y = 1 THEN rk ELSE 0e0 END) - sum(y) * (sum(y) + 1) / 2e0 AS u FROM r)
SELECT n, p AS n_positive, round(u / nullif(p * (n - p), 0), 6) AS auc, round(u, 3) AS mann_whitney_u FROM s""")


def k_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine over all pairs of different members of a class, from the sum of unit vectors: |sum|^2 = n + pairs."""
    u = table(spark, d, "embeddings").select("label", V.unit(F.col("embedding")).alias("u"))
    at = u.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return at.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).filter("n > 1").select("label", "n", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("cohesion"))


_add("k14_cohesion", k_cohesion, "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.label, (SELECT count(*) FROM e c WHERE c.label = a.label) AS n, round(avg(list_cosine_similarity(a.v, b.v)), 5) AS cohesion FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label")
_add("d4_topic_covariance", lambda s, d: topic_covariance(table(s, d, "nli_predictions").filter("passed_relevance_filter AND review_id IS NOT NULL"), "nm_id", "review_id", "aspect_name", "final_rating").withColumn("cov", F.round("cov", 5)), """
WITH m AS (SELECT nm_id, review_id AS r, aspect_name AS t, avg(final_rating) AS v FROM nli_predictions WHERE passed_relevance_filter AND review_id IS NOT NULL AND final_rating IS NOT NULL AND aspect_name IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT nm_id, t, CASE WHEN count(*) > 1 THEN var_pop(v) ELSE 1 END AS own FROM m GROUP BY nm_id, t), f AS (SELECT m.* FROM m JOIN (SELECT nm_id, r FROM m GROUP BY nm_id, r HAVING count(*) >= 2) s ON s.nm_id IS NOT DISTINCT FROM m.nm_id AND s.r = m.r),
z AS (SELECT nm_id, count(*) AS k FROM t GROUP BY nm_id), h AS (SELECT nm_id, count(DISTINCT r) AS n, count(DISTINCT t) AS held FROM f GROUP BY nm_id),
g AS (SELECT a.nm_id, a.t AS ta, b.t AS tb, a.own, z.k, h.n, coalesce(h.n >= 5 AND h.held = z.k, false) AS dense FROM t a JOIN t b ON a.nm_id IS NOT DISTINCT FROM b.nm_id JOIN z ON z.nm_id IS NOT DISTINCT FROM a.nm_id LEFT JOIN h ON h.nm_id IS NOT DISTINCT FROM a.nm_id WHERE z.k >= 2),
c AS (SELECT nm_id, r, t, v - avg(v) OVER (PARTITION BY nm_id, t) AS x FROM f), p AS (SELECT a.nm_id, a.t AS ta, b.t AS tb, sum(a.x * b.x) AS s, sum(a.x * a.x * b.x * b.x) AS q FROM c a JOIN c b ON a.nm_id IS NOT DISTINCT FROM b.nm_id AND a.r = b.r GROUP BY 1, 2, 3),
e AS (SELECT g.*, coalesce(p.s / g.n, 0) AS s, coalesce(p.q / g.n, 0) AS q FROM g LEFT JOIN p ON p.nm_id IS NOT DISTINCT FROM g.nm_id AND p.ta = g.ta AND p.tb = g.tb),
u AS (SELECT nm_id, sum(CASE WHEN ta = tb THEN s ELSE 0 END) / any_value(k) AS mean FROM e WHERE dense GROUP BY nm_id),
w AS (SELECT e.nm_id, any_value(u.mean) AS mean, sum(pow(s - CASE WHEN ta = tb THEN u.mean ELSE 0 END, 2)) / any_value(k) AS d2, sum(q - s * s) / any_value(k) / any_value(n) AS b2 FROM e JOIN u ON u.nm_id IS NOT DISTINCT FROM e.nm_id WHERE dense GROUP BY e.nm_id)
SELECT e.nm_id, ta AS topic_a, tb AS topic_b, round(CASE WHEN dense THEN CASE WHEN d2 > 1e-15 THEN least(b2, d2) / d2 * CASE WHEN ta = tb THEN mean ELSE 0 END + (1 - least(b2, d2) / d2) * s ELSE s END WHEN ta = tb THEN own ELSE 0 END, 5) AS cov FROM e LEFT JOIN w ON w.nm_id IS NOT DISTINCT FROM e.nm_id""")
_add("k5_varied_selection", lambda s, d: varied_selection(table(s, d, "embeddings").withColumn("score", V.norm(F.col("embedding"))), "label", "vec_id", "embedding", "score"), None)
_add("s1_windows", lambda s, d: windowed_totals(table(s, d, "events"), "ts", "event_type", "value", "1 day").withColumn("total", F.round("total", 4)), "SELECT date_trunc('day', ts)::TIMESTAMP AS start_at, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS end_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
_add("s1_sessions", lambda s, d: session_totals(table(s, d, "events"), "ts", "user_id", "6 hours"), """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS start_at, max(ts) + INTERVAL 6 HOUR AS end_at, user_id, count(*) AS n FROM g GROUP BY user_id, k""")
_add("s3_first_deliveries", lambda s, d: first_deliveries(table(s, d, "reviews").select("id", "ingested_at"), "ingested_at", ["id"]).select("id"), "SELECT DISTINCT id FROM reviews")
_add("s4_running_scores", lambda s, d: running_scores(table(s, d, "nli_predictions"), ["nm_id", "aspect_source"], "final_rating").withColumn("score", F.round("score", 6)), "SELECT nm_id, aspect_source, count(final_rating) AS n, round(CASE WHEN count(final_rating) = 0 THEN 3.0 ELSE greatest(1.0, least(5.0, (sum(final_rating) + 3.0) / (count(final_rating) + 1.0))) END, 6) AS score FROM nli_predictions GROUP BY nm_id, aspect_source")
ORACLE_SQL["d6_portfolio_variance"] = f"""WITH cov AS ({ORACLE_SQL["d4_topic_covariance"]}), w AS (SELECT canonical_name AS t, max(CASE WHEN level = 'specific' THEN 2 ELSE 1 END) AS w FROM aspect_reference GROUP BY 1), x AS (SELECT nm_id, topic_a, topic_b, cov, coalesce(a.w, 1) AS wa, coalesce(b.w, 1) AS wb FROM cov LEFT JOIN w a ON a.t = topic_a LEFT JOIN w b ON b.t = topic_b)
SELECT nm_id, round(greatest(0, sum(wa * cov * wb) / pow(sum(CASE WHEN topic_a = topic_b THEN wa END), 2)), 4) AS variance FROM x GROUP BY nm_id"""
