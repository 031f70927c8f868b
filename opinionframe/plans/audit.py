"""Review, product and audit metrics, mappings, queues, repair and validation, each with SQL written apart from the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionframe.functions import rating as R
from opinionframe.functions import text as X
from opinionframe.operators.heavy_keys import skew_join
from opinionframe.operators.joins import validated_join, word_matches
from opinionframe.operators.windows import first_by, head_by
from opinionframe.plans.base import PAIRS_SQL, counted, pairs, r6
from opinionframe.session import table

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, fn, sql: str | None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = counted(sql)


def _ratio(a, b) -> F.Column:
    return F.when(b > 0, a / b)


def _f1(p, r) -> F.Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


# --- review metrics on two tracks: A with vocabulary aspects only, B with discovered ones too
def _tracked(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nli_predictions").filter("review_id IS NOT NULL AND aspect_name IS NOT NULL")
    tracks = F.when(F.col("aspect_source") == "vocab", F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B")))
    return n.select("prediction_id", "review_id", "aspect_name", "aspect_source", "final_rating", F.explode(tracks).alias("track")).distinct()


def review_detection(spark: SparkSession, d: str) -> DataFrame:
    """``track, review_id, nm_id, category, np, ng, tp, p, r, f1`` of every review; both sets empty gives 1, one empty 0."""
    n = _tracked(spark, d).select("track", "review_id", "aspect_name").distinct()
    g = table(spark, d, "gold_decisions").filter("review_id IS NOT NULL AND gold_aspect IS NOT NULL").select("review_id", F.col("gold_aspect").alias("aspect_name")).distinct()
    ids = table(spark, d, "reviews").groupBy(F.col("id").alias("review_id")).agg(F.min("nm_id").alias("nm_id"), F.min("category").alias("category"))
    grid = ids.select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("track"))
    tp = n.join(g, ["review_id", "aspect_name"]).groupBy("track", "review_id").agg(F.count(F.lit(1)).alias("tp"))
    x = grid.join(n.groupBy("track", "review_id").agg(F.count(F.lit(1)).alias("np")), ["track", "review_id"], "left")
    x = x.join(g.groupBy("review_id").agg(F.count(F.lit(1)).alias("ng")), "review_id", "left").join(tp, ["track", "review_id"], "left").na.fill(0, ["np", "ng", "tp"])
    empty = (F.col("np") == 0) & (F.col("ng") == 0)
    x = x.withColumn("p", F.when(empty, 1.0).otherwise(F.coalesce(_ratio(F.col("tp"), F.col("np")), F.lit(0.0)))).withColumn("r", F.when(empty, 1.0).otherwise(F.coalesce(_ratio(F.col("tp"), F.col("ng")), F.lit(0.0))))
    return x.withColumn("f1", _f1(F.col("p"), F.col("r")))


def pair_errors(spark: SparkSession, d: str) -> DataFrame:
    """``track, review_id, aspect_name, e, er, discovered``: per review and gold aspect, the error of the mean prediction,
    plain and rounded, and whether a discovered aspect took part."""
    n = _tracked(spark, d).filter("final_rating IS NOT NULL")
    mean = n.groupBy("track", "review_id", "aspect_name").agg(F.avg("final_rating").alias("m"), F.max((F.col("aspect_source") == "discovery").cast("int")).alias("discovered"))
    g = table(spark, d, "gold_decisions").groupBy("review_id", F.col("gold_aspect").alias("aspect_name")).agg(F.max("gold_rating").alias("gold")).filter("gold IS NOT NULL")
    return mean.join(g, ["review_id", "aspect_name"]).select("track", "review_id", "aspect_name", F.abs(F.col("m") - F.col("gold")).alias("e"), F.abs(F.rint("m") - F.col("gold")).alias("er"), "discovered")


def d_review_metrics(spark: SparkSession, d: str) -> DataFrame:
    det = review_detection(spark, d).groupBy("track").agg(F.count(F.lit(1)).alias("n_reviews"), *(F.round(F.avg(c), 6).alias(k) for c, k in (("p", "precision"), ("r", "recall"), ("f1", "f1"))))
    e = pair_errors(spark, d)
    kind = lambda k: F.round(F.avg(F.when(F.col("discovered") == k, F.col("e"))), 6)
    by_pair = e.groupBy("track").agg(kind(0).alias("mae_vocab_pairs"), kind(1).alias("mae_discovery_pairs"), F.sum("discovered").cast("bigint").alias("n_discovery_pairs"))
    by_review = e.groupBy("track", "review_id").agg(F.avg("e").alias("e"), F.avg("er").alias("er")).groupBy("track").agg(F.round(F.avg("e"), 6).alias("mae_review"), F.round(F.avg("er"), 6).alias("mae_review_round"), F.count(F.lit(1)).alias("n_matched"))
    return det.join(by_pair, "track", "left").join(by_review, "track", "left")


_TRACK_SQL = """
WITH t AS (SELECT 'A' AS track UNION ALL SELECT 'B'), n AS (SELECT DISTINCT t.track, prediction_id, review_id, aspect_name, aspect_source, final_rating FROM nli_predictions CROSS JOIN t WHERE review_id IS NOT NULL AND aspect_name IS NOT NULL AND (t.track = 'B' OR aspect_source = 'vocab')),
p AS (SELECT DISTINCT track, review_id, aspect_name FROM n), g AS (SELECT DISTINCT review_id, gold_aspect FROM gold_decisions WHERE review_id IS NOT NULL AND gold_aspect IS NOT NULL),
ids AS (SELECT id, min(nm_id) AS nm_id, min(category) AS category FROM reviews GROUP BY id), cp AS (SELECT track, review_id, count(*) AS c FROM p GROUP BY ALL), cg AS (SELECT review_id, count(*) AS c FROM g GROUP BY ALL),
ct AS (SELECT p.track, p.review_id, count(*) AS c FROM p JOIN g ON g.review_id = p.review_id AND g.gold_aspect = p.aspect_name GROUP BY ALL),
x AS (SELECT t.track, ids.id, ids.nm_id, ids.category, coalesce(cp.c, 0) AS np, coalesce(cg.c, 0) AS ng, coalesce(ct.c, 0) AS tp FROM ids CROSS JOIN t LEFT JOIN cp ON cp.track = t.track AND cp.review_id = ids.id LEFT JOIN cg ON cg.review_id = ids.id LEFT JOIN ct ON ct.track = t.track AND ct.review_id = ids.id),
y AS (SELECT *, CASE WHEN np + ng = 0 THEN 1 WHEN np = 0 THEN 0 ELSE tp / np END AS pr, CASE WHEN np + ng = 0 THEN 1 WHEN ng = 0 THEN 0 ELSE tp / ng END AS rc FROM x),
z AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f FROM y),
gr AS (SELECT review_id, gold_aspect, max(gold_rating) AS gold FROM gold_decisions GROUP BY ALL),
e AS (SELECT m.*, abs(m.mean - gr.gold) AS e, abs(round_even(m.mean, 0) - gr.gold) AS er FROM (SELECT track, review_id, aspect_name, avg(final_rating) AS mean, max(CASE WHEN aspect_source = 'discovery' THEN 1 ELSE 0 END) AS disc FROM n WHERE final_rating IS NOT NULL GROUP BY ALL) m JOIN gr ON gr.review_id = m.review_id AND gr.gold_aspect = m.aspect_name WHERE gr.gold IS NOT NULL)
"""
_add("d11_review_metrics", d_review_metrics, _TRACK_SQL + """
SELECT z.track, count(*) AS n_reviews, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f), 6) AS f1,
 (SELECT round(avg(e), 6) FROM e WHERE e.track = z.track AND disc = 0) AS mae_vocab_pairs, (SELECT round(avg(e), 6) FROM e WHERE e.track = z.track AND disc = 1) AS mae_discovery_pairs, (SELECT CAST(coalesce(sum(disc), 0) AS BIGINT) FROM e WHERE e.track = z.track) AS n_discovery_pairs,
 (SELECT round(avg(q), 6) FROM (SELECT avg(e) AS q FROM e WHERE e.track = z.track GROUP BY review_id) w) AS mae_review, (SELECT round(avg(q), 6) FROM (SELECT avg(er) AS q FROM e WHERE e.track = z.track GROUP BY review_id) w) AS mae_review_round, (SELECT count(DISTINCT review_id) FROM e WHERE e.track = z.track) AS n_matched FROM z GROUP BY z.track""")


def d_product_table(spark: SparkSession, d: str) -> DataFrame:
    """Per product on track B: reviews, detection, pair errors, and the error of aspect means with three reviews or more."""
    det = review_detection(spark, d).filter("track = 'B'")
    by = det.groupBy("nm_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"))
    of = det.select("review_id", "nm_id")
    e = pair_errors(spark, d).filter("track = 'B'").join(of, "review_id").groupBy("nm_id").agg(F.round(F.avg("e"), 6).alias("mae"), F.round(F.avg("er"), 6).alias("mae_round"))
    m = pairs(spark, d).select("review_id", "aspect_name", "gold", "pred").join(of, "review_id").groupBy("nm_id", "aspect_name").agg(F.countDistinct("review_id").alias("k"), F.abs(F.avg("gold") - F.avg("pred")).alias("a"))
    m = m.groupBy("nm_id").agg(F.round(F.avg(F.when(F.col("k") >= 3, F.col("a"))), 6).alias("product_mae_n3"), F.count(F.lit(1)).alias("n_aspects"))
    keyed = lambda df: df.withColumn("key", F.coalesce(F.col("nm_id").cast("string"), F.lit(""))).drop("nm_id")
    return by.withColumn("key", F.coalesce(F.col("nm_id").cast("string"), F.lit(""))).join(keyed(e), "key", "left").join(keyed(m), "key", "left").drop("key").withColumn("n_aspects", F.coalesce("n_aspects", F.lit(0)))


_add("d14_product_table", d_product_table, _TRACK_SQL + """, n2 AS (SELECT DISTINCT prediction_id, review_id, aspect_name, aspect_source, nm_id, p_entailment, p_neutral, p_contradiction, raw_rating, final_rating, has_negation_match FROM nli_predictions WHERE final_rating IS NOT NULL),
pm AS (SELECT ids.nm_id, n2.aspect_name, count(DISTINCT n2.review_id) AS k, abs(avg(gr.gold) - avg(n2.final_rating)) AS a FROM n2 JOIN gr ON gr.review_id = n2.review_id AND gr.gold_aspect = n2.aspect_name JOIN ids ON ids.id = n2.review_id WHERE gr.gold IS NOT NULL GROUP BY ids.nm_id, n2.aspect_name)
SELECT z.nm_id, count(*) AS n_reviews, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall,
 (SELECT round(avg(e.e), 6) FROM e JOIN ids ON ids.id = e.review_id WHERE e.track = 'B' AND ids.nm_id IS NOT DISTINCT FROM z.nm_id) AS mae, (SELECT round(avg(e.er), 6) FROM e JOIN ids ON ids.id = e.review_id WHERE e.track = 'B' AND ids.nm_id IS NOT DISTINCT FROM z.nm_id) AS mae_round,
 (SELECT round(avg(CASE WHEN k >= 3 THEN a END), 6) FROM pm WHERE pm.nm_id IS NOT DISTINCT FROM z.nm_id) AS product_mae_n3, (SELECT count(*) FROM pm WHERE pm.nm_id IS NOT DISTINCT FROM z.nm_id) AS n_aspects FROM z WHERE track = 'B' GROUP BY z.nm_id""")


def d_matched_sample(spark: SparkSession, d: str) -> DataFrame:
    """Product errors of aspect means in which gold is averaged only over reviews with a prediction; all and with three or
    more gold reviews, plain and with rounded predictions."""
    gold = table(spark, d, "gold_decisions").filter("review_id IS NOT NULL AND gold_aspect IS NOT NULL AND gold_rating IS NOT NULL").groupBy("review_id", F.col("gold_aspect").alias("a")).agg(F.max("gold_rating").alias("g"))
    ids = table(spark, d, "reviews").filter("nm_id IS NOT NULL").groupBy(F.col("id").alias("review_id")).agg(F.min("nm_id").alias("nm_id"))
    pred = table(spark, d, "nli_predictions").filter("final_rating IS NOT NULL").select("prediction_id", "review_id", F.col("aspect_name").alias("a"), "final_rating").distinct().groupBy("review_id", "a").agg(F.avg("final_rating").alias("p"))
    x = gold.join(ids, "review_id").join(pred, ["review_id", "a"], "left")
    m = x.groupBy("nm_id", "a").agg(F.count(F.lit(1)).alias("n_true"), F.avg(F.when(F.col("p").isNotNull(), F.col("g"))).alias("g"), F.avg("p").alias("p"), F.avg(R.half_even(F.col("p"))).alias("pr")).filter("p IS NOT NULL")
    e, er = F.abs(F.col("g") - F.col("p")), F.abs(F.col("g") - F.col("pr"))
    three = lambda c: F.when(F.col("n_true") >= 3, c)
    return m.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(k) for c, k in ((e, "mae"), (three(e), "mae_n3"), (er, "mae_round"), (three(er), "mae_round_n3"))))


_add("d25_matched_sample", d_matched_sample, """
WITH g AS (SELECT review_id, gold_aspect AS a, max(gold_rating) AS g FROM gold_decisions WHERE review_id IS NOT NULL AND gold_aspect IS NOT NULL AND gold_rating IS NOT NULL GROUP BY ALL), i AS (SELECT id, min(nm_id) AS nm_id FROM reviews WHERE nm_id IS NOT NULL GROUP BY id),
p AS (SELECT review_id, aspect_name AS a, avg(final_rating) AS p FROM (SELECT DISTINCT prediction_id, review_id, aspect_name, final_rating FROM nli_predictions WHERE final_rating IS NOT NULL) x GROUP BY ALL),
m AS (SELECT i.nm_id, g.a, count(*) AS n_true, avg(g.g) FILTER (WHERE p.p IS NOT NULL) AS g, avg(p.p) AS p, avg(CASE WHEN p.p IS NOT NULL THEN least(5, greatest(1, round_even(p.p, 0))) END) AS pr FROM g JOIN i ON i.id = g.review_id LEFT JOIN p ON p.review_id = g.review_id AND p.a = g.a GROUP BY i.nm_id, g.a HAVING count(p.p) > 0)
SELECT count(*) AS n, round(avg(abs(g - p)), 6) AS mae, round(avg(abs(g - p)) FILTER (WHERE n_true >= 3), 6) AS mae_n3, round(avg(abs(g - pr)), 6) AS mae_round, round(avg(abs(g - pr)) FILTER (WHERE n_true >= 3), 6) AS mae_round_n3 FROM m""")


def d_mention_recall(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall, micro and macro over products, of aspects mentioned anywhere in a product and in the review."""
    n, g = _tracked(spark, d).filter("track = 'B'"), table(spark, d, "gold_decisions").filter("review_id IS NOT NULL AND gold_aspect IS NOT NULL")
    ids = table(spark, d, "reviews").filter("nm_id IS NOT NULL").groupBy(F.col("id").alias("review_id")).agg(F.min("nm_id").alias("nm_id"))
    p = n.select("review_id", F.col("aspect_name").alias("a")).join(ids, "review_id")
    q = g.select("review_id", F.col("gold_aspect").alias("a")).join(ids, "review_id")

    def tier(name: str, keys: list[str]) -> DataFrame:
        both = p.select(*keys).distinct().withColumn("x", F.lit(1)).join(q.select(*keys).distinct().withColumn("y", F.lit(1)), keys, "full")
        by = both.groupBy("nm_id").agg(F.count("x").alias("np"), F.count("y").alias("ng"), F.count(F.col("x") + F.col("y")).alias("tp"))
        return by.agg(
            F.lit(name).alias("tier"), F.sum("tp").alias("tp"), F.sum("np").alias("n_pred"), F.sum("ng").alias("n_gold"),
            F.round(_ratio(F.sum("tp"), F.sum("np")), 6).alias("micro_p"), F.round(_ratio(F.sum("tp"), F.sum("ng")), 6).alias("micro_r"),
            F.round(F.avg(_ratio(F.col("tp"), F.col("np"))), 6).alias("macro_p"), F.round(F.avg(_ratio(F.col("tp"), F.col("ng"))), 6).alias("macro_r"),
        )

    return tier("product", ["nm_id", "a"]).unionByName(tier("review", ["nm_id", "review_id", "a"]))


_MENTIONS = """WITH i AS (SELECT id, min(nm_id) AS nm_id FROM reviews WHERE nm_id IS NOT NULL GROUP BY id), p AS (SELECT DISTINCT i.nm_id, review_id, aspect_name AS a FROM nli_predictions JOIN i ON i.id = review_id WHERE aspect_name IS NOT NULL), g AS (SELECT DISTINCT i.nm_id, review_id, gold_aspect AS a FROM gold_decisions JOIN i ON i.id = review_id WHERE gold_aspect IS NOT NULL),
u AS (SELECT 'review' AS tier, nm_id, review_id AS r, a, 1 AS x, 0 AS y FROM p UNION ALL SELECT 'review', nm_id, review_id, a, 0, 1 FROM g UNION ALL SELECT DISTINCT 'product', nm_id, '', a, 1, 0 FROM p UNION ALL SELECT DISTINCT 'product', nm_id, '', a, 0, 1 FROM g),
k AS (SELECT tier, nm_id, r, a, max(x) AS x, max(y) AS y FROM u GROUP BY ALL), b AS (SELECT tier, nm_id, sum(x) AS np, sum(y) AS ng, sum(x * y) AS tp FROM k GROUP BY ALL)
SELECT tier, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np) AS BIGINT) AS n_pred, CAST(sum(ng) AS BIGINT) AS n_gold, round(sum(tp) / nullif(sum(np), 0), 6) AS micro_p, round(sum(tp) / nullif(sum(ng), 0), 6) AS micro_r, round(avg(tp / nullif(np, 0)), 6) AS macro_p, round(avg(tp / nullif(ng, 0)), 6) AS macro_r FROM b GROUP BY tier"""
_add("d28_mention_recall", d_mention_recall, _MENTIONS)


def d_aspect_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per aspect, in how many reviews it was found, wrongly found and missed."""
    p = table(spark, d, "nli_predictions").select("review_id", F.col("aspect_name").alias("aspect")).dropna().distinct().withColumn("x", F.lit(1))
    g = table(spark, d, "gold_decisions").select("review_id", F.col("gold_aspect").alias("aspect")).dropna().distinct().withColumn("y", F.lit(1))
    by = p.join(g, ["review_id", "aspect"], "full").groupBy("aspect").agg(F.count(F.col("x") + F.col("y")).alias("tp"), F.count(F.when(F.col("y").isNull(), 1)).alias("fp"), F.count(F.when(F.col("x").isNull(), 1)).alias("fn"))
    return by.select("*", F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


_SETS = "p AS (SELECT DISTINCT review_id, aspect_name AS a FROM nli_predictions WHERE review_id IS NOT NULL AND aspect_name IS NOT NULL), g AS (SELECT DISTINCT review_id, gold_aspect AS a FROM gold_decisions WHERE review_id IS NOT NULL AND gold_aspect IS NOT NULL)"
_add("d37_aspect_stats", d_aspect_stats, f"WITH {_SETS}, k AS (SELECT a, 'tp' AS c FROM (SELECT * FROM p INTERSECT SELECT * FROM g) UNION ALL SELECT a, 'fp' FROM (SELECT * FROM p EXCEPT SELECT * FROM g) UNION ALL SELECT a, 'fn' FROM (SELECT * FROM g EXCEPT SELECT * FROM p)), s AS (SELECT a, count_if(c = 'tp') AS tp, count_if(c = 'fp') AS fp, count_if(c = 'fn') AS fn FROM k GROUP BY a) SELECT a AS aspect, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM s")
_add("d38_category_prf", lambda s, d: review_detection(s, d).filter("track = 'B'").groupBy("category").agg(F.count(F.lit(1)).alias("n_reviews"), *(F.round(F.avg(c), 6).alias(k) for c, k in (("p", "precision"), ("r", "recall"), ("f1", "f1")))),
     _TRACK_SQL + "SELECT category, count(*) AS n_reviews, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f), 6) AS f1 FROM z WHERE track = 'B' GROUP BY category")
_add("d38_top_missed", lambda s, d: d_aspect_stats(s, d).select("aspect", F.explode(F.array(F.struct(F.lit("fp").alias("kind"), F.col("fp").alias("n")), F.struct(F.lit("fn").alias("kind"), F.col("fn").alias("n")))).alias("x")).select("x.kind", "aspect", "x.n").filter("n > 0").transform(lambda df: head_by(df, ["kind"], [F.desc("n"), F.asc("aspect")], 10).withColumn("rank", F.col("rank").cast("bigint"))),
     f"WITH {_SETS}, k AS (SELECT 'fp' AS kind, a FROM (SELECT * FROM p EXCEPT SELECT * FROM g) UNION ALL SELECT 'fn', a FROM (SELECT * FROM g EXCEPT SELECT * FROM p)), c AS (SELECT kind, a, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, a) AS rank FROM c) SELECT kind, a AS aspect, n, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10")


# --- audit detection, in slices
def d_detection_slices(spark: SparkSession, d: str) -> DataFrame:
    """Strict and soft precision, recall and F1 of audited rows, overall and by aspect source; recall needs missed gold
    aspects, which have no source, so slices by source have none."""
    s = table(spark, d, "system_decisions").select("prediction_id", "review_id", "aspect_source", X.null_like(F.upper(F.trim("manual_decision"))).alias("dec")).distinct()
    fn = table(spark, d, "gold_decisions").select("review_id", "gold_aspect", F.upper(F.trim("status")).alias("st")).distinct().agg(F.count(F.when(F.col("st") == "FN", 1)).alias("fn"))
    c = s.groupingSets([[F.col("aspect_source")], []], "aspect_source").agg(F.grouping("aspect_source").cast("int").alias("total"), *(F.count(F.when(F.col("dec") == k, 1)).alias(k.lower()) for k in ("TP", "FP", "UNCLEAR", "DUPLICATE", "OUT_OF_SCOPE")))
    c = c.crossJoin(F.broadcast(fn)).withColumn("fn", F.when(F.col("total") == 1, F.col("fn")))  # one row
    strict, soft, rc = _ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("unclear")), _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = lambda p: F.when(p + rc > 0, 2 * p * rc / (p + rc))
    return c.select(F.when(F.col("total") == 1, "all").otherwise(F.coalesce("aspect_source", F.lit("none"))).alias("slice"), "tp", "fp", "unclear", "duplicate", "out_of_scope", "fn", *(F.round(v, 6).alias(k) for k, v in (("precision_strict", strict), ("precision_soft", soft), ("recall", rc), ("f1_strict", f1(strict)), ("f1_soft", f1(soft)))))


_add("d20_detection_slices", d_detection_slices, """
WITH s AS (SELECT DISTINCT prediction_id, review_id, aspect_source, upper(trim(manual_decision)) AS dec FROM system_decisions), t AS (SELECT 'all' AS slice, dec FROM s UNION ALL SELECT coalesce(aspect_source, 'none'), dec FROM s),
c AS (SELECT slice, count_if(dec = 'TP') AS tp, count_if(dec = 'FP') AS fp, count_if(dec = 'UNCLEAR') AS unclear, count_if(dec = 'DUPLICATE') AS duplicate, count_if(dec = 'OUT_OF_SCOPE') AS out_of_scope FROM t GROUP BY slice),
f AS (SELECT *, CASE WHEN slice = 'all' THEN (SELECT count(*) FROM (SELECT DISTINCT review_id, gold_aspect, upper(trim(status)) AS st FROM gold_decisions) q WHERE st = 'FN') END AS fn FROM c),
m AS (SELECT *, tp / nullif(tp + fp + unclear, 0) AS a, tp / nullif(tp + fp, 0) AS b, tp / nullif(tp + fn, 0) AS r FROM f)
SELECT slice, tp, fp, unclear, duplicate, out_of_scope, fn, round(a, 6) AS precision_strict, round(b, 6) AS precision_soft, round(r, 6) AS recall, round(2 * a * r / nullif(a + r, 0), 6) AS f1_strict, round(2 * b * r / nullif(b + r, 0), 6) AS f1_soft FROM m""")


def d_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What one pass over the pairs gives beside the errors: recalls and macro F1 of directions, rates, coverage of gold."""
    g, p = F.col("gold"), R.clip(F.col("pred"))
    x = pairs(spark, d).select("nm_id", "aspect_source", g.alias("g"), p.alias("p"), R.gold_direction(g).alias("gd"), R.predicted_direction(p).alias("pd"))
    n, e = F.count(F.lit(1)), F.abs(F.col("p") - F.col("g"))
    hit = lambda k: F.count(F.when((F.col("gd") == k) & (F.col("pd") == k), 1))
    of = lambda c, k: F.count(F.when(F.col(c) == k, 1))
    kinds = ("positive", "negative", "neutral")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    err = F.col("p") - F.col("g")
    at = lambda s, c: F.round(F.avg(F.when(F.col("aspect_source") == s, c)), 6)
    total = table(spark, d, "gold_decisions").filter("gold_rating IS NOT NULL").select("review_id", "gold_aspect").distinct().agg(F.count(F.lit(1)).alias("all_gold"))
    m = x.agg(
        n.alias("n_pairs"), F.countDistinct("nm_id").alias("n_products"), F.round(F.avg(F.abs(F.rint("p") - F.col("g"))), 6).alias("mae_round"),
        *(F.round(_ratio(hit(k), of("gd", k)), 6).alias(f"{k}_recall") for k in kinds),
        F.round(sum((F.coalesce(_ratio(2 * hit(k), of("gd", k) + of("pd", k)), F.lit(0.0)) for k in kinds), F.lit(0.0)) / 3, 6).alias("macro_direction_f1"),
        share(err <= -1).alias("too_low_rate"), share(err >= 1).alias("too_high_rate"), share(err <= -2).alias("large_too_low_rate"), share(err >= 2).alias("large_too_high_rate"),
        at("vocab", e).alias("vocab_mae"), at("discovery", e).alias("discovery_mae"), at("vocab", (e <= 1).cast("double")).alias("vocab_acc_1"), at("discovery", (e <= 1).cast("double")).alias("discovery_acc_1"),
    )
    return m.crossJoin(F.broadcast(total)).withColumn("coverage", F.round(_ratio(F.col("n_pairs"), F.col("all_gold")), 6)).drop("all_gold")  # one row


_DIR = "CASE WHEN {0} THEN 1e0 ELSE 0e0 END".format
_add("d16_run_metrics", d_run_metrics, PAIRS_SQL + """, q AS (SELECT nm_id, aspect_source, gold AS g, least(5.0, greatest(1.0, pred)) AS p FROM pairs),
x AS (SELECT *, CASE WHEN g <= 2 THEN 'negative' WHEN g >= 4 THEN 'positive' ELSE 'neutral' END AS gd, CASE WHEN p < 2.75 THEN 'negative' WHEN p <= 3.25 THEN 'neutral' ELSE 'positive' END AS pd, abs(p - g) AS e FROM q),
k AS (SELECT unnest(['positive', 'negative', 'neutral']) AS k), f AS (SELECT k, count_if(gd = k AND pd = k) AS h, count_if(gd = k) AS a, count_if(pd = k) AS b FROM x CROSS JOIN k GROUP BY k)
SELECT count(*) AS n_pairs, count(DISTINCT nm_id) AS n_products, round(avg(abs(round_even(p, 0) - g)), 6) AS mae_round, (SELECT round(h / nullif(a, 0), 6) FROM f WHERE k = 'positive') AS positive_recall, (SELECT round(h / nullif(a, 0), 6) FROM f WHERE k = 'negative') AS negative_recall, (SELECT round(h / nullif(a, 0), 6) FROM f WHERE k = 'neutral') AS neutral_recall,
 (SELECT round(avg(coalesce(2 * h / nullif(a + b, 0), 0)), 6) FROM f) AS macro_direction_f1, """ + f"round(avg({_DIR('p - g <= -1')}), 6) AS too_low_rate, round(avg({_DIR('p - g >= 1')}), 6) AS too_high_rate, round(avg({_DIR('p - g <= -2')}), 6) AS large_too_low_rate, round(avg({_DIR('p - g >= 2')}), 6) AS large_too_high_rate, " + """
 round(avg(e) FILTER (WHERE aspect_source = 'vocab'), 6) AS vocab_mae, round(avg(e) FILTER (WHERE aspect_source = 'discovery'), 6) AS discovery_mae, round(avg(CASE WHEN e <= 1 THEN 1e0 ELSE 0e0 END) FILTER (WHERE aspect_source = 'vocab'), 6) AS vocab_acc_1, round(avg(CASE WHEN e <= 1 THEN 1e0 ELSE 0e0 END) FILTER (WHERE aspect_source = 'discovery'), 6) AS discovery_acc_1,
 round(count(*) / (SELECT nullif(count(*), 0) FROM (SELECT DISTINCT review_id, gold_aspect FROM gold_decisions WHERE gold_rating IS NOT NULL) y), 6) AS coverage FROM x""")


# --- personal ratings
def d_personal(spark: SparkSession, d: str, weights: tuple[tuple[str, float], ...] = (("general", 1.0), ("specific", 2.0))) -> DataFrame:
    """Per run and product, the mean score by a user's weights of aspect levels (1 for other aspects, 3 without weight)."""
    a = table(spark, d, "aspect_reference").groupBy(F.col("canonical_name").alias("aspect_name")).agg(F.min("level").alias("level"))
    w = F.lit(1.0)
    for level, v in weights:
        w = F.when(F.col("level") == level, F.lit(v)).otherwise(w)
    p = table(spark, d, "product_aggregates").filter("shrunken_rating IS NOT NULL").select("run_id", "nm_id", "aspect_name", "aspect_source", "shrunken_rating").distinct().join(a, "aspect_name", "left").withColumn("u", w)
    return p.groupBy("run_id", "nm_id").agg(F.round(F.coalesce(F.sum(F.col("u") * F.col("shrunken_rating")) / F.nullif(F.sum("u"), F.lit(0.0)), F.lit(3.0)), 5).alias("rating"))


_add("d5_personal_ratings", d_personal, "WITH a AS (SELECT canonical_name, min(level) AS level FROM aspect_reference GROUP BY canonical_name), p AS (SELECT DISTINCT run_id, nm_id, aspect_name, aspect_source, shrunken_rating AS s FROM product_aggregates WHERE shrunken_rating IS NOT NULL), u AS (SELECT p.*, CASE level WHEN 'general' THEN 1e0 WHEN 'specific' THEN 2e0 ELSE 1e0 END AS u FROM p LEFT JOIN a ON a.canonical_name = p.aspect_name) SELECT run_id, nm_id, round(coalesce(sum(u * s) / nullif(sum(u), 0), 3), 5) AS rating FROM u GROUP BY run_id, nm_id")


# --- joins with checks, mappings
def c_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the one review they refer to; the review side is checked to hold each id once."""
    r = table(spark, d, "reviews").filter("id IS NOT NULL").groupBy(F.col("id").alias("review_id")).agg(F.max("rating").alias("stars"))
    n = table(spark, d, "nli_predictions").select("prediction_id", "review_id").distinct()
    return validated_join(n, r, ["review_id"], "many_to_one").select("prediction_id", "stars")


_add("c2_many_to_one", c_many_to_one, "SELECT n.prediction_id, r.stars FROM (SELECT DISTINCT prediction_id, review_id FROM nli_predictions) n LEFT JOIN (SELECT id, max(rating) AS stars FROM reviews GROUP BY id) r ON r.id = n.review_id")


def c_word_cover(spark: SparkSession, d: str) -> DataFrame:
    """Which aspects share a word with a candidate's lemma; candidates that share none are the residue and don't appear."""
    c = table(spark, d, "candidates").filter("text_lemmatized IS NOT NULL").select("text_lemmatized").distinct()
    a = table(spark, d, "aspect_reference").select("aspect_id", "canonical_name")
    return word_matches(c, a, ["text_lemmatized"], ["aspect_id"], F.col("text_lemmatized"), F.col("canonical_name")).select("text_lemmatized", "aspect_id", F.col("shared").cast("bigint").alias("shared"))


_WORDS = r"regexp_extract_all(lower({0}), '[^\t\n\x0b\f\r\x1c-\x1f \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')".format
_add("c9_word_cover", c_word_cover, f"WITH c AS (SELECT DISTINCT text_lemmatized FROM candidates WHERE text_lemmatized IS NOT NULL), x AS (SELECT DISTINCT text_lemmatized, unnest({_WORDS('text_lemmatized')}) AS w FROM c), y AS (SELECT DISTINCT aspect_id, unnest({_WORDS('canonical_name')}) AS w FROM aspect_reference) SELECT text_lemmatized, aspect_id, count(*) AS shared FROM x JOIN y USING (w) GROUP BY ALL")


def _best_words(spark: SparkSession, left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    m = word_matches(left, right, [a], [b], F.col(a), F.col(b), within=["nm_id"]).filter(F.round("jaccard", 9) >= least)
    return m.groupBy("nm_id", a).agg(F.min(F.struct((-F.round("jaccard", 9)).alias("j"), F.col(b).alias("b"))).alias("x")).select("nm_id", a, F.col("x.b").alias(b), F.round(-F.col("x.j"), 6).alias("score"))


def c_gold_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Per product and gold aspect the one cluster whose phrases are most alike in words; ties go to the lower cluster."""
    ids = table(spark, d, "reviews").groupBy(F.col("id").alias("review_id")).agg(F.min("nm_id").alias("nm_id"))
    g = table(spark, d, "gold_decisions").filter("gold_aspect IS NOT NULL").select("review_id", "gold_aspect").join(ids, "review_id").select("nm_id", "gold_aspect").distinct()
    k = table(spark, d, "clusters").select("nm_id", "cluster_id", F.explode(F.concat(F.array("medoid_phrase"), F.coalesce(F.transform("top_phrases", lambda p: p["phrase"]), F.array().cast("array<string>")))).alias("phrase"))
    m = word_matches(g, k, ["gold_aspect"], ["cluster_id", "phrase"], F.col("gold_aspect"), F.col("phrase"), within=["nm_id"])
    return m.groupBy("nm_id", "gold_aspect").agg(F.min(F.struct((-F.round("jaccard", 9)).alias("j"), F.col("cluster_id").alias("c"))).alias("x")).select("nm_id", "gold_aspect", F.col("x.c").alias("cluster_id"), F.round(-F.col("x.j"), 6).alias("score"))


_JACCARD = "count(*) / (any_value({0}.k) + any_value({1}.k) - count(*))".format
_add("c19_gold_cluster", c_gold_cluster, f"""
WITH i AS (SELECT id, min(nm_id) AS nm_id FROM reviews GROUP BY id), g AS (SELECT DISTINCT i.nm_id, gold_aspect FROM gold_decisions JOIN i ON i.id = review_id WHERE gold_aspect IS NOT NULL),
p AS (SELECT DISTINCT nm_id, cluster_id, phrase FROM (SELECT nm_id, cluster_id, medoid_phrase AS phrase FROM clusters UNION ALL SELECT nm_id, cluster_id, unnest(list_transform(top_phrases, lambda x: x.phrase)) FROM clusters) u WHERE phrase IS NOT NULL),
gw AS (SELECT nm_id, gold_aspect, len(list_distinct({_WORDS('gold_aspect')})) AS k, unnest(list_distinct({_WORDS('gold_aspect')})) AS w FROM g), pw AS (SELECT nm_id, cluster_id, phrase, len(list_distinct({_WORDS('phrase')})) AS k, unnest(list_distinct({_WORDS('phrase')})) AS w FROM p),
m AS (SELECT gw.nm_id, gold_aspect, cluster_id, phrase, {_JACCARD('gw', 'pw')} AS j FROM gw JOIN pw ON pw.nm_id = gw.nm_id AND pw.w = gw.w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY nm_id, gold_aspect ORDER BY round(j, 9) DESC, cluster_id) AS q FROM m) SELECT nm_id, gold_aspect, cluster_id, round(j, 6) AS score FROM r WHERE q = 1""")


def c_auto_mapping(spark: SparkSession, d: str, least: float = 0.3) -> DataFrame:
    """Per product, each predicted aspect with its most alike gold aspect of the product, null below ``least``."""
    ids = table(spark, d, "reviews").groupBy(F.col("id").alias("review_id")).agg(F.min("nm_id").alias("nm_id"))
    p = table(spark, d, "nli_predictions").filter("aspect_name IS NOT NULL").select("nm_id", "aspect_name").distinct()
    g = table(spark, d, "gold_decisions").filter("gold_aspect IS NOT NULL").select("review_id", "gold_aspect").join(ids, "review_id").select("nm_id", "gold_aspect").distinct()
    return p.join(_best_words(spark, p, g, "aspect_name", "gold_aspect", least), ["nm_id", "aspect_name"], "left")


_add("c22_auto_mapping", c_auto_mapping, f"""
WITH i AS (SELECT id, min(nm_id) AS nm_id FROM reviews GROUP BY id), p AS (SELECT DISTINCT nm_id, aspect_name FROM nli_predictions WHERE aspect_name IS NOT NULL), g AS (SELECT DISTINCT i.nm_id, gold_aspect FROM gold_decisions JOIN i ON i.id = review_id WHERE gold_aspect IS NOT NULL),
a AS (SELECT nm_id, aspect_name, len(list_distinct({_WORDS('aspect_name')})) AS k, unnest(list_distinct({_WORDS('aspect_name')})) AS w FROM p), b AS (SELECT nm_id, gold_aspect, len(list_distinct({_WORDS('gold_aspect')})) AS k, unnest(list_distinct({_WORDS('gold_aspect')})) AS w FROM g),
m AS (SELECT a.nm_id, aspect_name, gold_aspect, {_JACCARD('a', 'b')} AS j FROM a JOIN b ON b.nm_id = a.nm_id AND a.w = b.w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY nm_id, aspect_name ORDER BY round(j, 9) DESC, gold_aspect) AS q FROM m WHERE round(j, 9) >= 0.3)
SELECT p.nm_id, p.aspect_name, r.gold_aspect, round(r.j, 6) AS score FROM p LEFT JOIN r ON r.nm_id = p.nm_id AND r.aspect_name = p.aspect_name AND r.q = 1""")


def c_evidence_pick(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the selected evidence: three-part key of review, aspect and prediction."""
    n = table(spark, d, "nli_predictions").filter("relevance_filter_value IS NOT NULL").select("review_id", "aspect_name", "prediction_id", "relevance_filter_value", "p_entailment", "final_rating").distinct()
    best = first_by(n.select("review_id", "aspect_name", "relevance_filter_value", "prediction_id"), ["review_id", "aspect_name"], [-F.col("relevance_filter_value"), F.col("prediction_id")]).select("review_id", "aspect_name", "prediction_id")
    return n.join(best, ["review_id", "aspect_name", "prediction_id"]).select("review_id", "aspect_name", "prediction_id", "p_entailment", "final_rating").distinct()


_add("c16_evidence_pick", c_evidence_pick, "WITH n AS (SELECT DISTINCT review_id, aspect_name, prediction_id, relevance_filter_value AS v, p_entailment, final_rating FROM nli_predictions WHERE relevance_filter_value IS NOT NULL AND review_id IS NOT NULL AND aspect_name IS NOT NULL), b AS (SELECT review_id, aspect_name, arg_min(prediction_id, {'a': -v, 'b': prediction_id}) AS prediction_id FROM n GROUP BY ALL) SELECT DISTINCT n.review_id, n.aspect_name, n.prediction_id, p_entailment, final_rating FROM n JOIN b ON b.review_id = n.review_id AND b.aspect_name = n.aspect_name AND b.prediction_id = n.prediction_id")

# --- picks, queues and samples
_add("e5_argmax_row", lambda s, d: table(s, d, "nli_predictions").filter("p_entailment IS NOT NULL").groupBy("review_id").agg(F.max(F.struct("p_entailment", "prediction_id")).alias("x")).select("review_id", "x.prediction_id", F.col("x.p_entailment").alias("p_entailment")),
     "WITH r AS (SELECT review_id, prediction_id, p_entailment, row_number() OVER (PARTITION BY review_id ORDER BY p_entailment DESC, prediction_id DESC) AS k FROM nli_predictions WHERE p_entailment IS NOT NULL) SELECT review_id, prediction_id, p_entailment FROM r WHERE k = 1")
_add("e6_head_30", lambda s, d: head_by(table(s, d, "system_decisions").select("aspect_source", "prediction_id").distinct(), ["aspect_source"], [F.col("prediction_id")], 30).drop("rank"),
     "WITH r AS (SELECT *, row_number() OVER (PARTITION BY aspect_source ORDER BY prediction_id) AS k FROM (SELECT DISTINCT aspect_source, prediction_id FROM system_decisions) x) SELECT aspect_source, prediction_id FROM r WHERE k <= 30")


def f_audit_queue(spark: SparkSession, d: str, n: int = 200) -> DataFrame:
    """The first ``n`` pairs to look at: wrong polarity, greatest error, negation, lowest rating; empty values last."""
    x = pairs(spark, d).select("prediction_id", "review_id", R.wrong_polarity(F.col("gold"), R.clip(F.col("pred"))).alias("wrong"), F.round(F.abs(F.col("pred") - F.col("gold")), 6).alias("e"), F.coalesce("neg", F.lit(False)).alias("neg"), "raw").distinct()
    return x.orderBy(F.desc("wrong"), F.desc_nulls_last("e"), F.desc("neg"), F.asc_nulls_last("raw"), "review_id", "prediction_id").limit(n)


_add("f2_audit_queue", f_audit_queue, PAIRS_SQL + "SELECT DISTINCT prediction_id, review_id, (gold >= 4 AND least(5.0, greatest(1.0, pred)) < 2.75) OR (gold <= 2 AND least(5.0, greatest(1.0, pred)) > 3.25) AS wrong, round(abs(pred - gold), 6) AS e, coalesce(neg, false) AS neg, raw FROM pairs ORDER BY wrong DESC, e DESC NULLS LAST, neg DESC, raw ASC NULLS LAST, review_id, prediction_id LIMIT 200")
_add("f3_top_inversions", lambda s, d: pairs(s, d).filter(R.wrong_polarity(F.col("gold"), F.col("pred"))).select("prediction_id", "gold", F.round("pred", 6).alias("pred"), F.round(F.col("pred") - F.col("gold"), 6).alias("by")).distinct().orderBy(F.desc(F.abs("by")), "prediction_id").limit(5),
     PAIRS_SQL + "SELECT DISTINCT prediction_id, gold, round(pred, 6) AS pred, round(pred - gold, 6) AS by FROM pairs WHERE (gold >= 4 AND pred < 2.75) OR (gold <= 2 AND pred > 3.25) ORDER BY abs(round(pred - gold, 6)) DESC, prediction_id LIMIT 5")


def f_worst_and_heads(spark: SparkSession, d: str, worst: int = 200, heads: int = 30) -> DataFrame:
    """The worst pairs and the first of every aspect source, each pair once; what is worst has the lower priority number."""
    x = pairs(spark, d).select("prediction_id", "aspect_source", F.round(F.abs(F.col("pred") - F.col("gold")), 6).alias("e"))
    w = x.groupBy("prediction_id").agg(F.max("e").alias("e")).orderBy(F.desc("e"), "prediction_id").limit(worst).select("prediction_id", F.lit(1).alias("priority"))
    h = head_by(x.select("aspect_source", "prediction_id").distinct(), ["aspect_source"], [F.col("prediction_id")], heads).select("prediction_id", F.lit(2).alias("priority"))
    return w.unionByName(h).groupBy("prediction_id").agg(F.min("priority").alias("priority"))


_add("f5_worst_and_heads", f_worst_and_heads, PAIRS_SQL + ", w AS (SELECT prediction_id, 1 AS p FROM (SELECT prediction_id, max(round(abs(pred - gold), 6)) AS e FROM pairs GROUP BY prediction_id) x ORDER BY e DESC, prediction_id LIMIT 200), h AS (SELECT prediction_id, 2 AS p FROM (SELECT prediction_id, row_number() OVER (PARTITION BY aspect_source ORDER BY prediction_id) AS k FROM (SELECT DISTINCT prediction_id, aspect_source FROM pairs) z) x WHERE k <= 30) SELECT prediction_id, min(p) AS priority FROM (SELECT * FROM w UNION ALL SELECT * FROM h) u GROUP BY prediction_id")


def f_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """The 200 hardest pairs counted by source, aspect, error type and product."""
    hard = pairs(spark, d).select("prediction_id", "aspect_source", "aspect_name", "nm_id", R.error_type(F.col("gold"), R.clip(F.col("pred"))).alias("kind"), F.round(F.abs(F.col("pred") - F.col("gold")), 6).alias("e")).orderBy(F.desc("e"), "prediction_id", "aspect_name", "nm_id").limit(200)
    dims = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(c).cast("string").alias("value")) for k, c in (("source", "aspect_source"), ("aspect", "aspect_name"), ("type", "kind"), ("product", "nm_id"))))).alias("x")
    return hard.select(dims).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


_add("f6_hard_case_breakdown", f_breakdown, PAIRS_SQL + """, c AS (SELECT *, least(5.0, greatest(1.0, pred)) AS p FROM pairs), h AS (SELECT aspect_source, aspect_name, nm_id, CASE WHEN (gold >= 4 AND p <= 2) OR (gold <= 2 AND p >= 4) THEN 'strong_wrong_polarity' WHEN (gold >= 4 AND p < 2.75) OR (gold <= 2 AND p > 3.25) THEN 'wrong_polarity' WHEN p - gold <= -2 THEN 'large_too_low' WHEN p - gold >= 2 THEN 'large_too_high' WHEN p - gold <= -1 THEN 'too_low' WHEN p - gold >= 1 THEN 'too_high' ELSE 'near_miss' END AS kind FROM c ORDER BY round(abs(pred - gold), 6) DESC, prediction_id, aspect_name, nm_id LIMIT 200)
SELECT 'source' AS dimension, aspect_source AS value, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 'aspect', aspect_name, count(*) FROM h GROUP BY ALL UNION ALL SELECT 'type', kind, count(*) FROM h GROUP BY ALL UNION ALL SELECT 'product', CAST(nm_id AS VARCHAR), count(*) FROM h GROUP BY ALL""")


def f_ranked_products(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    """The best and the worst products by mean error, at least three pairs each."""
    m = pairs(spark, d).filter("nm_id IS NOT NULL").groupBy("nm_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("gold"))), 6).alias("mae")).filter("n >= 3")
    best, worst = m.orderBy("mae", "nm_id").limit(n), m.orderBy(F.desc("mae"), "nm_id").limit(n)
    return best.withColumn("list", F.lit("best")).unionByName(worst.withColumn("list", F.lit("worst")))


_add("f8_ranked_products", f_ranked_products, PAIRS_SQL + ", m AS (SELECT nm_id, count(*) AS n, round(avg(abs(pred - gold)), 6) AS mae FROM pairs WHERE nm_id IS NOT NULL GROUP BY nm_id HAVING count(*) >= 3) (SELECT *, 'best' AS list FROM m ORDER BY mae, nm_id LIMIT 10) UNION ALL (SELECT *, 'worst' FROM m ORDER BY mae DESC, nm_id LIMIT 10)")


def f_quota_sample(spark: SparkSession, d: str, n: int = 60, quota: int = 10, seed: str = "7") -> DataFrame:
    """``n`` reviews: up to ``quota`` of each category in a seeded order, then any others in that order."""
    r = table(spark, d, "reviews").select("id", "category").dropna().groupBy("id").agg(F.min("category").alias("category")).withColumn("h", F.md5(F.concat("id", F.lit(seed))))
    first = head_by(r, ["category"], [F.col("h")], quota).select("id", "category", "h", F.lit(0).alias("late"))
    rest = r.join(first.select("id"), "id", "left_anti").orderBy("h").limit(n).select("id", "category", "h", F.lit(1).alias("late"))
    return first.unionByName(rest).orderBy("late", "h").limit(n).select("id", "category")


_add("f9_quota_sample", f_quota_sample, "WITH r AS (SELECT id, min(category) AS category, md5(id || '7') AS h FROM reviews WHERE id IS NOT NULL AND category IS NOT NULL GROUP BY id), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h) AS k FROM r) SELECT id, category FROM k ORDER BY CASE WHEN k <= 10 THEN 0 ELSE 1 END, h LIMIT 60")
_add("b15_seeded_sample", lambda s, d: table(s, d, "reviews").filter("length(trim(full_text)) >= 20 AND true_labels IS NOT NULL AND true_labels <> '{}'").select("id").distinct().orderBy(F.md5(F.concat("id", F.lit("42")))).limit(25),
     "SELECT id FROM (SELECT DISTINCT id FROM reviews WHERE length(trim(full_text)) >= 20 AND true_labels IS NOT NULL AND true_labels <> '{}') x ORDER BY md5(id || '42') LIMIT 25")

# --- sets
_add("g2_matched_terms", lambda s, d: table(s, d, "candidates").filter("text_lemmatized IS NOT NULL").select("review_id", F.col("text_lemmatized").alias("term")).distinct().join(table(s, d, "aspect_reference").select(F.lower("canonical_name").alias("term"), F.lit(True).alias("m")).distinct(), "term", "left").groupBy("review_id").agg(F.count("m").alias("n_matched"), F.count(F.when(F.col("m").isNull(), 1)).alias("n_unmatched")),
     "WITH c AS (SELECT DISTINCT review_id, text_lemmatized AS t FROM candidates WHERE text_lemmatized IS NOT NULL), v AS (SELECT lower(canonical_name) AS t FROM aspect_reference), m AS (SELECT review_id, t FROM c WHERE t IN (SELECT t FROM v)), u AS (SELECT * FROM c EXCEPT SELECT * FROM m), z AS (SELECT review_id, 1 AS a, 0 AS b FROM m UNION ALL SELECT review_id, 0, 1 FROM u) SELECT review_id, CAST(sum(a) AS BIGINT) AS n_matched, CAST(sum(b) AS BIGINT) AS n_unmatched FROM z GROUP BY review_id")
_add("g3_union_tracks", lambda s, d: table(s, d, "nli_predictions").select("review_id", F.col("aspect_name").alias("aspect"), F.lit("model").alias("track")).unionByName(table(s, d, "gold_decisions").select("review_id", F.col("gold_aspect").alias("aspect"), "status"), allowMissingColumns=True).dropDuplicates(["review_id", "aspect", "track"]).groupBy("track").agg(F.count(F.lit(1)).alias("n")),
     "SELECT track, count(*) AS n FROM (SELECT DISTINCT review_id, aspect_name, 'model' AS track FROM nli_predictions UNION ALL SELECT DISTINCT review_id, gold_aspect, NULL FROM gold_decisions) x GROUP BY track")


# --- repair and validation of the audit
def l_repair(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows said to be found without a match: linked to the one true positive mapped to them, else unclear if
    anything is mapped to them, else missed."""
    g = table(spark, d, "gold_decisions").select("review_id", "gold_aspect", "status", X.null_like(F.col("matched_system_prediction_id")).alias("m")).filter("status = 'FOUND' AND m IS NULL").select("review_id", "gold_aspect").distinct()
    s = table(spark, d, "system_decisions").select("prediction_id", "review_id", "manual_decision", F.trim("mapped_gold_aspect").alias("gold_aspect")).filter("gold_aspect <> ''").distinct()
    by = s.groupBy("review_id", "gold_aspect").agg(F.count_distinct(F.when(F.col("manual_decision") == "TP", F.col("prediction_id"))).alias("n_tp"), F.min(F.when(F.col("manual_decision") == "TP", F.col("prediction_id"))).alias("tp"), F.count(F.lit(1)).alias("n"))
    one = F.col("n_tp") == 1
    return g.join(by, ["review_id", "gold_aspect"], "left").select("review_id", "gold_aspect", F.when(one, "FOUND").when(F.col("n") > 0, "UNCLEAR").otherwise("FN").alias("new_status"), F.when(one, F.col("tp")).alias("match"))


_add("l5_repair", l_repair, "WITH g AS (SELECT DISTINCT review_id, gold_aspect FROM gold_decisions WHERE status = 'FOUND' AND (matched_system_prediction_id IS NULL OR upper(trim(matched_system_prediction_id)) IN ('', 'NONE', 'NULL', 'NAN', 'NA'))) SELECT review_id, gold_aspect, CASE WHEN t = 1 THEN 'FOUND' WHEN a > 0 THEN 'UNCLEAR' ELSE 'FN' END AS new_status, CASE WHEN t = 1 THEN id END AS match FROM (SELECT g.review_id, g.gold_aspect, count(DISTINCT s.prediction_id) FILTER (WHERE s.manual_decision = 'TP') AS t, count(s.prediction_id) AS a, min(s.prediction_id) FILTER (WHERE s.manual_decision = 'TP') AS id FROM g LEFT JOIN system_decisions s ON s.review_id = g.review_id AND trim(s.mapped_gold_aspect) = g.gold_aspect GROUP BY g.review_id, g.gold_aspect) x")
_add("l3_hit_counts", lambda s, d: table(s, d, "nli_predictions").filter("premise_text IS NOT NULL").groupBy(F.md5("premise_text").alias("text_key")).agg(F.count(F.lit(1)).alias("hits"), F.max("created_at").alias("last_hit_at")).filter("hits > 1"), "SELECT md5(premise_text) AS text_key, count(*) AS hits, max(created_at) AS last_hit_at FROM nli_predictions WHERE premise_text IS NOT NULL GROUP BY md5(premise_text) HAVING count(*) > 1")

#: What a decision, a status and a judgement of the rating may be.
DECISIONS, STATUSES, JUDGEMENTS = ("TP", "FP", "UNCLEAR", "DUPLICATE", "OUT_OF_SCOPE", ""), ("FOUND", "FN", "UNCLEAR", ""), ("OK", "WRONG", "UNCLEAR", "")


def l_validation(spark: SparkSession, d: str) -> DataFrame:
    """The eight rules of a complete audit with their number of violations; repeated rows count once."""
    s = table(spark, d, "system_decisions").select("prediction_id", "review_id", F.coalesce(F.upper(F.trim("manual_decision")), F.lit("")).alias("dec"), F.coalesce(X.null_like(F.col("mapped_gold_aspect")), F.lit("")).alias("map"), F.coalesce(F.upper(F.trim("manual_sentiment_decision")), F.lit("")).alias("sent")).distinct()
    g = table(spark, d, "gold_decisions").select("review_id", "gold_aspect", F.coalesce(F.upper(F.trim("status")), F.lit("")).alias("st"), X.null_like(F.col("matched_system_prediction_id")).alias("m")).distinct()
    reviewed = s.select("review_id").union(g.select("review_id")).dropna().distinct()
    due = table(spark, d, "nli_predictions").select("review_id", "prediction_id").distinct().join(reviewed, "review_id")
    labels = table(spark, d, "reviews").select(F.col("id").alias("review_id"), F.explode(X.label_map(F.col("true_labels"))).alias("gold_aspect", "v")).select("review_id", "gold_aspect").distinct().join(reviewed, "review_id")
    multi = s.filter("map <> '' AND dec <> 'DUPLICATE'").groupBy("review_id", "map").agg(F.countDistinct("prediction_id").alias("k")).filter("k > 1")
    rules = [
        due.join(s.select("review_id", "prediction_id").distinct(), ["review_id", "prediction_id"], "left_anti"),
        labels.join(g.select("review_id", "gold_aspect").distinct(), ["review_id", "gold_aspect"], "left_anti"),
        s.filter("dec = 'TP' AND map = ''"), s.filter("dec = 'FP' AND map <> ''"), g.filter("st = 'FOUND' AND m IS NULL"), multi,
        s.filter(~F.col("dec").isin(*DECISIONS)).select("review_id").unionAll(s.filter(~F.col("sent").isin(*JUDGEMENTS)).select("review_id")).unionAll(g.filter(~F.col("st").isin(*STATUSES)).select("review_id")),
        reviewed.join(table(spark, d, "reviews").select(F.col("id").alias("review_id")).distinct(), "review_id", "left_anti"),
    ]
    out = None
    for i, rows in enumerate(rules, 1):
        one = rows.agg(F.lit(i).alias("rule_id"), F.count(F.lit(1)).alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("violations") == 0)


_NULL = "upper(trim({0})) IN ('', 'NONE', 'NULL', 'NAN', 'NA') OR {0} IS NULL".format
_add("l6_audit_rules", l_validation, f"""
WITH s AS (SELECT DISTINCT prediction_id, review_id, coalesce(upper(trim(manual_decision)), '') AS dec, CASE WHEN {_NULL('mapped_gold_aspect')} THEN '' ELSE trim(mapped_gold_aspect) END AS map, coalesce(upper(trim(manual_sentiment_decision)), '') AS sent FROM system_decisions),
g AS (SELECT DISTINCT review_id, gold_aspect, coalesce(upper(trim(status)), '') AS st, CASE WHEN {_NULL('matched_system_prediction_id')} THEN NULL ELSE trim(matched_system_prediction_id) END AS m FROM gold_decisions), v AS (SELECT review_id FROM s WHERE review_id IS NOT NULL UNION SELECT review_id FROM g WHERE review_id IS NOT NULL),
l AS (SELECT DISTINCT id, regexp_extract(e, '^''([^'']*)''', 1) AS a FROM (SELECT id, unnest(regexp_extract_all(true_labels, '''[^'']*'': *[0-9.]+')) AS e FROM reviews) x WHERE trim(regexp_extract(e, '^''([^'']*)''', 1)) <> ''),
c AS (SELECT 1 AS rule_id, (SELECT count(*) FROM (SELECT DISTINCT review_id, prediction_id FROM nli_predictions) n WHERE review_id IN (SELECT review_id FROM v) AND NOT EXISTS (SELECT 1 FROM s WHERE s.review_id = n.review_id AND s.prediction_id = n.prediction_id)) AS violations
UNION ALL SELECT 2, (SELECT count(*) FROM l WHERE id IN (SELECT review_id FROM v) AND NOT EXISTS (SELECT 1 FROM g WHERE g.review_id = l.id AND g.gold_aspect = l.a)) UNION ALL SELECT 3, (SELECT count(*) FROM s WHERE dec = 'TP' AND map = '') UNION ALL SELECT 4, (SELECT count(*) FROM s WHERE dec = 'FP' AND map <> '') UNION ALL SELECT 5, (SELECT count(*) FROM g WHERE st = 'FOUND' AND m IS NULL)
UNION ALL SELECT 6, (SELECT count(*) FROM (SELECT review_id, map FROM s WHERE map <> '' AND dec <> 'DUPLICATE' GROUP BY ALL HAVING count(DISTINCT prediction_id) > 1) y) UNION ALL SELECT 7, (SELECT count_if(dec NOT IN {DECISIONS}) + count_if(sent NOT IN {JUDGEMENTS}) FROM s) + (SELECT count_if(st NOT IN {STATUSES}) FROM g) UNION ALL SELECT 8, (SELECT count(*) FROM v WHERE review_id NOT IN (SELECT id FROM reviews WHERE id IS NOT NULL)))
SELECT rule_id, violations, violations = 0 AS passed FROM c""")

# --- profiles
_add("d35_source_index", lambda s, d: table(s, d, "reviews").groupBy(F.md5(F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("category", F.lit("")))).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("full_text")), 4).alias("mean_length"), F.max(F.struct("ingested_at", "source"))["source"].alias("last_name"), F.round(F.avg("rating"), 6).alias("mean_rating")),
     "SELECT md5(concat_ws('|', coalesce(source, ''), coalesce(category, ''))) AS key, count(*) AS n, round(avg(length(full_text)), 4) AS mean_length, arg_max(source, ingested_at) AS last_name, round(avg(rating), 6) AS mean_rating FROM reviews GROUP BY 1")
_add("d43_cluster_labels", lambda s, d: table(s, d, "clusters").groupBy("nm_id").agg(F.count(F.lit(1)).alias("n"), F.count("matched_to_gold_aspect").alias("n_matched"), F.count(F.when(F.col("is_novel"), 1)).alias("n_novel"), F.round(F.count(F.when(F.col("is_novel") | F.col("matched_to_gold_aspect").isNotNull(), 1)) / F.count(F.lit(1)), 6).alias("valid_rate")),
     "SELECT nm_id, count(*) AS n, count(matched_to_gold_aspect) AS n_matched, count_if(is_novel) AS n_novel, round(count_if(is_novel OR matched_to_gold_aspect IS NOT NULL) / count(*), 6) AS valid_rate FROM clusters GROUP BY nm_id")
_add("d44_residual_quality", lambda s, d: table(s, d, "candidates").select("candidate_id", "category_id", F.lower("text_lemmatized").alias("term")).distinct().join(table(s, d, "clusters").select(F.lower("medoid_phrase").alias("term"), F.lit(1).alias("known")).dropna().distinct(), "term", "left").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("known").isNull(), 1)).alias("n_residual"), F.count(F.when(F.col("known").isNull() & (F.size(F.split("term", " ")) > 1), 1)).alias("n_phrases")),
     "SELECT category_id, count(*) AS n, count_if(k.t IS NULL) AS n_residual, count_if(k.t IS NULL AND len(string_split(c.term, ' ')) > 1) AS n_phrases FROM (SELECT DISTINCT candidate_id, category_id, lower(text_lemmatized) AS term FROM candidates) c LEFT JOIN (SELECT DISTINCT lower(medoid_phrase) AS t FROM clusters) k ON k.t = c.term GROUP BY category_id")
_add("d22_vector_rates", lambda s, d: pairs(s, d).select(F.col("gold").alias("g"), R.clip(F.col("pred")).alias("p")).withColumn("gd", R.gold_direction(F.col("g"))).withColumn("pd", R.predicted_direction(F.col("p"))).agg(
    F.count(F.when(F.col("gd") != "neutral", 1)).alias("n_polar"), *(F.round(_ratio(F.count(F.when(c, 1)), F.count(F.when(b, 1))), 6).alias(k) for k, c, b in (
        ("collapse_rate", (F.col("gd") != "neutral") & (F.col("pd") == "neutral"), F.col("gd") != "neutral"), ("flip_rate", (F.col("gd") != "neutral") & (F.col("pd") != "neutral") & (F.col("gd") != F.col("pd")), F.col("gd") != "neutral"), ("same_direction_rate", (F.col("gd") != "neutral") & (F.col("gd") == F.col("pd")), F.col("gd") != "neutral"))),
    F.round(F.avg(F.when((F.col("gd") != "neutral") & (F.col("gd") == F.col("pd")), F.abs(F.col("p") - F.col("g")))), 6).alias("mean_underestimate")),
     PAIRS_SQL + ", x AS (SELECT gold AS g, least(5.0, greatest(1.0, pred)) AS p FROM pairs), y AS (SELECT g, p, CASE WHEN g <= 2 THEN -1 WHEN g >= 4 THEN 1 ELSE 0 END AS a, CASE WHEN p < 2.75 THEN -1 WHEN p <= 3.25 THEN 0 ELSE 1 END AS b FROM x) SELECT count_if(a <> 0) AS n_polar, round(count_if(a <> 0 AND b = 0) / nullif(count_if(a <> 0), 0), 6) AS collapse_rate, round(count_if(a * b < 0) / nullif(count_if(a <> 0), 0), 6) AS flip_rate, round(count_if(a * b > 0) / nullif(count_if(a <> 0), 0), 6) AS same_direction_rate, round(avg(CASE WHEN a * b > 0 THEN abs(p - g) END), 6) AS mean_underestimate FROM y")
_add("i14_uniqueness", lambda s, d: table(s, d, "reviews").filter("full_text IS NOT NULL").select("id", "nm_id", F.md5("full_text").alias("k")).distinct().transform(lambda r: r.groupBy("nm_id", "k").agg(F.count(F.lit(1)).alias("copies"))).groupBy("copies").agg(F.sum("copies").alias("n_reviews"), F.first(F.round(R.uniqueness(F.when(F.col("copies") > 1, 1.0).otherwise(0.0), F.col("copies")), 6)).alias("weight")),
     "WITH c AS (SELECT count(*) AS copies FROM (SELECT DISTINCT id, nm_id, md5(full_text) AS k FROM reviews WHERE full_text IS NOT NULL) x GROUP BY nm_id, k) SELECT copies, CAST(sum(copies) AS BIGINT) AS n_reviews, round(any_value(CASE WHEN copies > 1 THEN 1e-2 ELSE 1e0 END), 6) AS weight FROM c GROUP BY copies")
