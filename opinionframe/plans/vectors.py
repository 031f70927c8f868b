"""Anchor matching, routing, cluster quality, cached scoring and label rows, each with SQL written apart from the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionframe.functions import text as X
from opinionframe.functions.vectors import dot, norm, unit
from opinionframe.operators.scoring_cache import model_signature, pair_key, score_pairs
from opinionframe.operators.similarity import anchor_scores, best_two, centroids, cluster_quality, medoids, route, softmax_ranks
from opinionframe.operators.upsert import insert_or_ignore
from opinionframe.operators.windows import head_by
from opinionframe.plans.base import PAIRS_SQL, counted, pairs
from opinionframe.session import table

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, fn, sql: str | None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = counted(sql)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return anchor_scores(e.select("vec_id", "label", "embedding"), "embedding", centroids(e, "label", "embedding"))


_V = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
p AS (SELECT label, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM u), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i), c AS (SELECT label AS anchor, list(x ORDER BY i) AS w0 FROM m GROUP BY label), k AS (SELECT anchor, list_transform(w0, lambda x: x / sqrt(list_dot_product(w0, w0))) AS w FROM c),
s AS (SELECT vec_id, label, anchor, round(list_dot_product(u, w), 9) AS s FROM u CROSS JOIN k)
"""
_add("k3_medoids", lambda s, d: medoids(table(s, d, "embeddings"), "label", "vec_id", "embedding").withColumn("mean_s", F.round("mean_s", 6)), _V + ", a AS (SELECT x.label, x.vec_id, round(avg(list_dot_product(x.u, y.u)), 9) AS m FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, vec_id) AS q FROM a) SELECT label, vec_id, round(m, 6) AS mean_s FROM r WHERE q = 1")
_add("k4_top_spans", lambda s, d: head_by(_scores(s, d).filter("anchor = label AND s >= 0.2"), ["label"], [F.desc("s"), F.asc("vec_id")], 7).select("label", "vec_id", F.round("s", 6).alias("score")), _V + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS q FROM s WHERE anchor = label AND s >= 0.2) SELECT label, vec_id, round(s, 6) AS score FROM r WHERE q <= 7")
_add("k6_margin_gate", lambda s, d: _scores(s, d).groupBy("vec_id", "label").agg(F.max(F.when(F.col("anchor") == F.col("label"), F.col("s"))).alias("own"), F.coalesce(F.max(F.when(F.col("anchor") != F.col("label"), F.col("s"))), F.lit(-1.0)).alias("other")).filter("own >= 0.1 AND round(own - other, 9) >= 0.03").select("vec_id", "label", F.round("own", 6).alias("score"), F.round(F.col("own") - F.col("other"), 6).alias("margin")),
     _V + ", o AS (SELECT vec_id, label, s FROM s WHERE anchor = label), b AS (SELECT vec_id, max(s) AS s FROM s WHERE anchor <> label GROUP BY vec_id) SELECT o.vec_id, o.label, round(o.s, 6) AS score, round(o.s - coalesce(b.s, -1), 6) AS margin FROM o LEFT JOIN b USING (vec_id) WHERE o.s >= 0.1 AND round(o.s - coalesce(b.s, -1), 9) >= 0.03")
_add("k7_softmax_match", lambda s, d: softmax_ranks(_scores(s, d), ["vec_id"]).filter("rank <= 2").groupBy("vec_id").agg(*(F.max(F.when(F.col("rank") == r, F.col("anchor"))).alias(f"top{r}") for r in (1, 2)), *(F.round(F.max(F.when(F.col("rank") == r, F.col("p"))), 6).alias(f"p{r}") for r in (1, 2))).withColumn("matched", F.when(F.col("p1") > 0.15, F.col("top1"))),
     _V + ", q AS (SELECT vec_id, anchor, s, exp(s / 0.1) / sum(exp(s / 0.1)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, anchor) AS r FROM s) SELECT vec_id, max(CASE WHEN r = 1 THEN anchor END) AS top1, max(CASE WHEN r = 2 THEN anchor END) AS top2, round(max(CASE WHEN r = 1 THEN p END), 6) AS p1, round(max(CASE WHEN r = 2 THEN p END), 6) AS p2, CASE WHEN round(max(CASE WHEN r = 1 THEN p END), 6) > 0.15 THEN max(CASE WHEN r = 1 THEN anchor END) END AS matched FROM q GROUP BY vec_id")


def k_routing(spark: SparkSession, d: str, domain_first: bool = False) -> DataFrame:
    """Items routed between two layers of anchors: the lower five labels are the general layer, the others the domain's."""
    s = _scores(spark, d)
    g, m = best_two(s.filter("anchor < 5"), ["vec_id"]), best_two(s.filter("anchor >= 5"), ["vec_id"])
    g, m = (df.select("vec_id", *(F.col(c).alias(f"{p}_{c}") for c in ("best", "s1", "s2"))) for df, p in ((g, "g"), (m, "d")))
    x = g.join(m, "vec_id")
    r = route(F.col("g_s1"), F.round("g_s2", 9), F.col("d_s1"), F.round("d_s2", 9), F.greatest("g_s1", "d_s1") < 0.05, 0.25, 0.03, 0.25, 0.03, 0.2, 0.05, domain_first)
    return x.withColumn("route", r).select("vec_id", "route", F.when(F.col("route") == "general", F.col("g_best")).when(F.col("route") == "domain", F.col("d_best")).alias("anchor"))


_ROUTE = _V + """, r AS (SELECT vec_id, anchor < 5 AS g, anchor, s, row_number() OVER (PARTITION BY vec_id, anchor < 5 ORDER BY s DESC, anchor) AS q FROM s),
x AS (SELECT vec_id, max(CASE WHEN g AND q = 1 THEN s END) AS a, max(CASE WHEN g AND q = 2 THEN s END) AS a2, max(CASE WHEN g AND q = 1 THEN anchor END) AS ga, max(CASE WHEN NOT g AND q = 1 THEN s END) AS b, max(CASE WHEN NOT g AND q = 2 THEN s END) AS b2, max(CASE WHEN NOT g AND q = 1 THEN anchor END) AS da FROM r GROUP BY vec_id),
y AS (SELECT *, a >= 0.25 AND a - a2 >= 0.03 AS okg, b >= 0.25 AND b - b2 >= 0.03 AS okd, a >= 0.2 AND b >= 0.2 AND abs(a - b) <= 0.05 AS cf FROM x),
z AS (SELECT vec_id, ga, da, CASE WHEN greatest(a, b) < 0.05 THEN 'noise' {0} WHEN okg AND NOT cf THEN 'general' WHEN okd AND NOT cf THEN 'domain' WHEN cf THEN 'overlap' ELSE 'residual' END AS route FROM y) SELECT vec_id, route, CASE route WHEN 'general' THEN ga WHEN 'domain' THEN da END AS anchor FROM z"""
_add("k8_routing", k_routing, _ROUTE.replace("{0}", ""))
_add("k8_routing_domain_first", lambda s, d: k_routing(s, d, True), _ROUTE.replace("{0}", "WHEN cf AND okd THEN 'domain'"))
_add("k14_cluster_quality", lambda s, d: cluster_quality(table(s, d, "embeddings"), "label", "vec_id", "embedding"), _V + """, d AS (SELECT x.vec_id, x.label, y.label AS other, avg(1 - list_dot_product(x.u, y.u)) AS a FROM u x JOIN u y ON x.vec_id <> y.vec_id GROUP BY ALL),
i AS (SELECT label, vec_id, max(CASE WHEN other = label THEN a END) AS a, min(CASE WHEN other <> label THEN a END) AS b FROM d GROUP BY ALL), q AS (SELECT label, avg(1 - a) AS coh FROM i GROUP BY label)
SELECT (SELECT count(*) FROM k) AS n_clusters, (SELECT round(avg(coh), 6) FROM q) AS cohesion, (SELECT round(avg(list_dot_product(x.w, y.w)), 6) FROM k x JOIN k y ON x.anchor < y.anchor) AS separation, (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM i) AS silhouette""")


def k_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per threshold, the share of gold centroids (odd members of a label) some cluster (even members) comes near to."""
    e = table(spark, d, "embeddings")
    s = anchor_scores(e.filter("vec_id % 2 = 0").select("vec_id", "label", "embedding"), "embedding", centroids(e.filter("vec_id % 2 = 1"), "label", "embedding"))
    best = s.groupBy("anchor").agg(F.max("s").alias("s"))
    taus = F.explode(F.array(*map(F.lit, (0.4, 0.45, 0.5, 0.6, 0.65, 0.7)))).alias("tau")
    return best.select("s", taus).groupBy("tau").agg(F.count(F.lit(1)).alias("n_gold"), F.round(F.avg((F.col("s") >= F.col("tau")).cast("double")), 6).alias("coverage"))


_add("k15_coverage", k_coverage, "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e), m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM u WHERE vec_id % 2 = 1) p GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS w FROM m GROUP BY label), b AS (SELECT c.label, max(round(list_dot_product(u.u, c.w) / sqrt(list_dot_product(c.w, c.w)), 9)) AS s FROM u CROSS JOIN c WHERE u.vec_id % 2 = 0 GROUP BY c.label), t AS (SELECT CAST(unnest([0.4, 0.45, 0.5, 0.6, 0.65, 0.7]) AS DOUBLE) AS tau) SELECT tau, count(*) AS n_gold, round(avg(CASE WHEN s >= tau THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM b CROSS JOIN t GROUP BY tau")


def k_purity(spark: SparkSession, d: str, least: float = 0.5) -> DataFrame:
    """Per system aspect as a cluster: its dominant gold aspect, the share it holds, and whether that makes it clean."""
    c = table(spark, d, "system_decisions").select("prediction_id", "system_aspect", F.lower(F.trim("mapped_gold_aspect")).alias("g")).distinct().filter("system_aspect IS NOT NULL")
    n = c.groupBy("system_aspect").agg(F.count(F.lit(1)).alias("size"))
    best = c.filter("g IS NOT NULL AND g <> ''").groupBy("system_aspect", "g").agg(F.count(F.lit(1)).alias("k")).groupBy("system_aspect").agg(F.min(F.struct((-F.col("k")).alias("k"), "g")).alias("x"))
    p = F.round(F.coalesce(-F.col("x.k"), F.lit(0)) / F.col("size"), 6)
    return n.join(best, "system_aspect", "left").select("system_aspect", "size", F.col("x.g").alias("dominant"), p.alias("purity"), (p >= least).alias("clean"))


_add("k16_purity", k_purity, "WITH c AS (SELECT DISTINCT prediction_id, system_aspect, lower(trim(mapped_gold_aspect)) AS g FROM system_decisions WHERE system_aspect IS NOT NULL), n AS (SELECT system_aspect, count(*) AS size FROM c GROUP BY 1), k AS (SELECT system_aspect, g, count(*) AS k, row_number() OVER (PARTITION BY system_aspect ORDER BY count(*) DESC, g) AS q FROM c WHERE g IS NOT NULL AND g <> '' GROUP BY system_aspect, g) SELECT n.system_aspect, size, k.g AS dominant, round(coalesce(k.k, 0) / size, 6) AS purity, round(coalesce(k.k, 0) / size, 6) >= 0.5 AS clean FROM n LEFT JOIN k ON k.system_aspect = n.system_aspect AND q = 1")


def k_lopo_grid(spark: SparkSession, d: str) -> DataFrame:
    """For each product, the best of 101 evenly spaced thresholds for all others, by F1, then the lowest; from sums per
    product and threshold taken off the totals."""
    t = spark.range(101).select((F.col("id") / 100).alias("tau"))
    x = pairs(spark, d).filter("pe IS NOT NULL AND nm_id IS NOT NULL").select("nm_id", "pe", (F.col("gold") >= 4).cast("int").alias("y"))
    hit = F.col("pe") >= F.col("tau")
    s = x.crossJoin(F.broadcast(t)).groupBy("nm_id", "tau").agg(F.sum((hit & (F.col("y") == 1)).cast("int")).alias("tp"), F.sum((hit & (F.col("y") == 0)).cast("int")).alias("fp"), F.sum("y").alias("pos"))  # 101 rows
    a = s.groupBy("tau").agg(*(F.sum(c).alias(f"t_{c}") for c in ("tp", "fp", "pos")))
    z = s.join(F.broadcast(a), "tau")  # 101 rows
    tp, fp, pos = (F.col(f"t_{c}") - F.col(c) for c in ("tp", "fp", "pos"))
    f1 = F.round(2.0 * tp / F.greatest(tp + fp + pos, F.lit(1)), 9)
    return z.groupBy("nm_id").agg(F.min(F.struct((-f1).alias("f"), "tau")).alias("x")).select("nm_id", F.col("x.tau").alias("tau"), F.round(-F.col("x.f"), 6).alias("f1"))


_add("k20_lopo_grid", k_lopo_grid, PAIRS_SQL + ", t AS (SELECT unnest(range(101)) / 100 AS tau), s AS (SELECT nm_id, tau, count_if(pe >= tau AND gold >= 4) AS tp, count_if(pe >= tau AND gold < 4) AS fp, count_if(gold >= 4) AS pos FROM pairs CROSS JOIN t WHERE pe IS NOT NULL AND nm_id IS NOT NULL GROUP BY ALL), f AS (SELECT s.nm_id, s.tau, round(2 * (sum(tp) OVER w - tp) / greatest(sum(tp) OVER w - tp + sum(fp) OVER w - fp + sum(pos) OVER w - pos, 1), 9) AS f1 FROM s WINDOW w AS (PARTITION BY tau)), r AS (SELECT *, row_number() OVER (PARTITION BY nm_id ORDER BY f1 DESC, tau) AS q FROM f) SELECT nm_id, tau, round(f1, 6) AS f1 FROM r WHERE q = 1")
_add("k25_medoid_labels", lambda s, d: best_two(anchor_scores(medoids(table(s, d, "embeddings"), "label", "vec_id", "embedding").select("vec_id", F.col("label").alias("cluster")).join(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id"), "embedding", centroids(table(s, d, "embeddings"), "label", "embedding")), ["cluster", "vec_id"]).select("cluster", "vec_id", F.col("best").alias("named_by"), F.round("s1", 6).alias("score")),
     _V + ", a AS (SELECT x.label, x.vec_id, round(avg(list_dot_product(x.u, y.u)), 9) AS m FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, vec_id) AS q FROM a), b AS (SELECT s.*, row_number() OVER (PARTITION BY s.vec_id ORDER BY s DESC, anchor) AS q FROM s JOIN r ON r.vec_id = s.vec_id AND r.q = 1) SELECT label AS cluster, vec_id, anchor AS named_by, round(s, 6) AS score FROM b WHERE q = 1")
_add("k26_multi_label_pairs", lambda s, d: head_by(_scores(s, d).filter("s >= 0.15"), ["vec_id"], [F.desc("s"), F.asc("anchor")], 3).select("vec_id", "anchor", F.round("s", 6).alias("weight")), _V + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, anchor) AS q FROM s WHERE s >= 0.15) SELECT vec_id, anchor, round(s, 6) AS weight FROM r WHERE q <= 3")
_add("c11_aligned_centroids", lambda s, d: anchor_scores(centroids(table(s, d, "embeddings"), "label", "embedding", "label"), "w", centroids(table(s, d, "embeddings"), "label", "embedding")).filter("label < anchor AND s >= 0.0").select("label", "anchor", F.round("s", 6).alias("score")), _V + "SELECT x.anchor AS label, y.anchor, round(round(list_dot_product(x.w, y.w), 9), 6) AS score FROM k x JOIN k y ON x.anchor < y.anchor WHERE round(list_dot_product(x.w, y.w), 9) >= 0.0")
_add("d41_span_totals", lambda s, d: centroids(table(s, d, "embeddings"), "label", "embedding", "label").join(_scores(s, d).filter("anchor = label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s"), 5).alias("score_sum")), "label").select("label", "n", "score_sum", F.round(F.element_at("w", 1), 6).alias("first_axis")), _V + "SELECT s.label, count(*) AS n, round(sum(s), 5) AS score_sum, round(any_value(k.w[1]), 6) AS first_axis FROM s JOIN k ON k.anchor = s.label WHERE s.anchor = s.label GROUP BY s.label")
_add("i17_contrastive_scores", lambda s, d: softmax_ranks(_scores(s, d), ["vec_id"]).groupBy("vec_id", "label").agg(F.max(F.when(F.col("anchor") == F.col("label"), F.col("rank"))).cast("bigint").alias("own_rank"), F.round((F.max(F.when(F.col("anchor") == F.col("label"), F.col("s"))) - F.max(F.when(F.col("anchor") != F.col("label"), F.col("s")))) / 0.1, 5).alias("contrast")),
     _V + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, anchor) AS q FROM s) SELECT vec_id, label, CAST(max(CASE WHEN anchor = label THEN q END) AS BIGINT) AS own_rank, round((max(CASE WHEN anchor = label THEN s END) - max(CASE WHEN anchor <> label THEN s END)) / 0.1, 5) AS contrast FROM r GROUP BY vec_id, label")
_add("i18_margin_thresholds", lambda s, d: best_two(_scores(s, d), ["vec_id"]).withColumn("gap", F.col("s1") - F.col("s2")).agg(F.round(F.least(F.lit(0.10), F.greatest(F.lit(0.03), F.percentile("gap", 0.25))), 3).alias("margin"), F.round(F.least(F.lit(0.08), F.greatest(F.lit(0.03), F.percentile("gap", 0.25))), 3).alias("band")),
     _V + ", r AS (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, anchor) AS q FROM s), g AS (SELECT vec_id, max(CASE WHEN q = 1 THEN s END) - max(CASE WHEN q = 2 THEN s END) AS gap FROM r GROUP BY vec_id) SELECT round(least(0.10, greatest(0.03, quantile_cont(gap, 0.25))), 3) AS margin, round(least(0.08, greatest(0.03, quantile_cont(gap, 0.25))), 3) AS band FROM g")
_add("i19_score_variants", lambda s, d: table(s, d, "nli_predictions").select("prediction_id", F.round(F.col("p_entailment") - 0.5 * F.col("p_neutral"), 6).alias("less_neutral"), F.round(F.col("p_entailment") - F.col("p_contradiction"), 6).alias("less_contradiction")).distinct(), "SELECT DISTINCT prediction_id, round(p_entailment - 0.5 * p_neutral, 6) AS less_neutral, round(p_entailment - p_contradiction, 6) AS less_contradiction FROM nli_predictions")


def k_concentration(spark: SparkSession, d: str) -> DataFrame:
    """The share of a cluster's phrase weights its first three hold, and its five heaviest phrases."""
    w = F.transform(F.coalesce("top_phrases", F.array().cast("array<struct<phrase:string,weight:int>>")), lambda p: F.greatest(F.lit(0), F.coalesce(p["weight"], F.lit(0))))
    c = table(spark, d, "clusters").select("cluster_id", "top_phrases", w.alias("w"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)
    heavy = F.slice(F.array_sort(F.transform(F.filter("top_phrases", lambda p: p["phrase"].isNotNull()), lambda p: F.struct((-F.coalesce(p["weight"], F.lit(0))).alias("n"), p["phrase"].alias("p")))), 1, 5)
    return c.select("cluster_id", F.size("w").cast("bigint").alias("n_phrases"), total(F.col("w")).alias("weight"), F.round(F.when(total(F.col("w")) > 0, total(F.slice("w", 1, 3)) / total(F.col("w"))).otherwise(0.0), 6).alias("concentration"), F.coalesce(F.array_join(F.transform(heavy, lambda x: x["p"]), "|"), F.lit("")).alias("top"))


_add("d40_cluster_summary", k_concentration, "WITH c AS (SELECT cluster_id, coalesce(top_phrases, []) AS t FROM clusters), w AS (SELECT cluster_id, t, list_transform(t, lambda p: greatest(0, coalesce(p.weight, 0))) AS w FROM c) SELECT cluster_id, len(w) AS n_phrases, CAST(coalesce(list_sum(w), 0) AS BIGINT) AS weight, round(CASE WHEN coalesce(list_sum(w), 0) > 0 THEN list_sum(w[1:3]) / list_sum(w) ELSE 0 END, 6) AS concentration, array_to_string(list_transform(list_sort(list_transform(list_filter(t, lambda p: p.phrase IS NOT NULL), lambda p: {'n': -coalesce(p.weight, 0), 'p': p.phrase}))[1:5], lambda x: x.p), '|') AS top FROM w")
_add("i21_cluster_verdicts", lambda s, d: table(s, d, "clusters").select("cluster_id", F.when(F.col("cohesion") >= 0.7, "keep").when(F.col("cohesion") >= 0.6, "review").when(F.col("cohesion").isNotNull(), "drop").otherwise("unknown").alias("verdict")), "SELECT cluster_id, CASE WHEN cohesion IS NULL THEN 'unknown' WHEN cohesion < 0.6 THEN 'drop' WHEN cohesion < 0.7 THEN 'review' ELSE 'keep' END AS verdict FROM clusters")
_add("i22_label_scores", lambda s, d: table(s, d, "gold_decisions").select("review_id", "gold_aspect", F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(gold_rating AS int)"), F.lit(3)))).alias("score")).distinct(), "SELECT DISTINCT review_id, gold_aspect, least(5, greatest(1, coalesce(TRY_CAST(trunc(gold_rating) AS INTEGER), 3))) AS score FROM gold_decisions")


def k_cached(spark: SparkSession, d: str) -> DataFrame:
    """Hits and scores when the pairs of the first half of the predictions are cached already. The provider is a stand-in."""
    n = table(spark, d, "nli_predictions").select("prediction_id", F.col("premise_text").alias("premise"), F.col("hypothesis_text").alias("hypothesis")).distinct()
    provider = lambda p, h: F.pmod(F.length(p) * 31 + F.length(h), F.lit(100)) / 100.0
    sig = model_signature(model="stand-in", temperature=0.7)
    old = n.filter("prediction_id < 'n' AND premise IS NOT NULL AND hypothesis IS NOT NULL").select(pair_key(sig, F.col("premise"), F.col("hypothesis")).alias("pair"), provider(F.col("premise"), F.col("hypothesis")).alias("score"))
    return score_pairs(n, old, provider, sig)[0].select("prediction_id", "hit", F.round("score", 4).alias("score")).distinct()


_add("k18_cached_scores", k_cached, "WITH n AS (SELECT DISTINCT prediction_id, premise_text AS p, hypothesis_text AS h FROM nli_predictions), o AS (SELECT DISTINCT p, h FROM n WHERE prediction_id < 'n') SELECT DISTINCT n.prediction_id, CASE WHEN n.p IS NOT NULL AND n.h IS NOT NULL THEN o.p IS NOT NULL END AS hit, round(((length(n.p) * 31 + length(n.h)) % 100) / 100, 4) AS score FROM n LEFT JOIN o ON o.p = n.p AND o.h = n.h")


def l_cached_texts(spark: SparkSession, d: str) -> DataFrame:
    """Premises put into a table that holds those of earlier rows: present ones are ignored, new ones appended once."""
    n = table(spark, d, "nli_predictions").filter("premise_text IS NOT NULL").select(F.md5("premise_text").alias("text_key"), "created_at")
    at = F.lit("2025-06-01").cast("timestamp")
    old, new = (df.select("text_key", F.lit(k).alias("batch")).distinct() for k, df in (("old", n.filter(F.col("created_at") < at)), ("new", n.filter(F.coalesce(F.col("created_at") >= at, F.lit(True))))))
    return insert_or_ignore(old, new, ["text_key"]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


_add("l2_insert_or_ignore", l_cached_texts, "WITH n AS (SELECT md5(premise_text) AS k, min(CASE WHEN created_at < TIMESTAMP '2025-06-01' THEN 0 ELSE 1 END) AS b FROM nli_predictions WHERE premise_text IS NOT NULL GROUP BY 1) SELECT CASE b WHEN 0 THEN 'old' ELSE 'new' END AS batch, count(*) AS n FROM n GROUP BY 1")
_add("l4_commit_batch", lambda s, d: table(s, d, "system_decisions").filter("deleted_at IS NULL").select("prediction_id", "review_id", "manual_decision").distinct().groupBy("review_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.trim("manual_decision"), F.lit(""))).alias("n_decided")).withColumn("committed", (F.col("n") == F.col("n_decided")).cast("int")), "SELECT review_id, count(*) AS n, count(nullif(trim(manual_decision), '')) AS n_decided, CASE WHEN count(*) = count(nullif(trim(manual_decision), '')) THEN 1 ELSE 0 END AS committed FROM (SELECT DISTINCT prediction_id, review_id, manual_decision FROM system_decisions WHERE deleted_at IS NULL) x GROUP BY review_id")
# --- scans with paging, generated ids and aligned labels
_add("a3_label_keys", lambda s, d: table(s, d, "reviews").filter("true_labels IS NOT NULL").select("id", F.explode(F.map_keys(F.coalesce(F.from_json("true_labels", "map<string,double>", {"allowSingleQuotes": "false"}), X.label_map(F.col("true_labels"))))).alias("label")).distinct(), "SELECT DISTINCT id, regexp_extract(e, '^''([^'']*)''', 1) AS label FROM (SELECT id, unnest(regexp_extract_all(true_labels, '''[^'']*'': *[0-9.]+')) AS e FROM reviews WHERE true_labels IS NOT NULL) x")
_add("a5_page_of_reviews", lambda s, d: table(s, d, "reviews").filter("nm_id = 0 AND coalesce(nullif(trim(full_text), ''), nullif(trim(pros), ''), nullif(trim(cons), '')) IS NOT NULL").select("id", "created_date").distinct().orderBy(F.asc_nulls_first("created_date"), "id").offset(5).limit(20), "SELECT DISTINCT id, created_date FROM reviews WHERE nm_id = 0 AND coalesce(nullif(trim(full_text), ''), nullif(trim(pros), ''), nullif(trim(cons), '')) IS NOT NULL ORDER BY created_date NULLS FIRST, id LIMIT 20 OFFSET 5")
_add("a6_projected_scan", lambda s, d: table(s, d, "reviews").select("source", "rating").groupBy("source").agg(F.count("rating").alias("n_ratings")), "SELECT source, count(rating) AS n_ratings FROM reviews GROUP BY source")
_add("a7_venue_ids", lambda s, d: head_by(table(s, d, "reviews").filter("category = 'hospitality' AND trim(full_text) <> ''").select("id", "nm_id").distinct(), ["nm_id"], [F.col("id")], 100).select("id", F.format_string("ym_%d_%04d", "nm_id", "rank").alias("venue_id")), "WITH r AS (SELECT id, nm_id, row_number() OVER (PARTITION BY nm_id ORDER BY id) AS k FROM (SELECT DISTINCT id, nm_id FROM reviews WHERE category = 'hospitality' AND trim(full_text) <> '') x) SELECT id, printf('ym_%d_%04d', nm_id, k) AS venue_id FROM r WHERE k <= 100")
_add("a20_aligned_labels", lambda s, d: table(s, d, "product_aggregates").select("run_id", "nm_id", "aspect_name", "aspect_source", F.posexplode("contributing_review_ids").alias("pos", "review_id")).distinct().groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("review_id").alias("n_reviews")).withColumn("pos", F.col("pos").cast("bigint")), "SELECT CAST(i - 1 AS BIGINT) AS pos, count(*) AS n, count(DISTINCT review_id) AS n_reviews FROM (SELECT DISTINCT run_id, nm_id, aspect_name, aspect_source, generate_subscripts(contributing_review_ids, 1) AS i, unnest(contributing_review_ids) AS review_id FROM product_aggregates) x GROUP BY 1")
_add("j4_sorted_json", lambda s, d: table(s, d, "reviews").filter("true_labels IS NOT NULL").select("id", F.array_join(F.transform(F.array_sort(F.map_entries(X.label_map(F.col("true_labels")))), lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 1).cast("string"))), ";").alias("labels")).distinct(), None)
