"""Scan, filter, join, window, set, text, vector and upsert plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionframe.functions import text as X
from opinionframe.functions import vectors as V
from opinionframe.functions.rating import length_trust
from opinionframe.operators.heavy_keys import skew_join
from opinionframe.operators.joins import word_matches
from opinionframe.operators.ranks import value_ranks
from opinionframe.operators.upsert import upsert_latest
from opinionframe.operators.windows import first_by, head_by, share_of_total
from opinionframe.plans.base import PAIRS_SQL, counted, pairs, sql_plan
from opinionframe.session import table

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, fn, sql: str | None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = counted(sql)


def _same(name: str, sql: str) -> None:
    _add(name, sql_plan(sql), sql)


# --- scans and filters
_add("a1_review_scan", lambda s, d: table(s, d, "reviews").filter("full_text IS NOT NULL AND trim(full_text) <> ''").select("id", "nm_id", "rating", "full_text", "source", "category").distinct(),
     "SELECT DISTINCT id, nm_id, rating, full_text, source, category FROM reviews WHERE full_text IS NOT NULL AND trim(full_text) <> ''")
_add("a2_label_rows", lambda s, d: table(s, d, "reviews").filter("true_labels IS NOT NULL").select("id", F.explode(X.label_map(F.col("true_labels"))).alias("label", "gold")).distinct(), r"""
WITH r AS (SELECT DISTINCT id, true_labels AS t FROM reviews WHERE true_labels IS NOT NULL), x AS (SELECT id, unnest(regexp_extract_all(t, '''[^'']*'': *[0-9.]+')) AS e FROM r)
SELECT DISTINCT id, regexp_extract(e, '^''([^'']*)''', 1) AS label, CAST(regexp_extract(e, ': *([0-9.]+)$', 1) AS DOUBLE) AS gold FROM x""")
_add("a4_first_source_wins", lambda s, d: first_by(table(s, d, "reviews").filter("source IS NOT NULL").select("id", "source", "full_text").distinct(), ["id"], [F.col("source"), F.col("full_text")]),
     "WITH r AS (SELECT id, source, full_text, row_number() OVER (PARTITION BY id ORDER BY source, full_text) AS k FROM (SELECT DISTINCT id, source, full_text FROM reviews WHERE source IS NOT NULL) y) SELECT id, source, full_text FROM r WHERE k = 1")
_add("a17_product_documents", lambda s, d: table(s, d, "clusters").groupBy("nm_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "medoid_phrase"))), lambda c: F.concat_ws(":", c["cluster_id"].cast("string"), c["medoid_phrase"])), ";").alias("clusters")),
     "SELECT nm_id, count(*) AS n_clusters, string_agg(concat_ws(':', CAST(cluster_id AS VARCHAR), medoid_phrase), ';' ORDER BY cluster_id) AS clusters FROM clusters GROUP BY nm_id")
_same("a11_term_index", "SELECT DISTINCT lower(canonical_name) AS term, aspect_id FROM aspect_reference")
_add("a11_vocabulary", lambda s, d: table(s, d, "aspect_reference").select("aspect_id", "level", F.explode("domains").alias("domain"), F.size("synonyms").cast("bigint").alias("n_synonyms")),
     "SELECT aspect_id, level, unnest(domains) AS domain, len(synonyms) AS n_synonyms FROM aspect_reference")
_same("a12_duplicate_ids", "SELECT aspect_id, count(*) AS n FROM aspect_reference GROUP BY aspect_id HAVING count(*) > 1")
_same("a21_text_fallback", "SELECT DISTINCT id, coalesce(nullif(trim(full_text), ''), nullif(trim(concat_ws(' ', pros, cons)), '')) AS body FROM reviews")
_same("b1_smallest_products", "SELECT DISTINCT id, nm_id FROM reviews WHERE nm_id IN (SELECT DISTINCT nm_id FROM reviews WHERE nm_id <> 0 ORDER BY nm_id LIMIT 5)")
_same("b2_relevance_flag", "SELECT DISTINCT prediction_id, p_entailment + p_contradiction >= 0.2 AS relevant FROM nli_predictions")
_same("b3_filter_with_fallback", "WITH x AS (SELECT DISTINCT review_id, prediction_id, passed_relevance_filter AS ok FROM nli_predictions), y AS (SELECT *, max(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY review_id) AS any_ok FROM x) SELECT review_id, prediction_id FROM y WHERE ok OR any_ok = 0")
_same("b4_valid_text", "SELECT DISTINCT id FROM reviews WHERE length(trim(full_text)) > 20 AND rating BETWEEN 1 AND 5")
_same("b6_source_report", "SELECT source, count(*) AS n, count(*) / (SELECT count(*) FROM candidates) AS share FROM candidates GROUP BY source")
_add("b9_min_frequency", lambda s, d: skew_join(table(s, d, "candidates").filter("text_lemmatized IS NOT NULL").select("candidate_id", "text_lemmatized"), table(s, d, "candidates").groupBy("text_lemmatized").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"), "text_lemmatized", how="inner").select("candidate_id", "text_lemmatized"),
     "SELECT candidate_id, text_lemmatized FROM (SELECT candidate_id, text_lemmatized, count(*) OVER (PARTITION BY text_lemmatized) AS n FROM candidates WHERE text_lemmatized IS NOT NULL) x WHERE n >= 2")
_add("b10_frequent_words", lambda s, d: share_of_total(table(s, d, "candidates").filter("text NOT LIKE '% %' AND length(text) >= 3").select(F.lower("text").alias("word")), ["word"]).filter("share >= 0.005").select("word", "n"),
     "WITH c AS (SELECT lower(text) AS word FROM candidates WHERE text NOT LIKE '% %' AND length(text) >= 3) SELECT word, count(*) AS n FROM c GROUP BY word HAVING count(*) >= 0.005 * (SELECT count(*) FROM c)")
_add("b11_null_like", lambda s, d: table(s, d, "gold_decisions").groupBy(X.null_like(F.col("matched_system_prediction_id")).isNull().alias("is_null")).agg(F.count(F.lit(1)).alias("n")),
     "SELECT matched_system_prediction_id IS NULL OR upper(trim(matched_system_prediction_id)) IN ('', 'NONE', 'NULL', 'NAN', 'NA') AS is_null, count(*) AS n FROM gold_decisions GROUP BY 1")
_same("b13_availability", "SELECT count(*) AS n, count(p_entailment) AS n_entailment, count(raw_rating) AS n_raw, count(final_rating) AS n_final FROM nli_predictions")
_same("b14_repair_eligible", "SELECT DISTINCT p.prediction_id FROM nli_predictions p JOIN reviews r ON r.id = p.review_id WHERE p.raw_rating <= 2 AND r.rating >= 4")

# --- joins
_same("c1_candidates_with_reviews", "SELECT DISTINCT c.candidate_id, r.rating FROM candidates c JOIN reviews r ON r.id = c.review_id")
_same("c4_missing_decisions", "SELECT DISTINCT p.prediction_id FROM nli_predictions p WHERE NOT EXISTS (SELECT 1 FROM system_decisions s WHERE s.prediction_id = p.prediction_id)")
_same("c5_presence", "WITH a AS (SELECT DISTINCT review_id, aspect_name AS k FROM nli_predictions), b AS (SELECT DISTINCT review_id, gold_aspect AS k FROM gold_decisions) SELECT a.k IS NOT NULL AS predicted, b.k IS NOT NULL AS gold, count(*) AS n FROM a FULL OUTER JOIN b ON a.review_id = b.review_id AND a.k = b.k GROUP BY 1, 2")
_same("c6_join_status", "WITH s AS (SELECT DISTINCT prediction_id FROM system_decisions), p AS (SELECT DISTINCT prediction_id, aspect_source FROM nli_predictions) SELECT aspect_source, CASE WHEN s.prediction_id IS NULL THEN 'left_only' ELSE 'both' END AS status, count(*) AS n FROM p LEFT JOIN s ON s.prediction_id = p.prediction_id GROUP BY 1, 2")


def c_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose normal form is a term of the vocabulary fan out to its aspects; the rest come once, unmatched."""
    a = table(spark, d, "clusters").select(X.normal_form(F.col("medoid_phrase")).alias("term"), "cluster_id").distinct()
    c = table(spark, d, "candidates").select("candidate_id", X.normal_form(F.col("text")).alias("term")).distinct()
    return c.join(a, "term", "left").select("candidate_id", "cluster_id", F.col("cluster_id").isNull().alias("is_unmatched"))


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '-', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))".format
_add("c7_lexical_match", c_lexical, f"WITH a AS (SELECT DISTINCT {_NORM('medoid_phrase')} AS term, cluster_id FROM clusters), c AS (SELECT DISTINCT candidate_id, {_NORM('text')} AS term FROM candidates) SELECT candidate_id, cluster_id, cluster_id IS NULL AS is_unmatched FROM c LEFT JOIN a ON a.term = c.term")


def c_contained(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose words are a run of words of a known phrase or hold all its words as a run: each side's first word
    is joined with all words of the other, then the run is verified."""
    a = table(spark, d, "clusters").select("cluster_id", X.tokens(F.col("medoid_phrase")).alias("v")).filter("size(v) > 0").distinct()
    c = table(spark, d, "candidates").select("candidate_id", X.tokens(F.col("text")).alias("t")).filter("size(t) > 0").distinct()
    t = c.select("t").distinct()
    first = lambda x: F.get(x, F.lit(0)).alias("w")
    every = lambda x: F.explode(F.array_distinct(x)).alias("w")
    holds = lambda x, y: X.contains_term(F.array_join(x, " "), F.array_join(y, " "))
    wider = t.select("t", every("t")).join(a.select("cluster_id", "v", first("v")), "w").filter(holds("t", "v"))
    narrower = t.select("t", first("t")).join(a.select("cluster_id", "v", every("v")), "w").filter(holds("v", "t"))
    found = wider.select("t", "cluster_id").union(narrower.select("t", "cluster_id")).distinct()
    return c.join(found, "t").select("candidate_id", "cluster_id").distinct()


_TOKENS = r"array_to_string(regexp_extract_all(lower({0}), '[^\t\n\x0b\f\r\x1c-\x1f \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), ' ')".format
_add("c8_contained_terms", c_contained, f"""WITH a AS (SELECT DISTINCT cluster_id, {_TOKENS('medoid_phrase')} AS v FROM clusters), c AS (SELECT DISTINCT candidate_id, {_TOKENS('text')} AS t FROM candidates),
m AS (SELECT t, cluster_id FROM (SELECT DISTINCT t FROM c WHERE t <> '') x JOIN a ON v <> '' AND (contains(' ' || t || ' ', ' ' || v || ' ') OR contains(' ' || v || ' ', ' ' || t || ' ')))
SELECT DISTINCT candidate_id, cluster_id FROM c JOIN m USING (t)""")


def c_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's best class centroid by cosine; ties go to the lower label. The centroids are few: a row a label."""
    e = table(spark, d, "embeddings")
    c = V.mean_vectors(e, "label", "embedding").withColumnRenamed("label", "c")
    best = e.join(F.broadcast(c)).select("vec_id", "label", "c", V.cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    return best.groupBy("vec_id", "label").agg(F.min(F.struct((-F.round("s", 9)).alias("m"), F.col("c"))).alias("x")).select("vec_id", "label", F.col("x.c").alias("best_label"), F.round(-F.col("x.m"), 5).alias("score"))


_add("c10_top1_centroid", c_centroids, """
WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label AS c, i, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY label, i),
k AS (SELECT c, list(x ORDER BY i) AS v FROM m GROUP BY c),
s AS (SELECT vec_id, label, c, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings CROSS JOIN k),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, c) AS n FROM s)
SELECT vec_id, label, c AS best_label, round(s, 5) AS score FROM r WHERE n = 1""")
_same("c12_overlapping_spans", "WITH c AS (SELECT DISTINCT candidate_id, review_id, start_offset AS a, end_offset AS b, source FROM candidates WHERE start_offset >= 0) SELECT x.review_id, count(*) AS n FROM c x JOIN c y ON x.review_id = y.review_id AND x.source = 'ngram' AND y.source = 'dependency' AND x.a < y.b AND y.a < x.b GROUP BY x.review_id")
_same("c14_in_all_sources", "SELECT review_id, text_lemmatized FROM candidates WHERE text_lemmatized IS NOT NULL GROUP BY review_id, text_lemmatized HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM candidates)")
_same("c15_presence_matrix", "SELECT review_id, text_lemmatized, max(CASE WHEN source = 'ngram' THEN 1 ELSE 0 END) AS in_ngram, max(CASE WHEN source = 'dependency' THEN 1 ELSE 0 END) AS in_dependency, count(DISTINCT source) AS n_sources FROM candidates GROUP BY review_id, text_lemmatized")


def c_mapped_targets(spark: SparkSession, d: str) -> DataFrame:
    """Predictions per target of their aspect. Predictions with the same aspects are counted before they meet the targets,
    so what is joined grows with the mappings, not with predictions times targets of an aspect."""
    m = table(spark, d, "system_decisions").filter("mapped_gold_aspect IS NOT NULL").select(F.col("system_aspect").alias("aspect"), F.col("mapped_gold_aspect").alias("t")).distinct()
    p = table(spark, d, "nli_predictions").filter("aspect_name IS NOT NULL").groupBy("prediction_id").agg(F.sort_array(F.collect_set("aspect_name")).alias("aspects"))
    sets = p.groupBy("aspects").agg(F.count("prediction_id").alias("n"))
    met = sets.select("aspects", "n", F.explode("aspects").alias("aspect")).join(m, "aspect").select("aspects", "t", "n").distinct()
    return met.groupBy("t").agg(F.sum("n").alias("n"))


_add("c17_mapped_targets", c_mapped_targets, "WITH m AS (SELECT DISTINCT system_aspect, mapped_gold_aspect AS t FROM system_decisions WHERE mapped_gold_aspect IS NOT NULL) SELECT t, count(DISTINCT p.prediction_id) AS n FROM nli_predictions p JOIN m ON m.system_aspect = p.aspect_name GROUP BY t")
_add("c20_cluster_keys", lambda s, d: table(s, d, "clusters").select("nm_id", "cluster_id", F.explode(F.array_distinct(F.filter(F.array(F.lower("medoid_phrase"), F.lower("matched_to_gold_aspect")), lambda x: x.isNotNull()))).alias("key")).groupBy("nm_id", "key").agg(F.max("cluster_id").alias("cluster_id")),
     "SELECT nm_id, key, max(cluster_id) AS cluster_id FROM (SELECT nm_id, lower(medoid_phrase) AS key, cluster_id FROM clusters UNION ALL SELECT nm_id, lower(matched_to_gold_aspect), cluster_id FROM clusters) x WHERE key IS NOT NULL GROUP BY nm_id, key")
_same("c21_resolver_fallback", "WITH s AS (SELECT review_id, lower(system_aspect) AS a, aspect_source AS src, max(prediction_id) AS p FROM system_decisions GROUP BY 1, 2, 3), t AS (SELECT review_id, a, max(p) AS p FROM s GROUP BY review_id, a), g AS (SELECT DISTINCT review_id, lower(gold_aspect) AS a FROM gold_decisions) SELECT g.review_id, g.a, coalesce(s.p, t.p) AS prediction_id FROM g LEFT JOIN s ON s.review_id = g.review_id AND s.a = g.a AND s.src = 'vocab' LEFT JOIN t ON t.review_id = g.review_id AND t.a = g.a")


def c_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each error event with the user's latest purchase-like event before it, by one union and a running last value."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("prev", F.last(F.when(F.col("event_type") == "click", F.col("value")), ignorenulls=True).over(w)).filter("event_type = 'error'").select("event_id", F.col("prev").alias("last_click_value"))


_add("c23_as_of", c_asof, "WITH e AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events) SELECT event_id, p AS last_click_value FROM e WHERE event_type = 'error'")

# --- windows, sorts, sets
_add("e1_first_span", lambda s, d: first_by(table(s, d, "candidates").select("review_id", "candidate_id", "start_offset", "end_offset").distinct(), ["review_id"], [F.col("start_offset") < 0, F.col("start_offset"), -(F.col("end_offset") - F.col("start_offset")), F.col("candidate_id")]).select("review_id", "candidate_id"),
     "WITH r AS (SELECT review_id, candidate_id, row_number() OVER (PARTITION BY review_id ORDER BY start_offset < 0, start_offset, -(end_offset - start_offset), candidate_id) AS k FROM (SELECT DISTINCT review_id, candidate_id, start_offset, end_offset FROM candidates) y) SELECT review_id, candidate_id FROM r WHERE k = 1")
_same("e2_occurrence_number", "SELECT candidate_id, CAST(row_number() OVER (PARTITION BY review_id, text ORDER BY candidate_id) AS BIGINT) AS k FROM (SELECT DISTINCT candidate_id, review_id, text FROM candidates) x")
_add("e3_top7_per_product", lambda s, d: head_by(table(s, d, "product_aggregates").select("nm_id", "run_id", "aspect_name", "aspect_source", "n_reviews_contributing").distinct(), ["nm_id"], [F.desc("n_reviews_contributing"), F.asc("run_id"), F.asc("aspect_name"), F.asc("aspect_source")], 7).drop("rank"),
     "WITH r AS (SELECT *, row_number() OVER (PARTITION BY nm_id ORDER BY n_reviews_contributing DESC, run_id, aspect_name, aspect_source) AS k FROM (SELECT DISTINCT nm_id, run_id, aspect_name, aspect_source, n_reviews_contributing FROM product_aggregates) y) SELECT nm_id, run_id, aspect_name, aspect_source, n_reviews_contributing FROM r WHERE k <= 7")
_same("e4_margin", "WITH r AS (SELECT review_id, p_entailment AS s, row_number() OVER (PARTITION BY review_id ORDER BY p_entailment DESC) AS k FROM (SELECT DISTINCT prediction_id, review_id, p_entailment FROM nli_predictions WHERE p_entailment IS NOT NULL) x) SELECT review_id, max(CASE WHEN k = 1 THEN s END) AS best, round(max(CASE WHEN k = 1 THEN s END) - max(CASE WHEN k = 2 THEN s END), 6) AS margin FROM r GROUP BY review_id")
_same("e7_max_per_pair", "SELECT review_id, aspect_name, max(final_rating) AS best FROM nli_predictions GROUP BY review_id, aspect_name")
_add("e8_share_of_total", lambda s, d: share_of_total(table(s, d, "parsed_chunks"), ["dep_label"]).select("dep_label", "n", F.round("share", 6).alias("share")), "SELECT dep_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM parsed_chunks GROUP BY dep_label")
_add("e9_average_ranks", lambda s, d: skew_join(table(s, d, "embeddings").select("vec_id", "label"), value_ranks(table(s, d, "embeddings"), "label").select("label", "avg_rank"), "label", how="inner").select("vec_id", "avg_rank"), "SELECT vec_id, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0e0 AS avg_rank FROM embeddings")
_same("e11_mode_with_ties", "WITH c AS (SELECT nm_id, category, count(*) AS n FROM reviews WHERE category IS NOT NULL GROUP BY nm_id, category), r AS (SELECT nm_id, category, row_number() OVER (PARTITION BY nm_id ORDER BY n DESC, category) AS k FROM c) SELECT nm_id, category FROM r WHERE k = 1")
_same("e12_lag_ntile", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS quarter, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
_add("f1_hard_cases", lambda s, d: pairs(s, d).select("prediction_id", F.round(F.abs(F.col("pred") - F.col("gold")), 6).alias("e")).orderBy(F.desc("e"), "prediction_id").limit(30), PAIRS_SQL + "SELECT prediction_id, round(abs(pred - gold), 6) AS e FROM pairs ORDER BY e DESC, prediction_id LIMIT 30")
_same("f7_page", "SELECT DISTINCT id FROM reviews ORDER BY id LIMIT 50 OFFSET 100")
_same("f4_most_common", "SELECT text_lemmatized, count(*) AS n FROM candidates WHERE text_lemmatized IS NOT NULL GROUP BY text_lemmatized ORDER BY n DESC, text_lemmatized LIMIT 50")
_same("g1_found_missed_extra", "WITH p AS (SELECT DISTINCT review_id, aspect_name AS a FROM nli_predictions), g AS (SELECT DISTINCT review_id, gold_aspect AS a FROM gold_decisions), tp AS (SELECT review_id, a FROM p INTERSECT SELECT review_id, a FROM g), fp AS (SELECT review_id, a FROM p EXCEPT SELECT review_id, a FROM g), fn AS (SELECT review_id, a FROM g EXCEPT SELECT review_id, a FROM p) SELECT 'tp' AS kind, count(*) AS n FROM tp UNION ALL SELECT 'fp', count(*) FROM fp UNION ALL SELECT 'fn', count(*) FROM fn")
_same("g5_absent_ids", "(SELECT review_id FROM candidates UNION SELECT review_id FROM parsed_chunks UNION SELECT review_id FROM nli_predictions) EXCEPT SELECT id FROM reviews")
_same("g7_repeated_keys", "SELECT run_id, nm_id, aspect_name, aspect_source, count(*) AS n FROM product_aggregates GROUP BY run_id, nm_id, aspect_name, aspect_source HAVING count(*) > 1")

# --- text
_ID = "SELECT DISTINCT id, full_text AS t FROM reviews WHERE full_text IS NOT NULL"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").filter("full_text IS NOT NULL").select("id", F.col("full_text").alias("t")).distinct()


#: White space as Python knows it, for the engine of the SQL.
_WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACED = rf"regexp_replace(regexp_replace(replace(t, '\n', ' '), '([.,!?;:])([^{_WS}])', '\1 \2', 'g'), '([.,!?;:])([^{_WS}])', '\1 \2', 'g')"
_add("h1_clean_text", lambda s, d: _texts(s, d).select("id", X.clean_text(F.col("t")).alias("clean")),
     rf"SELECT id, regexp_replace(regexp_replace(regexp_replace({_SPACED}, '[^\p{{L}}\p{{N}}_{_WS}.,!?;:-]', ' ', 'g'), '[{_WS}]{{2,}}', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS clean FROM ({_ID}) y")
_add("h2_plain_sentences", lambda s, d: _texts(s, d).select("id", F.size(X.plain_sentences(F.col("t"))).cast("bigint").alias("n_sentences")),
     rf"SELECT id, greatest(1, len(list_filter(string_split_regex(t, '[.!?]+'), lambda x: regexp_matches(x, '[^{_WS}]')))) AS n_sentences FROM ({_ID}) y")
_add("h4_words", lambda s, d: _texts(s, d).select("id", F.size(X.words(F.col("t"))).cast("bigint").alias("n_words")),
     rf"SELECT id, len(list_filter(regexp_extract_all(t, '[^{_WS}]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}_-]'))) AS n_words FROM ({_ID}) y")
STOP_TOKENS = ("это", "для", "как", "что", "the", "and", "was", "der", "die", "das", "und")  # fixed values


def h_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs of words of every sentence, three letters or more each and no stop word, once a sentence, counted."""
    w = _texts(spark, d).select("id", F.posexplode(X.plain_sentences(F.col("t"))).alias("at", "s")).select("id", "at", F.filter(X.words(F.col("s")), lambda x: ~x.isin(*STOP_TOKENS)).alias("w"))
    return w.select(F.explode(X.phrase_candidates(F.col("w"))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


_add("h6_phrase_candidates", h_phrases, rf"""WITH s AS (SELECT id, CASE WHEN len(p) > 0 THEN p ELSE [t] END AS p FROM (SELECT id, t, list_filter(string_split_regex(t, '[.!?]+'), lambda x: regexp_matches(x, '[^{_WS}]')) AS p FROM ({_ID}) y) z),
w AS (SELECT id, i, list_filter(list_transform(regexp_extract_all(lower(p[i]), '[^{_WS}]+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}\p{{M}}_-]', '', 'g')), lambda x: x <> '' AND x NOT IN {STOP_TOKENS}) AS w FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM s) q),
g AS (SELECT DISTINCT id, i, unnest(list_concat(list_filter(w, lambda x: length(x) >= 3), list_transform(list_filter(range(1, len(w)), lambda k: length(w[k]) >= 3 AND length(w[k + 1]) >= 3), lambda k: w[k] || ' ' || w[k + 1]))) AS phrase FROM w) SELECT phrase, count(*) AS n FROM g GROUP BY phrase""")
_add("h9_normal_form", lambda s, d: table(s, d, "candidates").filter("text IS NOT NULL").select("candidate_id", X.normal_form(F.col("text")).alias("norm")).distinct(), f"SELECT DISTINCT candidate_id, {_NORM('text')} AS norm FROM candidates WHERE text IS NOT NULL")
_add("h20_contains_term", lambda s, d: table(s, d, "parsed_chunks").filter("sentence IS NOT NULL AND head_lemma IS NOT NULL").select("chunk_id", X.contains_term(F.lower("sentence"), F.col("head_lemma")).alias("holds")).distinct(), "SELECT DISTINCT chunk_id, contains(' ' || lower(sentence) || ' ', ' ' || head_lemma || ' ') AS holds FROM parsed_chunks WHERE sentence IS NOT NULL AND head_lemma IS NOT NULL")
_same("h22_composed_text", "SELECT DISTINCT id, concat_ws(' ', nullif(trim(pros), ''), nullif(trim(cons), ''), nullif(trim(full_text), '')) AS body FROM reviews")
_same("h26_hypothesis", "SELECT aspect_id, concat(canonical_name, ' — это хорошо') AS positive, concat(canonical_name, ' — это плохо') AS negative FROM aspect_reference")
_add("h0_stable_id", lambda s, d: table(s, d, "nli_predictions").select("prediction_id", X.stable_id(F.col("review_id"), F.col("aspect_name")).alias("sid")).distinct(), "SELECT DISTINCT prediction_id, substr(sha256(coalesce(review_id, 'None') || '|' || coalesce(aspect_name, 'None')), 1, 16) AS sid FROM nli_predictions")
_add("i13_length_trust", lambda s, d: _texts(s, d).select("id", F.round(length_trust(F.col("t")), 6).alias("trust")),
     rf"SELECT id, round(1 / (1 + exp(-0.8 * (len(regexp_extract_all(t, '[^{_WS}]+')) - 4))), 6) AS trust FROM ({_ID}) y")

# --- dates, arrays, vectors
_same("j1_review_age", "SELECT DISTINCT id, CAST(ingested_at AS DATE) AS day, CAST(year(created_date) AS BIGINT) AS y, CAST(month(created_date) AS BIGINT) AS m FROM reviews WHERE created_date IS NOT NULL")
_add("j2_array_profile", lambda s, d: table(s, d, "product_aggregates").select("run_id", "nm_id", "aspect_name", "aspect_source", F.size("contributing_review_ids").cast("bigint").alias("n_ids"), F.array_join(F.array_sort(F.array_distinct("contributing_review_ids")), "|").alias("ids")).distinct(), "SELECT DISTINCT run_id, nm_id, aspect_name, aspect_source, len(contributing_review_ids) AS n_ids, array_to_string(list_sort(list_distinct(contributing_review_ids)), '|') AS ids FROM product_aggregates")
_add("k2_unit_centroids", lambda s, d: V.mean_vectors(table(s, d, "embeddings").select("label", V.unit(F.col("embedding")).alias("u")), "label", "u").select("label", F.round(V.norm(F.col("centroid")), 5).alias("length")),
     "WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i) SELECT label, round(sqrt(sum(x * x)), 5) AS length FROM m GROUP BY label")
def k_uncovered(spark: SparkSession, d: str) -> DataFrame:
    """Aspects none of whose words stands in a cluster's phrase."""
    a = table(spark, d, "aspect_reference").select("aspect_id", "canonical_name")
    k = table(spark, d, "clusters").filter("medoid_phrase IS NOT NULL").select("cluster_id", "medoid_phrase")
    met = word_matches(a, k, ["aspect_id"], ["cluster_id"], F.col("canonical_name"), F.col("medoid_phrase")).select("aspect_id").distinct()
    return a.join(met, "aspect_id", "left_anti")


_add("k17_uncovered_aspects", k_uncovered, "SELECT aspect_id, canonical_name FROM aspect_reference a WHERE NOT EXISTS (SELECT 1 FROM clusters c WHERE len(list_intersect(string_split_regex(lower(c.medoid_phrase), '\\s+'), string_split_regex(lower(a.canonical_name), '\\s+'))) > 0)")
_same("d39_surface_forms", "WITH c AS (SELECT text_lemmatized AS k, text, count(*) AS n FROM candidates WHERE text_lemmatized IS NOT NULL AND text IS NOT NULL GROUP BY text_lemmatized, text), r AS (SELECT k, text, sum(n) OVER (PARTITION BY k) AS weight, row_number() OVER (PARTITION BY k ORDER BY n DESC, text) AS i FROM c) SELECT k, text AS surface, CAST(weight AS BIGINT) AS weight FROM r WHERE i = 1")

# --- upserts and checks
_add("l1_upsert_latest", lambda s, d: upsert_latest(table(s, d, "system_decisions").select("prediction_id", "manual_decision", "committed", "updated_at").distinct(), ["prediction_id"], ["updated_at", "manual_decision", "committed"]),
     "WITH r AS (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY updated_at DESC NULLS LAST, manual_decision DESC NULLS LAST, committed DESC NULLS LAST) AS k FROM (SELECT DISTINCT prediction_id, manual_decision, committed, updated_at FROM system_decisions) y) SELECT prediction_id, manual_decision, committed, updated_at FROM r WHERE k = 1")
_same("l4_live_rows", "SELECT DISTINCT prediction_id FROM system_decisions WHERE deleted_at IS NULL AND committed = 1")
_same("s1_hourly_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
