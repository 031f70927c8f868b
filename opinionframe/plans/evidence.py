"""Text evidence: sentences, windows, occurrences, negations, premises, segments and phrase filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionframe.functions import text as X
from opinionframe.operators import evidence as E
from opinionframe.operators.windows import head_by
from opinionframe.plans.base import counted
from opinionframe.session import table

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, fn, sql: str | None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = counted(sql)


_WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ID = "SELECT DISTINCT id, full_text AS t FROM reviews WHERE full_text IS NOT NULL"
def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").filter("full_text IS NOT NULL").select("id", F.col("full_text").alias("t")).distinct()


@F.pandas_udf(T.ArrayType(T.StructType().add("start_offset", T.IntegerType()).add("end_offset", T.IntegerType()).add("sentence", T.StringType())))
def _sentences(t: pd.Series) -> pd.Series:
    return t.map(lambda x: [{"start_offset": a, "end_offset": b, "sentence": x[a:b]} for a, b in E.sentence_spans(x)])


def h_sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    x = _texts(spark, d).select("id", F.posexplode(_sentences("t")).alias("seq", "s"))
    return x.select("id", F.col("seq").cast("bigint").alias("seq"), "s.sentence", (F.col("s.end_offset") - F.col("s.start_offset")).cast("bigint").alias("length"))


_add("h3_sentence_spans", h_sentence_spans, rf"""WITH p AS (SELECT id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?;])[{_WS}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS s FROM ({_ID}) y)
SELECT id, CAST(i - 1 AS BIGINT) AS seq, s[i] AS sentence, CAST(length(s[i]) AS BIGINT) AS length FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT DISTINCT id, t, s FROM p) q) z""")


@F.pandas_udf(T.ArrayType(T.StructType().add("a", T.IntegerType()).add("b", T.IntegerType())))
def _token_spans(t: pd.Series) -> pd.Series:
    return t.map(lambda x: [{"a": a, "b": b} for a, b in E.token_spans(x)])


_add("h5_token_spans", lambda s, d: _texts(s, d).withColumn("k", _token_spans("t")).select("id", F.size("k").cast("bigint").alias("n_tokens"), F.aggregate("k", F.lit(0).cast("bigint"), lambda a, x: a + x["b"] - x["a"]).alias("letters")),
     rf"SELECT id, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS n_tokens, CAST(coalesce(list_sum(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x))), 0) AS BIGINT) AS letters FROM ({_ID}) y")


def h_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one to three lemmas, each once a phrase, with the number of phrases they stand in."""
    c = table(spark, d, "candidates").filter("text_lemmatized IS NOT NULL").select(X.tokens(F.col("text_lemmatized")).alias("w")).distinct()
    return c.select(F.explode(F.array_distinct(F.concat(*(X.ngrams(F.col("w"), n) for n in (1, 2, 3))))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_add("h7_lemma_ngrams", h_ngrams, rf"""WITH c AS (SELECT DISTINCT regexp_extract_all(lower(text_lemmatized), '[^{_WS}]+') AS w FROM candidates WHERE text_lemmatized IS NOT NULL),
g AS (SELECT w, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM c, (SELECT unnest([1, 2, 3]) AS n) k, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) r WHERE len(w) >= n) SELECT gram, count(*) AS n FROM (SELECT DISTINCT w, gram FROM g) x GROUP BY gram""")
_add("h10_lemma_tuple", lambda s, d: _texts(s, d).select("id", F.array_join(F.filter(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) > 2), " ").alias("w0"), F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{N}_]*\p{L}[\p{L}\p{N}_]*)"), F.lit(1)).alias("w")).select("id", F.array_join(F.filter("w", lambda w: F.length(w) > 2), " ").alias("lemmas")),
     rf"SELECT id, array_to_string(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2 AND regexp_matches(x, '\p{{L}}')), ' ') AS lemmas FROM ({_ID}) y")


def h_negation(spark: SparkSession, d: str) -> DataFrame:
    """Denials of what is better absent in the premises of predictions, against the words of their aspect."""
    n = table(spark, d, "nli_predictions").filter("premise_text IS NOT NULL AND aspect_name IS NOT NULL").select("prediction_id", "premise_text", "aspect_name").distinct()

    @F.pandas_udf("struct<matched:boolean,pattern:string,hit:string>")
    def find(t: pd.Series, a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([E.negation(x, E.lemmas_of(y)) for x, y in zip(t, a, strict=True)], columns=["matched", "pattern", "hit"])

    return n.withColumn("x", find("premise_text", "aspect_name")).select("prediction_id", "x.matched", "x.pattern", "x.hit").distinct()


_add("h11_negation", h_negation, None)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Candidates beside the text of their review, with sentence and window."""
    r = table(spark, d, "reviews").filter("full_text IS NOT NULL").groupBy(F.col("id").alias("review_id")).agg(F.min("full_text").alias("body"))
    c = table(spark, d, "candidates").select("candidate_id", "review_id", "text", "start_offset", "end_offset").distinct()
    return E.with_sentences(c.join(r, "review_id"), "body", "text", "start_offset", "end_offset")


_add("h12_resolved_sentences", lambda s, d: _evidence(s, d).select("candidate_id", "sentence", "window").distinct(), None)
_add("c13_sentence_holds_offset", lambda s, d: _evidence(s, d).filter("start_offset >= 0 AND start_offset < length(body)").select("candidate_id", F.contains("body", "sentence").alias("in_text")).groupBy("in_text").agg(F.countDistinct("candidate_id").alias("n")),
     "WITH r AS (SELECT id, min(full_text) AS b FROM reviews WHERE full_text IS NOT NULL GROUP BY id) SELECT true AS in_text, count(DISTINCT candidate_id) AS n FROM candidates c JOIN r ON r.id = c.review_id WHERE start_offset >= 0 AND start_offset < length(b)")


def h_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """How often each phrase of a product's clusters occurs in the product's reviews, overlaps resolved. The phrases of a
    product are few; they are sent to its reviews."""
    k = table(spark, d, "clusters").filter("medoid_phrase IS NOT NULL").groupBy("nm_id").agg(F.array_sort(F.collect_set("medoid_phrase")).alias("phrases"))
    r = table(spark, d, "reviews").filter("full_text IS NOT NULL").select("id", "nm_id", "full_text").distinct().join(k, "nm_id")

    @F.pandas_udf("array<string>")
    def find(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([[x[2] for x in E.occurrences(a, b)] for a, b in zip(t, p, strict=True)])

    return r.select("nm_id", F.explode(find("full_text", "phrases")).alias("phrase")).groupBy("nm_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


_add("h14_phrase_occurrences", h_occurrences, None)
_SEGMENT = r"[.!?;\n\r]+|[{0}]+-[{0}]+|[{0}]+—[{0}]+|,[{0}]+но[{0}]+|,[{0}]+а[{0}]+|,[{0}]+однако[{0}]+"


def segments(t: F.Column) -> F.Column:
    """Pieces of a text between marks, free-standing dashes and conjunctions after a comma, stripped."""
    ws = r"\s\x{1c}-\x{1f}"
    return F.filter(F.transform(F.split(t, "(?U)" + _SEGMENT.replace("{0}", ws)), X.strip), lambda x: F.length(x) > 0)


_SEGMENTS_SQL = rf"list_filter(list_transform(string_split_regex(t, '{_SEGMENT.replace('{0}', _WS)}'), lambda x: {_strip('x')}), lambda x: x <> '')"
_add("h15_segments", lambda s, d: _texts(s, d).select("id", segments(F.col("t")).alias("s")).select("id", F.size("s").cast("bigint").alias("n_segments"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("bigint").alias("longest")),
     f"SELECT id, len(s) AS n_segments, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest FROM (SELECT id, {_SEGMENTS_SQL} AS s FROM ({_ID}) y) z")


def h_minimal(spark: SparkSession, d: str) -> DataFrame:
    """The premise of a chunk: its sentence, else the shortest segment of the review that holds its text, else the text."""
    r = table(spark, d, "reviews").filter("full_text IS NOT NULL").groupBy(F.col("id").alias("review_id")).agg(F.min("full_text").alias("t"))
    c = table(spark, d, "parsed_chunks").select("chunk_id", "review_id", "text", X.strip(F.coalesce("sentence", F.lit(""))).alias("s")).distinct().join(r, "review_id", "left").withColumn("all", segments(F.col("t")))
    holds = F.filter("all", lambda x: F.contains(F.lower(x), F.lower(X.strip(F.col("text")))))
    short = F.array_min(F.transform(holds, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return c.select("chunk_id", F.when(F.length("s") > 0, F.col("s")).otherwise(F.coalesce(short, X.strip(F.col("text")))).alias("premise")).distinct()


_add("h18_minimal_premise", h_minimal, rf"""WITH r AS (SELECT id, min(full_text) AS t FROM reviews WHERE full_text IS NOT NULL GROUP BY id), c AS (SELECT DISTINCT chunk_id, text, {_strip("coalesce(sentence, '')")} AS s, {_SEGMENTS_SQL} AS a FROM parsed_chunks LEFT JOIN r ON r.id = review_id)
SELECT DISTINCT chunk_id, CASE WHEN s <> '' THEN s ELSE coalesce(list_sort(list_transform(list_filter(a, lambda x: contains(lower(x), lower({_strip('text')}))), lambda x: {{'n': length(x), 'x': x}}))[1].x, {_strip('text')}) END AS premise FROM c""")
_add("h19_matched_terms", lambda s, d: table(s, d, "parsed_chunks").filter("sentence IS NOT NULL").select("chunk_id", F.array_join(X.words(F.col("sentence")), " ").alias("t")).distinct().join(F.broadcast(table(s, d, "aspect_reference").select("aspect_id", F.array_join(X.words(F.col("canonical_name")), " ").alias("term"))), X.contains_term(F.col("t"), F.col("term"))).groupBy("chunk_id").agg(F.countDistinct("aspect_id").alias("n_terms")),
     rf"WITH c AS (SELECT DISTINCT chunk_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(sentence), '[^{_WS}]+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}\p{{M}}_-]', '', 'g')), lambda x: x <> ''), ' ') AS t FROM parsed_chunks WHERE sentence IS NOT NULL), a AS (SELECT aspect_id, lower(canonical_name) AS term FROM aspect_reference) SELECT chunk_id, count(DISTINCT aspect_id) AS n_terms FROM c JOIN a ON contains(' ' || t || ' ', ' ' || term || ' ') GROUP BY chunk_id")
_add("h21_pair_head", lambda s, d: table(s, d, "parsed_chunks").select("chunk_id", F.when(~F.col("dep_label").startswith("event_"), F.substring_index("dep_label", "_", 1)).alias("head")).distinct(), "SELECT DISTINCT chunk_id, CASE WHEN NOT starts_with(dep_label, 'event_') THEN split_part(dep_label, '_', 1) END AS head FROM parsed_chunks")
_add("h24_case_features", lambda s, d: _texts(s, d).select("id", *(F.col("t").rlike(p).cast("int").alias(k) for k, p in (("digits", "[0-9]"), ("shouts", "!!|\\?\\?"), ("caps", "[A-ZА-ЯЁ]{4,}"), ("lines", "\n"), ("list_mark", "(^|\n)[-•*]")))).withColumn("score", F.col("digits") + F.col("shouts") + F.col("caps") + F.col("lines") + F.col("list_mark")),
     f"WITH x AS (SELECT id, " + ", ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER) AS {k}" for k, p in (("digits", "[0-9]"), ("shouts", r"!!|\?\?"), ("caps", "[A-ZА-ЯЁ]{4,}"), ("lines", r"\n"), ("list_mark", r"(^|\n)[-•*]"))) + f" FROM ({_ID}) y) SELECT *, digits + shouts + caps + lines + list_mark AS score FROM x")
_add("h25_first_words", lambda s, d: table(s, d, "parsed_chunks").filter("text IS NOT NULL").select("chunk_id", F.array_join(F.slice(X.words(F.col("text")), 1, 2), " ").alias("label")).distinct(),
     rf"SELECT DISTINCT chunk_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(text), '[^{_WS}]+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}\p{{M}}_-]', '', 'g')), lambda x: x <> '')[1:2], ' ') AS label FROM parsed_chunks WHERE text IS NOT NULL")


def k_premise_modes(spark: SparkSession, d: str) -> DataFrame:
    """Premises by mode: one row an assignment (review and product aspect) in A, B and C, one row an evidence in D."""
    e = _evidence(spark, d).select(F.concat_ws("|", "review_id", F.lower("text")).alias("assignment_id"), F.col("candidate_id").alias("evidence_id"), "start_offset", "end_offset", "sentence", "window", "body").distinct()
    a = e.groupBy("assignment_id").agg(F.min("body").alias("text"))
    out = None
    for mode in "ABCD":
        one = E.premises(a, e, mode).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.countDistinct("assignment_id").alias("n_assignments"))
        out = one if out is None else out.unionByName(one)
    return out


_add("k27_premise_modes", k_premise_modes, """WITH r AS (SELECT DISTINCT id FROM reviews WHERE full_text IS NOT NULL), e AS (SELECT DISTINCT concat_ws('|', review_id, lower(text)) AS a, candidate_id, start_offset, end_offset, text FROM candidates JOIN r ON r.id = review_id), m AS (SELECT unnest(['A', 'B', 'C', 'D']) AS mode)
SELECT mode, CASE WHEN mode = 'D' THEN (SELECT count(*) FROM (SELECT DISTINCT a, candidate_id, start_offset, end_offset FROM e) z) ELSE (SELECT count(DISTINCT a) FROM e) END AS n, (SELECT count(DISTINCT a) FROM e) AS n_assignments FROM m""")

# Marks of money and time, and words that name nothing by themselves.
MONEY, TIME, CONTEXT = "руб|рублей|рубля|рубль|₽|тыс|eur|euro|евро", "январ|феврал|март|апрел|июн|июл|август|сентябр|октябр|ноябр|декабр|месяц|недел", ("это", "все", "всё", "очень", "просто", "раз", "вещь", "штука")
RULES = ("numeric", "monetary", "temporal", "too_short", "context_stop")


def phrase_noise(t: F.Column) -> F.Column:
    """The first rule that makes a phrase noise, or null: mostly digits, money, time, too short, words of context only."""
    bare = F.regexp_replace(t, r"(?U)[\s\x{1c}-\x{1f}]", "")
    words = X.words(t)
    return (
        F.when(F.length(bare) == 0, "too_short").when(F.length(F.regexp_replace(bare, "[^0-9]", "")) * 2 >= F.length(bare), "numeric").when(F.lower(t).rlike(rf"(^|[ .])({MONEY})([ .]|$)"), "monetary")
        .when(F.lower(t).rlike(rf"(^| )({TIME})"), "temporal").when(F.length(X.strip(t)) < 4, "too_short").when(F.forall(words, lambda w: w.isin(*CONTEXT)), "context_stop")
    )


_NOISE_SQL = rf"""CASE WHEN b = '' THEN 'too_short' WHEN length(regexp_replace(b, '[^0-9]', '', 'g')) * 2 >= length(b) THEN 'numeric' WHEN regexp_matches(lower(text), '(^|[ .])({MONEY})([ .]|$)') THEN 'monetary' WHEN regexp_matches(lower(text), '(^| )({TIME})') THEN 'temporal' WHEN length({_strip('text')}) < 4 THEN 'too_short'
 WHEN len(list_filter(list_filter(list_transform(regexp_extract_all(lower(text), '[^{_WS}]+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}\p{{M}}_-]', '', 'g')), lambda x: x <> ''), lambda x: x NOT IN {CONTEXT})) = 0 THEN 'context_stop' END"""
_NOISE_ROWS = f"SELECT DISTINCT candidate_id, text, {_NOISE_SQL} AS rule FROM (SELECT candidate_id, text, regexp_replace(text, '[{_WS}]', '', 'g') AS b FROM candidates WHERE text IS NOT NULL) x"
_add("b5_phrase_noise", lambda s, d: table(s, d, "candidates").filter("text IS NOT NULL").select("candidate_id", phrase_noise(F.col("text")).alias("rule")).distinct(), f"SELECT DISTINCT candidate_id, rule FROM ({_NOISE_ROWS}) y")


def b_filter_report(spark: SparkSession, d: str) -> DataFrame:
    """Phrases filtered by each rule, rules without any included, with the share of all and the first five as samples. A
    rule's samples are kept by a bounded pick, not by collecting its phrases."""
    p = table(spark, d, "candidates").filter("text IS NOT NULL").select("candidate_id", "text", phrase_noise(F.col("text")).alias("rule")).distinct()
    n = p.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    top = head_by(p.filter("rule IS NOT NULL").select("rule", "text").distinct(), ["rule"], [F.col("text")], 5).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("text")), "|").alias("samples"))
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    total = p.agg(F.count(F.lit(1)).alias("total"))
    return rules.join(n, "rule", "left").join(top, "rule", "left").crossJoin(F.broadcast(total)).select("rule", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"), F.coalesce("samples", F.lit("")).alias("samples"))  # one row


_add("b6_filter_report", b_filter_report, f"""WITH p AS ({_NOISE_ROWS}), r AS (SELECT unnest({list(RULES)}) AS rule), s AS (SELECT rule, text, row_number() OVER (PARTITION BY rule ORDER BY text) AS k FROM (SELECT DISTINCT rule, text FROM p WHERE rule IS NOT NULL) z)
SELECT r.rule, (SELECT count(*) FROM p WHERE p.rule = r.rule) AS n, round((SELECT count(*) FROM p WHERE p.rule = r.rule) / (SELECT count(*) FROM p), 6) AS share, coalesce((SELECT string_agg(text, '|' ORDER BY text) FROM s WHERE s.rule = r.rule AND k <= 5), '') AS samples FROM r""")
_add("b8_meta_noise", lambda s, d: table(s, d, "candidates").filter("text_lemmatized IS NOT NULL").select("candidate_id", F.forall(F.split("text_lemmatized", " "), lambda w: w.isin(*CONTEXT)).alias("meta")).distinct(), f"SELECT DISTINCT candidate_id, len(list_filter(string_split(text_lemmatized, ' '), lambda w: w NOT IN {CONTEXT})) = 0 AS meta FROM candidates WHERE text_lemmatized IS NOT NULL")
# Words that praise or name a thing without saying more.
EMOTION, OBJECT = ("супер", "отлично", "класс", "хорошо", "плохо", "нормально", "ок"), ("товар", "вещь", "заказ", "магазин", "покупка")


def noise_reason(lemma: F.Column, score: F.Column, weak: float = 0.2) -> F.Column:
    """The first reason to set a candidate aside: too short, emotion only, too generic, technical, weak scores; else ''."""
    return (
        F.when(F.length(F.trim(lemma)) < 3, "too_short").when(F.forall(F.split(F.trim(lemma), " +"), lambda w: w.isin(*EMOTION)), "generic_emotion").when(F.trim(lemma).isin(*OBJECT), "too_generic")
        .when(F.trim(lemma).rlike("^[a-z0-9-]+$"), "technical_garbage").when(score < weak, "weak_scores").otherwise("")
    )


_add("b7_noise_reason", lambda s, d: table(s, d, "nli_predictions").filter("aspect_name IS NOT NULL").select("prediction_id", noise_reason(F.lower("aspect_name"), F.coalesce("relevance_filter_value", F.lit(0.0))).alias("reason")).distinct(),
     f"SELECT DISTINCT prediction_id, CASE WHEN length(trim(a)) < 3 THEN 'too_short' WHEN len(list_filter(string_split_regex(trim(a), ' +'), lambda w: w NOT IN {EMOTION})) = 0 THEN 'generic_emotion' WHEN trim(a) IN {OBJECT} THEN 'too_generic' WHEN regexp_matches(trim(a), '^[a-z0-9-]+$') THEN 'technical_garbage' WHEN v < 0.2 THEN 'weak_scores' ELSE '' END AS reason FROM (SELECT prediction_id, lower(aspect_name) AS a, coalesce(relevance_filter_value, 0) AS v FROM nli_predictions WHERE aspect_name IS NOT NULL) x")
