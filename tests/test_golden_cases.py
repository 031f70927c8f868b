"""Small cases with known answers: metrics, text evidence, joins, anchors, cached scores and repairs; and odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionframe.functions import rating as R
from opinionframe.functions import text as X
from opinionframe.operators import evidence as E
from opinionframe.operators.joins import repeated_keys, validated_join, word_matches
from opinionframe.operators.scoring_cache import model_signature, score_pairs
from opinionframe.operators.similarity import anchor_scores, best_two, centroids, cluster_quality, medoids, route, softmax_ranks
from opinionframe.plans.evidence import noise_reason, phrase_noise, segments
from opinionframe.plans.ratings import pair_metrics


def _col(spark, rows, schema, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*(c.alias(k) for k, c in cols.items())).collect()]


def test_rounding_and_directions(spark):
    got = _col(spark, [(x,) for x in (1.2, 4.7, 3.4, 2.5, 0.2)], "x double", r=R.half_even(F.col("x")))
    assert [r for (r,) in got] == [1, 5, 3, 2, 1]
    assert [r for (r,) in _col(spark, [(x,) for x in (2.74, 2.75, 3.25, 3.26)], "x double", d=R.predicted_direction(F.col("x")))] == ["negative", "neutral", "neutral", "positive"]
    assert [r for (r,) in _col(spark, [(x,) for x in (1.0, 3.0, 5.0)], "x double", d=R.gold_direction(F.col("x")))] == ["negative", "neutral", "positive"]


def test_sentiment_vectors(spark):
    got = spark.createDataFrame([(4.5,), (3.1,), (1.4,)], "x double").select(*(c.alias(k) for k, c in zip("nmp", R.sentiment_vector(F.col("x")), strict=True))).collect()
    assert np.allclose([tuple(r) for r in got], [(0, 0.25, 0.75), (0, 0.95, 0.05), (0.8, 0.2, 0)])


def test_run_metrics_of_three_pairs(spark):
    rows = [("a", 5.0, 4.2, "vocab"), ("b", 1.0, 4.5, "discovery"), ("c", 3.0, 3.1, "vocab")]
    m = pair_metrics(spark.createDataFrame(rows, "review_id string, gold double, pred double, aspect_source string")).first()
    assert m.mae == round(4.4 / 3, 6) and m.acc_1_0 == round(2 / 3, 6) and m.wrong_rate == m.strong_wrong_rate == round(1 / 3, 6) and m.n_pairs == 3
    assert [r for (r,) in _col(spark, [(1.0, 4.5), (5.0, 2.6), (3.0, 3.1)], "g double, p double", e=R.error_type(F.col("g"), F.col("p")))] == ["strong_wrong_polarity", "wrong_polarity", "near_miss"]


def test_formulas_with_two_hypotheses(spark):
    f = R.formulas(*(F.col(c) for c in ("pe", "pn", "pc", "ne", "nu", "nc", "now")))
    assert len(f) == 25
    r = spark.createDataFrame([(0.8, 0.1, 0.1, 0.2, 0.2, 0.6, 4.0), (0.8, 0.1, 0.1, None, None, None, 4.0)], "pe double, pn double, pc double, ne double, nu double, nc double, now double").select(*(c.alias(k) for k, c in f.items())).collect()
    a = r[0].asDict()
    assert math.isclose(a["F1_pos_full_distribution"], 4.4) and math.isclose(a["F2_neg_full_distribution"], 3.8) and math.isclose(a["F3_avg_full_distribution"], 4.1) and math.isclose(a["F4_dual_diff"], 4.2)
    assert math.isclose(a["F7_dual_full_nli"], (5 * 1.4 + 3 * 0.15 + 0.3) / 1.850001, rel_tol=1e-6) and math.isclose(a["F8_dual_full_nli_power_alpha1_0"], a["F7_dual_full_nli"])
    assert r[1].F4_dual_diff is None and r[1].F3_avg_full_distribution is None and math.isclose(r[1].F9_center_expansion_gamma1_5, 4.5)


def test_uniqueness_weights(spark):
    got = _col(spark, [(0.0, 1), (1.0, 2), (0.8, 2), (0.5, 10)], "s double, n int", w=R.uniqueness(F.col("s"), F.col("n")))
    assert np.allclose([w for (w,) in got], [1.0, 0.01, (1 - 0.2**2) * math.log(2) / math.log(3), math.log(2) / math.log(11)])


def test_null_words(spark):
    assert [r for (r,) in _col(spark, [(None,), (" NONE ",), ("nan",), ("x ",)], "t string", v=X.null_like(F.col("t")))] == [None, None, None, "x"]


TEXT = "Доставка быстрая. Корпус без царапин; запаха нет!  Кнопка\nработает плохо"


def test_sentences_and_windows():
    assert [TEXT[a:b] for a, b in E.sentence_spans(TEXT)] == ["Доставка быстрая.", "Корпус без царапин;", "запаха нет!", "Кнопка\nработает плохо"]
    assert E.sentence_spans("") == E.sentence_spans(" \n ") == [] and E.sentence_of(" ", "x") is None and E.window_of("", "x") is None
    assert E.sentence_of(TEXT, "что угодно", 20) == "Корпус без царапин;" and E.sentence_of(TEXT, "КНОПКА") == "Кнопка\nработает плохо"
    assert E.sentence_of(TEXT, "плохо кнопка") == "Кнопка\nработает плохо" and E.sentence_of(TEXT, "ничего") == "Доставка быстрая."
    assert E.window_of(TEXT, "без", around=1) == "Корпус без царапин" and E.window_of(TEXT, "x", 0, 8, around=1) == "Доставка быстрая" and E.window_of(TEXT, "ничего") == "Доставка быстрая."


def test_occurrences_prefer_the_longer():
    t = "Быстрая доставка курьером. быстрая доставка"
    assert [(a, p) for a, _, p in E.occurrences(t, ["быстрая доставка", "быстрая доставка курьером", "", "БЫСТРАЯ ДОСТАВКА"])] == [(0, "быстрая доставка курьером"), (27, "быстрая доставка")]
    assert [(a, b) for a, b, _ in E.occurrences("ааа", ["аа"])] == [(0, 2)] and E.occurrences("", ["x"]) == []


@pytest.mark.parametrize(("text", "pattern"), [("нет запах", "нет"), ("без всякий запах", "без"), ("запах вообще нет", "reverse нет"), ("не быть запах", "не было"), ("не иметь запах", "не имеет"), ("запах отсутствовать", "отсутствует"), ("никакой запах", "никакой"), ("запах есть", ""), ("нет вкус", "")])
def test_negations(text, pattern):
    assert E.negation(text, ["запах", "вкус"]) == (bool(pattern), pattern, "запах" if pattern else "")
    assert E.negation("нет шум и запах", ["шум", "запах"])[2] == "запах"


def test_premise_modes(spark):
    a = spark.createDataFrame([("r1", "T1"), ("r2", "T2")], "assignment_id string, text string")
    e = spark.createDataFrame([("r1", "e1", -1, -1, "s1", "w1"), ("r1", "e2", 4, 6, "s2", "w2"), ("r2", "e3", None, None, "s3", "w3")], "assignment_id string, evidence_id string, start_offset int, end_offset int, sentence string, window string")
    got = {m: sorted(tuple(r) for r in E.premises(a, e, m).collect()) for m in "ABCD"}
    assert got["A"] == [("r1", "T1"), ("r2", "T2")] and got["B"] == [("r1", "s2"), ("r2", "s3")] and got["C"] == [("r1", "w2"), ("r2", "w3")] and len(got["D"]) == 3
    with pytest.raises(ValueError, match="X"):
        E.premises(a, e, "X")
    df = spark.createDataFrame([("x", TEXT, "Кнопка", None, None, 1), ("y", None, "a", 0, 1, 2)], "id string, t string, e string, a int, b int, sentence_no int")
    assert [(r.id, r.sentence) for r in E.with_sentences(df, "t", "e", "a", "b").collect()] == [("x", "Кнопка\nработает плохо"), ("y", None)]


def test_segments_and_noise(spark):
    assert _col(spark, [("да, но нет. А - Б\nв",), ("",), (None,)], "t string", s=segments(F.col("t"))) == [(["да", "нет", "А", "Б", "в"],), ([],), (None,)]
    words = ["12 34а", "сто рублей", "два месяца", "оки", "все это", "мягкая подушка", " ", None]
    assert [r for (r,) in _col(spark, [(w,) for w in words], "t string", n=phrase_noise(F.col("t")))] == ["numeric", "monetary", "temporal", "too_short", "context_stop", None, "too_short", None]
    assert [r for (r,) in _col(spark, [("супер ок", 0.9), ("товар", 0.9), ("usb-c", 0.9), ("шов", 0.1), ("шов", 0.9)], "t string, s double", n=noise_reason(F.col("t"), F.col("s")))] == ["generic_emotion", "too_generic", "technical_garbage", "weak_scores", ""]


def test_checked_joins(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (None, "r"), (None, "s")], "k int, b string")
    assert sorted((r.a, r.b) for r in validated_join(a, b, ["k"]).collect()) == [("x", "p"), ("y", "p"), ("z", None)]
    for kind, l, r in (("one_to_one", a, b), ("many_to_one", b, a.withColumnRenamed("a", "c")), ("one_to_many", a, b)):
        with pytest.raises(ValueError, match="more than once"):
            validated_join(l, r, ["k"], kind)
    with pytest.raises(ValueError, match="both sides"):
        validated_join(a, b.withColumnRenamed("b", "a"), ["k"])
    assert [tuple(r) for r in repeated_keys(a, ["k"]).collect()] == [(1, 2)] and repeated_keys(a.limit(0), ["k"]).count() == 0
    x = spark.createDataFrame([(1, "шов ровный шов"), (2, None), (3, "")], "i int, t string")
    y = spark.createDataFrame([(7, "Ровный край"), (8, "цвет")], "j int, u string")
    assert [(r.i, r.j, r.shared, round(r.jaccard, 3)) for r in word_matches(x, y, ["i"], ["j"], F.col("t"), F.col("u")).collect()] == [(1, 7, 1, 0.333)]


def _vectors(spark, seed=3, n=60, k=4):
    rng = np.random.default_rng(seed)
    v, lab = rng.normal(size=(n, 6)) + np.eye(6)[rng.integers(0, k, n)] * 2, None
    lab = np.argmax(v[:, :k], axis=1)
    return v, lab, spark.createDataFrame([(i, int(x), [float(y) for y in r]) for i, (x, r) in enumerate(zip(lab, v, strict=True))] + [(999, 0, None)], "i int, k int, v array<double>")


def test_cluster_quality_and_medoids_equal_brute_force(spark):
    v, lab, df = _vectors(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s, n = u @ u.T, len(u)
    q = cluster_quality(df, "k", "i", "v").first()
    coh, sil = [], []
    for c in set(lab):
        m = lab == c
        coh.append(s[np.ix_(m, m)][~np.eye(m.sum(), dtype=bool)].mean())
    for i in range(n):
        own = [1 - s[i, j] for j in range(n) if lab[j] == lab[i] and j != i]
        a, b = np.mean(own), min(np.mean(1 - s[i, lab == c]) for c in set(lab) if c != lab[i])
        sil.append((b - a) / max(a, b))
    w = np.array([u[lab == c].mean(axis=0) / np.linalg.norm(u[lab == c].mean(axis=0)) for c in sorted(set(lab))])
    sep = (w @ w.T)[np.triu_indices(len(w), 1)].mean()
    assert np.allclose([q.cohesion, q.separation, q.silhouette], [np.mean(coh), sep, np.mean(sil)], atol=1e-5) and q.n_clusters == len(set(lab))
    got = {r.k: r.i for r in medoids(df, "k", "i", "v").collect()}
    assert got == {int(c): int(max(np.flatnonzero(lab == c), key=lambda i: (s[i, lab == c].sum(), -i))) for c in set(lab)}
    assert cluster_quality(df.limit(0), "k", "i", "v").count() == 0


def test_anchor_scores_ranks_and_routes(spark):
    v, lab, df = _vectors(spark)
    s = anchor_scores(df.select("i", "v"), "v", centroids(df, "k", "v"))
    two = {r.i: r for r in best_two(s, ["i"]).collect()}
    assert len(two) == len(v) and all(r.s1 >= r.s2 for r in two.values())
    p = softmax_ranks(s, ["i"]).groupBy("i").agg(F.sum("p").alias("p"), F.min_by("anchor", "rank").alias("a")).collect()
    assert all(abs(r.p - 1) < 1e-9 and r.a == two[r.i].best for r in p)
    one = best_two(anchor_scores(df.select("i", "v"), "v", centroids(df.filter("k = 0"), "k", "v")), ["i"]).first()
    assert one.second is None and one.s2 == -1.0
    rows = [(0.9, 0.1, 0.1, 0.0, False), (0.1, 0.0, 0.9, 0.1, False), (0.7, 0.1, 0.68, 0.1, False), (0.2, 0.1, 0.2, 0.1, False), (0.9, 0.1, 0.1, 0.0, True)]
    cols = [F.col(c) for c in "abcde"]
    assert [r for (r,) in _col(spark, rows, "a double, b double, c double, d double, e boolean", r=route(*cols))] == ["general", "domain", "overlap", "residual", "noise"]
    assert _col(spark, rows[2:3], "a double, b double, c double, d double, e boolean", r=route(*cols, domain_first=True)) == [("domain",)]


def test_cached_scores_are_computed_once(spark):
    pairs = spark.createDataFrame([("a", "p", "h"), ("b", "p", "g"), ("c", "p", "h"), ("d", None, "h")], "id string, premise string, hypothesis string")
    empty = spark.createDataFrame([], "pair string, score double")
    provider = lambda p, h: (F.ascii(p) * 1000 + F.ascii(h)).cast("double")
    cold, entries = score_pairs(pairs, empty, provider, model_signature(model="m", t=1))
    assert entries.count() == 2 and {(r.id, r.hit) for r in cold.collect()} == {("a", False), ("b", False), ("c", False), ("d", None)}
    warm, more = score_pairs(pairs, entries, provider, model_signature(t=1, model="m"))
    assert more.count() == 0 and {(r.id, r.hit) for r in warm.filter("premise IS NOT NULL").collect()} == {("a", True), ("b", True), ("c", True)}
    assert {(r.id, r.score) for r in warm.collect()} == {(r.id, r.score) for r in cold.collect()}
    assert score_pairs(pairs, entries, provider, model_signature(model="other"))[1].count() == 2
