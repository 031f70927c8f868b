"""Plans over all their rows, against brute force on small tables."""

import math
import random
import re
import time

import __spark_entry__ as entry
import numpy as np

from opinionframe.operators.covariance import topic_covariance


def _rows(spark, tmp_path, query, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return [tuple(r) for r in entry.queries()[query](spark, str(tmp_path)).collect()]


def test_texts_with_any_white_space(spark, tmp_path):
    texts = ["да. нет", "да.\nнет.\n", " \n\t", "\tодин два\nтри ", "а б\x1cв!\r\n?", "", "...", "x　y z", "Раз!\n\n Два? ."]
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)] + [("n", None)], "id string, full_text string")
    got = dict(_rows(spark, tmp_path, "h2_plain_sentences", reviews=df))
    assert got == {f"r{i}": max(1, len([x for x in re.split(r"[.!?]+", t) if x.strip()])) for i, t in enumerate(texts)}
    got = dict(_rows(spark, tmp_path, "i13_length_trust"))
    assert got == {f"r{i}": round(1 / (1 + math.exp(-0.8 * (len(t.split()) - 4))), 6) for i, t in enumerate(texts)}


def test_threshold_of_all_other_products(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{i}", f"r{i}", rng.choice([1, 1, 2, 3, None]), "a", "s", rng.choice([None, 0.9, 0.05, 0.11, 0.33, 0.77, 0.771]), 0.1, 0.1, 3.0, 3.0, False, rng.choice([1.0, 3.0, 5.0])) for i in range(60)]
    n = spark.createDataFrame([r[:-1] for r in rows] * 2, "prediction_id string, review_id string, nm_id long, aspect_name string, aspect_source string, p_entailment double, p_neutral double, p_contradiction double, raw_rating double, final_rating double, has_negation_match boolean")
    g = spark.createDataFrame([(r[1], "a", r[-1]) for r in rows], "review_id string, gold_aspect string, gold_rating double")
    scored = [(r[2], r[5], r[-1] >= 4) for r in rows if r[5] is not None]
    want = {}
    for product in {r[2] for r in rows}:
        ranks = []
        for tau in {-1.0, *(s for _, s, _ in scored)}:
            train = [(s > tau, y) for k, s, y in scored if k != product]
            tp, said, liked = sum(x and y for x, y in train), sum(x for x, _ in train), sum(y for _, y in train)
            ranks.append((-round(2 * tp / max(said + liked, 1), 12), -round(tp / max(liked, 1), 12), -round(tp / max(said, 1), 12), tau))
        best = min(ranks)
        want[product] = (best[3], round(-best[0], 6))
    got = {k: (tau, f1) for k, tau, f1 in _rows(spark, tmp_path, "k19_lopo_threshold", nli_predictions=n, gold_decisions=g)}
    assert got == want


def test_terms_contained_either_way(spark, tmp_path):
    terms = ["Дымная веранда возле окна", "лифт", "вялый  лифт", "a b a c", None, " "]
    texts = ["веранда возле", "дымная", "ДЫМНАЯ веранда", "была дымная веранда возле окна тут", "дымная окна", "вялый лифт", "лифта", "b a", "a\tc", "a c b", "", None, "x лифт"]
    a = spark.createDataFrame(list(enumerate(terms)), "cluster_id int, medoid_phrase string")
    c = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)] * 2, "candidate_id string, text string")
    runs = lambda w: {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    x, y = {f"c{i}": (t or "").lower().split() for i, t in enumerate(texts)}, {i: (t or "").lower().split() for i, t in enumerate(terms)}
    want = sorted((i, k) for i, t in x.items() for k, v in y.items() if tuple(t) in runs(v) or tuple(v) in runs(t))
    assert sorted(_rows(spark, tmp_path, "c8_contained_terms", clusters=a, candidates=c)) == want


def _shuffled_mb(spark, run):
    """What ``run`` gives and the MB shuffled for it."""

    def written():
        time.sleep(0.5)
        spark.range(1).count()  # the store is brought up to date by later tasks
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6

    before = written()
    return run(), written() - before


def test_targets_are_counted_without_all_pairs_of_predictions_and_targets(spark, tmp_path):
    n = [(f"p{i}", f"a{i % 3}") for i in range(3000)] + [("p1", "a2"), ("p1", "b"), ("p2", "a2"), ("q", None), (None, "a1"), (None, "c"), ("q", "unmapped")]
    s = [(f"a{i}", f"t{k}") for i in range(3) for k in range(300)] * 2 + [("b", "t0"), ("b", "v"), ("c", "w"), ("c", None), (None, "t1"), ("d", "t2")]
    want = {t: {p for p, a in n if p and (a, t) in s and a} for t in {t for a, t in s if t and any(a == x for _, x in n if x)}}
    tables = {"nli_predictions": spark.createDataFrame(n, "prediction_id string, aspect_name string"), "system_decisions": spark.createDataFrame(s, "system_aspect string, mapped_gold_aspect string")}
    got, mb = _shuffled_mb(spark, lambda: dict(_rows(spark, tmp_path, "c17_mapped_targets", **tables)))
    assert got == {t: len(p) for t, p in want.items()} and got["w"] == 0 and got["v"] == 1
    assert mb < 1.5


def test_pairs_of_topics_are_not_shuffled(spark, tmp_path):
    rng = random.Random(2)
    wide = [("w", f"r{i}", f"topic {i:03d}", float(rng.randint(1, 5))) for i in range(900)]
    rows = wide + [(g, f"r{i}", f"t{j}", float(rng.randint(1, 5))) for g in ("x", None) for i in range(60) for j in range(300) if rng.random() < 0.2]
    got, mb = _shuffled_mb(spark, lambda: topic_covariance(spark.createDataFrame(rows, "g string, r string, t string, v double"), "g", "r", "t", "v").write.parquet(str(tmp_path / "cov")))
    out = {(r.g, r.topic_a, r.topic_b): r.cov for r in spark.read.parquet(str(tmp_path / "cov")).collect()}
    assert len(out) == 900**2 + 2 * 300**2 and spark.read.parquet(str(tmp_path / "cov")).count() == len(out)
    assert all(out["w", a, b] == (1.0 if a == b else 0.0) for _, _, a, _ in wide for b in ("topic 000", "topic 899"))
    for g in ("x", None):
        x = np.full((60, 300), np.nan)
        for k, r, t, v in rows:
            if k == g:
                x[int(r[1:]), int(t[1:])] = v
        x = np.nan_to_num(x - np.nanmean(x, axis=0))
        s, k, n = x.T @ x / 60, 300, 60
        mu = np.trace(s) / k
        d2 = np.sum((s - mu * np.eye(k)) ** 2) / k
        w = min(d2, np.sum((x**2).T @ (x**2) / n - s**2) / k / n) / d2
        c = (1 - w) * s + w * mu * np.eye(k)
        assert all(abs(out[g, f"t{i}", f"t{j}"] - c[i, j]) < 1e-9 for i in range(300) for j in range(300))
    assert mb < 14
