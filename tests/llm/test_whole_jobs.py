"""Cases in which a short cut of an operator on texts would lose something."""

import itertools
import random

import numpy as np
import pytest

from opinionframe.llm import clusters as cl
from opinionframe.llm import near_dup
from opinionframe.llm.packing import best_fit, pack
from opinionframe.llm.textnorm import edit_distance


def _alike(a, b, n):
    """Whether two items of one word beside "zzz" are neighbours, and how similar they are."""
    s = cl.word_similarity(a, b, min(n[a], n[b]) / max(n[a], n[b]))
    return (1 + s) / 2 if cl.deletions(a) & cl.deletions(b) and s >= cl.WORD_LEAST else None


@pytest.mark.parametrize("block", [2000, 2])
def test_items_are_linked_to_all_of_their_key(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(1)
    n = {"".join(w): rng.choice([1, 2, 5, 30, 300]) for w in itertools.islice(itertools.product("ab", "ab", "cd", "cd", "ef", "ef"), 64)}
    items = spark.createDataFrame([(f"{w} zzz", f"{w} zzz", k) for w, k in n.items()], "item string, bag string, n long")
    words = spark.createDataFrame([*n.items(), ("zzz", 5000)], "w string, n long")
    want = {(a, b): _alike(a, b, n) for a in n for b in n if a < b and _alike(a, b, n) is not None}
    got = {(r.a.split()[0], r.b.split()[0]): (r.s, r.w) for r in cl.item_graph(items, words).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k][0] - s) < 1e-9 and got[k][1] == n[k[0]] * n[k[1]] for k, s in want.items())


def test_wordings_of_the_same_stems_are_linked(spark):
    items = spark.createDataFrame([("kamera tikhaya", "kamer tikh", 5), ("kamery tikhoy", "kamer tikh", 2), ("kameru tikhuyu", "kamer tikh", 1), ("kameera tikhaya", "kameer tikh", 1)], "item string, bag string, n long")
    words = spark.createDataFrame([("kamer", 90), ("kameer", 1), ("tikh", 20)], "w string, n long")
    got = {(r.a, r.b): (round(r.s, 2), r.w) for r in cl.item_graph(items, words).collect()}
    assert got == {("kamera tikhaya", "kamery tikhoy"): (1.0, 16.0), ("kamera tikhaya", "kameru tikhuyu"): (1.0, 8.0), ("kameera tikhaya", "kamera tikhaya"): (round((1 + 1 - (1 + 4 / 90) / 6) / 2, 2), 8.0)}


def test_optional_runs_are_learned(spark):
    base = [f"{q} {t}" for q in ("дымная", "тихая", "вялая", "мутная") for t in ("веранда", "камера", "кнопка")]
    rows = base + [f"весьма {x}" for x in base[:6]] + [f"{x} возле окна" for x in base[3:9]] + ["тихая веранда сломалась", "сломалась камера опять", "сломалась кнопка опять", "сломалась веранда опять"]
    items, _ = cl.phrase_items(spark.createDataFrame([(x, 1) for x in rows], "text string, n long"))
    bag = {r.text: r.bag for r in items.collect()}
    assert bag["весьма дымная веранда"] == bag["дымная веранда"] and bag["тихая веранда возле окна"] == bag["тихая веранда"] and bag["сломалась камера опять"].count(" ") == 2
    assert cl.left_after(["a", "b", "c"], {"a": 3, "b": 9}) == [0, 2] and cl.left_after(["a", "b", "c"], {"a": 1}) == [1, 2]
    assert cl.left_after(["a", "b", "c", "d"], {"a b": 1, "c d": 1}) == [0, 1] and cl.left_after(["a", "b"], {"a": 5}) == [0, 1]


def test_without_the_graph_wordings_stay_apart(spark, monkeypatch):
    named = spark.createDataFrame([(1, "тихая камера")], "name_id int, phrase string")
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(["тихой камеры", "камеру тихую", "тихая камера", "тихая камреа"] * 3 + ["тихая камера"] * 9)], "candidate_id string, text string")
    assert {r.text for r in cl.phrase_clusters(df, named).filter("name_id = 1").collect()} == {"тихой камеры", "камеру тихую", "тихая камера", "тихая камреа"}
    graph = cl.item_graph
    monkeypatch.setattr(cl, "item_graph", lambda items, words: graph(items, words).limit(0))
    assert {r.text for r in cl.phrase_clusters(df, named).filter("name_id = 1").collect()} == {"тихая камера"}


def test_bins_over_half_full_are_emptied_too():
    rng = np.random.default_rng(5)
    fitted = packed = 0
    for _ in range(20):
        s = rng.integers(25, 62, 120)
        bins = best_fit(s, 100)
        at = pack(s, 100)
        fill = np.bincount(at, weights=s)
        assert fill.max() <= 100 and fill.min() > 0 and len(at) == 120
        fitted, packed = fitted + len(bins), packed + len(fill)
    assert packed <= fitted - 10


def test_alike_words_are_compared_once(spark):
    """Pairs of words meet once for each word with letters left out that they share; edits are counted after they are made
    distinct, not also before."""
    words = [("kamera", 90), ("kamrea", 1), ("kamer", 2), ("kameraa", 1), ("kammera", 1), ("kmaera", 3), ("nozhka", 40), ("nozka", 2), ("xyz", 5)]
    links = cl.word_links(spark.createDataFrame(words, "w string, n bigint"))
    assert links._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r.w, r.to): r.t for r in links.collect()}
    n = dict(words)
    shared = lambda a, b: cl.deletions(a) & cl.deletions(b)
    met = {(a, b): cl.word_similarity(a, b, n[a] / n[b]) for a in n for b in n if (n[a], a) < (n[b], b) and shared(a, b)}
    want = {k: t for k, t in met.items() if t >= cl.WORD_LEAST}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 5


def test_edits_between_equal_beginnings_and_ends():
    def plain(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 7))) for _ in "xy")
        assert edit_distance(a, b) == plain(a, b)
