"""Near-duplicates, canonical values and clusters against brute force and in odd cases."""

import random
from collections import Counter

import numpy as np

from opinionframe.llm import near_dup as nd
from opinionframe.llm.canonical import match_values, words_alike
from opinionframe.llm.clusters import average_linkage, item_similarity, phrase_clusters, stem
from opinionframe.llm.near_dup import class_links, components, linked_ids, near_duplicate_documents, text_classes, words
from opinionframe.llm.textnorm import edit_distance, readings, to_latin

VOCAB = [a + b for a in ("ко", "ми", "та", "лу", "ре", "но", "ша", "ве") for b in ("ра", "ска", "дин", "лок", "пим", "зун")] + ["the", "box", "lamp", "7", "12"]


def _texts(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice(VOCAB) for _ in range(rng.randint(30, 60))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], [rng.choice(VOCAB)], [w[k], rng.choice(VOCAB)]))
        if rng.random() < 0.3:
            rng.shuffle(w)
        out.append((f"d{i:03}", (", " if i % 2 else "  ").join(w).upper() if i % 5 == 0 else " ".join(w)))
    return out


def _brute(rows):
    bags = {i: Counter(words(t)) for i, t in rows if t}
    ok = {i: b for i, b in bags.items() if b.total() >= 30}
    return {(a, b) for a in ok for b in ok if a < b and 5 * (ok[a] & ok[b]).total() >= 4 * max(ok[a].total(), ok[b].total())}


def test_links_equal_brute_force(spark):
    for seed in (1, 2):
        rows = _texts(seed, 120) + [("e1", "слово " * 40), ("e2", "СЛОВО, " * 40), ("e3", "слово " * 33), ("n", None), ("b", "  "), ("s", "мало слов")]
        df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id string, full_text string, cls int")
        members = text_classes(df.unionByName(df), "id", "full_text").cache()
        got = {(r.id_a, r.id_b) for r in linked_ids(members, class_links(members)).collect()}
        assert got == _brute(rows) and ("e1", "e2") in got


def test_hot_keys_go_through_blocks(spark, monkeypatch):
    rows = _texts(3, 100)
    monkeypatch.setattr(nd, "BLOCK", 3)
    members = text_classes(spark.createDataFrame(rows, "id string, full_text string"), "id", "full_text").cache()
    assert {(r.id_a, r.id_b) for r in linked_ids(members, class_links(members)).collect()} == _brute(rows)


def test_one_row_a_document_with_its_group(spark):
    rows = _texts(4, 60)
    got = near_duplicate_documents(spark.createDataFrame(rows, "id string, full_text string"), "id", "full_text").toPandas()
    pairs = _brute(rows)
    group = dict(zip(got["id"], got["group_id"], strict=True))
    assert got["id"].is_unique and all(group[a] == group[b] for a, b in pairs)
    assert text_classes(spark.createDataFrame([], "id string, full_text string"), "id", "full_text").count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(80)], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(81)] + [("z",)], "node string")
    got = {r.node: r.component for r in components(nodes, links, "a", "b").collect()}
    assert {got[f"n{i:03}"] for i in range(81)} == {"n000"} and got["z"] == "z"


ENTRIES = [("e1", "Прочность швов"), ("e1", "крепость строчки"), ("e2", "Вкус и аромат"), ("e3", "Скорость зарядки"), ("e4", "Напор воды")]


def test_values_in_many_spellings(spark):
    want = {
        "прочность швов": "e1", "Порчность  швов!!": "e1", "швов прочность": "e1", "ghjxyjcnm idjd": "e1", "prochnost shvov": "e1", "Пpoчнocть швoв": "e1", "прочность_швов": "e1", "Прочн. швов": "e1",
        "крепость строчки (5)": "e1", "аспект: Вкус и аромат, вроде бы": "e2", "drec b fhjvfn, вроде бы": "e2", "Скорос. зарядки / Мотено": "e3", "футбол на луне": None, "12345": None, "?": None, "": None, "Напор воды" * 200: "e4",
    }
    entries = spark.createDataFrame(ENTRIES, "entry_id string, name string")
    values = spark.createDataFrame([(v, "x", 1) for v in want] * 2 + [(None, "x", 1)], "value string, name string, entry_id int")
    got = {r.value: r.entry_id for r in match_values(values, entries).collect()}
    assert {k: v for k, v in got.items() if got[k] != want[k]} == {} and len(got) == len(want)
    assert {r.entry_id for r in match_values(values, entries.limit(0)).collect()} == {None}
    assert words_alike("Прочность", "Прочность швов") == 1.0


def test_letters_and_edits():
    assert to_latin("щёлочь") == "shchelоch".replace("о", "o") and readings("Пpивет") == ["привет"] and readings("ghbdtn")[1] == "привет"
    assert edit_distance("abcd", "abdc") == 1 and edit_distance("", "ab") == 2 and edit_distance("aaaaaa", "bbbbbb", 2) == 3
    assert stem(to_latin("надорванную")) == stem(to_latin("надорванной")) == stem(to_latin("надорванный"))


def test_linkage_equals_a_sequential_one(spark):
    rng = random.Random(5)
    nodes = [f"v{i:02}" for i in range(12)]
    edges = {(a, b): (round(rng.uniform(0.5, 1.0), 6), float(rng.randint(1, 5))) for a in nodes for b in nodes if a < b and rng.random() < 0.25}
    e = {k: (s * w, w) for k, (s, w) in edges.items()}
    names = {n: n for n in nodes}
    while e:
        (s, a, b) = max((x / w, *k) for k, (x, w) in e.items())
        if s < 0.7:
            break
        names = {n: (a if c == b else c) for n, c in names.items()}
        merged = {}
        for (x, y), (sw, w) in e.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                k = (min(x, y), max(x, y))
                old = merged.get(k, (0.0, 0.0))
                merged[k] = (old[0] + sw, old[1] + w)
        e = merged
    want = {frozenset(n for n in nodes if names[n] == c) for c in names.values()}
    df = spark.createDataFrame([(a, b, s, w) for (a, b), (s, w) in edges.items()], "a string, b string, s double, w double")
    for local in (0, 20_000):  # in rounds over the executors, and in tasks
        got = {}
        for r in average_linkage(spark.createDataFrame([(n,) for n in nodes], "node string"), df, 0.7, local_edges=max(1, local)).collect():
            got.setdefault(r.cluster, set()).add(r.node)
        assert {frozenset(v) for v in got.values()} == want and all(min(v) == k for k, v in got.items())


def test_phrases_find_their_cluster_in_any_wording(spark):
    named = spark.createDataFrame([(1, "дымная веранда возле окна"), (2, "вялый лифт")], "name_id int, phrase string")
    common = ["дымная веранда", "веранда дымная", "вялый лифт", "шумный лифт", "дымный соус", "возле окна", "сидел возле окна"] * 20
    odd = ["ДЫМНОЙ-ВЕРАНДЫ", "веранда была очень дымная", "дымная ввранда", "dymnaya veranda", "дымную верaнду возле окна", "вялого лифта"]
    other = ["дымная", "веранда", "лифт", "", None, "!!", "шумный лифт", "дымный соус"]
    df = spark.createDataFrame([(f"c{i}", t, 9) for i, t in enumerate(common + odd + other)], "candidate_id string, text string, cluster int")
    got = {r.text: r.name_id for r in phrase_clusters(df, named).collect()}
    assert {got[t] for t in odd[:-1]} == {1} and got["вялого лифта"] == 2 and {got[t] for t in ("дымная", "веранда", "лифт", "шумный лифт", "дымный соус", "", "!!")} == {None}
    assert phrase_clusters(df.limit(0), named.limit(0)).count() == 0
    assert item_similarity("a b", "a b c") == 0.0 and item_similarity("lift vyal", "lift vyal") == 1.0


def test_signatures_agree_as_often_as_texts_do():
    rng = np.random.default_rng(0)
    tally, runs = [], []
    for _ in range(400):  # 40 tokens each, 32 of them shared: the very threshold, where the union is largest
        a = rng.integers(-(2**62), 2**62, size=40)
        b = np.concatenate([a[:32], rng.integers(-(2**62), 2**62, size=8)])
        same = nd.signature(a) == nd.signature(b)
        tally.append(same[: nd.TALLIED].sum())
        runs.append(same.reshape(-1, nd.RUN).all(axis=1).sum())
    assert min(tally) >= nd.MIN_TALLY and abs(np.mean(tally) / nd.TALLIED - 2 / 3) < 0.02 and min(runs) > 0


def test_very_long_texts_meet(spark):
    rng = random.Random(6)
    long_ = [f"w{chr(97 + k % 26)}{'xyz'[k % 3]}{rng.choice(VOCAB[:40])}" for k in range(30000)]
    five = [rng.choice(VOCAB) for _ in range(5000)]
    rows = [("l1", " ".join(long_)), ("l2", " ".join(long_[5:-5][::-1]) + " новое" * 10), ("f1", " ".join(five)), ("f2", " ".join(five[:4100]) + " иное" * 900), ("f3", " ".join(five[:3900]) + " третье" * 1100)]
    members = text_classes(spark.createDataFrame(rows, "id string, full_text string"), "id", "full_text").cache()
    got = {(r.id_a, r.id_b) for r in linked_ids(members, class_links(members)).collect()}
    assert got == _brute(rows) == {("l1", "l2"), ("f1", "f2")} | ({("f2", "f3")} & _brute(rows))
