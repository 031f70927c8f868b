"""Sentences, packs, mixtures and spam: odd cases, exact round trips and small brute-force checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionframe.llm.mixing import language_key, marginal_report, mixture, mixture_report, rake, source_key
from opinionframe.llm.packing import best_fit, first_room, local_search, pack, pack_summary, packs
from opinionframe.llm import spam as spam_module
from opinionframe.llm.sentences import sentences, split, split_levels
from opinionframe.llm.spam import features, spam_scores
from opinionframe.llm.tokens import with_token_counts

#: The sentences of each text, in order.
CASES = [
    ["Вес ок. 2.10 кг, напр. ботинки легче в 7 раза?!", "Повторюсь, хорошо 👍", "Как ни странно, да."],
    ["«Стекло выцвело! Зачем?» — спросила Анна.", "Нам сказали: «Приходите. Зонт готов.»", "9. Рамка упала."],
    ["Мастер В. Б. Иванов приехал в 17.56.", "Ну... как сказать, полка.", "Заплатили 24 тыс. руб.", "Из плюсов, да."],
    ["Mr. Smith from St. Paul Street paid 5 p.m. and left.", '"Why bother? Send it back!" said the courier.', "We got towels, etc.", "The end"],
    ["„Warum das? Schade drum!“, meinte Dr. Braun dazu.", "Kosten ca. 8,94 Euro inkl. Versand an Nr. 5.", "Am 3. Mai kam es an."],
    ["डॉ. Zuke का तौलिया करता है!", "यह पंप दो बार टपका।"],
    ["المحرك تسرب مرتين؟", "د. Dobavi قال نعم."],
]
JOINED = [
    ["“这个坏了！真的吗？”春天店员说。", "不过，周末买的颜色偏黄…", "评分8.9分，漏水了？"],
    ["「とても丈夫です。本当ですか？」と聞かれました。", "重さは9.3kgで、ゆるいです。"],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences_between_spaces(want):
    for glue in (" ", "  ", "\n", "\n\n"):
        text = glue.join(want)
        assert [text[a:b] for a, b in split(text)] == want


@pytest.mark.parametrize("want", JOINED)
def test_sentences_without_spaces(want):
    text = "".join(want)
    assert [text[a:b] for a, b in split(text)] == want


def test_sentences_of_odd_texts():
    show = lambda t: [t[a:b] for a, b in split(t)]
    assert show("กาน้ำราคา 389.99 บาทไม่มีกลิ่น หลังฝนตกหลวม หมอน Nofaxi มืด") == ["กาน้ำราคา 389.99 บาทไม่มีกลิ่น", "หลังฝนตกหลวม หมอน Nofaxi มืด".split(" ")[0], "หมอน Nofaxi มืด"]
    assert show("нет конца.Новое начало!Ещё") == ["нет конца.", "Новое начало!", "Ещё"]
    assert show("a first one. now the second?! third at ranura.example v2.1.4 ok.") == ["a first one.", "now the second?!", "third at ranura.example v2.1.4 ok."]
    assert show("«не закрыто. Потом ещё") == ["«не закрыто.", "Потом ещё"] and show("👍") == ["👍"] and show("") == show(" \n\t ") == []
    long_ = "Слово дня. " * 20000
    assert len(split(long_)) == 20000


def test_list_levels():
    text = "Плюсы:\n1. Экран. Звук.\n  - Басы\n  - Верха\n2) Цена\n   и доставка\nИтог."
    assert [(text[a:b], k) for a, b, k in split_levels(text)] == [("Плюсы:", 0), ("1. Экран.", 1), ("Звук.", 1), ("- Басы", 2), ("- Верха", 2), ("2) Цена", 1), ("и доставка", 1), ("Итог.", 0)]


def test_offsets_cover_everything_but_white_space():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["а", "Б", "c", "D", ".", "!", " ", "\n", "«", "»", '"', "(", ")", "。", "…", "5", "👍", "ก", " "]) for _ in range(40))
        covered = set()
        for a, b in split(t):
            assert a < b and t[a:b] == t[a:b].strip() and not covered & set(range(a, b))
            covered |= set(range(a, b))
        assert all(i in covered or c.isspace() for i, c in enumerate(t))


def test_sentence_rows(spark):
    df = spark.createDataFrame([("a", "Да. Нет.", 1), ("a", "Да. Нет.", 1), ("b", None, 1), ("c", "  ", 1), (None, "Да.", 1)], "id string, full_text string, seq int")
    assert [(r.record_id, r.seq, r.start_offset, r.end_offset, r.sentence) for r in sentences(df, "id", "full_text").orderBy("seq").collect()] == [("a", 0, 0, 3, "Да."), ("a", 1, 4, 8, "Нет.")]
    assert sentences(df.limit(0), "id", "full_text").count() == 0
    assert sorted(tuple(r) for r in sentences(df, "id", "full_text", with_text=False).collect()) == [("a", 0, 3), ("a", 4, 8)]


def test_packs_hold_and_are_nearly_full():
    rng = np.random.default_rng(3)
    for top, cap in ((300, 512), (60, 512), (512, 512), (500, 2048)):
        s = rng.integers(1, top + 1, 400)
        at = pack(s, cap)
        fill = np.bincount(at, weights=s)
        assert fill.max() <= cap and len(at) == 400 and fill.min() > 0
        assert len(fill) <= len(best_fit(s, cap))
    assert len(pack(np.array([], dtype=np.int64), 10)) == len(pack(np.array([], dtype=np.int64), 10, first_room)) == 0
    s = rng.integers(10, 200, 2000)
    before, after = len(first_room(s, 512)), len(set(pack(s, 512, first_room).tolist()))
    assert after < before and after <= 1.01 * s.sum() / 512 + 1
    bins = local_search([[0], [1, 2], [3, 4]], np.array([3, 6, 2, 5, 3]), 10)  # 3 goes beside 6 when 2 goes beside 5 and 3
    assert len(bins) == 2


def test_packs_of_a_table(spark):
    rng = random.Random(2)
    sized = spark.createDataFrame([(i, rng.randint(1, 700)) for i in range(300)] + [(1000, 512), (1001, 1024), (1002, 1025)], "id long, n_tokens long")
    caps = spark.createDataFrame([("p", 512), ("q", 2048)], "pack_name string, capacity long")
    got = packs(sized, caps).toPandas()
    fill = got.groupby(["pack_name", "pack_id"])["n_tokens"].sum().reset_index()
    assert (fill["n_tokens"] <= fill["pack_name"].map({"p": 512, "q": 2048})).all()
    total = sized.agg(F.sum("n_tokens")).first()[0]
    assert set(got.groupby("pack_name")["n_tokens"].sum()) == {total}
    whole = got[got["pack_name"] == "q"]
    assert whole["id"].is_unique and got[(got["id"] == 1002) & (got["pack_name"] == "p")]["n_tokens"].sum() == 1025
    assert {r.unused_share < 0.1 for r in pack_summary(packs(sized, caps), caps).collect()} == {True}
    assert packs(sized.limit(0), caps).count() == 0


def test_raking_meets_shares_and_caps():
    t = np.array([[[100.0, 300.0], [200.0, 0.0]], [[50.0, 10.0], [40.0, 20.0]], [[0.0, 0.0], [0.0, 0.0]]])
    u = rake(t, np.array([0.5, 0.3, 0.2]), np.array([1.0, 4.0, 2.0]))
    got = (u * t).sum(axis=(1, 2))
    assert u[0].max() <= 1 + 1e-9 and u[1].max() <= 4 + 1e-9 and u[2].max() == 0
    assert abs(got[0] / got.sum() - 0.625) < 1e-6
    assert rake(t * 0, np.array([0.5, 0.3, 0.2]), np.ones(3)).sum() == 0


def test_mixture_of_a_table(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([" A", "a", "B", "c", None]), rng.choice(["ru", "EN", None]), rng.choice(["prose", "list", None]), f"t{i % 900}", 10 + (i % 900) % 50) for i in range(1000)]
    sized = spark.createDataFrame(rows, "id long, source string, lang string, topic string, text_key string, n_tokens long").select("id", source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("lang"), "topic", "text_key", "n_tokens")
    targets = spark.createDataFrame([("A", 0.5, 2), ("b ", 0.3, 3), ("gone", 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture(sized, targets).cache()
    report = {r.source: r.asDict() for r in mixture_report(mixed, targets).collect()}
    assert abs(report["a"]["reached_share"] - 0.625) < 0.01 and abs(report["b"]["reached_share"] - 0.375) < 0.01 and report["gone"]["n_tokens"] == 0
    assert report["a"]["most_uses"] <= 2 and report["b"]["most_uses"] <= 3 and mixed.filter("source = 'c'").count() == 0
    assert mixture(sized.limit(0), targets).count() == 0
    shares = {(r.marginal, r.value): r for r in marginal_report(mixed, sized, targets).collect()}
    assert abs(shares["topic", "prose"].reached_share - shares["topic", "prose"].goal_share) < 0.05 and ("topic", "unknown") in shares and ("lang", "other") in shares
    keys = spark.createDataFrame([(" Gid-Mesta",), ("gid_mesta",), ("GID mesta ",)], "t string").select(source_key(F.col("t")).alias("k")).collect()
    assert {r.k for r in keys} == {"gid_mesta"}


def test_shares_are_met_with_few_texts(spark):
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2], rng.choice(["ru", "en", "de"]), rng.choice("xyz"), f"t{i}", rng.choice([20, 50, 90, 400])) for i in range(120)]
    sized = spark.createDataFrame(rows, "id long, source string, lang string, topic string, text_key string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixture_report(mixture(sized, targets), targets).collect()}
    assert abs(report["a"].reached_share - 0.7) < 0.01 and report["a"].most_uses <= 1 and report["b"].most_uses <= 2


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, " "), (4, "слово " * 5000)], "id int, text string")
    got = {r.id: r.n_tokens for r in with_token_counts(df, "text", [F.col("id")]).collect()}
    assert set(got) == {1, 4} and 2 <= got[1] <= 4 and got[4] > 5000


SPAM = ["купить хит набор " * 20, "free, pillow, deal, deal, free, pillow, " * 8, "#цена #акция #купитьхит #заказать8 #термос #чехол #термос26 #подушка #набор", "<a href=\"www.x.example/a\">a</a>\nhttps://y.test/b\nhttp://z.invalid/c?id=1\n[b](http://q.example/d)\n" * 3, "В школе провод скрипел.\n" + "чехол Нодого 44 шт оптом 6119 руб | " * 20]
PLAIN = ["Плед от Лугано отклеился на третий день, а магазин пока молчит. Для начала, за 700 рублей насадка работала как надо, и это главное.", "The box by Nola came in the morning and it was a bit off, but we like it. See shop.example for photos of the lid.", "Супер", "👍", "- Стол от Мико стоял у окна\n- Лампа за 300 рублей не светит\n- В коробке был только чехол и всё"]


def test_spam_among_plain_pages(spark):
    rng = random.Random(3)
    filler = [" ".join(rng.sample(PLAIN[:2] + ["Из плюсов, стул не шатается и за эти деньги это очень хорошо.", "На мой вкус, цвет чуть другой, но мы довольны и после ремонта."], 3)) for _ in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(SPAM + PLAIN + filler)] + [(900, None, "x"), (901, "  ", "x"), (None, SPAM[0], "x"), (0, SPAM[0], "x")]
    got = {r.id for r in spam_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text").filter("is_spam").collect()}
    assert got == set(range(len(SPAM)))
    assert spam_scores(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    assert features("de​al")[0] == "en" and features("")[1] == 0


@pytest.mark.parametrize("share", [0.33, 0.45])
def test_spam_that_is_much_of_a_language(spark, share):
    rng = random.Random(9)
    plain = [" ".join(rng.sample(PLAIN[:1] + ["Из плюсов, стул не шатается и за эти деньги это очень хорошо.", "На мой вкус, цвет чуть другой, но мы довольны и после ремонта.", "Вес был не указан, а в магазине так и не ответили.", "Для кухни это то, что надо, и не без причины."], 3)) for _ in range(300)]
    words = "купить хит набор цена чехол термос скидка доставка".split()
    spam = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 90))) for _ in range(int(300 * share / (1 - share)))]
    rows = [(i, t) for i, t in enumerate(plain + spam)]
    got = {r.id for r in spam_scores(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").filter("is_spam").collect()}
    assert got == set(range(300, len(rows)))


def test_few_documents_are_judged_too(spark):
    rows = [(i, PLAIN[i % 2]) for i in range(6)] + [(6, SPAM[0]), (7, None)]
    assert {r.id for r in spam_scores(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").filter("is_spam").collect()} == {6}


def test_distance_and_side_equal_numpy(spark):
    rng = np.random.default_rng(2)
    m, a = rng.normal(size=4), rng.normal(size=(4, 4))
    fits = {"x": (m, a @ a.T + np.eye(4))}
    x = rng.normal(size=(20, 4))
    df = spark.createDataFrame([("x", *map(float, r)) for r in x], "lang string, " + ", ".join(f"{f} double" for f in spam_module.FEATURES))
    got = {tuple(round(r[f], 12) for f in spam_module.FEATURES): (r.d2, r.side) for r in spam_module.with_distances(df, fits).collect()}
    inv = fits["x"][1]
    to = [np.array([0.0 if p is None else p - c for p, c in zip(pole, m)]) for pole in spam_module.POLES]
    for r in x:
        d, s = got[tuple(round(float(v), 12) for v in r)]
        assert abs(d - (r - m) @ inv @ (r - m)) < 1e-9 and abs(s - max((r - m) @ inv @ t / (t @ inv @ t) for t in to)) < 1e-9
