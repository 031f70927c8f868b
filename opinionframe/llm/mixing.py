"""Mix sources to target shares of all tokens, with capped repeats and shares reported.

Token weights are raked (iterative proportional fitting) over the cells source x language x topic: the source marginal to
the target shares, the language and topic marginals to those of the texts at hand, so that mixing sources
doesn't shift them more than it must. A cell's weight is how often its texts are used; it can't exceed the source's
``max_repeats``, and what a full cell can't give, the source's other cells give. The size of the mixture is the largest
at which every source can reach its share. Each text is then used ``floor(weight)`` times and once more if its place in
a hashed order lies below the cell's threshold; thresholds are set by token mass in two steps of BUCKETS each, without
sorting a cell in one task. What a source still lacks then (less than a text a cell) is filled with texts of any of its
cells that fit into what is lacking, in TOP_UPS passes, so a source misses its share by less than its smaller texts.

The TOPICS topics with most tokens are kept apart, the others are one; a text without a topic is "unknown".

Defined results: texts that occur several times count as one text (first source, then smallest id), so no text exceeds
its repeats; sources without a target, null sources, blank texts and null ids aren't used; sources are compared without
outer white space, case and the kind of dash or space between words; a target without any text is left out and the other shares are scaled up, with 0 reported;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionframe.session import cut_lineage

#: Languages kept apart; everything else is "other", so that the cells are bounded.
LANGUAGES = ("ru", "en", "de", "zh", "ja", "th", "hi", "ar")
ROUNDS, BUCKETS, TOPICS, TOP_UPS = 200, 512, 32, 4


def source_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}_-]+", "_"))


def language_key(col: Column) -> Column:
    k = F.lower(F.trim(col))
    return F.when(k.isin(*LANGUAGES), k).otherwise("other")


def rake(tokens: np.ndarray, share: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Uses a text of each cell (source, language, topic), for tokens of the same shape, shares and caps of the sources."""
    have = tokens.sum(axis=(1, 2))
    share = np.where((have > 0) & (most > 0), share, 0.0)
    if share.sum() <= 0:
        return np.zeros_like(tokens)
    share = share / share.sum()
    size = min(m * h / s for m, h, s in zip(most, have, share, strict=True) if s > 0)
    want = share * size
    pool = tokens * (share > 0)[:, None, None]
    by_language, by_topic = (pool.sum(axis=a) / pool.sum() * size for a in ((0, 2), (0, 1)))
    got = pool * (want / np.maximum(have, 1e-12))[:, None, None]
    limit = pool * most[:, None, None]

    def to_sources(g: np.ndarray) -> np.ndarray:
        for _ in range(60):
            g = np.minimum(g * (want / np.maximum(g.sum(axis=(1, 2)), 1e-12))[:, None, None], limit)
            lacking = want - g.sum(axis=(1, 2))
            if np.all(lacking <= 1e-9 * size):
                break
            room = limit - g
            g = g + room * (np.maximum(lacking, 0) / np.maximum(room.sum(axis=(1, 2)), 1e-12))[:, None, None].clip(0, 1)
        return g

    for _ in range(ROUNDS):
        before = got
        got = got * (by_language / np.maximum(got.sum(axis=(0, 2)), 1e-12))[None, :, None]
        got = got * (by_topic / np.maximum(got.sum(axis=(0, 1)), 1e-12))[None, None, :]
        got = to_sources(got)
        if np.abs(got - before).max() < 1e-7 * size:
            break
    return np.divide(got, tokens, out=np.zeros_like(tokens), where=tokens > 0)


def mixture(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``id, source, lang, topic, n_tokens, n_uses`` of every distinct text that is used.

    ``sized``: id, source, lang, topic, text_key (equal for equal texts), n_tokens; ``targets``: source, target_share,
    max_repeats (a row a source).
    """
    spark = sized.sparkSession
    goals = _goals(targets)
    listed = pool(sized, targets)
    known = [r[0] for r in listed.groupBy("topic").agg(F.sum("n_tokens").alias("t")).orderBy(F.desc("t"), "topic").limit(TOPICS).collect()]
    texts = cut_lineage(
        listed.withColumn("topic", F.when(F.col("topic").isin(known), F.col("topic")).otherwise("other"))
        .withColumn("h", F.xxhash64("id")).withColumn("b1", F.pmod("h", F.lit(BUCKETS)).cast("int")).withColumn("b2", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)).cast("int"))
    )
    cells = texts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t")).collect()  # sources x 9 x 33 at most
    names = sorted(goals)
    langs, topics = sorted({r["lang"] for r in cells}), sorted({r["topic"] for r in cells})
    tokens = np.zeros((len(names), max(1, len(langs)), max(1, len(topics))))
    for r in cells:
        tokens[names.index(r["source"]), langs.index(r["lang"]), topics.index(r["topic"])] = r["t"]
    share = np.array([goals[s][0] for s in names])
    uses = rake(tokens, share, np.array([goals[s][1] for s in names], dtype=float))
    rows = []
    for r in cells:
        i = names.index(r["source"])
        u = min(float(uses[i, langs.index(r["lang"]), topics.index(r["topic"])]), float(goals[r["source"]][1]))
        base = math.floor(u + 1e-9)
        rows.append((r["source"], r["lang"], r["topic"], int(base), float(max(0.0, u - base) * r["t"])))
    plan = F.broadcast(spark.createDataFrame(rows, "source string, lang string, topic string, base int, extra double"))  # a row a cell
    key = ["source", "lang", "topic"]

    def cut(df: DataFrame, bucket: str, start: str) -> DataFrame:
        """Per cell, the first bucket whose tokens don't fit any more, and the tokens before it."""
        mass = df.groupBy(*key, bucket).agg(F.sum("n_tokens").alias("m"), F.first(start).alias("goal"))  # BUCKETS rows a cell
        w = Window.partitionBy(*key).orderBy(bucket)
        run = mass.withColumn("upto", F.sum("m").over(w)).withColumn("over", F.col("upto") > F.col("goal"))
        return run.filter("over").groupBy(*key).agg(F.min(F.struct(F.col(bucket).alias("b"), (F.col("upto") - F.col("m")).alias("before"))).alias("c")).select(*key, F.col("c.b").alias(f"cut_{bucket}"), F.col("c.before").alias(f"before_{bucket}"))

    planned = texts.join(plan, key)
    one = planned.join(F.broadcast(cut(planned, "b1", "extra")), key, "left")
    edge = one.filter("b1 = cut_b1").withColumn("rest", F.col("extra") - F.col("before_b1"))
    both = one.join(F.broadcast(cut(edge, "b2", "rest")), key, "left")
    more = F.col("cut_b1").isNull() & (F.col("extra") > 0) | (F.col("b1") < F.col("cut_b1")) | (F.col("b1") == F.col("cut_b1")) & (F.col("cut_b2").isNull() | (F.col("b2") < F.col("cut_b2")))
    out = both.withColumn("more", F.coalesce(more, F.lit(False))).withColumn("n_uses", F.col("base") + F.col("more").cast("int"))
    want = {n: float(v) for n, v in zip(names, (uses * tokens).sum(axis=(1, 2)), strict=True)}
    return _topped_up(cut_lineage(out.select("id", *key, "n_tokens", "n_uses", "more")), want, {s: m for s, (_, m) in goals.items()}).filter("n_uses > 0").select("id", *key, "n_tokens", "n_uses")


def _goals(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and most uses by source; a row a source."""
    return {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect()}


def pool(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``id, source, lang, topic, n_tokens`` of every distinct text of a source with a target."""
    goals = _goals(targets)
    listed = sized.filter(F.col("id").isNotNull()).join(F.broadcast(sized.sparkSession.createDataFrame([(s,) for s in goals], "source string")), "source")  # a row a source
    return listed.groupBy("text_key").agg(F.min(F.struct("source", "id", "lang", F.coalesce("topic", F.lit("unknown")).alias("topic"), "n_tokens")).alias("x")).select("x.*")


def _topped_up(used: DataFrame, want: dict[str, float], most: dict[str, int]) -> DataFrame:
    """``used`` with one use more of texts that fit into what their source lacks; each pass looks at texts that still fit."""
    spark = used.sparkSession
    for k in range(TOP_UPS):
        got = {r["source"]: float(r["t"]) for r in used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("t")).collect()}  # a row a source
        rows = [(s, int(want[s] - got[s]), most[s]) for s in got if want[s] - got[s] >= 1]
        if not rows:
            break
        lacking = F.broadcast(spark.createDataFrame(rows, "source string, lacking bigint, most int"))  # a row a source
        able = used.join(lacking, "source").filter((F.col("n_uses") < F.col("most")) & ~F.col("more") & (F.col("n_tokens") <= F.col("lacking"))).select("id", "source", "n_tokens", "lacking", F.pmod(F.xxhash64("id", F.lit(k)), F.lit(BUCKETS * 8)).cast("int").alias("b"))
        mass = able.groupBy("source", "b").agg(F.sum("n_tokens").alias("m"), F.first("lacking").alias("lacking"))  # 8 * BUCKETS rows a source
        run = mass.withColumn("over", F.sum("m").over(Window.partitionBy("source").orderBy("b")) > F.col("lacking"))
        cut = run.groupBy("source").agg(F.min(F.when(F.col("over"), F.col("b"))).alias("cut"))
        now = able.join(F.broadcast(cut), "source").filter(F.col("cut").isNull() | (F.col("b") < F.col("cut"))).select("id", F.lit(True).alias("now"))  # a row a source
        used = cut_lineage(used.join(now, "id", "left").withColumn("now", F.coalesce("now", F.lit(False))).withColumn("more", F.col("more") | F.col("now")).withColumn("n_uses", F.col("n_uses") + F.col("now").cast("int")).drop("now"))
    return used


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share of all tokens, texts, tokens, and the most uses of a text."""
    by = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("n_uses").alias("most_uses"))
    goal = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    all_ = by.agg(F.sum("n_tokens").alias("total"))
    return goal.join(by, "source", "left").crossJoin(F.broadcast(all_)).select(  # one row
        "source", "target_share", F.round(F.coalesce(F.col("n_tokens"), F.lit(0)) / F.col("total"), 6).alias("reached_share"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )


def marginal_report(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per language and per topic: its share of the tokens of all texts at hand (the goal of the raking), and of the
    mixture. A language or topic whose texts stand in sources with small targets can't keep its share."""
    given = pool(sized, targets)

    def shares(df: DataFrame, col: str, tokens: Column, name: str) -> DataFrame:
        by = df.groupBy(F.col(col).alias("value")).agg(F.sum(tokens).alias(name))
        return by.crossJoin(F.broadcast(by.agg(F.sum(name).alias("all_")))).select("value", name, F.round(F.col(name) / F.col("all_"), 6).alias(f"{name}_share"))  # one row

    def one(col: str) -> DataFrame:
        goal, got = shares(given, col, F.col("n_tokens"), "goal"), shares(mixed, col, F.col("n_tokens") * F.col("n_uses"), "reached")
        return goal.join(got, "value", "left").select(F.lit(col).alias("marginal"), "value", "goal_share", F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"), F.coalesce("reached", F.lit(0)).alias("n_tokens"))

    return one("lang").unionByName(one("topic"))
