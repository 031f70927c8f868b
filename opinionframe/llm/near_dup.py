"""Near-duplicate texts by shared words, over collections too large to compare each with each.

Two texts are linked if the multiset of words they share holds at least THRESHOLD of the longer one's words; order, case
and punctuation don't matter. The search is a byte-position inverted index with count filtering:

* The k-th occurrence of a word is a token of its own, so shared words are plain set intersections. Every text, long or
  short, gets a signature of POSITIONS bytes: byte p comes from the token that is least under the p-th hash function. Two
  texts agree at a position with the probability J = shared / (tokens of either), by chance once in 256.
* The index lists each text under the bytes of every RUN neighbouring positions: POSITIONS / RUN postings a text, whatever
  its length, each with the text's length and its first TALLIED bytes.
* Texts that meet under a key must pass the length filter; then their shared positional bytes are tallied, in the JVM,
  on 64-bit words, and pairs with at least MIN_TALLY are retained. Linked pairs have J >= 2/3, so 42.7 of 64 bytes are
  expected to agree, and MIN_TALLY is five deviations below. The shared words of what is left are counted exactly.

A linked pair is found unless none of its 40 runs agrees: at most 1.3e-4 at the very threshold (J = 2/3), 2e-7 at J = 0.75,
1e-12 at J = 0.85. Against brute force over all reviews no pair was lost (see the tests and the README).

Texts with equal words are one class from the start: links are between classes, and membership is kept beside them, so a
text copied a million times costs as one. Keys with more than BLOCK postings are known before anything is sent: their
postings go to pairs of blocks, each a key of its own for the join, so no task gets a hot list whole.

Defined results: null and blank texts, and texts with fewer than MIN_WORDS words, are linked to nothing; repeated rows of
an id count once; an id with several texts links by any of them but never to itself; no cap on links; long texts are
read whole; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionframe.llm.textnorm import hash64
from opinionframe.session import cut_lineage, drop_written

THRESHOLD, MIN_WORDS = 0.8, 30
POSITIONS, RUN, TALLIED, MIN_TALLY = 160, 4, 64, 24
BLOCK, BROADCAST_ROWS = 2000, 100_000
#: Words in Latin or Cyrillic letters, or numbers.
_WORD = re.compile(r"[a-zªºß-öø-ʯḀ-ỿЀ-ԯᲀ-ᲈⷠ-ⷿꙀ-ꚟ̀-ͯ]+|\d+")
_SEEDS = np.random.default_rng(17).integers(0, 2**32, POSITIONS, dtype=np.uint32)
#: The number of each run of four bytes, above its bytes in a key.
_RUNS = np.arange(POSITIONS // RUN, dtype=np.int64) << 32


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("ё", "е"))


def shared_needed(n: int) -> int:
    """The words two texts must share if the longer one has ``n`` (in whole numbers, so that 0.8 is exact)."""
    return (4 * n + 4) // 5


def signature(tokens: np.ndarray) -> np.ndarray:
    """POSITIONS bytes of a set of 64-bit tokens; a part of the tokens at a time, so that long texts need little room."""
    x = (tokens.view(np.uint64) >> np.uint64(16)).astype(np.uint32)
    least = np.full(POSITIONS, 2**32 - 1, dtype=np.uint32)
    for s in range(0, len(x), 2048):
        m = x[s : s + 2048, None] ^ _SEEDS
        m *= np.uint32(0x85EBCA6B)
        m ^= m >> np.uint32(15)
        m *= np.uint32(0xC2B2AE35)
        m ^= m >> np.uint32(13)
        least = np.minimum(least, m.min(axis=0))
    return (least & np.uint32(255)).astype(np.uint8)


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, int] = {}
    for b in batches:
        out = []
        for i, t in zip(b["id"], b["text"], strict=True):
            ws = words(t)
            if len(ws) < MIN_WORDS:
                continue
            ws.sort()
            cls = hashlib.md5(" ".join(ws).encode()).hexdigest()
            toks, last, k = np.empty(len(ws), dtype=np.int64), None, 0
            for at, w in enumerate(ws):
                k = k + 1 if w == last else 0
                last = w
                key = f"{w} {k}" if k else w
                h = seen.get(key)
                if h is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    h = seen[key] = hash64(key)
                toks[at] = h
            sig = signature(toks)
            out.append((i, cls, toks, sig[:TALLIED].view("<i8"), sig.view("<u4").astype(np.int64) + _RUNS))
        yield pd.DataFrame(out, columns=["id", "cls", "toks", "sig", "keys"])


def text_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, cls, toks, sig, keys`` of every text long enough: texts with equal words have equal ``cls``. ``sig`` holds the
    tallied bytes, eight to a number, and ``keys`` the runs the index lists the text under."""
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").distinct()
    return rows.mapInPandas(_classes, "id string, cls string, toks array<bigint>, sig array<bigint>, keys array<bigint>")


def in_blocks(rows: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, to be joined on ``key, x, y`` so that all pairs of a key meet once a direction and no join key has
    more than about BLOCK rows a side: rows of larger keys are dealt into blocks (by ``by``) and sent to every pair of blocks
    of theirs. The list of larger keys is broadcast only if it is short."""
    large = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK).select(key, F.ceil(F.col("c") / BLOCK).cast("int").alias("nb")))
    n = large.count()
    if not n:
        plain = rows.withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
        return plain, plain
    known = rows.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    dealt = known.withColumn("own", F.pmod(F.xxhash64(by), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    keep = rows.columns
    return dealt.select(*keep, F.col("own").alias("x"), F.col("other").alias("y")), dealt.select(*keep, F.col("other").alias("x"), F.col("own").alias("y"))


def _differing_bytes(a: Column, b: Column) -> Column:
    """In how many of its eight bytes one 64-bit word differs from another."""
    d = a.bitwiseXOR(b)
    for by in (4, 2, 1):
        d = d.bitwiseOR(F.shiftrightunsigned(d, by))
    return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))


def class_links(classes: DataFrame) -> DataFrame:
    """``cls_a, cls_b, shared, longer``: every pair of different classes that is linked, once (cls_a < cls_b).

    ``classes`` has a row for each text; it should be written or checkpointed.
    """
    one = cut_lineage(
        classes.groupBy("cls").agg(F.first("toks").alias("toks"), F.first("sig").alias("sig"), F.first("keys").alias("keys")).withColumn("cid", F.conv(F.substring("cls", 1, 15), 16, 10).cast("bigint")).withColumn("n", F.size("toks"))
    )
    tallied = range(TALLIED // 8)
    posted = one.select("cid", "n", *(F.element_at("sig", k + 1).alias(f"s{k}") for k in tallied), F.explode("keys").alias("key"))
    left, right = in_blocks(posted, "key", "cid")
    a, b = left.alias("a"), right.alias("b")
    longer, shorter = F.greatest("a.n", "b.n"), F.least("a.n", "b.n")
    differing = sum((_differing_bytes(F.col(f"a.s{k}"), F.col(f"b.s{k}")) for k in tallied), F.lit(0))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.cid") < F.col("b.cid")) & (shorter * 5 >= longer * 4) & (differing <= TALLIED - MIN_TALLY))
    kept = met.select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).distinct()
    a = one.select(F.col("cid").alias("a"), F.col("cls").alias("cls_1"), F.col("toks").alias("toks_1"))
    b = one.select(F.col("cid").alias("b"), F.col("cls").alias("cls_2"), F.col("toks").alias("toks_2"))
    checked = kept.join(a, "a").join(b, "b").select(
        F.least("cls_1", "cls_2").alias("cls_a"), F.greatest("cls_1", "cls_2").alias("cls_b"), F.size(F.array_intersect("toks_1", "toks_2")).alias("shared"), F.greatest(F.size("toks_1"), F.size("toks_2")).alias("longer")
    )
    return checked.filter(F.col("shared") * 5 >= F.col("longer") * 4)


def linked_ids(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): links and equal texts expanded to ids."""
    m = cut_lineage(members.select("id", "cls").distinct())
    x, y = m.select(F.col("id").alias("i"), F.col("cls").alias("cls_a")), m.select(F.col("id").alias("j"), F.col("cls").alias("cls_b"))
    across = links.select("cls_a", "cls_b").join(x, "cls_a").join(y, "cls_b").select("i", "j")
    several = m.groupBy("cls").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("cls")
    left, right = in_blocks(m.join(several, "cls"), "cls", "id")
    within = left.withColumnRenamed("id", "i").join(right.withColumnRenamed("id", "j"), ["cls", "x", "y"]).filter("i < j").select("i", "j")
    return across.unionByName(within).filter("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as stars: every node with the smallest one it is connected with inside the partition."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b["s"], b["t"], strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    at = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame([(x, r) for x, r in at if x != r], columns=["s", "t"], dtype=object)


def components(nodes: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node linked to each node directly or through others.

    ``nodes`` has one column ``node`` of strings. The links are first contracted within partitions, by either end in turn,
    which leaves few and short paths. Each round then takes the smallest label among the neighbours and follows labels
    once more, which halves the remaining paths, so long chains need few rounds.
    """
    short = links.select(F.col(a).alias("s"), F.col(b).alias("t"))
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for key in ("s", "s", "t", "s"):
        short = short.repartition(parts, key).mapInPandas(_contracted, "s string, t string")
    short = cut_lineage(short.distinct(), in_loop=True)
    edges = cut_lineage(short.unionByName(short.select(F.col("t").alias("s"), F.col("s").alias("t"))), in_loop=True)
    labels = last = cut_lineage(edges.groupBy("s").agg(F.least(F.first("s"), F.min("t")).alias("l")), in_loop=True)
    while True:
        best = edges.join(labels.withColumnRenamed("s", "t"), "t").groupBy("s").agg(F.min("l").alias("m"))
        near = labels.join(best, "s").select("s", F.least("l", "m").alias("l"), F.col("l").alias("before"))
        jump = near.select(F.col("s").alias("l"), F.col("l").alias("j"))
        now = cut_lineage(near.join(jump, "l").select("s", F.least("l", "j").alias("l"), "before"), in_loop=True)
        drop_written(last)
        last = now
        if now.filter("l <> before").isEmpty():
            break
        labels = now.select("s", "l")
    return nodes.join(now.select(F.col("s").alias("node"), "l"), "node", "left").select("node", F.coalesce("l", "node").alias("component"))


def near_duplicate_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a document: ``id, class_id, n_copies, n_links, group_id``.

    ``n_copies`` ids have the same words, ``n_links`` other classes are near, and ``group_id`` joins what is linked
    directly or through others. Documents too short to be compared don't appear.
    """
    members = cut_lineage(text_classes(docs, key, text))
    links = cut_lineage(class_links(members))
    sizes = members.groupBy("cls").agg(F.countDistinct("id").alias("n_copies"))
    degree = links.select(F.col("cls_a").alias("cls")).unionByName(links.select(F.col("cls_b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    groups = components(sizes.select(F.col("cls").alias("node")), links, "cls_a", "cls_b").withColumnRenamed("node", "cls")
    facts = sizes.join(degree, "cls", "left").join(groups, "cls")
    return members.select("id", "cls").distinct().join(facts, "cls").select("id", F.col("cls").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("component").alias("group_id"))
