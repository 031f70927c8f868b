"""Fill packs of fixed capacity with texts measured in tokens, splitting only what exceeds the capacity.

Texts longer than the capacity give full packs and a remainder. The other items are dealt by hash into groups of about
GROUP_ITEMS. A group's items first go, in the order they come, each into one of the last OPEN bins that has room; then
swap-based local search empties bins: for every bin with room, emptiest first and again while it helps, an item is moved
to, exchanged one for one with, or two are exchanged for one of, an item of a fuller bin, as long as the sum of squared
fills grows. The search of a group ends at the least number of bins its tokens need, when no step is left, or after
SEARCH_STEPS steps. The bins that stay loose are broken up, dealt again over all groups, packed by best fit and searched
once more, so a group's last bin isn't left half empty.

Defined results: null, blank and empty texts and null ids aren't packed; repeated rows of an id and text are packed once;
an item of exactly the capacity fills a pack alone; equal sizes are taken in order of their ids, so the result is the same
every time; an empty table gives no packs; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionframe.session import cut_lineage

GROUP_ITEMS, LOOSE, SEARCH_STEPS, OPEN = 4000, 0.004, 20_000, 40


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k == len(room):
            bins.append([i])
            free, b = capacity - s, len(bins) - 1
        else:
            free, b = room.pop(k)
            bins[b].append(i)
            free -= s
        if free:
            insort(room, (free, b))
    return bins


def first_room(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each, in the order given, into the first of the last OPEN bins that has room."""
    bins: list[list[int]] = []
    fill: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        k = next((k for k in range(max(0, len(bins) - OPEN), len(bins)) if fill[k] + s <= capacity), len(bins))
        if k == len(bins):
            bins.append([])
            fill.append(0)
        bins[k].append(i)
        fill[k] += s
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties bins into fuller ones by moves and swaps that raise the sum of squared fills, at most SEARCH_STEPS of them."""
    fill = np.array([int(sizes[b].sum()) for b in bins], dtype=np.int64)
    least = -(-int(sizes.sum()) // capacity)
    where = np.empty(len(sizes), dtype=np.int64)
    for k, b in enumerate(bins):
        where[b] = k
    alive, steps, before = len(bins), 0, -1
    while steps != before:
        before = steps
        for d in np.argsort(fill, kind="stable").tolist():
            if alive <= least or steps >= SEARCH_STEPS:
                return [b for b in bins if b]
            steps += _empty_into_others(d, bins, fill, where, sizes, capacity, SEARCH_STEPS - steps)
            alive = int((fill > 0).sum())
    return [b for b in bins if b]


def _empty_into_others(d: int, bins: list[list[int]], fill: np.ndarray, where: np.ndarray, sizes: np.ndarray, capacity: int, budget: int) -> int:
    """Takes steps that make bin ``d`` emptier and a fuller one fuller until there is none; how many were taken."""
    steps = 0
    if fill[d] < capacity:
        while bins[d] and steps < budget:
            able = (fill > 0) & (fill < capacity) & (fill >= fill[d])
            able[d] = False
            others = np.flatnonzero(able)
            if not len(others) or (capacity - fill[others]).sum() < fill[d]:
                break
            mine = np.array(sorted(bins[d], key=lambda i: (-sizes[i], i)))
            free = capacity - fill
            a, b, gain, target = None, None, 0, -1
            fits = others[np.argsort(free[others], kind="stable")]
            for i in mine.tolist():  # a move
                k = int(np.searchsorted(free[fits], sizes[i]))
                if k < len(fits):
                    a, gain, target = [i], int(sizes[i]), int(fits[k])
                    break
            if a is None:
                theirs = np.flatnonzero(able[where])
                most = sizes[theirs] + free[where[theirs]]  # the largest thing that could stand in an item's place
                pair_i, pair_j = np.triu_indices(len(mine), 1)
                things = np.concatenate([sizes[mine], sizes[mine[pair_i]] + sizes[mine[pair_j]]])
                order = np.argsort(things, kind="stable")
                at = np.searchsorted(things[order], most, side="right") - 1
                delta = np.where(at >= 0, things[order[np.maximum(at, 0)]] - sizes[theirs], 0)
                k = int(np.argmax(delta))
                if delta[k] <= 0:
                    break
                t, gain, target, b = int(order[at[k]]), int(delta[k]), int(where[theirs[k]]), int(theirs[k])
                a = [int(mine[t])] if t < len(mine) else [int(mine[pair_i[t - len(mine)]]), int(mine[pair_j[t - len(mine)]])]
            for i in a:
                bins[d].remove(i)
                bins[target].append(i)
                where[i] = target
            if b is not None:
                bins[target].remove(b)
                bins[d].append(b)
                where[b] = d
            fill[d] -= gain
            fill[target] += gain
            steps += 1
    return steps


def pack(sizes: np.ndarray, capacity: int, start=best_fit) -> np.ndarray:
    """The bin of every item, by local search from the bins of ``start``."""
    out = np.zeros(len(sizes), dtype=np.int64)
    for k, b in enumerate(local_search(start(sizes, capacity), sizes, capacity)):
        out[b] = k
    return out


_ITEMS = "pack_name string, capacity bigint, id bigint, piece int, tok_start bigint, n_tokens bigint"


def _packed(items: DataFrame, level: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
        at = pack(pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]), first_room if level == 1 else best_fit)
        return pdf[["pack_name", "capacity", "id", "piece", "tok_start", "n_tokens"]].assign(pack_id=[f"{level}-{g}-{k}" for g, k in zip(pdf["grp"], at, strict=True)])

    counted = items.groupBy("pack_name").agg(F.ceil(F.count(F.lit(1)) / GROUP_ITEMS).cast("bigint").alias("n_groups"))
    dealt = items.join(F.broadcast(counted), "pack_name").withColumn("grp", F.pmod(F.xxhash64("id", "piece", F.lit(level)), F.col("n_groups")))  # a row a pack size
    return dealt.drop("n_groups").groupBy("pack_name", "grp").applyInPandas(one, _ITEMS + ", pack_id string")


def packs(sized: DataFrame, capacities: DataFrame) -> DataFrame:
    """``pack_name, pack_id, id, piece, tok_start, n_tokens``: every item of every text in its pack, for every capacity.

    ``sized``: id, n_tokens; ``capacities``: pack_name, capacity (a handful of rows).
    """
    one = sized.crossJoin(F.broadcast(capacities.filter("capacity > 0")))  # each text once a pack size
    pieces = one.select(
        "pack_name", F.col("capacity").cast("bigint").alias("capacity"), "id", "n_tokens",
        F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / F.col("capacity")) - 1).cast("int"))).alias("piece"),
    ).withColumn("tok_start", F.col("piece") * F.col("capacity")).withColumn("n_tokens", F.least("capacity", F.col("n_tokens") - F.col("tok_start")))
    full = pieces.filter("n_tokens = capacity").withColumn("pack_id", F.concat_ws("-", F.lit("f"), "id", "piece"))
    first = cut_lineage(_packed(pieces.filter("n_tokens < capacity"), 1))
    loose = first.groupBy("pack_name", "pack_id").agg(F.sum("n_tokens").alias("used"), F.first("capacity").alias("c")).filter(F.col("used") < (1 - LOOSE) * F.col("c")).select("pack_name", "pack_id")
    again = _packed(first.join(loose, ["pack_name", "pack_id"], "left_semi").drop("pack_id"), 2)
    cols = ["pack_name", "pack_id", "id", "piece", "tok_start", "n_tokens"]
    return full.select(cols).unionByName(first.join(loose, ["pack_name", "pack_id"], "left_anti").select(cols)).unionByName(again.select(cols))


def pack_summary(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack size: packs, items, tokens, the least number of packs the tokens need, and the share of room unused."""
    by = packed.groupBy("pack_name").agg(F.countDistinct("pack_id").alias("n_packs"), F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    c = F.col("capacity")
    return by.join(capacities, "pack_name").select("pack_name", c, "n_packs", "n_items", "n_tokens", F.ceil(F.col("n_tokens") / c).alias("least_packs"), F.round(1 - F.col("n_tokens") / (F.col("n_packs") * c), 6).alias("unused_share"))
