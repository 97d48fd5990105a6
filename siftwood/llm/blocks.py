"""Pairwise work on candidate groups of any size, in bounded blocks, without a row for each pair.

Items carry the keys of the buckets that they fall into. A bucket's *leader* is its smallest item; two
items that share a bucket share that bucket's leader, so the groups of items by leader hold every
candidate pair. A group whose cost passes a bound is dealt into blocks, and each pair of blocks is one unit of work. A pair
whose items share several leaders is judged in the group of the smallest one alone.

Counting every link between m different texts takes every pair, so a group of m costs about m * m / 2 comparisons, in tiles of bounded
size, and m * ceil(m / rows) rows. Equal items must be one item before they come here. Aggregated sides are written before they are
joined, so that adaptive execution can split the partition of a key that most rows share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.storage import Scratch

TILE = 1 << 18


def leaders_of(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, leaders): from (id, key) rows, the sorted leaders of the buckets that hold more than one item."""
    low = buckets.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("top")).where("leader <> top").drop("top")
    low = scratch.write(low, "bucket-leaders")
    return buckets.join(low, "key").select("id", "leader").distinct().groupBy("id").agg(F.sort_array(F.collect_list("leader")).alias("leaders"))


def block_units(items: DataFrame, costs: DataFrame, rows: int, cost: int, scratch: Scratch) -> DataFrame:
    """Items (with id and leaders) once for each unit that they take part in: + leader, bi, bj, side.

    costs: (id, leaders, cost); a block holds about `rows` items and a total cost of `cost`. Side 0 of a unit is
    block bi, side 1 is block bj > bi; in a unit with bi = bj all items are on side 0.
    """
    sized = scratch.write(
        costs.select(F.explode("leaders").alias("leader"), "cost")
        .groupBy("leader")
        .agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
        .select("leader", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("c") / cost)).cast("int").alias("nb")),
        "group-sizes",
    )
    own = costs.select("id", F.explode("leaders").alias("leader")).join(sized, "leader").groupBy("id").agg(F.collect_list(F.struct("leader", "nb")).alias("where_"))
    return (
        items.join(own, "id")
        .select("*", F.explode("where_").alias("w_"))
        .drop("where_")
        .withColumn("own_", F.pmod(F.xxhash64("id", "w_.leader"), F.col("w_.nb").cast("long")).cast("int"))
        .withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("w_.nb") - 1)))
        .select(
            "*",
            F.col("w_.leader").alias("leader"),
            F.least("own_", "other_").alias("bi"),
            F.greatest("own_", "other_").alias("bj"),
            (F.col("own_") > F.col("other_")).cast("int").alias("side"),
        )
        .drop("w_", "own_", "other_")
    )


def dealt(units: DataFrame, parts: int) -> DataFrame:
    return units.repartition(parts, "leader", "bi", "bj").sortWithinPartitions("leader", "bi", "bj")


def candidate_pairs(side: np.ndarray, split: bool, leader: int, leaders: list[np.ndarray], tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a unit in tiles of about `tile` pairs, without those that a smaller shared leader's group judges."""
    rows = np.flatnonzero(side == 0) if split else np.arange(len(side))
    cols = np.flatnonzero(side == 1) if split else rows
    low = [x[x < leader] for x in leaders]
    sizes = np.array([len(x) for x in low], np.int64)
    flat, owner = np.concatenate(low) if low else np.zeros(0, np.int64), np.repeat(np.arange(len(low)), sizes)
    step = max(1, tile // max(1, len(cols)))
    for s in range(0, len(rows), step):
        a = rows[s : s + step]
        b = cols if split else cols[s + 1 :]
        if not len(b):
            continue
        free = np.ones((len(a), len(b)), bool) if split else b[None, :] > a[:, None]
        names = np.unique(np.concatenate([low[i] for i in a]))
        if len(names):
            at = np.searchsorted(names, flat)
            at[at == len(names)] = 0
            known = names[at] == flat
            has = np.zeros((len(low), len(names)), np.float32)
            has[owner[known], at[known]] = 1
            free &= (has[a] @ has[b].T) == 0
        x, y = np.nonzero(free)
        if len(x):
            yield a[x], b[y]


def forest(n: int, ia: np.ndarray, ib: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n items, the index of the item of smallest `order` that the links reach."""
    low = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(n)
    back = np.argsort(order, kind="stable")
    r = rank.copy()
    while len(ia):
        before = r.copy()
        np.minimum.at(r, ia, before[ib])
        np.minimum.at(r, ib, r[ia])
        r = np.minimum(r, r[back[r]])
        if (r == before).all():
            break
    low = back[r]
    return low
