"""Sharding by balanced label propagation.

Linked documents (equal texts) move towards the shard that holds most of their neighbours, in rounds
of Spark joins, under a quota for each shard; documents without a link fill what is left, so row counts end at most one apart
(the law is `rows`).

A link group is a hyperedge, so its members read the group's label counts instead of each other's. Its rows are dealt into pieces by a hash, of
at most 64 rows or 1/256 of a shard, and a group above a quarter of a shard fills one shard before the next (`seat`). A round proposes, for each piece,
the shard that most of its group's members share (the next heaviest for the pieces that one shard can't take). Proposals are admitted in hash order: the
most that fit, where rows that leave a shard in the same round make room in it. That is found from sums over hash buckets, at most
8 x `BUCKETS` rows, on the driver. Rounds end when no piece wants to move, at most `ROUNDS`. Groups that never fit whole stay where they lie.

Law and slots are exact and distributed: ranks come from counts per (shard, hash bucket), at most 8 x `BUCKETS` rows of
which are ordered in one place, and row numbers inside a bucket. Labels, buckets and ties are hashes of what a row holds and of a number among equal
rows, never of files or partitions, so reruns agree on any layout.

Defined cases: a null text has size 1 and the checksum of the empty text, and is linked with nothing; empty texts are equal; long texts count whole. Repeated rows
are documents of their own, linked and numbered. Ties between shards are broken by the group's hash. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.llm.common import Scratch, numbered

SHARDS, ROUNDS, BUCKETS = 8, 8, 2048


def _bucket(n: int, *cols):
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


#: What names a row: two hashes of its id, text and number among equal rows.
_ROW = ["ra", "rb"]


def _rank(rows: DataFrame, by: str, buckets: int) -> DataFrame:
    """Adds `rank`, gapless from 0 within each value of `by`: bucket offsets and a row number inside each bucket. rows: bucket, tie, ra, rb."""
    counts = rows.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    # at most (values of by) x buckets rows
    offsets = counts.withColumn("from_", F.sum("n").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select(by, "bucket", F.coalesce("from_", F.lit(0)).alias("from_"))
    inner = rows.withColumn("in_", F.row_number().over(Window.partitionBy(by, "bucket").orderBy("tie", *_ROW)))
    return inner.join(F.broadcast(offsets), [by, "bucket"]).withColumn("rank", (F.col("from_") + F.col("in_") - 1).cast("long")).drop("from_", "in_")


def admitted(adds: np.ndarray, leaves: np.ndarray, load: np.ndarray, quota: int) -> np.ndarray:
    """For each shard, the number of its first buckets whose proposals are admitted: the most for which no shard ends above its quota or its load.

    adds: (to, bucket) rows that would enter; leaves: (to, bucket, shard) rows that would leave a shard for it. Lowering one shard's
    number only takes room from others, so trimming until all fit finds the largest numbers that do.
    """
    shards, buckets = adds.shape
    into = np.concatenate([np.zeros((shards, 1), np.int64), np.cumsum(adds, 1)], 1)
    out = np.concatenate([np.zeros((shards, 1, shards), np.int64), np.cumsum(leaves, 1)], 1)
    cut = np.full(shards, buckets)
    while True:
        left = out[np.arange(shards), cut].sum(0)
        room = np.maximum(quota, load) - load + left
        new = np.array([min(cut[s], int(np.searchsorted(into[s], room[s], side="right")) - 1) for s in range(shards)])
        if (new == cut).all():
            return cut
        cut = new


def first_labels(linked: DataFrame, shards: int) -> DataFrame:
    return linked.withColumn("shard", F.pmod("ra", F.lit(shards)).cast("int"))


def link_pieces(keyed: DataFrame, scratch: Scratch, quota: int) -> DataFrame:
    """(ra, rb, link, piece, seat) of the rows that share a link with another."""
    groups = scratch.write(keyed.where("link IS NOT NULL").groupBy("link").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    limit = max(1, min(quota // 4, max(quota // 256, 64)))
    part = F.pmod("rb", F.ceil(F.col("n") / limit))
    return scratch.write(keyed.join(groups, "link").select(*_ROW, "link", F.xxhash64("link", part).alias("piece"), F.floor(part * limit / max(1, quota)).cast("long").alias("seat")), "linked")


def propagate(linked: DataFrame, scratch: Scratch, quota: int, shards: int, rounds: int) -> DataFrame:
    """(ra, rb, link, piece, seat, shard): balanced label propagation over pieces of link groups. linked: ra, rb, link, piece, seat.

    A group's members count its labels; the piece in seat s wants the group's s-th heaviest shard. From the third round a piece that found
    no room tries the next one.
    """
    at = scratch.write(first_labels(linked, shards), "labels-0")
    for k in range(1, rounds + 1):
        held = [F.count(F.when(F.col("shard") == s, 1)).alias(f"n{s}") for s in range(shards)]
        heaviest = F.array_sort(F.array(*[F.struct((-F.col(f"n{s}")).alias("n"), F.pmod(F.pmod("link", F.lit(shards)) + s, F.lit(shards)).alias("tie"), F.lit(s).alias("s")) for s in range(shards)]))
        order = at.groupBy("link").agg(*held).select("link", F.transform(heaviest, lambda x: x["s"]).alias("order"))
        pieces = at.groupBy("link", "piece", "seat").agg(F.count("*").alias("all"), *held).join(order, "link")
        there = F.array(*[F.col(f"n{s}") for s in range(shards)])
        wish = pieces.withColumn("to", F.expr(f"order[CAST((seat + {max(0, k - 2)}) % {shards} AS INT)]")).withColumn("there", F.element_at(there, F.col("to") + 1))
        # whole pieces stay, as long as no seat before the third round calls them elsewhere
        wish = wish.where(F.col("there") < F.col("all")).where((F.array_max(there) < F.col("all")) | F.lit(k < 3))
        wish = scratch.write(wish.select("piece", "to", _bucket(BUCKETS, "piece", F.lit(k)).alias("b"), (F.col("all") - F.col("there")).alias("adds"), *[F.when(F.col("to") != s, F.col(f"n{s}")).otherwise(0).alias(f"n{s}") for s in range(shards)]), f"wishes-{k}")
        adds, leaves, load = np.zeros((shards, BUCKETS), np.int64), np.zeros((shards, BUCKETS, shards), np.int64), np.zeros(shards, np.int64)
        for r in wish.groupBy("to", "b").agg(F.sum("adds"), *[F.sum(f"n{s}") for s in range(shards)]).collect():  # at most shards x BUCKETS rows
            adds[r[0], r[1]], leaves[r[0], r[1]] = r[2], r[3:]
        for r in at.groupBy("shard").count().collect():
            load[r[0]] = r[1]
        cut = admitted(adds, leaves, load, quota)
        moved = sum(int(adds[s, : cut[s]].sum()) for s in range(shards))
        if moved:
            upto = F.element_at(F.array(*[F.lit(int(c)) for c in cut]), F.col("to") + 1)
            moves = wish.where(F.col("b") < upto).select("piece", "to")
            at = scratch.write(at.join(moves, "piece", "left").select(*_ROW, "link", "piece", "seat", F.coalesce("to", "shard").alias("shard")), f"labels-{k}")
        scratch.drop(f"wishes-{k}")
        if not adds.any():
            break
    return at


def assign(keyed: DataFrame, scratch: Scratch, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """keyed: ra, rb (unique), link (or null). Returns ra, rb, shard, slot."""
    total = keyed.count()
    quota = max(1, total // shards)
    at = propagate(link_pieces(keyed, scratch, quota), scratch, quota, shards, rounds)
    # over a quota (only chance in the first labels makes that), the last in hash order give way and fill like the unlinked
    ranked = _rank(at.withColumn("bucket", _bucket(BUCKETS, "piece")).withColumn("tie", F.xxhash64("piece")), "shard", BUCKETS)
    placed = scratch.write(ranked.select(*_ROW, F.when(F.col("rank") < quota, F.col("shard")).alias("shard")), "placed")
    free = keyed.select(*_ROW).join(placed.where("shard IS NOT NULL").select(*_ROW), _ROW, "left_anti")
    held = {r["shard"]: r["n"] for r in placed.where("shard IS NOT NULL").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # shard s takes quota rows, and one more where s is below the remainder
    gap = [quota + (s < total - quota * shards) - held.get(s, 0) for s in range(shards)] if total >= shards else [int(s < total) - held.get(s, 0) for s in range(shards)]
    ends, upto = [], 0
    for g in gap:
        upto += g
        ends.append(upto)
    fill = _rank(free.select(*_ROW, F.lit(0).alias("one"), _bucket(BUCKETS, "ra").alias("bucket"), F.xxhash64("ra").alias("tie")), "one", BUCKETS)
    shard = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("rank") < ends[s], s).otherwise(shard)
    whole = placed.where("shard IS NOT NULL").select(*_ROW, "shard").unionByName(fill.select(*_ROW, shard.cast("int").alias("shard")))
    whole = scratch.write(whole, "shards")
    slots = _rank(whole.withColumn("bucket", _bucket(BUCKETS, F.lit(7), "ra")).withColumn("tie", F.xxhash64("ra")), "shard", BUCKETS)
    return slots.select(*_ROW, F.col("shard").cast("int").alias("shard"), F.col("rank").alias("slot"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    link = F.when(text.isNotNull(), F.xxhash64(F.md5(text.cast("binary")), F.octet_length(text)))
    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        link.alias("link"),
    )
    keys = ["doc_id", "size", "text_crc32", "link"]
    rows = numbered(thin.groupBy(*keys).agg(F.count("*").alias("n")), keys).drop("n")
    return rows.withColumn("ra", F.xxhash64(F.lit(1), "doc_id", F.lit(1), "link", "ordinal")).withColumn("rb", F.xxhash64(F.lit(2), "doc_id", F.lit(2), "link", "ordinal")).drop("ordinal")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under the law `rows`), and link, a hash that equal texts share."""
    scratch = Scratch(docs.sparkSession, "sharding")
    keyed = scratch.write(_keyed(docs, id_col, text_col), "keyed")
    out = keyed.join(assign(keyed.select(*_ROW, "link"), scratch, shards, rounds), _ROW)
    return scratch.keep(out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "link"))


def cut_groups(sharded: DataFrame) -> DataFrame:
    """One row: linked groups, groups in more than one shard, linked rows, and rows away from the shard that holds most of their group."""
    held = sharded.where("link IS NOT NULL").groupBy("link", "shard").agg(F.count("*").alias("n")).groupBy("link").agg(F.count("*").alias("shards"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return held.agg(F.count("*").alias("groups"), F.count(F.when(F.col("shards") > 1, 1)).alias("cut_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("linked_rows"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("rows_away"))
