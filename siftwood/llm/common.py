"""Shared plumbing of the training-data operators: tables, scratch storage, components, Arrow groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.storage import Scratch, spread

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one too small to fill the cores by itself is spread over them."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (u, v).

    Alternating large-star and small-star rounds; their number grows with the logarithm of the longest chain. Every round is written to
    shared storage. The smallest neighbours are written too before they are joined: a written side is shuffled by itself, so where one node
    has most of the edges, adaptive execution can split its partition. Nodes without an edge to another node are left out.
    """
    e = scratch.write(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), f"{name}-0")
    seen = None
    for k in range(1, max_rounds + 1):
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low-{k}")
        large = scratch.write(both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct(), f"{name}-large-{k}")
        # small star: every smaller-or-equal neighbour of u, and u, go to the smallest
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least-{k}")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.selectExpr("x.v AS u", "x.m AS v").where("u <> v").distinct()
        e = scratch.write(small, f"{name}-{k}")
        for old in (f"{name}-{k - 1}", f"{name}-low-{k}", f"{name}-large-{k}", f"{name}-least-{k}"):
            scratch.drop(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.selectExpr("u AS node", "v AS component")
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def with_roots(components: DataFrame) -> DataFrame:
    """Adds each component's root, which has no edge of its own."""
    return components.unionByName(components.selectExpr("component AS node", "component").distinct())


#: Equal rows that one task numbers at once.
STEP = 4096


def numbered(counted: DataFrame, keys: list[str], step: int | None = None) -> DataFrame:
    """A row for each of the n equal rows that a row (keys, n, others) counts, with `ordinal` from 0 to n - 1.

    A large n is dealt out in steps before it becomes rows, so equal rows never pass through one task, and the numbers don't depend on the layout.
    """
    step, one = step or STEP, F.lit(0).cast("long")
    few = counted.where(F.col("n") <= step).withColumn("ordinal", F.explode(F.sequence(one, F.col("n") - 1)))
    parts = counted.where(F.col("n") > step).withColumn("from_", F.explode(F.sequence(one, F.col("n") - 1, F.lit(step).cast("long"))))
    many = parts.repartition(*keys, "from_").withColumn("ordinal", F.explode(F.sequence(F.col("from_"), F.least(F.col("from_") + step, F.col("n")) - 1))).drop("from_")
    return few.unionByName(many)


def shuffled(df: DataFrame) -> DataFrame:
    """Marks a side of a join whose size grows with the data: it is never broadcast, so the plan is the same at every size."""
    return df.hint("merge")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys of a partition sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(n, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(cut).tolist(), n]
        for a, b in zip(at, at[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def min_spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
