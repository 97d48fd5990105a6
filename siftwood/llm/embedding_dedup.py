"""Embedding near-duplicates by E8 lattice hashing.

Each of `TABLES` tables projects a vector to 16 Gaussian directions and decodes them as two E8 lattice points of the
unit vector; the pair of points is the vector's cell. The vector also enters the four neighbouring cells nearest to it in
either half. A pair at cosine 0.98 shares no cell of any table with probability 1e-5 (each table: 0.10, as simulated).
Vectors that share a cell are verified by cosine in double precision, in bounded units of work that
return counts and spanning forests, never a row for each pair. Vectors of a group above `BLOCK_ROWS` different ones are sent once for each block.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component, and any
vector whose label or id is null, links with nothing and is its own component. Equal vectors of one label are linked; repeated
rows count as copies. Vectors of different lengths are never linked. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm import kernel, lattice
from siftwood.llm.blocks import block_units, candidate_pairs, dealt, forest, leaders_of
from siftwood.llm.common import Scratch, connected_components, groups, min_spread, with_roots

TABLES, BLOCKS, CELL, PROBES = 5, 2, 1.25, 4
BLOCK_ROWS, BLOCK_BYTES = 2048, 16_000_000


@lru_cache(maxsize=8)
def _projection(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(88_000 + dim)
    return rng.normal(size=(TABLES, dim, 8 * BLOCKS)) / CELL, rng.random((TABLES, 8 * BLOCKS)) * 4


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cell_keys(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(vectors, keys) of the cells that unit vectors enter."""
    proj, shift = _projection(x.shape[1])
    out = []
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            z = x @ proj[t] + shift[t]
            halves = []
            for b in range(BLOCKS):
                cells = (lattice.with_neighbours(z[:, 8 * b : 8 * b + 8], PROBES) * 2).astype(np.int64).view(np.uint64)
                h = np.full(cells.shape[:2], t * 64 + b + x.shape[1] * 4096, np.uint64)
                for k in range(8):
                    h = kernel.mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
                halves.append(h)
            base, far = halves
            pairs = [(base[:, :1], far[:, :1]), (base[:, 1:], far[:, :1]), (base[:, :1], far[:, 1:])]
            out += [kernel.mix(a * np.uint64(3) + b * np.uint64(5)) for a, b in pairs]
        return kernel.mix(np.concatenate(out, axis=1) + kernel.mix(label.astype(np.int64).view(np.uint64))[:, None]).view(np.int64)


def _keys(batches):
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = batch.column(2).to_pylist()
        dims = np.array([len(r) for r in rows])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for cut in np.array_split(at, max(1, len(at) // 4096)):
                keys = cell_keys(_unit([rows[i] for i in cut]), labels[cut])
                yield pa.RecordBatch.from_arrays([pa.array(ids[cut]), kernel.long_list(keys.ravel(), np.full(len(cut), keys.shape[1]))], ["id", "keys"])


def _judge(threshold: float):
    def run(batches):
        for (leader, bi, bj), t in groups(batches, ["leader", "bi", "bj"]):
            ids = t["id"].to_numpy()
            _, keep = np.unique(ids, return_index=True)
            if len(keep) < 2:
                continue
            t, ids = t.take(pa.array(keep)), ids[keep]
            rows, label, copies = t["embedding"].to_pylist(), t["label"].to_numpy(), t["copies"].to_numpy()
            dim = np.array([len(r) for r in rows])
            units = {d: _unit([rows[i] for i in np.flatnonzero(dim == d)]) for d in np.unique(dim)}
            place = np.zeros(len(ids), np.int64)
            for d in units:
                place[dim == d] = np.arange(len(units[d]))
            n = len(ids)
            weight, low = np.zeros(n), np.arange(n)
            for ia, ib in candidate_pairs(t["side"].to_numpy(), bi != bj, leader, [np.array(x, np.int64) for x in t["leaders"].to_pylist()]):
                ok = (label[ia] == label[ib]) & (dim[ia] == dim[ib])
                ia, ib = ia[ok], ib[ok]
                ok = np.zeros(len(ia), bool)
                for d, x in units.items():
                    at = np.flatnonzero(dim[ia] == d)
                    if len(at):
                        u, iu = np.unique(place[ia[at]], return_inverse=True)
                        ok[at] = (x[u] @ x.T)[iu, place[ib[at]]] >= threshold
                ia, ib = ia[ok], ib[ok]
                if len(ia):
                    weight += np.bincount(ia, copies[ib], n) + np.bincount(ib, copies[ia], n)
                    low = forest(n, np.concatenate([np.arange(n), ia]), np.concatenate([low, ib]), ids)
            hit = np.flatnonzero(weight)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(weight[hit].astype(np.int64)), pa.array(ids[low[hit]])], ["id", "links", "low"])

    return run


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept (the row's id is its component's)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    valid = F.coalesce(F.expr(f"vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {finite}"), F.lit(False))
    good = v.where(valid)
    classes = scratch.write(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    buckets = classes.select("id", "label", "embedding").mapInArrow(_keys, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    led = scratch.write(leaders_of(scratch.write(buckets, "buckets"), scratch).join(classes.select("id", F.size("embedding").alias("d")), "id"), "led")
    items = led.drop("d").join(classes, "id")
    units = block_units(items, led.select("id", "leaders", (F.col("d") * 8).alias("cost")), BLOCK_ROWS, BLOCK_BYTES, scratch)
    found = scratch.write(dealt(units, min_spread(spark)).mapInArrow(_judge(threshold), "id long, links long, low long"), "found")
    comps = with_roots(connected_components(found.selectExpr("id AS u", "low AS v"), scratch)).withColumnRenamed("node", "id")
    of = classes.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(comps, "id", "left")
    out = (
        good.join(of, ["label", "embedding"])
        .select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .unionByName(v.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    )
    return scratch.keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
