"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Documents become sets of word 5-grams. Documents with equal sets form a class, which takes part once.
MinHash bands propose candidates (32 bands of 4 values: a pair at similarity 0.8 shares no
band with probability 5e-8). Candidates' 128 MinHash values are compared sixteen at a time; a pair is dropped
when the posterior probability (uniform prior) that its similarity reaches the threshold is below
`tolerance`. What is left is verified exactly on whole sets.

Pairs exist only inside bounded units of work (see `blocks`): a unit returns link counts and a
spanning forest, one row for each item that has a link. Items of a group above `BLOCK_ROWS` distinct sets are sent once for each block.

Defined cases: words are lower-cased runs of non-white-space. Very long texts take part whole, in a slice of their own. Ties do not arise:
components and classes are named by their smallest id. A text of one to four words has one gram of all of them; a
null or empty text has none and links with nothing. Equal sets are links. Rows without doc_id are
returned, with class_id null when no copy has an id. Repeated rows are copies of each other; rows that
repeat a doc_id with another text count as one document. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.llm import kernel
from siftwood.llm.blocks import block_units, candidate_pairs, dealt, forest, leaders_of
from siftwood.llm.common import Scratch, connected_components, groups, min_spread, shuffled, with_roots

GRAM, THRESHOLD, BANDS, ROWS, STEP = 5, 0.8, 32, 4, 16
HASHES = BANDS * ROWS
BLOCK_ROWS, BLOCK_GRAMS = 2048, 2_000_000


def _grams(column: pa.Array, k: int):
    """For each slice of the column: (first document, counts, sorted distinct gram hashes of each document)."""
    data, offs = kernel.text_buffers(pc.utf8_lower(column))
    for a, b in kernel.doc_slices(offs):
        part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        starts, ends, first = kernel.words(part, at)
        w = kernel.word_hashes(part, starts, ends)
        n = np.diff(first)
        g = kernel.gram_hashes(w, k)
        # a gram belongs to the document of its first word, if its last is there too
        doc = np.repeat(np.arange(b - a), n)
        inside = doc[: len(g)] == doc[k - 1 :] if len(g) else np.zeros(0, bool)
        g, gd = g[inside], doc[: len(g)][inside]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            with np.errstate(over="ignore"):
                extra = np.array([kernel.mix(np.bitwise_xor.reduce(kernel.mix(w[first[d] : first[d + 1]] + np.arange(n[d], dtype=np.uint64))) + np.uint64(n[d])) for d in short], np.uint64)
            g, gd = np.concatenate([g, extra]), np.concatenate([gd, short])
        order = np.lexsort((g, gd))
        g, gd = g[order], gd[order]
        if len(g):
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
            g, gd = g[new], gd[new]
        yield a, np.bincount(gd, minlength=b - a), g


@lru_cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _minhash(g: np.ndarray, counts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(documents with grams, hashes) of 32-bit minima."""
    counts = counts[counts > 0]
    out = np.empty((len(counts), hashes), np.uint32)
    if not len(counts):
        return out
    mul, xor = _functions(hashes)
    h = (g >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(counts)])
    i = 0
    while i < len(counts):  # pieces that stay in cache
        j = max(i + 1, int(np.searchsorted(at, at[i] + 40_000, side="right")) - 1)
        part, cuts = h[at[i] : at[j]], at[i:j] - at[i]
        for k in range(hashes):
            out[i:j, k] = np.minimum.reduceat((part ^ xor[k]) * mul[k], cuts)
        i = j
    return out


def _bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) of bucket keys."""
    parts = sig.reshape(len(sig), sig.shape[1] // rows, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(parts.shape[:2], np.uint64)
        for r in range(rows):
            key = kernel.mix(key * np.uint64(31) + parts[:, :, r] + np.uint64(0x9E37))
        key = kernel.mix(key + np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return key.view(np.int64)


def _set_sums(g: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for a whole set."""
    out = np.zeros((2, len(counts)), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        at = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
        with np.errstate(over="ignore"):
            out[0, full] = np.add.reduceat(kernel.mix(g + np.uint64(0x1234567)), at)
            out[1, full] = np.add.reduceat(kernel.mix(g ^ np.uint64(0xABCDEF0123456789)), at)
    return out[0].view(np.int64), out[1].view(np.int64)


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, counts, g in _grams(text, k):
                h1, h2 = _set_sums(g, counts)
                keys = _bands(_minhash(g, counts))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(counts)), pa.array(h1), pa.array(h2), pa.array(counts.astype(np.int64)), kernel.long_list(keys.ravel(), np.where(counts > 0, BANDS, 0))],
                    ["doc_id", "h1", "h2", "n", "keys"],
                )

    return run


def _sets(k: int):
    """Whole gram sets and signatures of class representatives; rows of another text with the same id fall out."""

    def run(batches):
        for batch in batches:
            cols = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            w1, w2 = (cols[x].to_numpy(zero_copy_only=False) for x in ("h1", "h2"))
            for a, counts, g in _grams(cols["text"], k):
                n = len(counts)
                h1, h2 = _set_sums(g, counts)
                right = (h1 == w1[a : a + n]) & (h2 == w2[a : a + n]) & (counts > 0)
                sig = np.zeros((n, HASHES), np.uint32)
                sig[counts > 0] = _minhash(g, counts)
                at = np.zeros(n + 1, np.int32)
                np.cumsum(counts * 8, out=at[1:])
                sets = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(g.tobytes())])
                sat = np.arange(n + 1, dtype=np.int32) * (HASHES * 4)
                sigs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(sat), pa.py_buffer(sig.tobytes())])
                out = pa.RecordBatch.from_arrays([cols["id"].slice(a, n), cols["leaders"].slice(a, n), cols["copies"].slice(a, n), sigs, sets], ["id", "leaders", "copies", "sig", "grams"])
                yield out.filter(pa.array(right))

    return run


@lru_cache
def fewest_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest of `compared` MinHash matches with P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Bin(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(compared + 1):
        tail += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if tail >= tolerance:
            return m
    return compared


class Sets:
    """The signatures and whole gram sets of a unit; `linked` judges pairs of them."""

    def __init__(self, sig: np.ndarray, sets: list[np.ndarray]):
        self.sig, self.sets = sig, sets
        self.size = np.array([len(x) for x in sets], np.int64)
        self.numbered: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def linked(self, ia: np.ndarray, ib: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs at or above the threshold: pruned by the posterior, then verified exactly."""
        size, sig = self.size, self.sig
        small, large = np.minimum(size[ia], size[ib]), np.maximum(size[ia], size[ib])
        ok = small >= threshold * large - 1e-9
        ia, ib = ia[ok], ib[ok]
        same = np.zeros(len(ia), np.int32)
        for k in range(0, sig.shape[1], STEP):
            if not len(ia):
                return ia, ib
            same += (sig[ia, k : k + STEP] == sig[ib, k : k + STEP]).sum(1, dtype=np.int32)
            ok = same >= fewest_matches(k + STEP, threshold, tolerance)
            ia, ib, same = ia[ok], ib[ok], same[ok]
        if not len(ia):
            return ia, ib
        both = self._sparse(ia, ib) if len(ia) < len(self.sets) else self._dense(ia, ib)
        ok = both >= threshold * (size[ia] + size[ib] - both) - 1e-9
        return ia[ok], ib[ok]

    def _sparse(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        both = np.empty(len(ia), np.int64)
        for p in range(len(ia)):
            x, y = self.sets[ia[p]], self.sets[ib[p]]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both[p] = np.count_nonzero(y[at] == x)
        return both

    def _dense(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        """Grams are numbered once a unit; one set is marked and counted over all of its partners. Pairs come sorted by their first."""
        if self.numbered is None:
            flat, inv = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.numbered = inv.astype(np.int32), np.concatenate([[0], np.cumsum(self.size)]), np.zeros(len(flat), np.int32)
        inv, cuts, mark = self.numbered
        both = np.empty(len(ia), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], ia[1:] != ia[:-1], [True]]))
        for s, e in zip(edges, edges[1:]):
            own = inv[cuts[ia[s]] : cuts[ia[s] + 1]]
            mark[own] = 1
            if (e - s) * 2 > len(self.sets):
                both[s:e] = np.add.reduceat(mark[inv], cuts[:-1])[ib[s:e]]
            else:
                both[s:e] = [mark[inv[cuts[v] : cuts[v + 1]]].sum() for v in ib[s:e]]
            mark[own] = 0
        return both


def _judge(threshold: float, tolerance: float):
    def run(batches):
        for (leader, bi, bj), t in groups(batches, ["leader", "bi", "bj"]):
            ids = t["id"].to_numpy()
            _, keep = np.unique(ids, return_index=True)  # repeated rows of a representative
            if len(keep) < 2:
                continue
            t, ids = t.take(pa.array(keep)), ids[keep]
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(len(ids), -1)
            sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
            leaders = [np.array(x, np.int64) for x in t["leaders"].to_pylist()]
            copies = t["copies"].to_numpy()
            unit, n = Sets(sig, sets), len(ids)
            links, weight, low = np.zeros(n, np.int64), np.zeros(n), np.arange(n)
            for ia, ib in candidate_pairs(t["side"].to_numpy(), bi != bj, leader, leaders):
                ia, ib = unit.linked(ia, ib, threshold, tolerance)
                if not len(ia):
                    continue
                links += np.bincount(ia, minlength=n) + np.bincount(ib, minlength=n)
                weight += np.bincount(ia, copies[ib], n) + np.bincount(ib, copies[ia], n)
                low = forest(n, np.concatenate([np.arange(n), ia]), np.concatenate([low, ib]), ids)
            if not links.any():
                continue
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(weight[hit].astype(np.int64)), pa.array(ids[low[hit]])], ["id", "classes", "links", "low"])

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, tolerance: float = 1e-7) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with an equal gram set), n_links (other documents at or
    above the threshold, copies included), component_id (smallest id reachable by links) and kept (this row's id is component_id).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    parts = min_spread(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.write(d.mapInArrow(_sketches(gram), "doc_id long, h1 long, h2 long, n long, keys array<long>"), "sketch")
    full = sketch.where("n > 0")
    classes = scratch.write(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("keys").alias("keys")), "classes")
    buckets = classes.where("id IS NOT NULL").select("id", F.explode("keys").alias("key"))
    led = scratch.write(leaders_of(buckets, scratch).join(classes.select("id", "h1", "h2", "copies", "n"), "id"), "led")
    items = shuffled(led).join(d.withColumnRenamed("doc_id", "id"), "id").select("id", "leaders", "copies", "h1", "h2", "text").mapInArrow(_sets(gram), "id long, leaders array<long>, copies long, sig binary, grams binary")
    units = dealt(block_units(items, led.select("id", "leaders", F.col("n").alias("cost")), BLOCK_ROWS, BLOCK_GRAMS, scratch), parts)
    judged = units.mapInArrow(_judge(threshold, tolerance), "id long, classes long, links long, low long")
    found = scratch.write(judged, "found")
    stats = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = with_roots(connected_components(found.selectExpr("id AS u", "low AS v"), scratch)).withColumnRenamed("node", "id")
    of = classes.select("h1", "h2", "id", "copies").join(stats, "id", "left").join(comps, "id", "left").select("h1", "h2", "id", "copies", "links", "component")
    out = (
        full.select("doc_id", "h1", "h2")
        .join(of, ["h1", "h2"])
        .select("doc_id", F.col("id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .unionByName(sketch.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id")))
    )
    return scratch.keep(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull())))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of linked documents (that of smallest id), with all of its columns.

    Of repeated rows of that id one stays. Rows without an id stay, as nothing names them.
    """
    joined = ngram_jaccard_join(docs, id_col, text_col, **options)
    verdict = joined.where("doc_id IS NOT NULL AND kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    kept = docs.join(shuffled(verdict), F.col(id_col).cast("long") == F.col("__kept_id"))
    first = F.row_number().over(Window.partitionBy("__kept_id").orderBy(F.xxhash64(text_col)))
    out = kept.withColumn("__rank", first).where("__rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    out = out.unionByName(docs.where(F.col(id_col).isNull()))
    out._siftwood_scratch = joined._siftwood_scratch
    return out
