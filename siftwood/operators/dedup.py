"""Exact and fuzzy dedup of result documents and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import count, pairwise
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions.similar import Matcher, Seen, reaches
from siftwood.functions.text import text_signature
from siftwood.session import ensure_importable
from siftwood.storage import Scratch


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in a total order. Rows whose keys are all null or empty are all kept; they take no part in the window."""
    empty = reduce(and_, [F.coalesce(F.col(k).cast("string"), F.lit("")) == "" for k in keys])
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.where(~empty).withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_").unionByName(df.where(empty))


def dedup_chunks(chunks: DataFrame, doc_col: str, text_col: str = "chunk", order: str = "chunk_id") -> DataFrame:
    """Per document, the first chunk of each 1000-character signature."""
    keyed = chunks.withColumn("sig_", text_signature(F.col(text_col), 1000))
    return keep_first(keyed, [doc_col, "sig_"], [order]).drop("sig_")


def ordered_distinct(df: DataFrame, value: str, pos: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def dedup_docs(docs: DataFrame, query: str, url: str, signature: str, pos: str, threshold: float = 0.9, min_signature: int = 80) -> DataFrame:
    """Keeps the first document of each canonical URL, and of documents alike to `threshold`, in order of `pos` within a query.

    A query holds tens of hits, so the order-dependent comparison with the documents kept so far runs on one query's
    rows at a time. A dropped document leaves neither its URL nor its text behind.
    """
    ensure_importable(docs.sparkSession)

    def keep(rows: pa.Table) -> pa.Table:
        seen, urls, out = Seen(threshold), set(), []
        names, sigs = rows[url].to_pylist(), rows[signature].to_pylist()
        for i in pc.sort_indices(rows[pos]).to_pylist():
            s = sigs[i] or ""
            if (names[i] and names[i] in urls) or (len(s) >= min_signature and seen.like(s)):
                continue
            out.append(i)
            urls.add(names[i])
            if s:
                seen.add(s)
        return rows.take(pa.array(out, pa.int64()))

    return docs.groupBy(query).applyInArrow(keep, docs.schema)


#: Characters of the signatures hashed at once, whose shingles stay in cache.
_AT_ONCE = 1 << 15


def _minhash(signature: Column, bands: int, rows: int, shingle: int) -> Column:
    """One key a band: a hash of the minima of `rows` hash functions over the shingles; none for null. Signatures are no shorter than a shingle."""
    rng = np.random.default_rng(7)
    odd, add = rng.integers(1, 2**63, bands * rows, np.uint64) | np.uint64(1), rng.integers(0, 2**63, bands * rows, np.uint64)
    mix = rng.integers(1, 2**63, rows, np.uint64) | np.uint64(1)

    def keys(texts: list[str]) -> np.ndarray:
        sizes = np.array([len(s) for s in texts])
        codes, ends = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), np.cumsum(sizes)
        inside, h = np.ones(len(codes), bool), np.uint64(0)
        for i in range(shingle):
            h = (h + codes[i : len(codes) - shingle + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            inside[ends[:, None] - np.arange(1, i + 1)] = False
        h = h[inside[: len(h)]]
        cuts, low = ends - sizes - np.arange(len(sizes)) * (shingle - 1), np.empty((len(sizes), bands * rows), np.uint64)
        x, y = np.empty_like(h), np.empty_like(h)
        for k in range(bands * rows):
            np.multiply(h, odd[k], out=x)
            np.add(x, add[k], out=x)
            np.right_shift(x, np.uint64(31), out=y)
            np.bitwise_xor(x, y, out=x)
            low[:, k] = np.minimum.reduceat(x, cuts)
        out = (low.reshape(-1, bands, rows) * mix).sum(2, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(bands, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(shingle)
        return (out ^ (out >> np.uint64(32))).view(np.int64)

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        given = [i for i, s in enumerate(texts) if s is not None]
        out: list = [[]] * len(texts)
        slices = np.cumsum([len(texts.iloc[i]) for i in given]) // _AT_ONCE
        for part in np.split(np.array(given, int), np.flatnonzero(np.diff(slices)) + 1) if given else ():
            for i, k in zip(part, keys([texts.iloc[i] for i in part])):
                out[i] = k
        return pd.Series(out, dtype=object)

    return of(signature)


def _sharing(low: object, keys: list[np.ndarray], lows: list[np.ndarray]) -> np.ndarray:
    """Which items, the first before the second, share a key whose bucket `low` leads and none with a smaller leader."""
    flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    leads = np.concatenate(lows)
    flat, owner, leads = flat[leads <= low], owner[leads <= low], leads[leads <= low]
    order = np.lexsort((flat, -leads))  # smaller leaders come last and take their pairs away
    flat, owner, leads = flat[order], owner[order], leads[order]
    ends = np.append(np.flatnonzero((flat[1:] != flat[:-1]) | (leads[1:] != leads[:-1])) + 1, len(flat))
    out, begin = np.zeros((len(keys), len(keys)), bool), 0
    for end in ends:
        if end - begin > 1:
            out[np.ix_(owner[begin:end], owner[begin:end])] = leads[begin] == low
        begin = end
    return np.triu(out, 1)


def _links(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs (low, id) that are alike, of rows that come unit by unit and in order of id: each pair in the group of its smallest shared leader alone.

    Lengths and letters (in 512 classes) reject most pairs of a unit at once, by the bounds that `Seen` has.
    """

    def linked(unit: pa.Table) -> pa.RecordBatch:
        ids, own, texts = unit["id"], unit["own"].to_numpy(), unit["s"].to_pylist()
        out = _sharing(unit["low"][0].as_py(), *([x.values.to_numpy() for x in unit[c].combine_chunks()] for c in ("keys", "lows")))
        if unit["bi"][0] != unit["bj"][0]:
            out &= own[:, None] != own
        x, y = np.nonzero(out)
        size = np.array([len(s) for s in texts])
        near = 2 * np.minimum(size[x], size[y]) >= threshold * (size[x] + size[y])
        x, y = x[near], y[near]
        named = np.unique(np.concatenate((x, y)))
        letters = np.array([np.bincount(np.frombuffer(texts[i].encode("utf-32-le"), np.uint32) & 511, minlength=512) for i in named], np.int32).reshape(-1, 512)
        gone = np.zeros(len(x), bool)
        for at in range(0, len(x), 4096):
            cut = slice(at, at + 4096)
            common = np.minimum(letters[np.searchsorted(named, x[cut])], letters[np.searchsorted(named, y[cut])]).sum(1)
            gone[cut] = 2 * common < threshold * (size[x[cut]] + size[y[cut]])
        x, y, matcher, of = x[~gone], y[~gone], Matcher(""), -1
        alike = np.zeros(len(x), bool)
        for at, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
            if i != of:
                matcher, of = Matcher(texts[i]), i
            matcher.set_seq1(texts[j])
            alike[at] = reaches(matcher, threshold)
        ids = ids.combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x[alike])), ids.take(pa.array(y[alike]))], ["low", "id"])

    held: list[pa.Table] = []
    names = ("low", "bi", "bj")
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        units = list(zip(*(table[c].to_pylist() for c in names)))
        cuts = [0, *(i for i in range(1, len(units)) if units[i] != units[i - 1]), len(units)]
        for begin, end in pairwise(cuts):
            if held and units[begin] != tuple(held[-1][c][0].as_py() for c in names):
                yield linked(pa.concat_tables(held))
                held = []
            held.append(table.slice(begin, end - begin))
    if held:
        yield linked(pa.concat_tables(held))


def _in_order(edges: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ids that fall when ids are taken in order and each kept one drops its later neighbours. edges: low < id."""
    edges, gone = write(edges), None
    while not edges.isEmpty():
        firsts = edges.select(F.col("low").alias("id")).distinct().join(edges.select("id").distinct(), "id", "left_anti")
        fell = write(edges.join(firsts.withColumnRenamed("id", "low"), "low", "left_semi").select("id").distinct())
        gone = fell if gone is None else gone.unionByName(fell)
        edges = write(edges.join(fell, "id", "left_anti").join(fell.withColumnRenamed("id", "low"), "low", "left_anti").join(firsts.withColumnRenamed("id", "low"), "low", "left_anti"))
    return edges.select("id") if gone is None else gone


def dedup_corpus(docs: DataFrame, id_col: str, signature: str, threshold: float = 0.9, bands: int = 32, rows: int = 3, block: int = 256, rounds: int = 6) -> DataFrame:
    """The fuzzy keep-first dedup for whole tables: ids to keep, as if documents were taken in id order and compared with those kept.

    Signatures below 80 characters are never copies. Exact copies go first. MinHash proposes the rest: 32 bands of 3 over 8-character shingles and, for
    signatures below 250 characters or beyond Latin letters, where a ratio of 0.9 leaves room for more edits, 64 bands over 5-character ones. In each of the first
    rounds, ids that come first in all of their buckets are kept and compared with the rest of these, so a group of m near copies costs m
    comparisons. What is left then is compared pair by pair, once each: the ids whose buckets one id leads are dealt into blocks, each pair of blocks is one unit.
    Only pairs that share no bucket are missed. The tables between rounds are written to the shared folder, which cuts their plans.
    """
    scratch, names = Scratch(docs.sparkSession, "dedup_corpus"), count()
    write = lambda df: scratch.write(df, f"table-{next(names)}", free=True)
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(signature), F.lit("")).alias("s"))
    # one pass over the texts: exact copies become one row, short rows stay as many as they are
    single = F.when(F.length("s") < 80, F.col("id"))
    texts = write(named.groupBy("s", single.alias("own")).agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "s", "n", F.length("s").alias("size")))
    exact, sizes = (texts.where("size >= 80").select("id", c) for c in ("s", "size"))
    proposed = F.concat(_minhash(F.col("s"), bands, rows, 8), _minhash(F.when((F.length("s") < 250) | F.col("s").rlike(r"[^\x00-\u024F]"), F.col("s")), 2 * bands, rows, 5))
    members = exact.select("id", F.explode(proposed).alias("key"))
    shared = lambda m: m.join(m.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("top")).where("low < top").drop("top"), "key")
    of_like_size = 2 * F.least("size", "low_size") >= F.lit(threshold) * (F.col("size") + F.col("low_size"))

    @F.pandas_udf("boolean")
    def alike(new: pd.Series, low: pd.Series, old: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for n, i, o in zip(new, low, old):
            if i not in known:
                known = {i: Seen(threshold)}
                known[i].add(o)
            out.append(known[i].like(n))
        return pd.Series(out, dtype=bool)

    # comparisons cost milliseconds a row, so adaptive execution, which counts bytes, must not gather them in a few tasks
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    members, gone = write(shared(write(members))), None
    for _ in range(rounds):
        if members.isEmpty():
            break
        first = members.groupBy("id").agg(F.min("low").alias("least")).where("id = least").select(F.col("id").alias("low"))
        pairs = members.where("low < id").select("id", "low").distinct().join(first, "low", "left_semi")
        pairs = pairs.join(sizes, "id").join(sizes.toDF("low", "low_size"), "low").where(of_like_size).select("id", "low")  # before any text is moved
        pairs = pairs.join(exact, "id").join(exact.select(F.col("id").alias("low"), F.col("s").alias("old")), "low").repartition(parts, "low", F.pmod("id", F.lit(64))).sortWithinPartitions("low")
        fell = write(pairs.where(alike("s", "low", "old")).select("id").distinct())
        gone = fell if gone is None else gone.unionByName(fell)
        done = fell.unionByName(first.withColumnRenamed("low", "id"))
        members = write(shared(members.select("key", "id").join(done, "id", "left_anti")))

    shares = members.groupBy("id").agg(F.collect_list("key").alias("keys"), F.collect_list("low").alias("lows"))
    blocks = members.select("id", "low").distinct().groupBy("low").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    units = shares.withColumn("low", F.explode(F.array_distinct("lows"))).join(blocks, "low").withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    units = units.select("low", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "id", "own", "keys", "lows").join(exact, "id")

    id_type = dict(named.dtypes)["id"]
    units = units.repartition(parts, "low", "bi", "bj").sortWithinPartitions("low", "bi", "bj", "id")
    lost = _in_order(units.mapInArrow(lambda batches: _links(batches, threshold), f"low {id_type}, id {id_type}"), write)
    lost = lost if gone is None else lost.unionByName(gone)
    return scratch.keep(exact.select("id").join(lost, "id", "left_anti").unionByName(texts.where("size < 80").select(F.explode(F.array_repeat("id", F.col("n").cast("int"))).alias("id"))))
