"""Substring dedup by matching statistics against suffix automata of reference shards.

The reference of a document is every document with a smaller doc_id, so the reference is the corpus
itself: broadcasting automata of all of it to every executor and streaming every document through each would be quadratic. It is cut into shards that
are small by construction, and an automaton goes to the one task that streams the texts which can match it:

1. Each window of 50 words picks an anchor, the 8-gram in it of least hash. Neighbouring windows with one anchor
   form a *segment* (about 21 windows, 70 words). Equal windows pick equal anchors, so a window can only match inside segments with its anchor.
2. The segments of an anchor that two documents share are a reference shard. Segments equal word for word stand in it once, with the smallest and the largest of
   their doc_ids: their statistics are the same, so they are streamed once for all.
3. A shard's segments are built into one automaton, whose states know the smallest document that holds them. Each segment streams through it: where its matching statistic
   reaches 50, the window's first holder is read off, and every document with that segment and a larger doc_id loses the window.
4. An anchor with more than `HOT` different segments would exceed one automaton's bound (about 70 x `HOT` words). It is the text that a great many documents share with
   different surroundings; its windows find their first holders by a group-by of their hashes (128 bits with the anchor) instead, which splits and pre-aggregates. README has the shares.

Defined cases: words are runs of anything but the six ASCII white-space characters, unchanged; a null or empty text has none. Long texts are cut whole, in a slice of their
own. Rows without doc_id are returned whole and are no reference. Rows that repeat a doc_id don't remove each other. Ties don't arise: only the smallest holder counts.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm import kernel
from siftwood.llm.automaton import SuffixAutomaton
from siftwood.llm.common import Scratch, min_spread, shuffled

WINDOW, ANCHOR, HOT = 50, 8, 1000


def _segments_of(w: np.ndarray, first: np.ndarray, window: int):
    """(document, first window, windows, anchor hash, segment hash) of the segments of a slice of documents."""
    n_docs = len(first) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    k = min(ANCHOR, window)
    if len(w) < window:
        return None
    g = kernel.gram_hashes(w, k)
    bits = np.uint64(max(20, int(len(g)).bit_length()))
    packed = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    span, done = window - k + 1, 1
    while done < span:  # minima over windows of doubling width
        by = min(done, span - done)
        packed = np.minimum(packed[:-by], packed[by:])
        done += by
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.flatnonzero(doc[: len(at)] == doc[window - 1 : window - 1 + len(at)])
    if not len(start):
        return None
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    s = np.flatnonzero(new)
    count = np.diff(np.append(s, len(start)))
    s0 = start[s]
    pw, inv = kernel._powers(len(w) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernel.mix(w) * pw[: len(w)], dtype=np.uint64)])
        seg = kernel.mix((sums[s0 + count + window - 1] - sums[s0]) * inv[s0] + count.astype(np.uint64))
    d = doc[s0]
    return d, s0 - first[d], count, g[at[s]].view(np.int64), seg.view(np.int64)


def _segments(window: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, offs = kernel.text_buffers(batch.column(1))
            for a, b in kernel.doc_slices(offs):
                part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                starts, ends, first = kernel.words(part, at)
                found = _segments_of(kernel.word_hashes(part, starts, ends), first, window)
                if found is not None:
                    d, s0, count, anchor, seg = found
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(seg), ids.slice(a, b - a).take(pa.array(d)), pa.array(s0.astype(np.int32)), pa.array(count.astype(np.int32))], ["anchor", "seg", "doc_id", "s0", "n"])

    return run


_SENT = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("low", pa.int64()), ("top", pa.int64()), ("a", pa.int32()), ("win", pa.int64()), ("words", pa.binary())])


def _words_of(window: int):
    """The words (as hashes) of wanted segments, or, of hot anchors, a row for each window."""

    def run(batches):
        for batch in batches:
            data, offs = kernel.text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            wanted = batch.column(2)
            for i in range(batch.num_rows):
                part = data[offs[i] : offs[i + 1]]
                starts, ends, _ = kernel.words(part, np.array([0, len(part)]))
                w = kernel.word_hashes(part, starts, ends)
                rows = []
                for x in wanted[i].as_py():
                    s, e = x["s0"], x["s0"] + x["n"] + window - 1
                    if e > len(w):  # a row of another text with this id
                        continue
                    head = (x["anchor"], x["seg"], ids[i], x["top"])
                    if x["hot"]:
                        rows += [(*head, j, h, None) for j, h in enumerate(kernel.window_hashes(w[s:e], window).view(np.int64).tolist())]
                    else:
                        rows.append((*head, 0, None, w[s:e].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SENT.types)], schema=_SENT)

    return run


def _runs(held: list) -> list[tuple[int, int, int]]:
    """Runs of windows with one holder: (first, end, holder)."""
    out: list[tuple[int, int, int]] = []
    for k, low in enumerate(held):
        if out and out[-1][1] == k and out[-1][2] == low:
            out[-1] = (out[-1][0], k + 1, low)
        elif low is not None:
            out.append((k, k + 1, low))
    return out


_FATE = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("low", pa.int64())])


def _stream(window: int):
    """(anchor, seg, a, b, low): runs of a segment's windows (from its own start) and the smallest document that holds them.

    Rows come sorted by anchor; one shard is held at a time.
    """

    def judge(anchor: int, shard: list) -> list:
        auto, texts = SuffixAutomaton(), [np.frombuffer(x[3], np.uint64).tolist() for x in shard]
        for x, words in zip(shard, texts):
            auto.add(words, x[1])
        auto.settle()
        return [(anchor, seg, a, b, low) for (seg, _, top, _), words in zip(shard, texts) for a, b, low in _runs(auto.holders(words, window)) if low < top]

    def run(batches):
        last, shard, out = None, [], []
        for batch in batches:
            for anchor, *x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "seg", "low", "top", "words"))):
                if anchor != last:
                    if shard:
                        out += judge(last, shard)
                    last, shard = anchor, []
                shard.append(x)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FATE.types)], schema=_FATE)
                out = []
        if shard:
            out += judge(last, shard)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FATE.types)], schema=_FATE)

    return run


def _cut(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            data, offs = kernel.text_buffers(batch.column(1))
            spans = batch.column(2)
            for i in range(batch.num_rows):
                words = data[offs[i] : offs[i + 1]].tobytes().split()
                n = len(words)
                if spans[i].is_valid:
                    gone = np.zeros(n + 1, np.int32)
                    for x in spans[i].as_py():
                        a, b = min(x["a"], n), min(x["b"] + window - 1, n)
                        gone[a] += 1
                        gone[b] -= 1
                    keep = np.cumsum(gone[:n]) == 0
                    words = [words[j] for j in np.flatnonzero(keep)]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            n, gone, digest, kept = zip(*rows) if rows else ([], [], [], [])
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())] + ([pa.array(kept, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, a, b): runs of windows, by first word, that a smaller doc_id holds too. docs: doc_id, text."""
    segs = scratch.write(docs.where("doc_id IS NOT NULL").mapInArrow(_segments(window), "anchor long, seg long, doc_id long, s0 int, n int"), "segments")
    # different segments; ties of s0 inside the smallest document keep one, which is enough as the words are equal
    distinct = segs.groupBy("anchor", "seg").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), F.min_by("s0", "doc_id").alias("s0"), F.min("n").alias("n"))
    distinct = scratch.write(distinct, "distinct")
    shared = distinct.groupBy("anchor").agg(F.min("low").alias("x"), F.max("top").alias("y"), F.count("*").alias("m")).where("x <> y").select("anchor", (F.col("m") > hot).alias("hot"))
    wanted = distinct.join(scratch.write(shared, "anchors"), "anchor").groupBy(F.col("low").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "seg", "top", "s0", "n", "hot")).alias("wanted"))
    found = docs.join(shuffled(wanted), "doc_id").select("doc_id", "text", "wanted").mapInArrow(_words_of(window), "anchor long, seg long, low long, top long, a int, win long, words binary")
    found = scratch.write(found, "words")
    shards = found.where("win IS NULL").select("anchor", "seg", "low", "top", "words").repartition(min_spread(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    fate = shards.mapInArrow(_stream(window), "anchor long, seg long, a int, b int, low long")
    # windows of hot anchors: the smallest document of each
    wins = found.where("win IS NOT NULL")
    first = scratch.write(wins.groupBy("anchor", "win").agg(F.min("low").alias("least")), "hot-windows")
    hot_fate = wins.join(first, ["anchor", "win"]).where("least < top").select("anchor", "seg", "a", (F.col("a") + 1).alias("b"), F.col("least").alias("low"))
    fate = scratch.write(fate.unionByName(hot_fate).groupBy("anchor", "seg").agg(F.collect_list(F.struct("a", "b", "low")).alias("runs")), "fate")
    hit = segs.join(shuffled(fate), ["anchor", "seg"]).select("doc_id", "s0", F.explode("runs").alias("r"))
    return hit.where("doc_id > r.low").selectExpr("doc_id", "s0 + r.a AS a", "s0 + r.b AS b")


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text (words joined by a space)."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_windows(d, scratch, window, hot).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    out = d.join(shuffled(spans), "doc_id", "left").select("doc_id", "text", "spans")
    return scratch.keep(out.mapInArrow(_cut(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text))
