"""Quality classifier: a linear SVM on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators, hashed to 2^18 slots: word 1- and 2-grams (lower case); and 1- and 2-grams of word shapes (runs of
letters, digits and each punctuation mark), with steps of how much of the text they make up; and shares of words that repeat the word
before them or an earlier one. Word indicators of a document weigh 1/sqrt(their number).
Each slot is scaled by its smoothed log-count ratio between the classes; a hinge-loss model is fitted by
dual coordinate descent and its margins are calibrated to probabilities on a quarter of the sample that the descent didn't see.

The fit takes at most `SAMPLE` labelled rows, the first in hash order of the training ids (bounded, so they are broadcast
to find their texts), and of these, in the same order, whole texts of at most `SAMPLE_BYTES` together. It runs in one task, which reads the texts as a stream
and holds their indicators only. Every whole text is scored.

Defined cases: a null or empty text has the indicator of no words and gets a score. Null labels are ignored; of repeated
labels of an id the largest counts. Without labels of both classes every score is 1 (nothing to reject by) or,
with class 0 alone, 0. Rows without an id are scored and not held out. Repeated rows get equal scores. Long texts
are scored whole, in a slice of their own. Ties don't arise: a score depends on the text alone. Other columns are ignored by the scores and kept by `keep_quality`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.llm import kernel
from siftwood.session import ensure_importable

BITS, EPOCHS, COST, ALPHA = 18, 12, 1.0, 1.0
#: The sample that is fitted on: labelled rows, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 16_000, 256_000_000
DIM = 1 << BITS
_STEPS = np.array([1 / 64, 1 / 16, 1 / 4, 1 / 2, 3 / 4])


def _shape_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = ord("x")
    t[ord("A") : ord("Z") + 1] = ord("X")
    t[ord("0") : ord("9") + 1] = ord("9")
    t[128:] = ord("x")
    return t


_SHAPE = _shape_table()


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (kernel.mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(doc: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, occurrences) of distinct pairs."""
    key = np.sort(doc.astype(np.int64) << BITS | slot)
    if not len(key):
        return key, key, key
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key_at = key[at]
    return key_at >> BITS, key_at & (DIM - 1), np.diff(np.append(at, len(key)))


def features(column: pa.Array):
    """Yields (first document, documents, document of each indicator, slot, value) for slices of a text column."""
    data, offs = kernel.text_buffers(column)
    low, low_offs = kernel.text_buffers(pc.ascii_lower(column))
    for a, b in kernel.doc_slices(offs, 1 << 20):
        n = b - a
        part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        starts, ends, first = kernel.words(part, at)
        count = np.diff(first)
        doc = np.repeat(np.arange(n), count)
        w = kernel.word_hashes(low[low_offs[a] : low_offs[b]], starts, ends)
        # shapes: each byte's class, without repeats inside a word
        shape = _SHAPE[part]
        keep = np.ones(len(part), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[starts] = True
        upto = np.concatenate([[0], np.cumsum(keep)])
        s = kernel.word_hashes(shape[keep], upto[starts], upto[ends])
        pair = np.zeros(len(w), bool)  # the word has a next one in its document
        pair[:-1] = doc[1:] == doc[:-1]
        i = np.flatnonzero(pair)
        with np.errstate(over="ignore"):
            w2 = kernel.mix(w[i] * np.uint64(3) + w[i + 1]) if len(i) else w[:0]
            s2 = kernel.mix(s[i] * np.uint64(3) + s[i + 1]) if len(i) else s[:0]
        wd, ws, _ = _distinct(np.concatenate([doc, doc[i]]), np.concatenate([_slot(w, 1), _slot(w2, 2)]))
        value = 1 / np.sqrt(np.maximum(1, np.bincount(wd, minlength=n)))
        out = [(wd, ws, value[wd])]
        # repeats of the word before, and of any earlier word
        same = np.bincount(doc[i][w[i] == w[i + 1]], minlength=n) if len(i) else np.zeros(n)
        ud, _, _ = _distinct(doc, _slot(w, 1))
        again = count - np.bincount(ud, minlength=n)
        total = np.maximum(1, count)
        for salt, d, sl, share in ((3, *_shares(doc, s, 3, total)), (4, *_shares(doc[i], s2, 4, total)), (5, np.arange(n), np.full(n, 50), same / total), (6, np.arange(n), np.full(n, 60), again / total)):
            out.append((d, sl, np.ones(len(d))))
            for k, step in enumerate(_STEPS):
                m = share >= step
                out.append((d[m], _slot((sl[m] * 64 + k + 1).astype(np.uint64), salt + 10), np.ones(int(m.sum()))))
        none = np.flatnonzero(count == 0)
        out.append((none, np.full(len(none), 7), np.ones(len(none))))
        yield a, n, *(np.concatenate(x) for x in zip(*out))


def _shares(doc: np.ndarray, h: np.ndarray, salt: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, sl, c = _distinct(doc, _slot(h, salt))
    return d, sl, c / total[d]


def indicators(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text."""
    rows: list = [None] * len(texts)
    for a, n, d, sl, v in features(texts):
        order = np.argsort(d, kind="stable")
        cuts = np.searchsorted(d[order], np.arange(n + 1))
        for k in range(n):
            own = order[cuts[k] : cuts[k + 1]]
            rows[a + k] = (sl[own], v[own])
    return rows


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float, float]:
    """(weights, slope, offset): score = 1 / (1 + exp(-(slope * margin + offset)))."""
    y = np.where(labels > 0, 1.0, -1.0)
    train = np.arange(len(rows)) % 4 != 3
    if len(set(y[train])) < 2 or len(set(y[~train])) < 2:
        train = np.ones(len(rows), bool)
    counts = np.full((2, DIM), ALPHA)
    for k in np.flatnonzero(train):
        counts[int(y[k] > 0), np.unique(rows[k][0])] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = [(sl, v * ratio[sl]) for sl, v in rows]
    w, bias = np.zeros(DIM), 0.0
    share = np.array([(y[train] < 0).mean(), (y[train] > 0).mean()])
    limit = {s: cost * 0.5 / max(share[int(s > 0)], 1e-3) for s in (-1.0, 1.0)}
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(np.flatnonzero(train)):
            sl, v = rows[k]
            g = y[k] * (float(w[sl] @ v) + bias) - 1
            new = min(max(alpha[k] - g / norm[k], 0.0), limit[y[k]])
            step = (new - alpha[k]) * y[k]
            if step:
                np.add.at(w, sl, step * v)
                bias += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-4:
            break
    rest = np.flatnonzero(~train) if (~train).any() else np.arange(len(rows))
    margin = np.array([float(w[rows[k][0]] @ rows[k][1]) + bias for k in rest])
    slope, offset = _calibrate(margin, y[rest] > 0)
    return w * ratio, slope, offset + slope * bias


def _calibrate(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid with his smoothed targets, by damped Newton steps."""
    up, down = positive.sum(), (~positive).sum()
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0

    def loss(a, b):
        z = a * margin + b
        return float((np.logaddexp(0, z) - target * z).sum()) + 1e-3 * a * a

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([((p - target) * margin).sum() + 2e-3 * a, (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin * margin).sum() + 2e-3, (q * margin).sum()], [(q * margin).sum(), q.sum()]]) + 1e-9 * np.eye(2)
        d = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-6 and loss(a - t * d[0], b - t * d[1]) > loss(a, b):
            t /= 2
        a, b = a - t * d[0], b - t * d[1]
        if np.abs(t * d).max() < 1e-9:
            break
    return max(float(a), 1e-6), float(b)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fit_task(most: int):
    def run(batches):
        rows, labels, used = [], [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)) + used
            n = int(np.searchsorted(sizes, most, side="right"))
            rows += indicators(batch.column(0).slice(0, n))
            labels += batch.column(1).slice(0, n).to_pylist()
            if n < batch.num_rows:
                break
            used = int(sizes[-1]) if n else used
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            w, slope, offset = np.zeros(DIM), 0.0, (-1e9 if len(y) and not y.any() else 1e9)
        else:
            w, slope, offset = fit(rows, y)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([slope]), pa.array([offset])], ["w", "slope", "offset"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float, float]:
    """Fits on at most `sample` labelled rows whose ids are not held out, and at most `sample_bytes` of their texts."""
    ensure_importable(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max(F.col(label_col)).cast("int").alias("l_y"))
    picked = marked.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    # at most `sample` pairs of numbers, so they are broadcast; repeated ids keep one text each
    found = docs.select(F.col(id_col).cast("long").alias("l_id"), F.col(text_col).cast("string").alias("l_text")).join(F.broadcast(picked), "l_id")
    found = found.groupBy("l_id").agg(F.min("l_text").alias("l_text"), F.first("l_y").alias("l_y")).select(F.xxhash64("l_id").alias("h"), "l_id", "l_text", "l_y")
    ordered = found.repartition(1).sortWithinPartitions("h", "l_id").select("l_text", "l_y")
    row = ordered.mapInArrow(_fit_task(sample_bytes), "w binary, slope double, offset double").first()
    if row is None:
        return np.zeros(DIM, np.float32), 0.0, 1e9
    return np.frombuffer(row["w"], np.float32), row["slope"], row["offset"]


def scorer(model: tuple[np.ndarray, float, float]):
    """The model as a column function of texts."""
    weights, slope, offset = model

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = np.full(len(text), 0.0)
        for a, n, d, sl, v in features(text):
            out[a : a + n] = np.bincount(d, v * weights[sl], n)
        with np.errstate(over="ignore"):
            return pa.array(1 / (1 + np.exp(-np.clip(slope * out + offset, -800, 800))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with all of their columns."""
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col))
    return docs.withColumn("__quality", score(F.col(text_col).cast("string"))).where(F.col("__quality") >= threshold).drop("__quality")
