"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies: the source's target over its size, at most 2. The
whole part is certain. The fractional parts are rounded pair by pair: two undecided documents
exchange *words* (what one gains in size times probability the other loses) until one of them is 0 or 1, with chances that
keep every expectation. So a source's words never move by more than the size of the one document left at the end.

The rounding is a reduction tree: documents are dealt into blocks of a source by a hash, each block
leaves at most one undecided document, these meet in blocks again, until one is left per source, which is drawn alone.
Blocks, order and draws depend on what a row holds (id, source, size, a hash of the text, and a number among equal rows) and on the seed,
never on files, partitions or cores, so reruns agree on any layout.

Targets: sources in code-point order (null last) have the weights in turn and share `budget` times all words; a target stops at
`most` times its source's size and the excess is shared by weight again until none is above.
Only per-source totals reach the driver: one row a source, at most `MAX_SOURCES`, which is checked.

Defined cases: the size is the number of words, of whole texts however long; a null or empty text has size 0, and takes no words and
no part in the rounding. Null is a source of its own. Rows that agree in id, source and text are separate documents, numbered from 0; which of them an
extra copy goes to matters only to their other columns, and is open. Equal ids with other texts are separate documents, and so are rows without
doc_id. Ties of size inside a block go by hash. Other columns are ignored by `mix_sources` and kept by `mix_documents`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.llm.common import WORD, Scratch, numbered

MAX_SOURCES = 200_000
#: Documents of a block, undecided documents that meet in the next one, and parts of a key.
BLOCK, FAN, SALTS = 4096, 64, 256


def source_targets(sizes: list[tuple[str | None, int]], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Targets of sources that are in order: shares by weight, capped at most times the size, the excess reshared."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    left = budget * sum(s for _, s in sizes)
    target: list[float | None] = [None] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        share = left / sum(w[i] for i in open_)
        over = [i for i in open_ if share * w[i] > most * sizes[i][1]]
        if not over:
            for i in open_:
                target[i] = share * w[i]
            break
        for i in over:
            target[i] = most * sizes[i][1]
            left -= target[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return [max(0.0, t) for t in target]


def _draw(seed: int, *what) -> float:
    digest = hashlib.blake2b(repr((seed, *what)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def pivot(sizes: list[float], probs: list[float], names: list, seed: int) -> tuple[list[float], int | None]:
    """Rounds until at most one probability is fractional: (probabilities, its index or None)."""
    p = list(probs)
    held: int | None = None
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held is None:
            held = i
            continue
        a, b = held, i
        sa, sb = sizes[a], sizes[b]
        # words from b to a, or from a to b, as far as either can go
        up = min((1 - p[a]) * sa, p[b] * sb)
        down = min(p[a] * sa, (1 - p[b]) * sb)
        move = up if _draw(seed, names[a], names[b], i) * (up + down) < down else -down
        full_a, full_b = move == (1 - p[a]) * sa or move == -p[a] * sa, move == p[b] * sb or move == -(1 - p[b]) * sb
        pa_, pb_ = p[a] + move / sa, p[b] - move / sb
        p[a] = float(move > 0) if full_a else min(1.0, max(0.0, pa_))
        p[b] = float(move < 0) if full_b else min(1.0, max(0.0, pb_))
        held = next((k for k in (a, b) if 1e-12 < p[k] < 1 - 1e-12), None)
        for k in (a, b):
            if k != held:
                p[k] = float(round(p[k]))
    return p, held


def _round_block(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "a", "b"], kind="stable")
        p, _ = pivot(pdf["size"].tolist(), pdf["p"].tolist(), pdf["a"].tolist(), seed)
        return pdf.assign(p=p)

    return run


def _word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


#: What names a document: two hashes of its id, source, size and text, which equal rows share.
_KEY = ["k1", "k2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, head: str = "") -> DataFrame:
    """Adds doc_id, source, size, k1 and k2, with a prefix to their names."""
    doc_id, source, text = F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string")
    key = lambda n: F.xxhash64(F.lit(n), doc_id, F.lit(n), source, F.lit(n), text)
    return docs.select("*", doc_id.alias(f"{head}doc_id"), source.alias(f"{head}source"), _word_count(text_col).alias(f"{head}size"), key(1).alias(f"{head}k1"), key(2).alias(f"{head}k2"))


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(k1, k2, doc_id, source, size, n, ordinal): a row for each document, equal ones numbered.

    Equal rows are counted, not collected.
    """
    thin = _keyed(docs, id_col, text_col, source_col, "u_").select([F.col(f"u_{c}").alias(c) for c in (*_KEY, "doc_id", "source", "size")])
    counted = thin.groupBy(*_KEY, "doc_id", "source", "size").agg(F.count("*").alias("n"))
    return numbered(counted, _KEY)


def _mixed(docs: DataFrame, scratch: Scratch, weights: Sequence[float], budget: float, most: float, seed: int, block: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """k1, k2, doc_id, size, n, ordinal, source_size, target and copies of each document."""
    spark = docs.sparkSession
    units = scratch.write(_units(docs, id_col, text_col, source_col), "units")
    schema = "a long, b long, skey long, size long, p double, block long"
    totals = units.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    targets = source_targets([(r["source"], r["size"]) for r in totals], weights, budget, most)
    rows = [(r["source"], i, r["size"], t, (t / r["size"] if r["size"] else 0.0), max(1, math.ceil(r["n"] / block))) for i, (r, t) in enumerate(zip(totals, targets))]
    plan = spark.createDataFrame(rows, "source string, skey long, source_size long, target double, rate double, blocks long")
    # at most MAX_SOURCES short rows, so this is the one broadcast
    d = units.join(F.broadcast(plan), units["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    d = d.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    d = d.withColumn("a", F.xxhash64(F.lit(seed), *_KEY, "ordinal")).withColumn("b", F.xxhash64(F.lit(seed + 1), "ordinal", *_KEY))
    live = d.where("size > 0 AND p > 1e-12").select("a", "b", "skey", "size", "p", F.pmod("b", F.col("blocks")).alias("block"))
    decided = []
    level, widest = 0, max([r[5] for r in rows], default=1)
    while True:
        done = scratch.write(live.groupBy("skey", "block").applyInPandas(_round_block(seed + level), schema), f"level-{level}")
        decided.append(done.where("p >= 1"))
        open_ = done.where("p > 0 AND p < 1")
        if widest == 1:
            # one undecided document a source is left: it is drawn alone
            chance = F.pmod(F.xxhash64(F.lit(seed + 1000), "a"), F.lit(1 << 30)) / float(1 << 30)
            decided.append(open_.where(chance < F.col("p")))
            break
        widest = math.ceil(widest / FAN)
        live = open_.withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        level += 1
    extra = decided[0]
    for x in decided[1:]:
        extra = extra.unionByName(x)
    out = d.join(extra.select("a", "b", F.lit(1).cast("long").alias("extra")), ["a", "b"], "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select(*_KEY, "doc_id", "size", "n", "ordinal", "source_size", "target", copies.alias("copies"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 11, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (words)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    mixed = _mixed(docs, scratch, weights, budget, most, seed, block, id_col, text_col, source_col)
    return scratch.keep(mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 11, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with all of its columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    mixed = _mixed(docs, scratch, weights, budget, most, seed, block, id_col, text_col, source_col)
    key = ["__mix_k1", "__mix_k2"]
    # copies of equal documents differ by one at most: `more` of them take `least` + 1
    per_key = mixed.groupBy(*[F.col(k).alias(f"__mix_{k}") for k in _KEY]).agg(F.count("*").alias("__mix_n"), F.min("copies").alias("__mix_least"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("__mix_more"))
    per_key = scratch.write(per_key.where("__mix_least + __mix_more > 0"), "copies")
    own = _keyed(docs, id_col, text_col, source_col, "__mix_").drop("__mix_doc_id", "__mix_source", "__mix_size")
    one = own.join(per_key.where("__mix_n = 1"), key).withColumn("__mix_times", F.col("__mix_least") + F.col("__mix_more"))
    # rows that equal another are written with a salt, so that those of one key are numbered in many tasks
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    many = scratch.write(own.join(per_key.where("__mix_n > 1"), key).withColumn("__mix_salt", salt), "equal-rows")
    upto = F.sum("__mix_here").over(Window.partitionBy(*key).orderBy("__mix_salt")) - F.col("__mix_here")
    before = scratch.write(many.groupBy(*key, "__mix_salt").agg(F.count("*").alias("__mix_here")).withColumn("__mix_before", upto).drop("__mix_here"), "salts")
    place = F.row_number().over(Window.partitionBy(*key, "__mix_salt").orderBy("__mix_n")) + F.col("__mix_before")
    many = many.join(before, [*key, "__mix_salt"]).withColumn("__mix_times", F.col("__mix_least") + (place <= F.col("__mix_more")).cast("long"))
    wanted = [F.col(f"`{c}`") for c in docs.columns]
    taken = one.select(*wanted, "__mix_times").unionByName(many.select(*wanted, "__mix_times")).where("__mix_times > 0")
    taken = taken.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_times"))))
    return scratch.keep(taken.select(*wanted))
