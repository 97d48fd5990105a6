"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A mask keeps five of seven to nine neighbouring words and ignores the others, so a seed survives substitutions at
the ignored places. Seeds of the benchmark (four masks at every place) are joined with seeds of every document; a hit
fixes a diagonal, along which the item's words are compared one for one with the document's. An overlap counts as a leak if
at least `share` of the item's words stand there, or if a stretch scores at least `stretch` (a match adds 1, a
substitution takes 2). Items shorter than the shortest mask (seven words) have one seed of all their words and must stand there whole.

The document's words stay in the row from the seed to the verification, so nothing is shuffled but the
verified pairs. The benchmark's seeds are counted: up to `BROADCAST_SEEDS` they are broadcast; beyond that the seeds are
joined by a shuffle and the diagonals are joined with the texts again. Both ways give the same rows.

An overlap that the rule accepts is missed where no mask fits between its substitutions; README has the measured shares.

Defined cases: words are lower case, without ASCII punctuation. Null or empty texts and items have no words
and yield no rows. Long texts are searched whole. Repeated rows yield one pair. Rows without doc_id or item_id are compared too and keep the null. Ties: of the
diagonals of a pair the one with most matches counts, then the best score, then the first place. Other columns are ignored by the pairs and
kept by `drop_contaminated`. Empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.llm.common import shuffled

#: Places of a mask that count; the masks leave out a residue of the distances 3, 4 or 5, at which substitutions could repeat.
MASKS = ((0, 1, 3, 5, 6), (0, 1, 2, 4, 6), (0, 1, 4, 5, 8), (0, 1, 3, 4, 6))
SHORTEST = min(m[-1] for m in MASKS) + 1
BROADCAST_SEEDS = 1_000_000


def plain_words(text: Column) -> Column:
    """The words of a text; of one without any, the empty word."""
    bare = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[!-/:-@\[-`{-~]+", "")
    return F.split(F.regexp_replace(bare, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")


def _seeds(words: str, pos: str, short: list[int]) -> Column:
    """One seed a mask at a place, null where the mask passes the end, and one seed for each length of short items."""
    out = []
    for k, mask in enumerate([*MASKS, *[tuple(range(n)) for n in short]]):
        at = ", ".join(f"get({words}, {pos} + {i})" for i in mask)  # shorter generated code than [], which checks bounds
        out.append(f"CASE WHEN {pos} + {mask[-1]} < size({words}) THEN xxhash64({k if k < len(MASKS) else 100 + len(mask)}, {at}) END")
    return F.expr(f"array({', '.join(out)})")


def _placed(df: DataFrame, words: str, short: list[int]) -> DataFrame:
    return df.select("*", F.posexplode(words).alias("pos_", "w_")).drop("w_").withColumn("seed", F.explode(_seeds(words, "pos_", short))).where("seed IS NOT NULL")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, stretch: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, doc_key, item_id, n_item_words, n_matched, score, first_word) of leaks: the best diagonal of each pair.

    doc_key is a hash of the id and text, which names the row where ids are null or repeat.
    """
    item_key = F.xxhash64(F.col(item_col).cast("long"), F.col(item_text_col).cast("string")).alias("item_key")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), item_key, plain_words(F.col(item_text_col)).alias("item_words")).where("item_words[0] <> ''").distinct()
    # at most six lengths
    short = sorted(r[0] for r in items.where(F.size("item_words") < SHORTEST).select(F.size("item_words")).distinct().collect())
    whole = items.where(F.size("item_words") < SHORTEST)
    item_seeds = _placed(items.where(F.size("item_words") >= SHORTEST), "item_words", []).select("seed", "item_key", F.col("pos_").alias("item_pos"), F.size("item_words").alias("item_n"))
    if short:
        # of the lengths' seeds, the one of the item's own
        own = F.element_at(_seeds("item_words", "pos_", short), F.lit(len(MASKS)) + F.array_position(F.array(*[F.lit(n) for n in short]), F.size("item_words")).cast("int"))
        one = whole.withColumn("pos_", F.lit(0)).withColumn("seed", own)
        item_seeds = item_seeds.unionByName(one.select("seed", "item_key", F.col("pos_").alias("item_pos"), F.size("item_words").alias("item_n")))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("doc_key"), plain_words(F.col(text_col)).alias("words"))
    beside = "slice(words, greatest(diagonal, 0) + 1, item_n - greatest(-diagonal, 0))"
    placed = _placed(d, "words", short)
    if item_seeds.count() <= broadcast_seeds:
        # four numbers a seed, so at most some 100 MB
        hits = placed.join(F.broadcast(item_seeds), "seed").withColumn("diagonal", F.expr("pos_ - item_pos"))
    else:
        thin = placed.select("doc_key", "seed", "pos_").join(shuffled(item_seeds), "seed")
        diagonals = thin.selectExpr("doc_key", "item_key", "item_n", "pos_ - item_pos AS diagonal").distinct()
        hits = diagonals.join(shuffled(d), "doc_key")
    # one row a diagonal; the document's words beside the item's are cut out here, inside the generated code of the seed join
    found = hits.selectExpr("doc_id", "doc_key", "item_key", "diagonal", f"{beside} AS beside").groupBy("doc_id", "doc_key", "item_key", "diagonal").agg(F.first("beside").alias("beside")).join(items, "item_key")
    # places before the first or after the last word of the document are misses
    same = "transform(item_words, (w, j) -> CASE WHEN j + least(diagonal, 0) >= 0 AND get(beside, j + least(diagonal, 0)) = w THEN 1 ELSE 0 END)"
    best = "aggregate(same, struct(0 AS here, 0 AS best), (a, x) -> struct(greatest(0, a.here + IF(x = 1, 1, -2)) AS here, greatest(a.best, a.here + IF(x = 1, 1, -2)) AS best), a -> a.best)"
    judged = (
        found.select("doc_id", "doc_key", "item_id", F.size("item_words").alias("n_item_words"), F.expr(same).alias("same"), F.expr("greatest(0, diagonal)").alias("first_word"))
        .withColumn("n_matched", F.expr("aggregate(same, 0, (a, x) -> a + x)"))
        .withColumn("score", F.expr(best))
        .where((F.col("n_matched") == F.col("n_item_words")) | ((F.col("n_item_words") >= SHORTEST) & ((F.col("n_matched") >= F.lit(share) * F.col("n_item_words")) | (F.col("score") >= stretch))))
    )
    top = judged.groupBy("doc_id", "doc_key", "item_id").agg(F.max(F.struct("n_matched", "score", (-F.col("first_word")).alias("f"), "n_item_words")).alias("t"))
    return top.select("doc_id", "doc_key", "item_id", F.col("t.n_item_words").cast("long").alias("n_item_words"), F.col("t.n_matched").cast("long").alias("n_matched"), F.col("t.score").cast("long").alias("score"), (-F.col("t.f")).cast("long").alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without a leak, with all of their columns."""
    leaks = find_overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("doc_key").distinct()
    keyed = docs.withColumn("__leak_key", F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")))
    return keyed.join(leaks, keyed["__leak_key"] == leaks["doc_key"], "left_anti").drop("__leak_key")
