"""Operators on pairs against brute force, and the cases that their docstrings define."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from siftwood.llm import ngram_join
from siftwood.llm.automaton import SuffixAutomaton
from siftwood.llm.common import Scratch, connected_components
from siftwood.llm.embedding_dedup import embedding_near_duplicates
from siftwood.llm.ngram_join import fewest_matches, keep_one_of_each_group, ngram_jaccard_join
from siftwood.llm.substring_dedup import remove_repeated_windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def grams(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def corpus(seed=1, groups=12):
    """Copies, near copies at many similarities, a large group of near copies, short and empty texts."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = prose(rng, rng.randrange(30, 160))
        rows.append(" ".join(base))
        for k in (0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = "sub"
            rows.append(" ".join(w))
    base = prose(rng, 120)
    for _ in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    rows += ["one two", "one two", "One TWO", "", None, "   ", "a b c d e", "a b c d e"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a].add(b)
                    links[b].add(a)
    comp = {}
    for i in ids:
        if i not in comp:
            todo, comp[i] = [i], i
            while todo:
                for n in links[todo.pop()]:
                    if n not in comp:
                        comp[n] = i
                        todo.append(n)
    return {i: len(x) for i, x in links.items()}, comp


def test_ngram_join_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    n_links, comp = brute(rows)
    for block in (512, 8):  # one block, then groups dealt into many
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
        got = {r["doc_id"]: r for r in ngram_jaccard_join(docs_of(spark, rows)).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == n_links
        assert {i: r["component_id"] for i, r in got.items()} == comp
        assert all(r["kept"] == (i == comp[i]) for i, r in got.items())


def test_ngram_join_defined_cases(spark):
    df = docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (None, None)])
    df = df.withColumn("n", F.lit(1)).withColumn("id", F.lit(2)).withColumn("keys", F.lit(3)).withColumn("a.b", F.lit(4))
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 1, 2, True), (1, 1, 2, True), (None, 1, 2, False), (2, 2, 0, True), (3, 3, 0, True), (None, None, 0, True)], key=str)
    kept = keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, None, None]
    assert ngram_jaccard_join(df.limit(0)).count() == 0


def test_posterior_bound():
    # enough matches always pass; the bound falls with the tolerance and grows with the comparisons
    assert fewest_matches(128, 0.8, 1e-7) < 0.8 * 128 and fewest_matches(128, 0.8, 1e-2) > fewest_matches(128, 0.8, 1e-7)
    assert [fewest_matches(n, 0.8, 1e-7) for n in range(16, 129, 16)] == sorted(fewest_matches(n, 0.8, 1e-7) for n in range(16, 129, 16))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    rows = []
    for k in range(400):
        rows.append((k, (base[k % 40] + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.15, 0.2])).tolist(), int(k % 3) if k % 50 else None))
    rows += [(400, None, 1), (401, [0.0] * 64, 1), (402, [1.0] + [None] * 63, 1), (403, [float("nan")] + [1.0] * 63, 1), (404, [1e30] * 64, 2), (405, [1.0] * 64, 2), (406, [1.0] * 64, 2), (407, [1.0, 2.0], 2), (None, [1.0] * 64, 2), (408, [], 2)]
    got = {r["vec_id"]: r for r in embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect() if r["vec_id"] is not None}
    want = 0
    good = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v)]
    found = 0
    for i, x, lab in good:
        n = sum(j != i and lab == m and len(y) == len(x) and float(x @ y) >= 0.98 for j, y, m in good)
        want, found = want + n, found + got[i]["n_links"]
        assert got[i]["n_links"] <= n
    assert want > 200 and found == want
    assert got[400]["n_links"] == got[401]["n_links"] == got[403]["n_links"] == 0 and got[404]["component_id"] == 404 and got[405]["n_links"] == 2


def test_ngram_join_takes_long_texts_whole(spark):
    w = [f"w{i}" for i in range(60_000)]
    near = w[:30_000] + ["other"] * 100 + w[30_100:]
    far = w[:40_000] + [f"x{i}" for i in range(20_000)]
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_jaccard_join(docs_of(spark, [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far)), (4, "y" * 300_000)])).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_embeddings_defined_cases(spark):
    v, w = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [(1, v, 1), (1, v, 1), (2, v, 1), (3, v, 2), (4, w, 1), (None, v, 1), (5, v, None), (6, [1.0] * 20_000, 1), (7, [2.0] * 20_000, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("keys", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("leaders", F.lit("c"))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_near_duplicates(df).collect()), key=str)
    # repeated rows are vectors of their own, linked with each other
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)], key=str)
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_automaton_statistics():
    rng = random.Random(9)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        auto = SuffixAutomaton()
        for t in texts[:-1]:
            auto.add(t)
        known = {tuple(t[i:j]) for t in texts[:-1] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((n for n in range(e + 2) if n == 0 or tuple(texts[-1][e + 1 - n : e + 1]) in known)) for e in range(len(texts[-1]))]
        assert auto.statistics(texts[-1]) == want
        owned = SuffixAutomaton()
        for owner in rng.sample(range(4), 4):  # in any order
            owned.add(texts[owner], owner)
        owned.settle()
        asked = [rng.randrange(3) for _ in range(12)] + texts[-1]
        for k in (1, 2, 4):
            holders = [min((o for o, t in enumerate(texts) if any(t[i : i + k] == asked[s : s + k] for i in range(len(t)))), default=None) for s in range(len(asked) - k + 1)]
            assert owned.holders(asked, k) == holders


def test_substring_dedup_matches_brute_force(spark):
    import hashlib

    rng = random.Random(5)
    shared = [prose(rng, n, 50) for n in (50, 55, 80, 49, 120)]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 90), 50)
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(len(w) + 1)
            w = w[:cut] + s[rng.randrange(4) :] + w[cut:]
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, rows[3][1] + " tail"), (64, " ".join(["again"] * 200)), (65, " ".join(["again"] * 130)), (66, "é " * 60), (67, "\té\n" * 60)]
    seen, want = {}, {}
    for i, t in rows:
        w = (t or "").split()
        own = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {k + d for k, x in enumerate(own) if x in seen for d in range(50)}
        for x in own:
            seen.setdefault(x, i)
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for hot in (1000, 1):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeated_windows(docs_of(spark, shuffled), hot=hot).collect()}
        assert got == want


def test_substring_dedup_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    very = " ".join(f"v{i}" for i in range(70_000))
    df = docs_of(spark, [(1, long), (1, long), (None, long), (2, long), (4, very), (5, f"{very} {long}")]).withColumn("seg", F.lit(1)).withColumn("s0", F.lit(1)).withColumn("a.b", F.lit(1))
    got = sorted(((r["doc_id"], r["n_removed"]) for r in remove_repeated_windows(df).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (2, 60), (4, 0), (5, 70_060)], key=str)
    assert remove_repeated_windows(df.limit(0)).count() == 0
