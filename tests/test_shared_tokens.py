"""The inverted index against plain scores of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwood.functions.scoring import lexical_score
from siftwood.functions.shared_tokens import QueryIndex
from siftwood.functions.text import lexical_tokens
from siftwood.operators import match
from siftwood.sources.search import corpus_search


def _plain(q, c):
    both = len(set(q) & set(c))
    return 0.75 * both / len(q) + 0.25 * both / len(c) if both else 0.0


def test_best_rows_are_those_of_all_pairs():
    rng = random.Random(1)
    words = [f"t{i}" for i in range(30)]
    for _ in range(40):
        queries = [rng.sample(words, rng.randrange(8)) for _ in range(rng.randrange(1, 9))]
        rows = [[rng.sample([*words, "z1", "z2"], rng.randrange(10)) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 40))]
        index, best, got = QueryIndex(queries), np.zeros((3, len(queries))), {}
        for a in range(0, len(rows), 16):
            row, query, score, chunk, count, _ = index.best_rows(pa.array(rows[a : a + 16], pa.list_(pa.list_(pa.string()))), best, 2)
            ends = np.cumsum(count)
            for k, (r, q) in enumerate(zip(row, query)):
                got[a + r, q] = list(zip(score[ends[k] - count[k] : ends[k]], chunk[ends[k] - count[k] : ends[k]]))
        for q, words_of in enumerate(queries):
            every = {r: sorted((-_plain(words_of, c), k) for k, c in enumerate(chunks) if _plain(words_of, c))[:2] for r, chunks in enumerate(rows)}
            order = sorted(r for r in every if every[r])
            cut = sorted((every[r][0][0] for r in order))[:3]
            for r in order:
                if every[r][0][0] <= cut[-1]:  # the best three with ties
                    assert [(-s, k) for s, k in got[r, q]] == every[r]


def test_search_meets_every_pair(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(300)] + [(300, None), (301, ""), (302, "the")]
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(40)] + [(40, None), (41, "nothing here")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    got = sorted(tuple(r) for r in corpus_search(q, d, 5).select("query_id", "doc_id", "score", "rank").collect())
    pairs = q.join(d).withColumn("score", F.round(lexical_score(lexical_tokens(F.col("query")), lexical_tokens(F.col("text"))), 6)).where("score > 0")
    assert got == sorted(tuple(r) for r in match.topk(pairs, ["query_id"], [F.col("score").desc(), F.col("doc_id")], 5).select("query_id", "doc_id", "score", "rank").collect())
    assert "NestedLoop" not in corpus_search(q, d, 5)._jdf.queryExecution().toString()
    assert corpus_search(q.limit(0), d, 5).count() == 0 and corpus_search(q, d.limit(0), 5).count() == 0


def test_search_in_blocks_of_queries(spark, monkeypatch):
    q = spark.createDataFrame([(i, f"a{i % 7} b{i % 3}") for i in range(50)], "query_id long, query string")
    d = spark.createDataFrame([(i, f"a{i % 11} b{i % 5} c{i}") for i in range(90)], "doc_id long, text string")
    want = sorted(map(str, corpus_search(q, d, 3).collect()))
    monkeypatch.setattr(match, "BROADCAST_QUERIES", 8)
    assert sorted(map(str, corpus_search(q, d, 3).collect())) == want
