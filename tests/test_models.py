from __future__ import annotations

from pyspark.sql import functions as F

from siftwood.operators import models, reports
from siftwood.sources.offline import hash_embedding
from siftwood.sources.search import read_eval_set


def test_judge_is_asked_about_uncertain_questions_only(spark):
    def ask(batch):
        assert all(q in ("who won", "who lost") for q in batch)
        return ['{"judgement": "YES"}' if q == "who won" else "?" for q in batch]

    df = spark.createDataFrame([(1, "hello"), (2, "this image"), (3, "who won"), (4, "who lost")], "i int, q string")
    assert {r["i"]: r["use_rag"] for r in models.should_use_rag(df, "q", ask).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_queries_per_candidate(spark):
    def find(batch):
        return ['{"candidates": [{"name": "A", "aliases": ["Alpha"], "confidence": 0.9}, {"name": "B"}]}' if q == "x" else "none" for q in batch]

    df = spark.createDataFrame([(1, "x"), (2, "y")], "i int, q string")
    got = [(r["i"], r["query"]) for r in models.generate_queries(df, "i", "q", find, lambda b: b).orderBy("i", "pos").collect()]
    assert got == [(1, "x A / Alpha"), (1, "x B"), (2, "y")]


def test_page_images_and_profiles(spark):
    def download(urls):
        return [None if "bad" in u else u.encode() for u in urls]

    def vectors(bodies):
        if any(b"odd" in b for b in bodies):
            raise ValueError
        return [[float(len(b))] for b in bodies]

    docs = spark.createDataFrame([(1, ["https://e.com/a.jpg", "https://e.com/a.jpg", "https://e.com/logo.png", "https://e.com/bad.jpg"]), (2, ["https://e.com/odd.jpg", "https://e.com/a.jpg"])], "k int, imgs array<string>")
    got = {(r["k"], r["url"]): r["vector"] for r in models.page_images(docs, "k", "imgs", download, vectors).collect()}
    assert got == {(1, "https://e.com/a.jpg"): [19.0], (1, "https://e.com/bad.jpg"): None, (2, "https://e.com/odd.jpg"): None, (2, "https://e.com/a.jpg"): [19.0]}

    chunks = spark.createDataFrame([("h1", 400, 1, 0, "text one"), ("h2", 400, 1, 0, "text two")], "content_hash string, size int, query_id int, chunk_id int, chunk string")
    empty = spark.createDataFrame([], "content_hash string, size int, query_id int, chunk_id int, chunk string, vector array<float>")
    first = spark.createDataFrame(models.chunk_profiles(chunks, empty, "query_id", hash_embedding).collect(), empty.schema)

    def fail(batch):
        raise AssertionError("nothing is left to embed")

    assert models.chunk_profiles(chunks, first, "query_id", fail).where("vector IS NOT NULL").count() == 2


def test_eval_files(spark, tmp_path):
    (tmp_path / "set.json").write_text('[{"question": "q", "answer": "a", "image": "i.png"}, {"question": "r", "answer": "b", "image": "j.png", "split": "g"}]')
    assert [r["group"] for r in read_eval_set(spark, str(tmp_path / "set.json")).orderBy("question").collect()] == [None, "g"]
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 4.0)], "g string, s double, l double")
    reports.write_results(df, reports.eval_summary(df, "g", "s", "l"), "g", str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/report")).collect()][0] == "overall (2): 50.00%, 3.000 s"


def test_blocks(spark):
    found = F.array(F.struct(F.lit("A").alias("name"), F.lit("t").alias("type"), F.array(F.lit("x")).alias("aliases")))
    row = spark.range(1).select(models.candidates_block(found).alias("c"), models.previous_block(F.array(F.lit("q"))).alias("p"), models.previous_block(F.array().cast("array<string>")).alias("n")).first()
    assert tuple(row) == ("1. A (t); aliases: x", "- q", "- none")


def test_entity_candidates_take_whole_texts(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    longest = max(len(r["variants"]) for r in entry.queries()["entity_candidates"](spark, sf).collect())
    assert longest > 60
