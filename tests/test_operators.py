from __future__ import annotations

import random

from pyspark.sql import functions as F

from siftwood.config import EngineConfig
from siftwood.operators import context, dedup, match, select, state
from siftwood.plans.retrieval import answer_loop, context_of, retrieve


def test_diverse_topk_is_the_greedy_choice(spark):
    rng = random.Random(3)
    rows = [(q, i, f"d{rng.randrange(4)}", rng.randrange(3), rng.random()) for q in range(12) for i in range(15)]
    df = spark.createDataFrame(rows, "q int, i int, d string, p int, s double").withColumn("u", F.concat("d", F.col("p").cast("string")))
    got = {(r["q"], r["pick"]): r["i"] for r in select.diverse_topk(df, "q", "u", "d", F.lit(True), [F.col("s").desc(), F.col("i")], 6).collect()}
    for q in range(12):
        ranked = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[4], r[1]))
        chosen = []
        for url_cap, dom_cap in ((1, 1), (2, 3)):
            for r in ranked:
                if len(chosen) < 6 and r not in chosen and sum((c[2], c[3]) == (r[2], r[3]) for c in chosen) < url_cap and sum(c[2] == r[2] for c in chosen) < dom_cap:
                    chosen.append(r)
        assert [got.get((q, k + 1)) for k in range(len(chosen))] == [c[1] for c in chosen]


def test_rescue(spark):
    df = spark.createDataFrame([(1, 1, True, False, True), (1, 2, False, True, True), (2, 3, False, False, False), (2, 4, True, False, False)], "q int, i int, ok boolean, good boolean, res boolean")
    out = select.quality_select(df, "q", F.col("good"), F.col("res"), F.col("ok"), [F.col("i")], 5).collect()
    assert {(r["q"], r["i"], r["evidence_rescue_status"]) for r in out} == {(1, 1, "image_filter_rescue"), (1, 2, "image_filter_rescue"), (2, 4, "")}


def test_dedup_docs(spark):
    long = "abcdefghij" * 12
    df = spark.createDataFrame([("q", "u1", long, 1), ("q", "u1", "x", 2), ("q", "u2", long[:-1] + "z", 3), ("q", "", "short", 4), ("q", "", "short", 5)], "q string, u string, s string, p long")
    assert sorted(r["p"] for r in dedup.dedup_docs(df, "q", "u", "s", "p").collect()) == [1, 4, 5]


def test_image_match(spark):
    images = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "doc int, vector array<float>")
    prompts = spark.createDataFrame([([1.0, 0.0],)], "prompt_vector array<float>")
    got = {r["doc"]: r["image_match_decision"] for r in match.image_match(images, prompts, "doc").collect()}
    assert got == {1: "strong_match", 2: "low_similarity", 3: "download_failed"}


def test_suppressed_duplicates_update_nothing(spark):
    t = "some evidence text that is long enough to be compared " * 4
    df = spark.createDataFrame([(1, "u", 1, 0, t, 0.5), (1, "u", 2, 1, t + "x", 0.9), (1, "u", 3, 2, "other", 0.7)], "q int, u string, p long, chunk_id int, content string, score double")
    g = context.group_evidence(context.suppress_near_duplicates(df, "q", "u", "p", "content"), "q", "u", "p").first()
    assert g["score"] == 0.7 and len(g["chunks"]) == 2


def test_cache(spark):
    c = spark.createDataFrame([("a", 8, 0), ("b", 8, 100), ("c", 7, 100), ("d", 8, 950)], "key string, schema_version int, cached_at long")
    assert sorted(r["key"] for r in state.cache_hits(c, F.lit(1000), 100).collect()) == ["a", "d"]
    assert state.cache_hits(c, F.lit(1000), 0).count() == 0


def test_session_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0])], "doc int, vector array<float>")
    state.save_session(df, str(tmp_path), "s1", "page_images")
    state.save_session(df.withColumn("doc", F.lit(2)), str(tmp_path), "s2", "page_images")
    assert [tuple(r) for r in state.load_session(spark, str(tmp_path), "s1", "page_images").collect()] == [(1, [0.5, 1.0])]


def _pages(spark):
    page = "<html><body><article><h1>{t}</h1><p>{b}</p></article></body></html>"
    rows = [(f"https://s{i}.example.com/p", page.format(t=f"Title {i}", b=(f"alpha{i} beta{i} " + "common words in every page of the set. ") * 9)) for i in range(6)]
    return spark.createDataFrame(rows, "url string, html string")


def test_retrieve_and_context(spark):
    q = spark.createDataFrame([(1, "alpha2 beta2"), (2, "alpha4"), (3, "nothingmatches")], "query_id long, query string")
    found = retrieve(q, _pages(spark), EngineConfig(top_k=2)).collect()
    first = {r["query_id"]: r["canonical_url"] for r in found if r["pick"] == 1}
    assert first == {1: "https://s2.example.com/p", 2: "https://s4.example.com/p"}
    rendered = {r["query_id"]: r for r in context_of(retrieve(q, _pages(spark), EngineConfig(top_k=2)), q).collect()}
    assert "[Doc 1] Evidence Block\nURL: https://s2.example.com/p" in rendered[1]["context"]


def test_answer_loop(spark, tmp_path):
    def materialise(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def find(df):
        return df.select("question_id", F.concat(F.lit("ctx:"), "query", F.lit("@"), F.col("start").cast("string")).alias("context"), F.lit(2).alias("n_docs"))

    def judge(df):
        yes = (F.col("question_id") == 1) | F.contains("context", F.lit("more"))
        return df.select("question_id", F.when(F.col("question_id") == 4, None).when(yes, "YES").otherwise("NO").alias("judgement"), F.when(F.col("question_id") == 2, "more").alias("addition"))

    q = spark.createDataFrame([(i, f"q{i}") for i in (1, 2, 3, 4)], "question_id long, query string")
    got = {r["question_id"]: (r["rounds"], r["verdict"], r["context"]) for r in answer_loop(q, find, judge, materialise).collect()}
    assert got[1] == (1, "YES", "ctx:q1@1")
    assert got[2] == (2, "YES", "ctx:q2@1\n\nctx:more@3")
    assert got[3][:2] == (1, "NO") and got[4][0] == 3


def test_offline_search_source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(__import__("siftwood.sources.search", fromlist=["SearchSource"]).SearchSource)
    got = spark.read.format("siftwood_search").option("queries", '["a", "b"]').load().collect()
    assert sorted(r["query"] for r in got) == ["a", "b"]
    fresh = spark.read.format("siftwood_search").option("queries", '["a"]').load().where("freshness = 'oneDay'").collect()
    assert [r["freshness"] for r in fresh] == ["oneDay"]


def test_diverse_topk_rejects_near_copies(spark):
    t = "some evidence text that is long enough to be compared " * 4
    df = spark.createDataFrame([(1, 1, "a", t, 0.9), (1, 2, "b", t + "x", 0.8), (1, 3, "c", "another passage altogether, on rivers and boats " * 4, 0.7)], "q int, i int, u string, content string, s double")
    got = select.diverse_topk(df, "q", "u", "u", F.lit(True), [F.col("s").desc()], 3, text="content").orderBy("pick").collect()
    assert [r["i"] for r in got] == [1, 3]


def test_group_evidence_suppresses_near_copies(spark):
    t = "some evidence text that is long enough to be compared " * 4
    df = spark.createDataFrame([(1, "u", 1, 0, t, 0.5), (1, "u", 2, 1, t + "x", 0.9), (1, "v", 3, 0, t, 0.7)], "q int, u string, p long, chunk_id int, content string, score double")
    got = {r["u"]: r for r in context.group_evidence(df, "q", "u", "p").collect()}
    assert got["u"]["score"] == 0.5 and len(got["u"]["chunks"]) == 1 and len(got["v"]["chunks"]) == 1


def test_retrieve_drops_mirrors_and_blends_signals(spark):
    page = "<html><head><title>{t}</title></head><body><article><p>{b}</p></article></body></html>"
    body = lambda w: f"alpha beta {w} " + " ".join(f"{w}{k}" for k in range(120))
    rows = [(f"https://m{i:02d}.example.com/p", page.format(t="Copied", b="alpha beta gamma " + body("gamma"))) for i in range(60)]
    rows += [(f"https://z{i}.example.com/p", page.format(t=f"Own {i}", b=body(w))) for i, w in enumerate(("river", "mountain"))]
    pages, q = spark.createDataFrame(rows, "url string, html string"), spark.createDataFrame([(1, "alpha beta gamma")], "query_id long, query string")
    cfg = EngineConfig(candidate_k=3, top_k=3)
    plain = retrieve(q, pages, cfg).collect()
    # 60 mirrors fill the first 12 and 48 places; the other two pages must be reached
    assert [sorted({r["canonical_url"] for r in plain if r["canonical_url"].startswith(f"https://{c}")})for c in "mz"] == [["https://m00.example.com/p"], ["https://z0.example.com/p", "https://z1.example.com/p"]]
    seen = spark.createDataFrame([(1, "https://z1.example.com/p", "matched", "strong_match", 0.9)], "query_id long, canonical_url string, image_match_status string, image_match_decision string, max_image_similarity double")
    with_image = {(r["canonical_url"], r["chunk_id"]): r["score"] for r in retrieve(q, pages, cfg, images=seen).collect()}
    for r in plain:
        more = 0.05 if "z1" in r["canonical_url"] else 0.0
        if (key := (r["canonical_url"], r["chunk_id"])) in with_image:
            assert abs(with_image[key] - r["score"] - more) < 1e-9
    assert any("z1" in u for u, _ in with_image)


def test_retrieve_counts_freshness(spark):
    page = '<html><head><meta property="article:published_time" content="{d}"></head><body><article><p>alpha beta words here. ' + "more words of the page to read. " * 80 + "</p></article></body></html>"
    rows = [("https://a.example.com/p", page.format(d="2024-02-10")), ("https://b.example.com/p", page.format(d="not a date").replace("more words", "rather different ones, and some others"))]
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    pages = spark.createDataFrame(rows, "url string, html string")
    base = {r["canonical_url"]: r for r in retrieve(q, pages).collect() if r["chunk_id"] == 0}
    aged = {r["canonical_url"]: r for r in retrieve(q, pages, as_of="2024-02-15 00:00:00").collect() if r["chunk_id"] == 0}
    gain = {u: round(aged[u]["score"] - base[u]["score"], 9) for u in base}
    assert base["https://a.example.com/p"]["date_published"] == "2024-02-10"
    assert gain == {"https://a.example.com/p": 0.04, "https://b.example.com/p": 0.0}


def test_digest_context_hashes_what_render_context_gives(spark):
    """Blocks of many pieces, ties in chunk order, empty pages, a query without text; no plan step gathers the blocks of a query."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopé\u65e5 ") for _ in range(n))
    rows = [(q, f"u{p}", 100 * p + k, k % 2, word(rng.choice((0, 5, 90, 400))), (p + k) % 3 / 2) for q in ("one", "", None) for p in range(12) for k in range(3)]
    rows += [("one", "u99", 9900, 0, word(60_000), 1.0), ("one", "u99", 9901, 1, None, 0.5), ("two", None, 5, None, None, None)]
    chunks = spark.createDataFrame(rows, "q string, u string, p long, chunk_id int, content string, score double")
    named = lambda df: df.withColumn("text", F.concat(F.lit(" "), "q"))
    want = context.render_context(named(context.group_evidence(chunks, "q", "u", "p")), "q", "text", "u", 4, "now").select("q", F.sha2("context", 256), "n_docs")
    got = context.digest_context(named(context.group_pages(chunks, "q", "u", "p")), "q", "text", "u", 4, "now").select("q", "digest", "n_docs")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and got.count() == 4
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_pages_are_shuffled_once(spark):
    """Near copies are left out and pages grouped on one side of one shuffle."""
    df = spark.createDataFrame([("q", "u", 1, "x" * 90), ("q", "u", 2, "x" * 90), ("q", "u", 3, "y")], "q string, u string, p long, content string").withColumns({"chunk_id": F.lit(1), "score": F.lit(0.5)})
    got = context.group_pages(df, "q", "u", "p")
    assert [len(r["chunks"]) for r in got.collect()] == [2]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_dedup_docs_forgets_urls_of_dropped_documents(spark):
    a, b = "abcdefghij" * 12, "klmnopqrst" * 12
    df = spark.createDataFrame([("q", "u1", a, 1), ("q", "u2", a[:-1] + "z", 2), ("q", "u2", b, 3)], "q string, u string, s string, p long")
    assert sorted(r["p"] for r in dedup.dedup_docs(df, "q", "u", "s", "p").collect()) == [1, 3]


def test_dedup_corpus_equals_the_plain_greedy(spark):
    from siftwood.functions.similar import Seen

    rng = random.Random(5)
    letter = lambda: chr(0x4E00 + rng.randrange(400))
    base = "".join(letter() for _ in range(800))

    def edited(s, n):
        s = list(s)
        for at in rng.sample(range(len(s)), n):
            s[at] = rng.choice("ABCDEFGH")
        return "".join(s)

    # one group of more than 256 near copies, scattered edits about the bound, chains, short texts, and signatures that are never copies
    rows = [edited(base, 3) for _ in range(300)] + [edited(base, n) for n in range(10, 60, 10)]
    for _ in range(15):
        own = "".join(letter() for _ in range(rng.choice((90, 180, 800))))
        rows += [own, edited(own, len(own) // 30), edited(own, len(own) // 14)]
    rows += ["short", "short", "", ""]
    rng.shuffle(rows)
    seen, want = Seen(0.9), []
    for i, s in enumerate(rows):
        if len(s) < 80 or not seen.like(s):
            want.append(i)
            seen.add(s) if s else None
    df = spark.createDataFrame(list(enumerate(rows)), "i long, s string")
    assert sorted(r["id"] for r in dedup.dedup_corpus(df, "i", "s").collect()) == want


def test_dedup_of_the_tables_equals_plain_comparison(spark):
    """Documents of one query, and the whole table, against difflib alone, which compares each document with all that were kept."""
    from difflib import SequenceMatcher

    import __spark_entry__ as entry
    from siftwood.functions.text import text_signature
    from siftwood.sources.search import corpus_search

    sf = "/root/testdata/sf0.001"

    def alike(a, b):
        if 2 * min(len(a), len(b)) < 0.9 * (len(a) + len(b)):
            return False
        m = SequenceMatcher(None, a, b)
        return m.quick_ratio() >= 0.9 and m.ratio() >= 0.9

    def greedy(rows):
        kept = []
        for i, s in rows:
            if len(s) < 80 or not any(alike(s, k) for _, k in kept):
                kept.append((i, s))
        return [i for i, _ in kept]

    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    sigs = {r["doc_id"]: r["s"] for r in docs.select("doc_id", text_signature(F.col("text")).alias("s")).collect()}
    assert sorted(r["id"] for r in entry.queries()["dedup_corpus"](spark, sf).collect()) == sorted(greedy(sorted(sigs.items())))
    got = {}
    for r in entry.queries()["dedup_docs"](spark, sf).orderBy("query", "pos").collect():
        got.setdefault(r["query"], []).append(r["doc_id"])
    hits = corpus_search(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), docs, 30).orderBy("query_id", "rank").collect()
    for q in sorted(got)[:12]:
        assert got[q] == greedy([(r["doc_id"], sigs[r["doc_id"]]) for r in hits if r["query_id"] == q])


def test_dedup_corpus_compares_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(8)
    words = lambda n: " ".join("".join(chr(0x4E00 + rng.randrange(400)) for _ in range(6)) for _ in range(n))
    head, tail = words(150), words(150)
    # the same first 900 letters and another end; the same but for one word in the middle; an exact copy; another start and the same end
    texts = [f"{head} {tail}", f"{head} {words(150)}", f"{head} {words(1)} {tail}", f"{head}, {tail}!", f"{words(10)} {tail}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["id"] for r in entry.queries()["dedup_corpus"](spark, str(tmp_path)).collect()) == [0, 1, 4]


def test_keep_first_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), ("", 4), (None, 5)], "k string, p long")
    assert sorted(r["p"] for r in dedup.keep_first(df, ["k"], ["p"]).collect()) == [1, 3, 4, 5]


def test_search_requests_and_errors():
    import pytest

    from siftwood.sources.search import checked, request_of

    assert request_of("a", " q ", 10, "oneWeek", "site:a.org", "-site:b.org") == {"q": "q site:a.org -site:b.org", "num": 10, "tbs": "qdr:w"}
    assert request_of("b", "q", 5, "oneDay", exclude="b.org") == {"query": "q", "freshness": "oneDay", "summary": True, "count": 5, "exclude": "b.org"}
    assert checked("a", '{"error": "No results found"}') == '{"organic_results": []}'
    for provider, answer in (("a", '{"error": "bad key"}'), ("a", (500, "{}")), ("b", '{"code": 403, "msg": "no"}'), ("b", "<html>")):
        with pytest.raises(RuntimeError):
            checked(provider, answer)
    with pytest.raises(ValueError):
        request_of("b", "q", 51, "noLimit")


def test_dedup_docs_query_groups_by_search_hits(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["dedup_docs"](spark, sf).toPandas()
    asked = {r["item_id"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert set(got["query"]) <= asked and got.groupby("query").size().max() > 4 and got["pos"].between(1, 30).all()
