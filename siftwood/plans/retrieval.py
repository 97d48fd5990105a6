"""The retrieval plan: whole tables of queries against whole tables of pages, as one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.config import EngineConfig
from siftwood.functions.scoring import evidence_parts, freshness, high_quality_body, image_bonus, source_reliability, usable_chunk
from siftwood.functions.text import doc_signature, lexical_tokens
from siftwood.functions.url import domain_key
from siftwood.operators.context import group_evidence, render_context
from siftwood.operators.dedup import dedup_docs
from siftwood.operators.match import lexical_topk
from siftwood.operators.pages import chunk_array, read_pages
from siftwood.operators.select import diverse_topk, quality_select, topk


def _candidates(docs: DataFrame, queries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The first `candidate_k` pages of each query that are no copies of better ones, by canonical URL or by text.

    Copies fall after the best pages of a query are known, so more are taken than are needed; where copies fill those, four times as many. The few rows taken are
    cached, as they are read to see whether they suffice.
    """
    order, width = [F.expr("-best[0].score"), F.col("canonical_url"), F.col("doc")], 4 * cfg.candidate_k
    while True:
        pairs = lexical_topk(docs, queries, "tokens", width, cfg.chunks_per_doc, "chunks")
        near = topk(pairs, ["query_id"], order, width, "place").persist()
        kept = topk(dedup_docs(near, "query_id", "canonical_url", "signature", "place", cfg.near_dup_docs, cfg.min_signature), ["query_id"], [F.col("place")], cfg.candidate_k, "kept_").persist()
        cut = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == width)
        full = kept.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == cfg.candidate_k)
        if cut.join(full, "query_id", "left_anti").isEmpty():
            return kept.drop("kept_", "signature")
        near.unpersist()
        kept.unpersist()
        width *= 4


def retrieve(queries: DataFrame, pages: DataFrame, cfg: EngineConfig = EngineConfig(), as_of: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """Diversified evidence chunks of each query. queries: query_id, query; pages: url, html.

    as_of: the moment that page ages are taken at; without it there is no freshness bonus. images: query_id, canonical_url, image_match_status, image_match_decision and
    max_image_similarity of the pages (one row each), as `image_match` gives; pages without a row have no image bonus.

    One pass over the corpus: a page is read and chunked in its own row, and its chunks meet the queries through an inverted index of the queries' tokens
    (`lexical_topk`). Each batch, and then each task, keeps a query's best pages before the shuffle, so what is shuffled depends on the
    number of tasks and queries, not on the corpus.
    """
    docs = read_pages(pages.select("url", "html")).where("text <> ''").withColumn("doc", F.xxhash64("canonical_url", "content_hash"))
    docs = docs.select("doc", "canonical_url", "title", "site_name", "date_published", "fetch_status", "quality_score", "is_probable_listing", F.length("text").alias("text_len"), doc_signature(F.col("title"), F.col("text")).alias("signature"), chunk_array(F.col("text"), cfg.chunk_size).alias("chunks"))
    docs = docs.withColumn("tokens", F.transform("chunks", lexical_tokens))
    near = _candidates(docs, queries.select("query_id", lexical_tokens(F.col("query")).alias("qt")), cfg)
    if images is None:
        near = near.withColumns({"image_match_status": F.lit(""), "image_match_decision": F.lit(""), "max_image_similarity": F.lit(0.0)})
    else:
        near = near.join(images.select("query_id", "canonical_url", "image_match_status", "image_match_decision", "max_image_similarity"), ["query_id", "canonical_url"], "left")
    image = F.coalesce(image_bonus(F.col("image_match_status"), F.col("image_match_decision"), F.col("max_image_similarity"), cfg.image_threshold), F.lit(0.0))
    domain = domain_key(F.col("canonical_url"))
    path = F.regexp_extract("canonical_url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    fresh = F.lit(0.0) if as_of is None else freshness(F.col("date_published"), as_of)
    near = near.withColumns({"domain": domain, "image": image, "reliability": source_reliability(domain, path, F.col("site_name")), "fresh": fresh})
    good = high_quality_body(F.lit("web_page"), F.col("fetch_status"), F.col("text_len"), F.col("quality_score"), F.col("is_probable_listing"), cfg.min_text)
    best = [F.col(c).desc() for c in ("quality_score", "reliability", "image", "text_len")] + [F.col("place")]
    near = quality_select(near, "query_id", good, good, F.lit(True), best, max(2 * cfg.top_k, cfg.top_k + 2)).drop("rank")
    rows = near.select("*", F.explode("best").alias("b")).select("*", F.col("b.chunk_id"), F.col("b.chunk"), F.col("b.score").alias("semantic_score")).drop("b", "best", "place")
    parts = evidence_parts(F.col("semantic_score"), F.lit("web_page"), F.col("quality_score"), F.col("is_probable_listing"), F.col("image"), F.col("reliability"), F.col("fresh"))
    rows = rows.withColumn("score", F.round(parts["total_score"], 9))
    usable = usable_chunk(F.col("chunk"), F.col("semantic_score"), F.col("semantic_score"), F.col("quality_score"), F.col("is_probable_listing"))
    picked = diverse_topk(rows, "query_id", "canonical_url", "domain", usable, [F.col("score").desc(), F.col("canonical_url"), F.col("doc"), F.col("chunk_id")], cfg.top_k, text="chunk", threshold=cfg.near_dup_chunks)
    return picked.select("query_id", "pick", "canonical_url", "domain", "title", "site_name", "date_published", "chunk_id", F.col("chunk").alias("content"), "semantic_score", "score", "quality_score", "is_probable_listing")


def context_of(evidence: DataFrame, queries: DataFrame, start: int = 1) -> DataFrame:
    """The rendered context of each query."""
    groups = group_evidence(evidence.withColumn("name", F.col("title")), "query_id", "canonical_url", "pick")
    return render_context(groups.join(queries.select("query_id", "query"), "query_id"), "query_id", "query", "canonical_url", start)


def answer_loop(questions: DataFrame, retrieve_fn: Callable[[DataFrame], DataFrame], judge_fn: Callable[[DataFrame], DataFrame], materialise: Callable[[DataFrame, str], DataFrame], cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Rounds of retrieval for all open questions at once: (question_id, rounds, verdict, context).

    retrieve_fn: (question_id, query, start) to (question_id, context, n_docs); judge_fn: (question_id, context) to (question_id, judgement, addition), null where it can't be
    read. A question closes at YES, at NO without an addition, at a run of unread verdicts, or after the last round. `materialise` writes each
    round to shared storage, so a round never recomputes the ones before.
    """
    state = questions.select("question_id", "query", F.lit(1).alias("start"), F.lit("").alias("context"), F.lit(0).alias("fails"), F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("verdict"), F.lit(True).alias("open"))
    for k in range(cfg.max_rounds):
        live = state.where("open")
        if k and live.isEmpty():
            break
        found = retrieve_fn(live.select("question_id", "query", "start")).select("question_id", F.col("context").alias("more"), "n_docs")
        grown = live.join(found, "question_id", "left").withColumn("context", F.concat_ws("\n\n", F.nullif("context", F.lit("")), "more")).withColumn("start", F.col("start") + F.coalesce("n_docs", F.lit(0)))
        grown = materialise(grown.drop("more", "n_docs"), f"round-{k}-context")
        said = judge_fn(grown.select("question_id", "context")).select("question_id", "judgement", "addition")
        after = grown.join(said, "question_id", "left").withColumn("fails", F.when(F.col("judgement").isNull(), F.col("fails") + 1).otherwise(0))
        again = ((F.col("judgement") == "NO") & F.col("addition").isNotNull()) | (F.col("judgement").isNull() & (F.col("fails") < cfg.max_parse_failures))
        after = after.withColumn("open", F.coalesce(again, F.lit(False)) & F.lit(k + 1 < cfg.max_rounds)).withColumn("verdict", F.coalesce("judgement", "verdict")).withColumn("query", F.coalesce("addition", "query")).withColumn("rounds", F.lit(k + 1)).drop("judgement", "addition")
        state = materialise(state.where("NOT open").unionByName(after), f"round-{k}")
    return state.select("question_id", "rounds", "verdict", "context")
