"""Operators around injected models: routing by a judge, query generation, embeddings, page images and chunk profiles.

A provider is a batch function, list to list. It runs in Arrow batches on the executors, and only on the rows that need it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.functions.model_text import entity_candidates, freshness_choice, judge_verdict, sufficiency
from siftwood.functions.routing import route
from siftwood.functions.url import valid_image_url
from siftwood.operators.select import dedupe_queries
from siftwood.session import ensure_importable

Batch = Callable[[list], list]


def _mapped(f: Batch, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(f(values.tolist()), index=values.index, dtype=object)

    return run


def chat(prompt: Column, f: Batch) -> Column:
    return _mapped(f, T.StringType())(prompt)


def embed(values: Column, f: Batch) -> Column:
    """Vectors from an embedding provider; a value that it fails on gets null."""

    def safe(batch: list) -> list:
        try:
            return f(batch)
        except Exception:  # one bad value must not lose its batch: each is tried alone
            out = []
            for v in batch:
                try:
                    out += f([v])
                except Exception:
                    out.append(None)
            return out

    return _mapped(safe, T.ArrayType(T.FloatType()))(values)


def should_use_rag(questions: DataFrame, question: str, ask: Batch, floor: float = 0.90) -> DataFrame:
    """The rule route; the judge is asked about uncertain questions alone. RAG is skipped only on a sure NO_RAG rule, or where the judge says that
    nothing is missing; unread or failed answers use RAG.
    """
    ensure_importable(questions.sparkSession)
    routed = questions.withColumn("route_", route(F.col(question)))
    known = routed.where("route_.decision <> 'UNCERTAIN'").withColumn("use_rag", ~((F.col("route_.decision") == "NO_RAG_CONFIDENT") & (F.col("route_.confidence") >= floor)))
    asked = routed.where("route_.decision = 'UNCERTAIN'").withColumn("use_rag", F.coalesce(sufficiency(chat(F.col(question), ask))["judgement"] != "YES", F.lit(True)))
    return known.unionByName(asked).select(*questions.columns, "route_.decision", "route_.reason", "use_rag")


def candidates_block(found: Column) -> Column:
    """The numbered candidates of a prompt."""
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["name"], F.when(c["type"] != "", F.concat(F.lit(" ("), c["type"], F.lit(")"))).otherwise(""), F.when(F.size(c["aliases"]) > 0, F.concat(F.lit("; aliases: "), F.array_join(c["aliases"], ", "))).otherwise(""))
    return F.when(F.size(found) == 0, "- none").otherwise(F.array_join(F.transform(found, line), "\n"))


def previous_block(queries: Column) -> Column:
    return F.when(F.coalesce(F.size(queries), F.lit(0)) <= 0, "- none").otherwise(F.array_join(F.transform(queries, lambda q: F.concat(F.lit("- "), q)), "\n"))


def generate_queries(questions: DataFrame, qid: str, question: str, find: Batch, write: Batch, limit: int = 3) -> DataFrame:
    """(qid, pos, query): one query for each entity candidate that the first model lists (its name and first alias go into the prompt), else one for the plain question; distinct, up to a limit."""
    ensure_importable(questions.sparkSession)
    found = questions.select(qid, question, entity_candidates(chat(F.col(question), find)).alias("c"))
    none = F.array(F.lit(None).cast("struct<name:string,type:string,aliases:array<string>,confidence:double,reason:string,missing_slot:string>"))
    rows = found.select(qid, question, F.posexplode(F.when(F.size("c") > 0, F.col("c")).otherwise(none)).alias("pos", "c"))
    prompt = F.concat_ws("\n", F.col(question), F.when(F.col("c").isNotNull(), F.concat_ws(" / ", F.col("c.name"), F.get("c.aliases", 0))))
    return dedupe_queries(rows.select(qid, "pos", chat(prompt, write).alias("query")), qid, "query", "pos", limit).select(qid, "pos", "query")


def prompted(task: str, **parts: Column) -> Column:
    """A prompt: the task, then each part under its name; empty parts are left out."""
    named = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name.replace('_', ' ').capitalize()}:\n"), c)) for name, c in parts.items()]
    return F.concat_ws("\n\n", F.lit(task), *named)


ANSWER = "Answer the question from the evidence blocks and the images. Cite the block of every claim that rests on one, as in [Doc 1]; cite nothing that a block does not say. Compare dates of events, not of pages."
PLAIN_ANSWER = "Answer the question from the images and what you know. Where the answer changes with time, say that it may be out of date."
FRESHNESS = "Name the window that the search for this question needs, one of oneDay, oneWeek, oneMonth, oneYear, noLimit."
SUFFICIENCY = 'Say whether the context answers the question. Return JSON: {"judgement": "YES" or "NO", "addition": the search that is still missing}.'
VERDICT = 'Compare the prediction with the reference answer. Return JSON: {"verdict": "CORRECT" or "INCORRECT"}.'


def choose_freshness(questions: DataFrame, question: str, ask: Batch) -> DataFrame:
    """Adds freshness: the window that a model chooses for each question, noLimit where it names none."""
    ensure_importable(questions.sparkSession)
    return questions.withColumn("freshness", freshness_choice(chat(prompted(FRESHNESS, question=F.col(question)), ask)))


#: The ways to answer: without evidence, with it (from texts, or texts and images), or as the route decides.
MODES = ("no_rag", "text_only_rag", "full_rag", "route_router")


def answer_questions(questions: DataFrame, question: str, mode: str, contexts: Callable[[DataFrame, bool], DataFrame], answer: Batch, ask: Batch) -> DataFrame:
    """Adds mode, use_rag and prediction. contexts: the questions that need evidence, and whether images count, to the same rows with a `context`."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    ensure_importable(questions.sparkSession)
    if mode == "route_router":
        routed = should_use_rag(questions, question, ask).drop("decision", "reason")
    else:
        routed = questions.withColumn("use_rag", F.lit(mode != "no_rag"))
    plain = routed.where("NOT use_rag").withColumn("prompt_", prompted(PLAIN_ANSWER, question=F.col(question)))
    found = contexts(routed.where("use_rag"), mode != "text_only_rag") if mode != "no_rag" else None
    if found is not None:
        plain = plain.unionByName(found.withColumn("prompt_", prompted(ANSWER, evidence=F.col("context"), question=F.col(question))).drop("context"))
    return plain.withColumn("mode", F.lit(mode)).withColumn("prediction", chat(F.col("prompt_"), answer)).drop("prompt_")


def judge(predictions: DataFrame, prompt: Column, ask: Batch) -> DataFrame:
    """Adds judge_correct; an answer that says neither fails the job."""
    ensure_importable(predictions.sparkSession)
    said = predictions.withColumn("judge_raw", chat(prompt, ask))
    bad = F.raise_error(F.concat(F.lit("unreadable verdict: "), F.coalesce("judge_raw", F.lit("null")))).cast("boolean")
    return said.withColumn("judge_correct", F.coalesce(judge_verdict(F.col("judge_raw")), bad))


def page_images(docs: DataFrame, key: str, images: str, download: Batch, embed_images: Batch, limit: int = 3, known: DataFrame | None = None) -> DataFrame:
    """(key, url, vector): the valid images of each document, downloaded and embedded once for each distinct URL. A null vector failed.

    known: (url, vector) of earlier runs, which are not fetched again.
    """
    ensure_importable(docs.sparkSession)
    urls = F.slice(F.array_distinct(F.filter(F.col(images), valid_image_url)), 1, limit)
    wanted = docs.select(key, F.posexplode(urls).alias("pos", "url"))
    fresh = wanted.select("url").distinct()
    if known is not None:
        fresh = fresh.join(known.select("url"), "url", "left_anti")
    body = fresh.withColumn("body", _mapped(download, T.BinaryType())(F.col("url")))
    done = body.where("body IS NOT NULL AND length(body) > 0").select("url", embed(F.col("body"), embed_images).alias("vector"))
    if known is not None:
        done = done.unionByName(known.select("url", "vector"))
    return wanted.join(done, "url", "left").select(key, "pos", "url", "vector")


def image_states(images: DataFrame, key: str) -> DataFrame:
    """What is known of each document's images, from `page_images`: embedded URLs in order, failed URLs, and that all were tried."""
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "url")))), lambda x: x["url"])
    return images.groupBy(key).agg(listed(F.col("vector").isNotNull()).alias("embedded_urls"), listed(F.col("vector").isNull()).alias("failed_urls")).withColumn("ready", F.lit(True))


def page_image_score(images: DataFrame, key: str, similarity: str, default: float = 1.0) -> DataFrame:
    """The best similarity of each document, or the default where none is known."""
    return images.groupBy(key).agg(F.coalesce(F.max(similarity), F.lit(default)).alias("score"))


def chunk_profiles(chunks: DataFrame, stored: DataFrame, query: str, embed_text: Batch) -> DataFrame:
    """Profiles (content_hash, size, query_id, chunk_id, chunk, vector): stored ones are reused, the rest are embedded. Keys hold the
    content's hash and the query, so new text or another query never meets an old profile.
    """
    ensure_importable(chunks.sparkSession)
    keys = ["content_hash", "size", query]
    fresh = chunks.join(stored.where("vector IS NOT NULL").select(*keys).distinct(), keys, "left_anti")
    made = fresh.select(*keys, "chunk_id", "chunk", embed(F.col("chunk"), embed_text).alias("vector"))
    reused = stored.join(chunks.select(*keys).distinct(), keys, "left_semi").where("vector IS NOT NULL")
    return reused.select(*made.columns).unionByName(made)


def save_images(images: DataFrame, path: str) -> None:
    """Writes downloaded bodies once for each URL, keyed by a 16-digit hash; existing keys are skipped.

    images: url, body and, where it is known, content_type; what is no image by its type is not written.
    """
    spark = images.sparkSession
    kind = F.lower(F.coalesce("content_type", F.lit(""))) if "content_type" in images.columns else F.lit("")
    new = images.where("body IS NOT NULL AND length(body) > 0").where((kind == "") | F.startswith(kind, F.lit("image/"))).select(F.substring(F.sha2("url", 256), 1, 16).alias("key"), "url", "body").dropDuplicates(["key"])
    try:
        new = new.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)
