"""Grouping retrieved chunks by page and rendering them as citable context."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood import config
from siftwood.functions.similar import Seen
from siftwood.functions.text import text_signature
from siftwood.session import ensure_importable
from siftwood.storage import Scratch, settings

_FIRST = ("name", "site_name", "display_url", "date_published", "date_last_crawled", "content_source", "image_match_status", "image_match_decision", "web_fetch_status", "evidence_rescue_status")


def _pages(chunks: DataFrame, query: str, url: str, pos: str, text: str, threshold: float) -> DataFrame:
    """(query, url, rows_): the chunks of each page of a query in order, without those alike to an earlier one (at most a few tens are selected).

    A chunk with the same signature as an earlier one falls whether that one stays or not, so copies that come in one batch fall before the shuffle. Python sees positions
    and signatures only.
    """
    ensure_importable(chunks.sparkSession)
    others = [c for c in chunks.columns if c not in (query, url)]

    @F.pandas_udf("boolean")
    def copied(queries: pd.Series, urls: pd.Series, places: pd.Series, sigs: pd.Series) -> pd.Series:
        rows = pd.DataFrame({"q": queries, "u": urls, "p": places, "s": sigs})[sigs.str.len() >= 80]
        later = rows.sort_values("p", kind="stable").duplicated(["q", "u", "s"])
        return later.reindex(sigs.index, fill_value=False).astype(bool)

    @F.pandas_udf("array<int>")
    def keep(places: pd.Series, sigs: pd.Series) -> pd.Series:
        def of(ps, ss) -> list[int]:
            if len(ps) == 1:
                return [0]
            seen, out = Seen(threshold), []
            for i in sorted(range(len(ps)), key=lambda i: (1, 0) if ps[i] is None or ps[i] != ps[i] else (0, ps[i])):
                if len(ss[i]) < 80 or not seen.like(ss[i]):
                    out.append(i)
                    if ss[i]:
                        seen.add(ss[i])
            return out

        return pd.Series([of(p, s) for p, s in zip(places, sigs)], dtype=object)

    fresh = chunks.where(~copied.asNondeterministic()(F.col(query), F.col(url), F.col(pos), text_signature(F.col(text), config.SIGNATURE)))
    pages = fresh.groupBy(query, url).agg(F.collect_list(F.struct(*others)).alias("rows_"))
    kept = keep(F.transform("rows_", lambda r: r[pos]), F.transform("rows_", lambda r: text_signature(r[text], config.SIGNATURE)))
    return pages.withColumn("kept_", kept).select(query, url, F.expr("transform(kept_, i -> rows_[i])").alias("rows_"))


def suppress_near_duplicates(chunks: DataFrame, query: str, url: str, pos: str, text: str, threshold: float = 0.92) -> DataFrame:
    """Drops chunks alike to an earlier one of the same page of the same query."""
    return _pages(chunks, query, url, pos, text, threshold).select(query, url, F.inline("rows_")).select(*chunks.columns)


def group_pages(chunks: DataFrame, query: str, url: str, pos: str, text: str = "content") -> DataFrame:
    """One row a page of a query: first non-empty text attributes, maxima of scores, chunks in order, `first_pos`.

    A chunk alike to an earlier one of its page is left out first, and updates nothing.
    """
    given, rows = set(chunks.columns), F.col("rows_")
    of = lambda c, empty=None: F.transform(rows, lambda r: r[c] if empty is None else F.coalesce(r[c], F.lit(empty)))
    first = [F.coalesce(F.get(F.filter(of(c, ""), lambda x: x != ""), F.lit(0)), F.lit("")).alias(c) for c in _FIRST if c in given]
    tops = [F.array_max(of(c, 0.0)).alias(c) for c in ("score", "semantic_score", "max_image_similarity", "web_fetch_quality_score") if c in given]
    flags = [F.array_max(of(c, False)).alias(c) for c in ("web_fetch_is_probable_listing", "web_fetch_from_cache") if c in given]
    flags += [F.array_max(of(c)).alias(c) for c in ("image_match_image_count", "image_match_failed_count") if c in given]
    piece = lambda r: F.struct(F.coalesce(r["chunk_id"], F.lit(1_000_000_000)).alias("chunk_id"), (-r["score"]).alias("neg"), r[text].alias("content"))
    listed = F.sort_array(F.transform(F.filter(rows, lambda r: F.coalesce(r[text], F.lit("")) != ""), piece)).alias("chunks")
    return _pages(chunks, query, url, pos, text, 0.92).select(query, url, F.array_min(of(pos)).alias("first_pos"), *first, *tops, *flags, listed)


def group_evidence(chunks: DataFrame, query: str, url: str, pos: str, text: str = "content") -> DataFrame:
    """The pages of each query (`group_pages`) with `doc`, which numbers them by first appearance."""
    return group_pages(chunks, query, url, pos, text).withColumn("doc", F.row_number().over(Window.partitionBy(query).orderBy("first_pos")))


def context_urls(chunks: DataFrame, query: str, url: str, pos: str) -> DataFrame:
    """The distinct pages of each query, in order of first appearance."""
    first = chunks.where(F.coalesce(F.col(url), F.lit("")) != "").groupBy(query, url).agg(F.min(pos).alias("p"))
    return first.groupBy(query).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", url))), lambda s: s[url]).alias("urls"))


#: What the answering model is told about the blocks.
RULES = "Citation Rules:\nEach evidence block below has a stable source id such as [Doc 1]. Use these exact ids when citing claims in the final answer. "
NOTE = "Temporal Note:\nDocument date fields below are page/search metadata. For latest/current questions, verify event dates and completed/current status from titles or content."


def _three(c: Column) -> Column:
    return F.format_string("%.3f", F.bround(c, 3))


def evidence_source(source: Column, status: Column, cached: Column, quality: Column, listing: Column, rescue: Column) -> Column:
    """Where a block's text comes from, as the answering model reads it."""
    body = F.concat_ws(", ", F.lit("webpage body"), F.when(cached, "cache"), F.concat(F.lit("quality="), _three(quality)), F.when(rescue == "image_filter_rescue", "image-filter rescue"), F.when(listing, "possible listing page"))
    snippet = F.concat_ws(", ", F.lit("Search-result snippet fallback"), F.when(F.coalesce(status, F.lit("")) != "", F.concat(F.lit("fetch_status="), status)))
    return F.when(source == "web_page", body).when(F.contains(source, F.lit("fallback")), snippet).otherwise(source)


def image_line(status: Column, decision: Column, similarity: Column, images: Column, failed: Column) -> Column:
    """How a block's page images fit the question's."""
    matched = F.concat_ws(", ", F.lit("matched"), F.concat(F.lit("score="), _three(similarity)), F.concat(F.lit("decision="), F.nullif(decision, F.lit(""))), F.concat(F.lit("images="), images.cast("string")))
    broken = F.concat(F.lit("page image fetch failed, failed_images="), F.coalesce(failed, F.lit(0)).cast("string"))
    return F.when(status == "matched", matched).when(status == "no_images", "no page images available").when(status == "failed", broken).when(status == "unavailable", "CLIP image matching unavailable").otherwise(status)


def _body(groups: DataFrame, url: str) -> Column:
    """A block below its number; empty where it has no line. Columns that the groups lack give no lines."""
    given = set(groups.columns)
    of = lambda c, kind="string": F.col(c).cast(kind) if c in given else F.lit(None).cast(kind)
    line = lambda head, c, tail="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c, F.lit(tail)))
    some = lambda c: F.nullif(F.coalesce(of(c), F.lit("")), F.lit(""))
    dated = F.coalesce(line("Page metadata - Published: ", of("date_published"), " (not necessarily the event date)"), line("Page metadata - Last crawled: ", of("date_last_crawled"), " (not necessarily the event date)"))
    one, many = F.expr("concat('Evidence text: ', chunks[0].content)"), F.expr("concat('Evidence text:\\n', array_join(transform(chunks, (c, i) -> concat('- Chunk ', i + 1, ': ', c.content)), '\\n'))")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("URL: "), F.col(url)),
        line("Title: ", of("name")),
        line("Source: ", F.coalesce(some("site_name"), some("display_url"))),
        dated,
        F.concat(F.lit("Retrieval score: "), _three(F.col("score"))),
        line("Evidence source: ", evidence_source(of("content_source"), of("web_fetch_status"), of("web_fetch_from_cache", "boolean"), of("web_fetch_quality_score", "double"), of("web_fetch_is_probable_listing", "boolean"), of("evidence_rescue_status"))),
        line("Image match: ", image_line(of("image_match_status"), of("image_match_decision"), of("max_image_similarity", "double"), of("image_match_image_count", "long"), of("image_match_failed_count", "long"))),
        F.when(F.size("chunks") == 1, one).when(F.size("chunks") > 1, many),
    )


def _head(query_text: str, current_time: str) -> Column:
    """A context up to its first block."""
    parts = [F.lit(f"Pipeline Current Time:\n{current_time}") if current_time else F.lit(None).cast("string"), F.when(F.trim(query_text) != "", F.concat(F.lit("Search Query:\n"), F.trim(query_text))), F.lit(RULES), F.lit(NOTE), F.lit("Retrieved Context:\n")]
    return F.concat_ws("\n\n", *parts)


def render_context(groups: DataFrame, query: str, query_text: str, url: str, start: int = 1, current_time: str = "") -> DataFrame:
    """(query, context, n_docs): the sections of each query, with blocks numbered from `start`. Columns that the groups lack give no lines.

    A context is one string, so it must fit in a task's memory; `digest_context` takes those of any size.
    """
    number = F.concat(F.lit("[Doc "), (F.col("doc") + max(1, start) - 1).cast("string"), F.lit("] Evidence Block"))
    block = F.concat_ws("\n", number, F.nullif(_body(groups, url), F.lit("")))
    blocks = groups.select(query, query_text, "doc", block.alias("b")).groupBy(query, query_text).agg(F.sort_array(F.collect_list(F.struct("doc", "b"))).alias("bs"))
    return blocks.select(query, F.concat(_head(query_text, current_time), F.expr("array_join(transform(bs, x -> x.b), '\\n\\n')")).alias("context"), F.size("bs").alias("n_docs"))


#: Bytes of a packed block in one row, which bounds the batches of rows; bytes of a batch of blocks that Python packs.
PIECE, BATCH = 8192, "4194304"


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _packed(bodies: pd.Series) -> pd.Series:
    def of(b: bytes) -> list[bytes]:
        whole = len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)
        return [whole[i : i + PIECE] for i in range(0, len(whole), PIECE)]

    return bodies.map(of)


def digest_context(pages: DataFrame, query: str, query_text: str, url: str, start: int = 1, current_time: str = "") -> DataFrame:
    """(query, digest, n_docs): SHA-256 (lowercase hex) of the UTF-8 bytes of each context that `render_context` would give, and its number of blocks.

    pages: as `group_pages` gives them; blocks are numbered by `first_pos` as they pass. No context is ever held: blocks are written packed, then those of a query pass
    through one task in order, which holds one block and the state of the hash, so a context may exceed memory and the length of a string.
    """
    scratch = Scratch(pages.sparkSession, "digest-context")
    bodies = scratch.write(pages.select(F.col(query).alias("q"), F.col(query_text).alias("text"), "first_pos", F.col(url).alias("u"), _body(pages, url).alias("body")), "bodies", free=True)
    with settings(pages.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}):
        blocks = scratch.write(bodies.select("q", "text", "first_pos", "u", F.posexplode(_packed(F.col("body").cast("binary"))).alias("k", "piece")), "blocks")
    scratch.drop("bodies")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, state, n = None, [], None, 0

        def close() -> None:
            nonlocal n
            if held:
                whole = b"".join(held)
                body = pa.decompress(whole[8:], int.from_bytes(whole[:8], "little"), "zstd", asbytes=True)
                state.update((b"\n\n" if n else b"") + f"[Doc {n + max(1, start)}] Evidence Block".encode() + (b"\n" if body else b""))
                state.update(body)
                n += 1
                held.clear()

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last[0]], key_type), pa.array([state.hexdigest()]), pa.array([n], pa.int32())], ["q", "digest", "n_docs"])

        for batch in batches:
            key_type = batch.schema.field("q").type
            for q, text, k, piece, head in zip(*(batch.column(c).to_pylist() for c in ("q", "text", "k", "piece", "head"))):
                if k == 0:
                    close()
                if last != (q, text):
                    if state:
                        yield result()
                    last, state, n = (q, text), hashlib.sha256(head.encode()), 0
                held.append(piece)
        close()
        if state:
            yield result()

    ordered = blocks.repartition("q", "text").sortWithinPartitions("q", "text", "first_pos", "u", "k")
    kind = dict(blocks.dtypes)["q"]
    out = ordered.select("q", "text", "k", "piece", _head("text", current_time).alias("head")).mapInArrow(digests, f"q {kind}, digest string, n_docs int")
    return scratch.keep(out.select(F.col("q").alias(query), "digest", "n_docs"))
