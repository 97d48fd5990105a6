"""Evidence scores and predicates over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwood import config
from siftwood.functions.text import listing_noise, strip


def lexical_score(query_tokens: Column, chunk_tokens: Column) -> Column:
    """Three quarters recall and one quarter precision of distinct tokens."""
    both = F.size(F.array_intersect(query_tokens, chunk_tokens)).cast("double")
    q, c = F.size(query_tokens), F.size(chunk_tokens)
    return F.when((q == 0) | (c == 0), 0.0).otherwise(0.75 * both / F.greatest(q, F.lit(1)) + 0.25 * both / F.greatest(c, F.lit(1)))


def source_reliability(host: Column, path: Column, site: Column) -> Column:
    text = F.concat_ws(" ", host, F.lower(path), F.lower(F.coalesce(site, F.lit(""))))
    any_of = lambda tokens: F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(text, t))
    return (
        F.when(host.rlike(r"\.gov$|\.gov\.|\.mil$"), 0.08)
        .when(host.rlike(r"\.edu$|\.edu\.|\.ac\."), 0.04)
        .when(any_of(config.TRUSTED_TOKENS), 0.04)
        .when(any_of(config.WEAK_TOKENS), -0.02)
        .otherwise(0.0)
    )


def freshness(published: Column, as_of: str) -> Column:
    """A bonus by age in days at a fixed moment; times without a zone are UTC, and what can't be read as ISO text has none."""
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(published.try_cast("timestamp"))) / 86_400_000_000
    return F.coalesce(F.when(days < 0, 0.0).when(days <= 7, 0.04).when(days <= 30, 0.025).when(days <= 365, 0.005).otherwise(0.0), F.lit(0.0))


def image_decision(similarity: Column, status: Column, threshold: float = 0.5) -> Column:
    return F.when(status != "matched", status).when(similarity >= threshold, "strong_match").when(similarity >= 0.7 * threshold, "weak_match").otherwise("low_similarity")


def image_bonus(status: Column, decision: Column, similarity: Column, threshold: float = 0.5) -> Column:
    strong = F.least(F.lit(0.05), F.greatest(F.lit(0.0), (similarity - threshold) * 0.12 + 0.025))
    scored = F.when(decision == "strong_match", strong).when(decision == "weak_match", 0.01).when(decision == "low_similarity", -0.005).otherwise(0.0)
    return F.when(status == "matched", scored).otherwise(0.0)


def evidence_parts(chunk_score: Column, source: Column, quality: Column, listing: Column, image: Column, reliability: Column, fresh: Column) -> dict[str, Column]:
    """The addends of an evidence score and their total."""
    src, q = F.coalesce(source, F.lit("")), F.coalesce(quality, F.lit(0.0))
    parts = {
        "semantic_score": chunk_score,
        "content_adjustment": F.when(src == "web_page", 0.04).when(F.contains(src, F.lit("fallback")), -0.04).otherwise(0.0),
        "quality_bonus": F.when(src == "web_page", F.least(F.lit(0.06), q * 0.06)).otherwise(0.0),
        "image_bonus": image,
        "source_bonus": reliability,
        "freshness_bonus": fresh,
        "listing_penalty": F.when(listing, -0.04).otherwise(0.0),
    }
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    return parts | {"total_score": total}


def usable_chunk(content: Column, semantic: Column, text_score: Column, quality: Column, listing: Column) -> Column:
    t = strip(F.coalesce(content, F.lit("")))
    sem = F.coalesce(semantic, F.lit(0.0))
    doubtful = F.coalesce(listing, F.lit(False)) | listing_noise(content)
    relevant = (sem >= 0.3) | (F.coalesce(text_score, sem) >= 0.18)
    long = (F.coalesce(quality, F.lit(0.0)) >= 0.55) & (F.length(t) >= 900) & (sem >= 0.22)
    return (t != "") & (~doubtful | relevant | long)


def high_quality_body(source: Column, status: Column, length: Column, quality: Column, listing: Column, min_text: int = 300) -> Column:
    q = F.coalesce(quality, F.lit(0.0))
    base = (source == "web_page") & status.isin("success", "short_content") & (length >= min_text) & (q >= 0.25)
    return F.coalesce(base & (~F.coalesce(listing, F.lit(False)) | ((length >= 1200) & (q >= 0.35))), F.lit(False))


def usable_fallback(source: Column, length: Column, match_status: Column, reliability: Column) -> Column:
    return F.coalesce(F.contains(source, F.lit("fallback")) & (length >= 300) & ((F.coalesce(match_status, F.lit("")) == "matched") | (reliability > 0)), F.lit(False))


def page_text_better(text: Column, fallback: Column, quality: Column, listing: Column) -> Column:
    """Whether a fetched body replaces the search result's own text."""
    n, f = F.length(F.coalesce(text, F.lit(""))), F.length(F.coalesce(fallback, F.lit("")))
    return (
        F.when(n == 0, False)
        .when(listing, (quality >= 0.55) & (n >= F.greatest(F.lit(1200.0), f * 1.2)))
        .when((quality < 0.2) & (f > 0), False)
        .when(n >= 300, True)
        .otherwise(n > F.greatest(F.lit(120.0), f * 1.5))
    )
