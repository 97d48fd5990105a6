"""The rule router: one CASE expression of substring tests, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwood import config
from siftwood.functions.text import let, normalize_query, strip

RISK_TERMS = config.VISUAL + config.SPATIAL + config.DEICTIC + config.EVIDENCE + config.FRESH


def term_hits(q: Column, terms: list[str], word_boundary: bool = False) -> Column:
    """The terms that a normalised query holds, in list order; as substrings, or as whole words."""
    held = (lambda t: q.rlike(F.concat(F.lit(r"\b"), t, F.lit(r"\b")))) if word_boundary else (lambda t: F.contains(q, t))
    return F.filter(F.array(*[F.lit(t) for t in terms]), held)


def has_payload(query: Column) -> Column:
    quoted = query.rlike("\"[^\"]{3,}\"|'[^']{3,}'|“[^”]{3,}”")
    return quoted | query.rlike(r"(?s)[:：]\s*.{8,}") | (F.length(strip(query)) >= 120)


def _greeting(q: Column) -> Column:
    return q.rlike(r"^(hi|hello|hey|thanks|thank you|good morning|good afternoon|good evening|who are you|what can you do|introduce yourself|tell me a joke|chat with me)[.!?\s]*$")


def _math(q: Column) -> Column:
    return q.rlike(r"\d+\s*[-+*/^]\s*\d+|[a-z]\s*\^\s*\d+|solve\s+.*=")


def _concept(q: Column) -> Column:
    found = [F.regexp_extract(q, p, 1) for p in (r"^what is ([a-z0-9 \-]+)\??$", r"^explain ([a-z0-9 \-]+)\.?$", r"^explain the concept of ([a-z0-9 \-]+)\.?$", r"^give me an overview of ([a-z0-9 \-]+)\.?$")]
    return F.coalesce(*[F.when(F.trim(f).isin(config.CONCEPTS), F.trim(f)) for f in found], F.lit(""))


def route(query: Column, word_boundary: bool = False) -> Column:
    """struct(decision, confidence, reason, matched)."""
    raw = F.coalesce(query, F.lit(""))
    return let(F.struct(raw.alias("raw"), normalize_query(raw).alias("q"), has_payload(raw).alias("payload")), lambda x: _cascade(x["raw"], x["q"], x["payload"], word_boundary))


def _cascade(raw: Column, q: Column, payload: Column, word_boundary: bool) -> Column:
    hits = lambda terms: term_hits(q, terms, word_boundary)
    some = lambda terms: F.size(hits(terms)) > 0
    answer = lambda d, c, r, m: F.struct(F.lit(d).alias("decision"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"), m.alias("matched"))
    also = lambda terms, word: F.concat(hits(terms), F.array(F.lit(word)))
    free, need, none = "NO_RAG_CONFIDENT", "NEED_RAG", F.array().cast("array<string>")
    concept = _concept(q)
    return (
        F.when(strip(raw) == "", answer(free, 0.99, "EMPTY_QUERY", none))
        .when(some(RISK_TERMS), answer(need, 0.90, "RAG_RISK_SIGNAL", hits(RISK_TERMS)))
        .when(_greeting(q), answer(free, 0.99, "GREETING_OR_SMALLTALK", F.array(F.lit("short_greeting"))))
        .when(some(config.TRANSFORM) & payload, answer(free, 0.97, "INLINE_TEXT_TRANSFORM", also(config.TRANSFORM, "inline_payload")))
        .when(some(config.SUMMARY) & payload, answer(free, 0.96, "INLINE_TEXT_SUMMARIZATION_OR_EXTRACTION", also(config.SUMMARY, "inline_payload")))
        .when(some(config.CREATIVE) & ~payload, answer(free, 0.93, "GENERAL_CREATIVE_GENERATION", hits(config.CREATIVE)))
        .when(some(config.CODE) & ~some(config.REPO_WORDS), answer(free, 0.94, "GENERAL_CODE_TASK", hits(config.CODE)))
        .when(some(config.MATH) & _math(q), answer(free, 0.95, "INLINE_MATH_TASK", also(config.MATH, "math_expression")))
        .when(concept != "", answer(free, 0.94, "GENERAL_CONCEPT_WHITELIST", F.array(concept)))
        .otherwise(answer("UNCERTAIN", 0.50, "NO_HIGH_CONFIDENCE_RULE_MATCH", none))
    )
