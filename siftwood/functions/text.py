"""Text functions, Column to Column, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood import config

#: Unicode white space; Java's own \s is ASCII only.
SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words_of(c: Column) -> Column:
    """Words at Unicode white space, none for an empty text."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def text_signature(text: Column, length: int | None = None) -> Column:
    """Letters and digits in lower case of the whole text; cut where a rule fixes a length."""
    whole = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))
    return whole if length is None else F.substring(whole, 1, length)


def doc_signature(*parts: Column) -> Column:
    return text_signature(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]), config.SIGNATURE)


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unescape(t))


def clean_text(text: Column) -> Column:
    """Entities are decoded, white space and control characters become single spaces, zero-width characters go.

    The few texts that hold something like an entity pass through Python; all else is columns.
    """
    raw = F.coalesce(text, F.lit(""))
    odd = raw.rlike("&#?[A-Za-z0-9]")
    t = F.coalesce(_unescaped(F.when(odd, raw)), raw)
    t = F.regexp_replace(t, "[\u200b-\u200f\u202a-\u202e\ufeff]", "")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\xa0]", " ")
    return F.trim(F.regexp_replace(t, SPACE, " "))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(clean_text(v), F.lit("")) for v in values], F.lit(""))


def safe_float(value: Column, default: float = 0.0) -> Column:
    """A number, or the default where there is none to read."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def count_of(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def looks_boilerplate(text: Column) -> Column:
    low, n = F.lower(text), F.length(text)
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (
        (low.rlike("|".join(config.BOILERPLATE)) & (n < 220))
        | ((n <= 18) & low.rlike("|".join(config.NAV_WORDS)))
        | (count_of(text, "|") >= 4)
        | (count_of(text, " / ") >= 4)
        | ((n > 0) & (alnum / F.greatest(n, F.lit(1)) < 0.35))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once a row; inside lambdas Catalyst would compute it again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def listing_noise(text: Column) -> Column:
    """Navigation and link-list text rather than prose."""

    def judge(t: Column) -> Column:
        hits = let(F.lower(t), lambda low: F.size(F.filter(F.array(*[F.lit(x) for x in config.LISTING_TOKENS]), lambda x: F.contains(low, x))))
        lines = F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.struct(F.regexp_count(x, F.lit(r"(?U)\S+")).alias("w"), x.alias("x")))

        def add(a: Column, x: Column) -> Column:
            short = (x["w"] > 0) & (x["w"] <= 7) & (F.length(strip(x["x"])) <= 80)
            return F.struct((a["n"] + (x["w"] > 0).cast("int")).alias("n"), (a["s"] + short.cast("int")).alias("s"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"))
        shorts = F.aggregate(lines, zero, add, lambda a: (a["n"] >= 5) & (a["s"] / F.greatest(a["n"], F.lit(1)) >= 0.7))
        return F.when(t == "", False).otherwise(let(hits, lambda h: (h >= 2) | ((h >= 1) & (F.length(t) < 900))) | shorts)

    return let(strip(F.coalesce(text, F.lit(""))), judge)


def strip_title_suffix(title: Column, site: Column) -> Column:
    t, s = clean_text(title), clean_text(site)
    out = t
    for sep in (" -- ", "_", " | ", " - "):  # the last one wrapped is tried first
        tail = F.concat(F.lit(sep), s)
        out = F.when(F.endswith(t, tail), F.trim(F.left(t, F.length(t) - F.length(tail)))).otherwise(out)
    return F.when((t == "") | (s == ""), t).otherwise(out)


def json_ld_date(html: Column) -> Column:
    found = [F.regexp_extract(html, rf'(?i)"{key}"\s*:\s*"([^"]+)"', 1) for key in ("datePublished", "pubdate")]
    return F.when(found[0] != "", clean_text(found[0])).otherwise(clean_text(found[1]))


def content_hash(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.sha2(text, 256))


def lexical_tokens(text: Column) -> Column:
    """Distinct ASCII letter-digit runs and single CJK characters of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+|[一-鿿])"), F.lit(1)))


def normalize_query(q: Column) -> Column:
    return F.regexp_replace(F.lower(strip(q)), SPACE, " ")


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?<=[。！？!?])|(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def char_windows(text: Column, size: int, overlap: int) -> Column:
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))), lambda w: strip(w) != "")
