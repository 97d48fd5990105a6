"""Reading what models write: verdicts, candidates and choices, tolerant of prose around JSON."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Provider freshness windows, in the order in which they are tried.
FRESHNESS = ["oneDay", "oneWeek", "oneMonth", "oneYear", "noLimit"]
CANDIDATE = "array<struct<name: string, type: string, aliases: array<string>, confidence: double, reason: string, missing_slot: string>>"


def freshness_choice(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    out = F.when(t.isin(FRESHNESS), t)
    for value in FRESHNESS:
        out = out.when(F.contains(t, F.lit(value)), value)
    return out.otherwise("noLimit")


def sufficiency(text: Column) -> Column:
    """struct(judgement, addition) of the first flat JSON object with a usable judgement; null without one."""
    objects = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\{[\s\S]*?\})"), F.lit(1))
    schema = "struct<judgement: string, judge: string, addition: string>"

    def read(x: Column) -> Column:
        j = F.from_json(x, schema)
        said = F.upper(F.trim(F.coalesce(j["judgement"], j["judge"])))
        verdict = F.when(said.isin("YES", "TRUE"), "YES").when(said.isin("NO", "FALSE"), "NO")
        return F.struct(verdict.alias("judgement"), F.nullif(F.trim(j["addition"]), F.lit("")).alias("addition"))

    usable = F.filter(F.transform(objects, read), lambda s: s["judgement"].isNotNull())
    return F.get(usable, 0)


def judge_verdict(text: Column) -> Column:
    """True for CORRECT, false for INCORRECT, null where neither is said."""
    t = F.trim(F.coalesce(text, F.lit("")))
    j = F.from_json(t, "struct<verdict: string, label: string>")
    said = F.upper(F.trim(F.coalesce(F.nullif(j["verdict"], F.lit("")), j["label"])))
    up = F.upper(t)
    return F.when(said == "CORRECT", True).when(said == "INCORRECT", False).when(F.contains(up, F.lit("INCORRECT")), False).when(F.contains(up, F.lit("CORRECT")), True)


def json_objects(text: str) -> list[dict]:
    """Every JSON object that starts at any brace, nested ones too."""
    decoder, out, at = json.JSONDecoder(), [], (text or "").find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            out.append(found)
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)
    return out


def _candidate(item) -> dict | None:
    text = lambda v: str(v or "").strip()
    if not isinstance(item, dict) or not text(item.get("name")):
        return None
    name = text(item["name"])
    given = item.get("aliases")
    aliases = [a for a in map(text, given if isinstance(given, list) else []) if a and a.lower() != name.lower()]
    try:
        sure = min(1.0, max(0.0, float(item.get("confidence", 0.0))))
    except (TypeError, ValueError):
        sure = 0.0
    return {"name": name, "type": text(item.get("type")), "aliases": list(dict.fromkeys(aliases)), "confidence": sure, "reason": text(item.get("reason")), "missing_slot": text(item.get("missing_slot"))}


def candidates(text: str, most: int = 3) -> list[dict]:
    """The entity candidates of the first object that lists any, the surest and longest first."""
    for found in json_objects(text):
        listed = found.get("candidates")
        usable = [c for c in map(_candidate, listed if isinstance(listed, list) else []) if c]
        if usable:
            return sorted(usable, key=lambda c: (-c["confidence"], -len(c["name"])))[:most]
    return []


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("missing_slot", T.StringType())])))
def entity_candidates(text: pd.Series) -> pd.Series:
    return text.map(candidates)


def candidate_variants(found: Column) -> Column:
    """Each candidate's name and its first alias."""
    return F.flatten(F.transform(found, lambda c: F.concat(F.array(c["name"]), F.slice(c["aliases"], 1, 1))))


def assign(similarity: np.ndarray) -> list[tuple[int, int]]:
    """A one-to-one assignment of largest total similarity, by shortest augmenting paths over reduced costs."""
    s = np.asarray(similarity, float)
    if s.size == 0:
        return []
    flipped = s.shape[0] > s.shape[1]
    cost = s.max() - (s.T if flipped else s)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, last = start, 0.0, -1
        while True:
            better = base + cost[row] - row_price[row] - col_price
            closer = ~done & (better < dist)
            dist[closer], via[closer] = better[closer], last
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row, last = row_of[col], col
        settled = done & (row_of >= 0)
        row_price[row_of[settled]] += base - dist[settled]
        row_price[start] += base
        col_price[done] -= base - dist[done]
        while col >= 0:
            back = via[col]
            row_of[col] = row_of[back] if back >= 0 else start
            col = back
    pairs = [(int(r), c) for c, r in enumerate(row_of) if r >= 0]
    return sorted((c, r) for r, c in pairs) if flipped else sorted(pairs)
