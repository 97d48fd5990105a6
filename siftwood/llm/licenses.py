"""License scan with a tolerance for errors in short notices.

Exact places: the base phrases' words standing one after the other. Fuzzy places: in each short notice the words that name the license must stand
exactly, as whole words; the words around them may differ by up to k character edits in all. By the pigeonhole principle one of the k + 1 pieces
that the rest is cut into then stands unchanged, so the pieces, found by one Aho-Corasick pass, locate every candidate. Around each candidate that
holds the name, the regex library's bounded-error matching (`{e<=k}`) verifies the edits and reports the span. So an edit never turns one
license into another: bsd is three edits from mit, and nc two from sa.

Both work on the text with A-Z in lower case and words joined by one space. Scans are row by row: no shuffle and one broadcast of a few notices.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters; a null or empty text has none, no places, no labels
and score 0. Texts of any length are scanned whole. Repeated rows give equal rows; ids may be null. Other columns are ignored. Ties: of overlapping
fuzzy places of one notice the one with the fewest edits counts, then the first. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm import kernel
from siftwood.session import ensure_importable

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices as words, with the naming words in braces; their labels; the character edits allowed around the names; and words that
#: must not follow, as they would name another license.
_CC = ("nc", "sa", "nd")
_CREATIVE = ("noncommercial", "non", "sharealike", "share", "noderivatives", "noderivs", "no")
NOTICES = (
    ("released under the {mit} license", "mit", 3, ()),
    ("permission is hereby granted free of charge to any person {obtaining a copy}", "mit", 5, ()),
    ("licensed under the {apache} license version {2}", "apache-2", 4, ()),
    ("released under the {bsd} license", "bsd", 3, ()),
    ("redistribution and use in {source and binary} forms", "bsd", 3, ()),
    ("released under the {isc} license", "isc", 3, ()),
    ("permission to use copy modify and or {distribute this software} for any purpose", "isc", 4, ()),
    ("licensed under the {gnu general} public license", "gpl", 4, ()),
    ("{gnu general} public license version {2}", "gpl-2", 3, ()),
    ("{gnu general} public license version {3}", "gpl-3", 3, ()),
    ("{gnu lesser} general public license", "lgpl", 3, ()),
    ("{gnu affero} general public license", "agpl", 3, ()),
    ("{mozilla} public license", "mpl", 2, ()),
    ("{eclipse} public license", "epl", 2, ()),
    ("licensed under {cc by}", "cc-by", 2, _CC),
    ("licensed under {cc by sa}", "cc-by-sa", 2, ()),
    ("licensed under {cc by nd}", "cc-by-nd", 2, ()),
    ("licensed under {cc by nc}", "cc-by-nc", 2, _CC),
    ("licensed under {cc by nc sa}", "cc-by-nc-sa", 2, ()),
    ("licensed under {cc by nc nd}", "cc-by-nc-nd", 2, ()),
    ("creative commons {attribution}", "cc-by", 3, _CREATIVE),
    ("creative commons {attribution sharealike}", "cc-by-sa", 3, ()),
    ("creative commons {attribution noncommercial}", "cc-by-nc", 3, _CREATIVE),
    ("{cc0} universal public domain dedication", "cc0", 4, ()),
    ("dedicated to the {public domain}", "public-domain", 3, ()),
    ("this is free and {unencumbered} software", "unlicense", 3, ()),
    ("all {rights} reserved", "all-rights-reserved", 2, ()),
)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NOT_WORD = np.zeros(256, bool)
_NOT_WORD[0x00:0x30] = _NOT_WORD[0x3A:0x61] = _NOT_WORD[0x7B:0x80] = True


@dataclass(frozen=True)
class Notice:
    """A notice made ready: its plain text, name parts, the pieces (text, offset in the notice) and the pattern."""

    text: str
    label: str
    edits: int
    names: tuple[str, ...]
    pieces: tuple[tuple[str, int], ...]
    pattern: regex.Pattern
    never: regex.Pattern | None


def _prepare(marked: str, label: str, k: int, never: tuple[str, ...]) -> Notice:
    parts = re.split(r"[{}]", marked)  # context and name take turns
    plain, pattern, context, at = "".join(parts), "", [], 0
    for i, part in enumerate(parts):
        if i % 2:
            pattern += f"(?<![^ ]){regex.escape(part)}(?![^ ])"
        elif part.strip():
            body = part.strip()
            head, tail = part[: len(part) - len(part.lstrip())], part[len(part.rstrip()) :]
            pattern += f"{head}(?:{regex.escape(body)}){{e<={k}}}{tail}"
            context.append((body, at + len(head)))
        else:
            pattern += part
        at += len(part)
    # each context is cut into pieces by its share of all characters, k + 1 or more in all
    total, pieces = sum(len(c) for c, _ in context), []
    for body, start in context:
        n = max(1, math.ceil((k + 1) * len(body) / total))
        cuts = [len(body) * j // n for j in range(n + 1)]
        pieces += [(body[i:j], start + i) for i, j in zip(cuts, cuts[1:])]
    return Notice(plain, label, k, tuple(parts[1::2]), tuple(pieces), regex.compile(f"(?be){pattern}"), regex.compile(f" (?:{'|'.join(never)})(?![^ ])") if never else None)


@lru_cache
def prepared(notices: tuple = NOTICES) -> tuple[tuple[Notice, ...], ahocorasick.Automaton]:
    """The notices made ready, and one automaton of the pieces of all."""
    ready, auto = tuple(_prepare(*n) for n in notices), ahocorasick.Automaton()
    for n, notice in enumerate(ready):
        for piece, at in notice.pieces:
            auto.add_word(piece, (*(auto.get(piece) if piece in auto else ()), (n, at, len(piece))))
    auto.make_automaton()
    return ready, auto


def fuzzy_places(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of bounded-error matches in a text of words joined by one space."""
    ready, auto = prepared(notices)
    spans: dict[int, list[list[int]]] = {}
    for end, hits in auto.iter(text):
        for n, at, length in hits:
            k = ready[n].edits
            a = end + 1 - length - at - k
            b = a + len(ready[n].text) + 2 * k + 1  # and the character after it
            own = spans.setdefault(n, [])
            if own and a <= own[-1][1]:
                own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
            else:
                own.append([a, b])
    out = []
    for n, own in spans.items():
        notice = ready[n]
        for a, b in own:
            a, b = max(0, a), min(len(text), b)
            if all(text.find(name, a, b) >= 0 for name in notice.names):
                # each context may take k edits by itself, so all of them are summed here
                for m in notice.pattern.finditer(text, a, min(len(text), b)):
                    if (edits := sum(m.fuzzy_counts)) <= notice.edits and not (notice.never and notice.never.match(text, m.end())):
                        out.append((n, m.start(), m.end(), edits))
    return sorted(out)


def scan_text(raw: bytes, notices: tuple = NOTICES) -> tuple:
    """(n_base, first_word, last_word, base labels, labels, score, spans) of one lower-cased text."""
    found = [w.decode("utf-8", "replace") for w in _WORD.findall(raw)]
    joined = " ".join(found)
    padded = f" {joined} "
    at = np.cumsum([0] + [len(w) + 1 for w in found])
    starts, labels = [], set()
    for phrase, label in BASE.items():
        needle, p = f" {phrase} ", -1
        while (p := padded.find(needle, p + 1)) >= 0:
            starts.append(int(np.searchsorted(at, p)))
            labels.add(label)
    base = set(labels)
    spans, score = [], 1.0 if base else 0.0
    for n, a, b, edits in fuzzy_places(joined, notices):
        notice = prepared(notices)[0][n]
        labels.add(notice.label)
        score = max(score, 1.0 - edits / len(notice.text))
        spans.append((notice.label, int(np.searchsorted(at, a, side="right")) - 1, int(np.searchsorted(at, max(a, b - 1), side="right")) - 1, edits))
    return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, edits: long>>"


def _scan(batches):
    for batch in batches:
        data, offs = kernel.text_buffers(batch.column(1))
        low = data.copy()
        upper = (low >= 65) & (low <= 90)
        low[upper] += 32
        for a, b in kernel.doc_slices(offs):
            part, at = low[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            _, _, first = kernel.words(part, at, _NOT_WORD)
            rows = []
            for i, n in enumerate(np.diff(first).tolist()):
                raw = part[at[i] : at[i + 1]].tobytes()
                rows.append((n, *scan_text(raw)) if n else (0, 0, None, None, "", "", 0.0, []))
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN))
            spans = [[dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in x] for x in cols[7]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(cols[:7], kinds)), pa.array(spans, kinds[7])], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for an exact place, else
    one less the share of edited characters), spans (label, first and last word, edits).
    """
    ensure_importable(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, _SCHEMA)
