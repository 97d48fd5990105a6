"""Splitting documents into chunks of about a size."""

from __future__ import annotations

import re

from siftwood.functions.readable import signature

_SENTENCE = re.compile(r"(?<=[。！？!?])|(?<=[.!?])\s+")
_LATIN_HEAD = re.compile(r"[A-Za-z][A-Za-z0-9.'-]{0,24}(?=[^\x00-\x7f])")


def _ascii_share(text: str) -> float | None:
    """The share of ASCII among the letters, or None without letters."""
    letters = [c for c in text if c.isalpha()]
    return sum(map(str.isascii, letters)) / len(letters) if letters else None


def _rejoin(pieces: list[str]) -> str:
    text = re.sub(r"\s+([,.;:!?%)\]])", r"\1", " ".join(pieces))
    return re.sub(r"\s{2,}", " ", re.sub(r"([(\[])\s+", r"\1", text)).strip()


def _is_fragment(p: str) -> bool:
    return len(p) <= 32 and len(p.split()) <= 2 and (_ascii_share(p) or 0.0) >= 0.6


def _all_fragments(paras: list[str]) -> bool:
    if len(paras) < 6 or (_ascii_share(" ".join(paras)) or 0.0) < 0.6:
        return False
    sizes = [len(p.split()) for p in paras]
    short = sum(s <= 2 for s in sizes) / len(sizes)
    return short >= 0.7 and sum(sizes) <= 2.5 * len(sizes) or short >= 0.85 and max(sizes) <= 3


def paragraphs(text: str) -> list[str]:
    """Paragraphs with single spaces; runs of word fragments, as broken extraction leaves them, are joined again."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    parts = re.split(r"\n\s*\n+", text)
    parts = [" ".join(p.split()) for p in (parts if len(parts) > 1 else text.splitlines())]
    parts = [p for p in parts if p]
    if _all_fragments(parts):
        return [x for x in (_rejoin(parts),) if x] or parts
    out: list[str] = []
    at = 0
    while at < len(parts):
        end = next((i for i in range(at, len(parts)) if not _is_fragment(parts[i])), len(parts))
        run, after = parts[at:end], parts[end] if end < len(parts) else ""
        # a Latin word that runs into a paragraph of another script ends a run of fragments
        if run and (head := _LATIN_HEAD.match(after)):
            run.append(head[0])
            after = after[head.end() :].strip()
        out += [_rejoin(run)] if len(run) >= 4 else run
        out += [after] if after else []
        at = end + 1
    return out


def _pack(pieces, size: int, joint: str, split) -> list[str]:
    """Joins pieces while they fit; a piece that is too long is split alone."""
    out, held = [], ""
    for piece in pieces:
        if len(piece) > size:
            out += [held] * bool(held) + split(piece)
            held = ""
        elif held and len(held) + len(joint) + len(piece) > size:
            out.append(held)
            held = piece
        else:
            held = held + joint + piece if held else piece
    return out + [held] * bool(held)


def _word_windows(text: str, size: int, overlap: int) -> list[str]:
    """Greedy windows of words; the next one starts with the last words that fit the overlap, one at least."""
    words = text.split()
    out, start, end, length = [], 0, 0, 0
    while end < len(words):
        more = len(words[end]) + (end > start)
        if end > start and length + more > size:
            out.append(" ".join(words[start:end]))
            back, carried = end - 1, len(words[end - 1])
            while back > start and carried + 1 + len(words[back - 1]) <= overlap:
                back -= 1
                carried += 1 + len(words[back])
            start, length, more = back, carried, len(words[end]) + 1
        length += more
        end += 1
    return out + [" ".join(words[start:])] * (start < len(words))


def _split_long(text: str, size: int, overlap: int) -> list[str]:
    sentences = [s.strip() for s in _SENTENCE.split(text) if s and s.strip()]
    if len(sentences) > 1:
        return _pack(sentences, size, " ", lambda s: _split_long(s, size, overlap))
    if " " in text:
        return _word_windows(text, size, overlap)
    step = max(1, size - overlap)
    windows = (text[i : i + size] for i in range(0, len(text), step))
    return [w for w in windows if w.strip()]


def chunks(text: str, size: int) -> list[str]:
    """Chunks in order; those whose letters and digits repeat an earlier chunk's are left out."""
    overlap = min(80, max(0, size // 5))
    out, seen = [], set()
    for c in _pack(paragraphs(text), size, "\n\n", lambda p: _split_long(p, size, overlap)):
        c = c.strip()
        s = signature(c)
        if c and s not in seen:
            seen.add(s)
            out.append(c)
    return out
