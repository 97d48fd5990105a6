"""Deterministic offline providers for tests and runs without a network."""

from __future__ import annotations

import hashlib

import numpy as np


def fetch_nothing(urls: list[str]) -> list[dict]:
    """A network that answers every URL with a small page that names it."""
    return [{"status_code": 200, "content_type": "text/html", "body": f"<html><body><article><h1>Page</h1><p>Body of {u}. {'Text. ' * 60}</p></article></body></html>"} for u in urls]


def hash_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Unit vectors from a hash of each text."""
    out = []
    for t in texts:
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big"))
        v = rng.normal(size=dim)
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def doubting_judge(prompts: list[str]) -> list[str]:
    """A judge that always wants more evidence."""
    return ['{"judgement": "NO", "addition": "more"}'] * len(prompts)


def first_words(prompts: list[str]) -> list[str]:
    """A query writer that keeps the first five words."""
    return [" ".join((p or "").split()[:5]) for p in prompts]


def name_entities(prompts: list[str]) -> list[str]:
    """A candidate finder that names the longest word."""
    import json

    return [json.dumps({"candidates": [{"name": max((p or "x").split() or ["x"], key=len), "confidence": 0.5}]}) for p in prompts]


def echo_bytes(urls: list[str]) -> list[bytes]:
    """A download whose body is the URL."""
    return [u.encode() for u in urls]


def hash_images(bodies: list[bytes]) -> list[list[float]]:
    return hash_embedding([b.decode() for b in bodies])


def echo_search(request: dict) -> str:
    """A search provider with one hit a query, which repeats the request."""
    import json

    q = request["q"]
    return json.dumps({"organic_results": [{"position": 1, "title": f"about {q}", "link": f"https://search.example.com/{len(q)}?tbs={request.get('tbs', 'none')}", "snippet": q, "source": "echo"}]})


def last_line(prompts: list[str]) -> list[str]:
    """A model that repeats the last line of its prompt."""
    return [(p or "").split("\n")[-1] for p in prompts]


def some_bytes(urls: list[str]) -> list[bytes | None]:
    """A download that fails for URLs whose number ends in 7."""
    return [None if u.split(".")[-2].endswith("7") else u.encode() for u in urls]


def agreeing_judge(prompts: list[str]) -> list[str]:
    """A judge that finds prompts of an even length correct."""
    return ['{"verdict": "CORRECT"}' if len(p or "") % 2 == 0 else "Incorrect." for p in prompts]


def varied_fetch(urls: list[str]) -> list[dict]:
    """A network whose answer depends on the last number of a URL: pages, a missing one, a failing server, no answer, an image, a short page."""
    out = []
    for u in urls:
        kind = int(u.rsplit("/", 1)[-1]) % 6
        if kind == 3:
            raise ConnectionError("no answer")
        text = "A sentence of the page that goes on for a while. " * (2 if kind == 5 else 20)
        out.append({"status_code": {1: 404, 2: 503}.get(kind, 200), "content_type": "image/png" if kind == 4 else "text/html", "body": f"<html><body><article><p>{text}</p></article></body></html>"})
    return out
