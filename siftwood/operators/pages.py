"""Page and chunk table functions: Arrow-batched Python around page-local work, everything else in columns."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions import readable
from siftwood.functions.chunking import chunks
from siftwood.session import ensure_importable


def read_pages(pages: DataFrame, url_col: str = "url", body_col: str = "html", html: bool = True) -> DataFrame:
    """Adds the readable record of each page as columns. Page bodies pass through Python once, in Arrow batches."""
    ensure_importable(pages.sparkSession)
    read = readable.read_html if html else readable.read_text

    @F.pandas_udf(readable.PAGE_SCHEMA)
    def parse(url: pd.Series, body: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in readable.PAGE_SCHEMA.split(", ")]
        return pd.DataFrame([read(u or "", b or "") for u, b in zip(url, body)], columns=names)

    rest = [c for c in pages.columns if c != body_col]
    return pages.withColumn("page_", parse(F.col(url_col), F.col(body_col))).select(*rest, "page_.*")


def chunk_array(text: Column, size: int = 400) -> Column:
    """The chunks of a text as an array."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t or "", size))

    return split(text)


def chunk_documents(docs: DataFrame, text_col: str = "text", size: int = 400) -> DataFrame:
    """One row a chunk: the other columns, chunk_id, chunk and chunk_size."""
    ensure_importable(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(chunk_array(F.col(text_col), size)).alias("chunk_id", "chunk")).withColumn("chunk_size", F.length("chunk"))


#: Statuses that are tried again.
RETRIED = (429, 500, 502, 503, 504)


def _fetched(urls: list[str], fetch: Callable[[list[str]], list[dict]], retries: int, pause: float) -> dict[str, dict]:
    """The answers by URL. Busy and failing servers are asked again, after pauses of 1, 2 and then 4 times `pause`; where a batch raises, each of its URLs is tried alone."""
    got: dict[str, dict] = {}
    open_ = list(dict.fromkeys(urls))
    for attempt in range(retries + 1):
        if attempt and open_:
            time.sleep(pause * min(2 ** (attempt - 1), 4))
        batches = [open_] if open_ else []
        while batches:
            batch = batches.pop()
            try:
                got.update(zip(batch, fetch(batch)))
            except Exception as e:  # one bad URL must not lose its batch, nor the job
                if len(batch) == 1:
                    got[batch[0]] = {"error": str(e) or type(e).__name__}
                else:
                    batches += [[u] for u in batch]
        open_ = [u for u in open_ if (got.get(u) or {}).get("error") or (got.get(u) or {}).get("status_code") in RETRIED or u not in got]
    return got


def fetch_pages(urls: DataFrame, fetch: Callable[[list[str]], list[dict]], parts: int, min_text: int = 300, retries: int = 2, pause: float = 1.0) -> DataFrame:
    """Fetches and reads a column of URLs with an injected batch function (url list to dicts with status_code, content_type, body).

    Statuses: invalid_url, http_error, unsupported_content_type, success, short_content, empty_content, request_failed.
    """
    ensure_importable(urls.sparkSession)
    schema = "requested_url string, status_code int, content_type string, error string, " + readable.PAGE_SCHEMA
    blank = readable.read_text("", "")

    def record(url: str, got: dict | None) -> dict:
        head = {"requested_url": url, "status_code": None, "content_type": "", "error": ""}
        if not readable.canonical(url):
            return {**blank, **head, "fetch_status": "invalid_url"}
        if got is None or got.get("error"):
            return {**blank, **head, "canonical_url": readable.canonical(url), "fetch_status": "request_failed", "error": str((got or {}).get("error", "no response"))}
        kind = (got.get("content_type") or "text/html").lower()
        head |= {"status_code": got.get("status_code"), "content_type": kind}
        if (got.get("status_code") or 200) >= 400:
            return {**blank, **head, "canonical_url": readable.canonical(url), "fetch_status": "http_error", "error": f"HTTP {got['status_code']}"}
        if not kind.startswith(("text/html", "application/xhtml+xml", "text/plain")):
            return {**blank, **head, "canonical_url": readable.canonical(url), "fetch_status": "unsupported_content_type", "error": f"unsupported content type: {kind}"}
        body = got.get("body") or b""
        text = body if isinstance(body, str) else readable.decode_body(body[:2_500_000], kind)
        page = (readable.read_text if kind.startswith("text/plain") else readable.read_html)(url, text, got.get("final_url") or url)
        if page["text"] and len(page["text"]) < min_text:
            page["fetch_status"] = "short_content"
        return {**page, **head}

    def run(batches):
        for pdf in batches:
            links = pdf.iloc[:, 0].tolist()
            usable = [u for u in links if readable.canonical(u)]
            got = _fetched(usable, fetch, retries, pause)
            yield pd.DataFrame([record(u, got.get(u)) for u in links], columns=[c.split()[0] for c in schema.split(", ")])

    return urls.repartition(parts).mapInPandas(run, schema)
