"""Sources: an offline search provider as a Spark data source, the evaluation set, and downloaded files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from siftwood.config import NO_RESULTS


class _Request(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)


class SearchSource(DataSource):
    """`format("siftwood_search")`: one partition a query, each answered by a request function.

    Options: queries (a JSON list), provider ("a" or "b"), count, freshness, include, exclude, handler ("module:function", which takes the request
    and returns the provider's JSON text, or a status and the text). A filter on freshness is pushed into the request (this takes
    spark.sql.python.filterPushdown.enabled).
    """

    @classmethod
    def name(cls) -> str:
        return "siftwood_search"

    def schema(self) -> str:
        return "query string, provider string, freshness string, body string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


#: Provider A's codes of the freshness windows, and its errors that mean an empty result.
FRESHNESS_CODES = {"oneDay": "qdr:d", "oneWeek": "qdr:w", "oneMonth": "qdr:m", "oneYear": "qdr:y"}
MOST = {"a": 100, "b": 50}


def request_of(provider: str, query: str, count: int, freshness: str, include: str = "", exclude: str = "") -> dict:
    """What a provider is asked: provider A takes the sites as words of the query and a code for freshness, provider B fields of their own."""
    if not 1 <= count <= MOST[provider]:
        raise ValueError(f"count must be between 1 and {MOST[provider]}")
    if provider == "a":
        code = FRESHNESS_CODES.get(freshness)
        return {"q": " ".join(x for x in (query.strip(), include, exclude) if x), "num": count} | ({"tbs": code} if code else {})
    return {"query": query, "freshness": freshness, "summary": True, "count": count} | {k: v for k, v in (("include", include), ("exclude", exclude)) if v}


def checked(provider: str, answer: str | tuple[int, str]) -> str:
    """A provider's answer, or an error for what is none: no JSON, another status than 200, or an error inside. "No results" is an empty answer."""
    status, body = answer if isinstance(answer, tuple) else (200, answer)
    try:
        said = json.loads(body)
    except ValueError as e:
        raise RuntimeError(f"provider {provider} returned no JSON (status {status})") from e
    if provider == "a":
        problem = str(said.get("error") or "").strip()
        if problem and status == 200 and any(x in problem.lower() for x in NO_RESULTS):
            return json.dumps({"organic_results": []})
    else:
        problem = "" if said.get("code", 200) == 200 else f"code {said.get('code')}, {said.get('msg') or said.get('message')}"
    if status != 200 or problem:
        raise RuntimeError(f"provider {provider} failed: status {status}, {problem or said.get('message') or said.get('msg')}")
    return body


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.queries = json.loads(options.get("queries", "[]"))
        self.provider = options.get("provider", "a")
        if self.provider not in MOST:
            raise ValueError(f"unknown search provider {self.provider!r}")
        self.count = int(options.get("count", "10"))
        self.freshness = options.get("freshness", "noLimit")
        self.sites = options.get("include", ""), options.get("exclude", "")
        self.handler = options.get("handler", "siftwood.sources.search:no_results")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("freshness",):
                self.freshness = f.value
            else:
                yield f

    def partitions(self):
        return [_Request(q) for q in self.queries]

    def read(self, partition):
        from importlib import import_module

        module, _, function = self.handler.partition(":")
        ask = getattr(import_module(module), function)
        request = request_of(self.provider, partition.value, self.count, self.freshness, *self.sites)
        yield (partition.value, self.provider, self.freshness, checked(self.provider, ask(request)))


def no_results(request: dict) -> str:
    """The offline default: an empty answer."""
    return json.dumps({"organic_results": []} if "q" in request else {"code": 200, "data": {"webPages": {"value": []}}})


def corpus_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The offline provider over a corpus: the k best documents of each query by lexical score, of those that share a token with it.

    queries: query_id, query; docs: doc_id, text. Scores are rounded to six places, so that ties are the same everywhere, and go to the smaller doc_id.
    """
    from siftwood.functions.text import lexical_tokens
    from siftwood.operators.match import lexical_topk
    from siftwood.operators.select import topk

    q = queries.select("query_id", lexical_tokens(F.col("query")).alias("qt"))
    d = docs.select("doc_id", F.array(lexical_tokens(F.col("text"))).alias("tokens"))
    # a document that rounding lifts is within two millionths of the k-th
    hits = lexical_topk(d, q, "tokens", k, 1, slack=2e-6).select("query_id", "doc_id", F.round(F.col("best")[0]["score"], 6).alias("score"))
    return topk(hits, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """question, answer, image and group of an evaluation file (a JSON array); rows that lack one of the first three fail."""
    rows = spark.read.schema("question string, answer string, image string, `group` string, split string").option("multiLine", True).json(path)
    missing = F.col("question").isNull() | F.col("answer").isNull() | F.col("image").isNull()
    checked = F.when(missing, F.raise_error(F.lit("a sample lacks question, answer or image")).cast("string")).otherwise(F.col("question"))
    return rows.select(checked.alias("question"), "answer", "image", F.coalesce("group", "split").alias("group"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded images or pages as path, length and content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
