"""Search results: provider JSON to documents, images by host page, and the merge of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood import config
from siftwood.functions.scoring import page_text_better
from siftwood.functions.url import canonical_url, merge_images, valid_image_url

_LIST_A = "array<struct<position: int, title: string, link: string, displayed_link: string, snippet: string, source: string, favicon: string, date: string, cached_page_link: string, thumbnail: string>>"
HITS_A = f"struct<organic_results: {_LIST_A}, error: string>"
HITS_B = "struct<data: struct<webPages: struct<value: array<struct<id: string, name: string, url: string, displayUrl: string, summary: string, snippet: string, siteName: string, siteIcon: string, datePublished: string, dateLastCrawled: string, cachedPageUrl: string, language: string>>>, images: struct<value: array<struct<hostPageUrl: string, contentUrl: string, thumbnailUrl: string>>>>>"
def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def parse_hits(responses: DataFrame, query: str, body: str, preview: int = 800) -> DataFrame:
    """Documents of provider A's JSON: one a link, the first of each canonical URL, in order of position."""
    answer = F.from_json(body, HITS_A)
    problem = F.lower(F.coalesce(answer["error"], F.lit("")))
    benign = (problem == "") | F.exists(F.array(*[F.lit(x) for x in config.NO_RESULTS]), lambda x: F.contains(problem, x))
    found = F.when(benign, answer["organic_results"]).otherwise(F.raise_error(F.concat(F.lit("search failed: "), problem)).cast(_LIST_A))
    hits = responses.select(F.col(query), F.posexplode(found).alias("pos", "h")).select(query, "pos", "h.*").where(_text("link") != "")
    key = canonical_url(F.col("link"))
    hits = hits.withColumn("canonical_url", key).withColumn("k_", F.when(key == "", _text("link")).otherwise(key))
    first = hits.withColumn("rn_", F.row_number().over(Window.partitionBy(query, "k_").orderBy("pos"))).where("rn_ = 1")
    images = F.when(valid_image_url(F.col("thumbnail")), F.array(F.trim("thumbnail"))).otherwise(F.array().cast("array<string>"))
    return first.select(query, "pos", _text("link").alias("url"), "canonical_url", _text("title").alias("name"), F.substring(_text("snippet"), 1, preview).alias("content"), _text("source").alias("site_name"), _text("date").alias("date_published"), images.alias("image_urls"))


def images_by_host(responses: DataFrame, query: str, body: str, limit: int | None = None) -> DataFrame:
    """(query, host_url, image_urls): provider B's images by canonical host page, distinct, in order, valid ones."""
    rows = responses.select(F.col(query), F.posexplode(F.expr(f"from_json({body}, '{HITS_B}').data.images.value")).alias("pos", "i")).select(query, "pos", canonical_url(F.col("i.hostPageUrl")).alias("host_url"), F.trim(F.coalesce(F.nullif("i.contentUrl", F.lit("")), "i.thumbnailUrl")).alias("image"))
    first = rows.where((F.col("host_url") != "") & valid_image_url(F.col("image"))).groupBy(query, "host_url", "image").agg(F.min("pos").alias("pos"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "image"))), lambda s: s["image"])
    return first.groupBy(query, "host_url").agg((F.slice(listed, 1, limit) if limit else listed).alias("image_urls"))


def parse_hits_b(responses: DataFrame, query: str, body: str, images: int = 3, preview: int = 800) -> DataFrame:
    """Documents of provider B's JSON with the images of their host page."""
    hits = responses.select(F.col(query), F.posexplode(F.expr(f"from_json({body}, '{HITS_B}').data.webPages.value")).alias("pos", "h")).select(query, "pos", "h.*").where(_text("url") != "")
    hits = hits.withColumn("canonical_url", canonical_url(F.col("url")))
    content = F.coalesce(F.nullif(_text("summary"), F.lit("")), _text("snippet"))
    by_host = images_by_host(responses, query, body, images).withColumnRenamed(query, "q_")
    joined = hits.join(by_host, (F.col(query) == F.col("q_")) & (F.col("canonical_url") == F.col("host_url")), "left")
    return joined.select(query, "pos", _text("url").alias("url"), "canonical_url", _text("name").alias("name"), F.substring(content, 1, preview).alias("content"), _text("siteName").alias("site_name"), _text("datePublished").alias("date_published"), F.coalesce("image_urls", F.array().cast("array<string>")).alias("image_urls"))


def apply_fetched(docs: DataFrame, pages: DataFrame, images: int = 3) -> DataFrame:
    """Documents joined with their fetched pages: better bodies replace the search result's text, gaps are filled."""
    p = pages.select(*[F.col(c).alias(f"p_{c}") for c in pages.columns])
    both = docs.join(p, docs["canonical_url"] == F.col("p_canonical_url"), "left")
    better = F.coalesce(page_text_better(F.col("p_text"), F.col("content"), F.col("p_quality_score"), F.col("p_is_probable_listing")), F.lit(False))
    new_title = F.coalesce("p_title", F.lit(""))
    old = F.coalesce("name", F.lit(""))
    retitle = (new_title != "") & ((old == "") | (F.length(new_title) >= F.least(F.length(old), F.lit(24))))
    fill = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    rest = [c for c in docs.columns if c not in ("name", "content", "site_name", "date_published", "image_urls", "language")]
    return both.select(
        *rest,
        F.when(retitle, new_title).otherwise(old).alias("name"),
        F.when(better, F.col("p_text")).otherwise(F.col("content")).alias("content"),
        F.when(better, "web_page").otherwise("search_snippet_fallback").alias("content_source"),
        fill("site_name", "p_site_name").alias("site_name"),
        fill("date_published", "p_date_published").alias("date_published"),
        merge_images(F.col("image_urls"), F.col("p_image_urls"), images).alias("image_urls"),
        *([fill("language", "p_language").alias("language")] if "language" in docs.columns else [F.coalesce("p_language", F.lit("")).alias("language")]),
        F.coalesce("p_fetch_status", F.lit("")).alias("web_fetch_status"),
        F.col("p_quality_score").alias("web_fetch_quality_score"),
        F.coalesce("p_is_probable_listing", F.lit(False)).alias("web_fetch_is_probable_listing"),
    )
