"""Evaluation and timing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eval_summary(results: DataFrame, group: str, success: str, latency: str) -> DataFrame:
    """Count, mean success and mean latency of each group and overall (group is null), in one pass."""
    return results.rollup(group).agg(F.count("*").alias("count"), F.avg(success).alias("success_rate"), F.avg(latency).alias("avg_latency"))


def timing_report(nodes: DataFrame, key: str, elapsed: str, own: str, top: int = 15) -> DataFrame:
    """Per key: total, self time, mean and share of all self time; the largest first. The grand total is a one-row aggregate."""
    total = nodes.agg(F.sum(own).alias("all_"))
    grouped = nodes.groupBy(key).agg(F.count("*").alias("count"), F.sum(elapsed).alias("total"), F.sum(own).alias("self"), F.avg(elapsed).alias("avg"))
    return grouped.crossJoin(F.broadcast(total)).withColumn("share", F.col("self") / F.col("all_")).drop("all_").orderBy(F.col("total").desc(), key).limit(top)


def infer_group(explicit: Column, question: Column, index: Column, keywords: list[str], boundary: int = 22) -> Column:
    """The given group, else dynamic by keywords, else by the position in the set."""
    low = F.lower(F.coalesce(question, F.lit("")))
    hit = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k))
    return F.when(F.coalesce(explicit, F.lit("")) != "", explicit).when(hit | (index <= boundary), "dynamic_web_qa").otherwise("static_vqa")


def status_counts(docs: DataFrame, *by: str) -> DataFrame:
    return docs.groupBy(*by).agg(F.count("*").alias("n"))


def report_text(summary: DataFrame, group: str) -> DataFrame:
    """The summary as report lines, overall first: a table for the text sink."""
    name = F.coalesce(F.col(group), F.lit("overall"))
    line = F.format_string("%s (%d): %.2f%%, %.3f s", name, F.col("count"), F.col("success_rate") * 100, F.col("avg_latency"))
    lines = summary.select(F.struct(F.col(group).isNotNull().alias("later"), name.alias("name"), line.alias("value")).alias("x")).orderBy("x")
    return lines.select("x.value")


def write_results(results: DataFrame, summary: DataFrame, group: str, path: str) -> None:
    """JSON rows and a text report."""
    results.write.mode("overwrite").json(f"{path}/results")
    report_text(summary, group).coalesce(1).write.mode("overwrite").text(f"{path}/report")
