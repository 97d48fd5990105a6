"""Tables that outlive a query: the page cache and the session store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_hits(cache: DataFrame, now: Column, ttl: int = 604_800, schema_version: int = 8) -> DataFrame:
    """Live entries: of the current schema and not older than the TTL; ttl <= 0 turns the cache off, cached_at 0 never expires."""
    if ttl <= 0:
        return cache.limit(0)
    return cache.where((F.col("schema_version") == schema_version) & ((F.col("cached_at") == 0) | (now - F.col("cached_at") <= ttl)))


def cache_misses(urls: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return urls.join(hits.select(key), key, "left_anti")


def cache_key(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def upsert_docs(stored: DataFrame, new: DataFrame, key: str, always: list[str], if_given: list[str]) -> DataFrame:
    """MERGE by key: unknown keys are inserted whole; known ones take `always` columns, and `if_given` ones where the new value is not empty."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n_is"))
    both = stored.withColumn("s_is", F.lit(True)).join(n, F.col(key) == F.col(f"n_{key}"), "full")

    def merged(c: str) -> Column:
        fresh = F.col(f"n_{c}")
        if c in always:
            known = F.when(F.col("n_is"), fresh).otherwise(F.col(c))
        elif c in if_given:
            known = F.when(F.coalesce(fresh.cast("string"), F.lit("")) != "", fresh).otherwise(F.col(c))
        else:
            known = F.col(c)
        return F.when(F.col("s_is"), known).otherwise(fresh).alias(c)

    return both.select(*[F.coalesce(F.col(c), F.col(f"n_{c}")).alias(c) if c == key else merged(c) for c in stored.columns])


def append_queries(stored: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Stored queries of a session and those new ones whose text it does not hold yet, without regard to case."""
    have = stored.select(key, F.lower(text).alias("low_")).distinct()
    fresh = new.withColumn("low_", F.lower(text)).join(have, [key, "low_"], "left_anti").dropDuplicates([key, "low_"]).drop("low_")
    return stored.unionByName(fresh.select(*stored.columns))


def save_session(df: DataFrame, path: str, session: str, table: str) -> None:
    """Replaces one session's partition of a session table (queries, docs, page_images or chunks)."""
    df.withColumn("session", F.lit(session)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(f"{path}/{table}")


def load_session(spark, path: str, session: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}").where(F.col("session") == session).drop("session")
