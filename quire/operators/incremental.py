"""What has to be built again, what was seen already, and how a cache fares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def cache_key(tex: Column, *options: Column) -> Column:
    """A key of a source and all that changes its output."""
    return F.sha2(F.concat_ws("\x1f", F.sha2(tex, 256), *options), 256)


def stale(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents without a manifest entry of the same path, format and content that is as new as all their files.

    `docs`: path, format, content_hash, newest_dep (time); `manifest`: path, format, content_hash, oldest_output.
    """
    held = manifest.select("path", "format", "content_hash", "oldest_output")
    fresh = docs.join(held, ["path", "format", "content_hash"]).where("newest_dep is null or newest_dep <= oldest_output")
    return docs.join(fresh.select("path", "format"), ["path", "format"], "left_anti")


def first_of_each_content(docs: DataFrame, key: str = "doc_id", content: str = "content_hash") -> DataFrame:
    """(key, first): for each document the least key with the same content. Minima are combined before the shuffle."""
    first = docs.groupBy(content).agg(F.min(key).alias("first"))
    return docs.select(key, content).join(first, content).select(key, "first")


def hit_rates(stats: DataFrame) -> DataFrame:
    """Adds parse, output and total rates to counts of hits and misses; none without any lookups."""
    rate = lambda h, m: F.coalesce(F.try_divide(h.cast("double"), (h + m).cast("double")), F.lit(0.0))
    c = F.col
    return stats.withColumns({"parse_rate": rate(c("parse_hits"), c("parse_misses")), "output_rate": rate(c("output_hits"), c("output_misses")), "total_rate": rate(c("parse_hits") + c("output_hits"), c("parse_misses") + c("output_misses"))})


#: Parts of a cache whose latest entries are picked before those of the whole cache.
PARTS = 64


def evicted(entries: DataFrame, capacity: int, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Entries (cache, key, last_accessed) that are too old, or not among the latest `capacity` of their cache; keys of a cache are distinct.

    The latest ones are picked in parts first, so no task sorts a whole cache.
    """
    old = entries.withColumn("expired", F.unix_timestamp(now) - F.unix_timestamp("last_accessed") > ttl_seconds)
    latest = old.where("not expired").select("cache", "key", "last_accessed", F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part"))
    for keys in (("cache", "part"), ("cache",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last_accessed"), "key"))
        latest = latest.withColumn("rank", rank).where(F.col("rank") <= capacity)
    return old.join(latest.select("cache", "key"), ["cache", "key"], "left_anti")


def counted(docs: DataFrame, manifest: DataFrame, name: str = "incremental") -> tuple[DataFrame, Observation]:
    """`stale`, and how many documents were skipped and how many are to be built, observed while the result is made: no second pass."""
    held = manifest.select("path", "format", "content_hash", "oldest_output")
    fresh = docs.join(held, ["path", "format", "content_hash"]).where("newest_dep is null or newest_dep <= oldest_output").select("path", "format", F.lit(True).alias("_fresh")).distinct()
    decided = docs.join(fresh, ["path", "format"], "left")
    seen = Observation(name)
    rows = decided.observe(seen, F.count("_fresh").alias("skips"), F.count(F.when(F.col("_fresh").isNull(), 1)).alias("builds"))
    return rows.where("_fresh is null").drop("_fresh"), seen
