"""Reuse of earlier results by content hash.

Copies of one text may make up a third of all files.  Texts are therefore compared by hash only: the narrow
``(file_id, digest)`` table is what gets shuffled, and its join with the result table can be split where a hash is
hot.  The texts to scan are picked by ``file_id`` behind a sketch of the wanted ids, so texts that are not scanned are
never dealt out, however many ids there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge import constants as C
from codegauge.functions import scalars as S
from codegauge.operators.sketch import Wanted, pick
from codegauge.operators.skew import even_join
from codegauge.session import stage
from codegauge.sources.keyed import BUCKETS, KeyedTable, newest
from codegauge.sources.tables import CACHE_SCHEMA


def content_hashes(files: DataFrame, config: Column | str = "") -> DataFrame:
    """``file_id, content_hash, digest``, staged so that texts are hashed once.

    ``digest`` is the whole hash and decides what is equal; ``content_hash`` is its first 16 digits, for show.
    """
    digest = S.content_digest(F.col("code"), config)
    return stage(files.select("file_id", digest.alias("digest")).select(
        "file_id", F.substring("digest", 1, 16).alias("content_hash"), "digest"), "hashes")


def live_entries(cache: DataFrame, as_of: Column, ttl_days: int = C.CACHE_TTL_DAYS) -> DataFrame:
    return cache.where(~S.is_expired(F.col("ts"), as_of, ttl_days))


def cache_lookup(hashes: DataFrame, cache: DataFrame, as_of: Column, ttl_days: int = C.CACHE_TTL_DAYS) -> DataFrame:
    """Files with a live entry, and that entry.  ``cache`` has one row per ``digest``."""
    return even_join(hashes, live_entries(cache, as_of, ttl_days).drop("content_hash"), "digest")


def cache_miss(hashes: DataFrame, cache: DataFrame, as_of: Column, ttl_days: int = C.CACHE_TTL_DAYS) -> DataFrame:
    """Files without a live entry."""
    live = live_entries(cache, as_of, ttl_days).select("digest")
    return even_join(hashes, live, "digest", "left_anti")


def representatives(hashes: DataFrame) -> DataFrame:
    """One file per distinct content: ``file_id, digest``."""
    return hashes.groupBy("digest").agg(F.min("file_id").alias("file_id"))


def dedup_scan(files: DataFrame, scan: Callable[[DataFrame], DataFrame], hashes: DataFrame | None = None) -> DataFrame:
    """``scan(files) -> one row per file_id`` run once per distinct content, results given to every copy."""
    hashes = content_hashes(files) if hashes is None else hashes
    reps = stage(representatives(hashes), "representatives")
    results = scan(pick(files, Wanted(reps, "file_id")))
    by_hash = results.join(reps, "file_id").drop("file_id")
    fanned = even_join(hashes, by_hash, "digest")
    return fanned.drop("content_hash", "digest")


def incremental_scan(files: DataFrame, cache: DataFrame, scan: Callable[[DataFrame], DataFrame], as_of: Column,
                     columns: list[str], config: Column | str = "") -> DataFrame:
    """Cached results where there is a live entry, fresh ones elsewhere; ``from_cache`` tells which."""
    hashes = content_hashes(files, config)
    hits = cache_lookup(hashes, cache, as_of).select(
        "file_id", *columns, F.lit(True).alias("from_cache"))
    missed = stage(cache_miss(hashes, cache, as_of), "misses")
    fresh = dedup_scan(files, scan, missed).select("file_id", *columns, F.lit(False).alias("from_cache"))
    return hits.unionByName(fresh)


def cache_entries(results: DataFrame, hashes: DataFrame, ts: Column, config: Column | str,
                  duration_ms: Column | None = None) -> DataFrame:
    """Entries to store for scanned files, one per distinct content."""
    config = F.lit(config) if isinstance(config, str) else config
    duration = F.lit(None).cast("double") if duration_ms is None else duration_ms
    return representatives(hashes).join(results, "file_id").select(
        F.substring("digest", 1, 16).alias("content_hash"), "digest", config.alias("config_hash"), "trust_score", F.col("issue_count").alias("issues_count"),
        "critical_count", ts.cast("string").alias("ts"), F.col("path").alias("file_path"), duration.alias("duration_ms"))


def cache_upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after storing ``entries``: a new entry replaces an old one, the newest of several new ones stays.

    ``max_by`` keeps one row per hash and task before the shuffle, so a hash stored very often is no hot spot.
    """
    rows = cache.select(*entries.columns, F.lit(0).alias("gen")).union(entries.select("*", F.lit(1).alias("gen")))
    others = [c for c in entries.columns if c != "digest"]
    return (
        rows.groupBy("digest")
        .agg(F.max_by(F.struct(*others), F.struct("gen", "ts", *[c for c in others if c != "ts"])).alias("e"))
        .select("digest", "e.*").select(*entries.columns)
    )


def cache_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """The cache as a stored table with one entry per digest; ``merge(entries)`` stores new ones, ``read()`` is the cache.

    A new entry replaces an old one whatever their times, the newest of several new ones stays.
    """
    schema = T._parse_datatype_string(CACHE_SCHEMA)
    return KeyedTable(spark, path, schema, "digest", newest("digest", ["gen__", "ts"], schema.names), buckets)


def cache_cleanup(cache: DataFrame, as_of: Column, ttl_days: int = C.CACHE_TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, one row with the number removed)."""
    expired = S.is_expired(F.col("ts"), as_of, ttl_days)
    return cache.where(~expired), cache.agg(F.count_if(expired).alias("removed"))


def score_distribution(cache: DataFrame) -> DataFrame:
    return cache.groupBy(S.score_band(F.col("trust_score")).alias("band")).agg(F.count(F.lit(1)).alias("entries"))


def cache_metrics(cache: DataFrame) -> DataFrame:
    """Entries, distinct files, issues, true means of score and duration (a mean, not a running sum)."""
    n = F.count(F.lit(1))
    return cache.agg(
        n.alias("total_validations"), F.countDistinct("file_path").alias("files_analyzed"),
        F.coalesce(F.sum("issues_count"), F.lit(0)).alias("total_issues_found"),
        F.coalesce(F.try_divide(F.sum("trust_score"), n), F.lit(0.0)).alias("avg_trust_score"),
        F.coalesce(F.try_divide(F.sum("duration_ms"), F.count("duration_ms")), F.lit(0.0)).alias("avg_analysis_time_ms"))


def cache_stats(cache: DataFrame, text: str = "result_json") -> DataFrame:
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    return cache.agg(
        F.count(F.lit(1)).alias("entries"), size.alias("total_size_bytes"),
        F.round(size / (1024 * 1024), 2).alias("total_size_mb"))
