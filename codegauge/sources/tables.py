"""History and cache tables: writing and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.operators import scoring

CACHE_SCHEMA = (
    "content_hash string, digest string, config_hash string, trust_score int, issues_count bigint, critical_count bigint, "
    "ts string, file_path string, duration_ms double, result_json string"
)


def history_rows(results: DataFrame, ts: Column, user: str = "anonymous", project: str = "default",
                 branch: str = "main", commit: str | None = None) -> DataFrame:
    """History rows of scored files (``scoring.trust_scores`` output)."""
    ok = F.col("unparsed") == 0
    pairs = [("security", "security"), ("hallucinations", "hallucination"), ("logic", "logic"),
             ("best_practices", "best_practices")]
    return results.select(
        ts.alias("ts"), F.col("path").alias("file_path"), "trust_score", "passed",
        "critical_count", "high_count", "medium_count", "low_count",
        *[F.when(ok, scoring.clamp_score(F.col(f"{key}_penalty"))).otherwise(0).alias(f"{name}_score") for key, name in pairs],
        F.lit(user).alias("user"), F.lit(project).alias("project"), F.lit(branch).alias("branch"),
        F.lit(commit).cast("string").alias("commit"))


def history_append(rows: DataFrame, path: str, run: str) -> None:
    """Append the rows of one run to the history, partitioned by day so that time filters prune whole folders.

    Rows lie in folders of their day and run, and writing a run again replaces its folders: a job that is repeated after a failure leaves the
    table as one that succeeded at once.  Days are dealt out in tasks of even size, so a day has few files.
    """
    dated = rows.withColumn("day", F.to_date("ts")).withColumn("run", F.lit(run)).hint("rebalance", "day")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # keeps microseconds


def history_export(rows: DataFrame, path: str) -> None:
    """JSON lines in the order of ``rows``."""
    rows.write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(path)


def cache_scan(spark: SparkSession, path: str) -> DataFrame:
    """Cache entries from JSON lines; rows that are not valid JSON are skipped."""
    return spark.read.schema(CACHE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
