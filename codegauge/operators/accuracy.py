"""Accuracy against labels and statistics of recorded durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy_metrics(truth: DataFrame, issues: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1.

    ``truth(file_id, expected)`` says whether issues are expected; a file counts as positive when it has any.
    """
    found = issues.select("file_id").distinct().withColumn("found", F.lit(True))
    cases = truth.join(found, "file_id", "left").select("expected", F.coalesce("found", F.lit(False)).alias("found"))
    e, f = F.col("expected"), F.col("found")
    counts = cases.agg(
        F.count_if(e & f).alias("tp"), F.count_if(~e & ~f).alias("tn"),
        F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "tp", "tn", "fp", "fn",
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
    ).withColumn("f1_score", F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def duration_stats(durations: DataFrame, *group: str) -> DataFrame:
    """Per group of ``durations(..., lines, ms)``: count, sum, mean, extremes, deviation, lines per second."""
    return durations.groupBy(*group).agg(
        F.count(F.lit(1)).alias("iterations"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("avg_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
        F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("std_dev_ms"),
        F.sum("lines").alias("lines_processed"),
        F.try_divide(F.sum("lines"), F.sum("ms") / 1000).alias("lines_per_second"))


def tool_comparison(durations: DataFrame, ours: str, other: str) -> DataFrame:
    """Mean duration of two tools per sample, with speed-up and the faster flag."""
    wide = durations.groupBy("sample").pivot("tool", [ours, other]).agg(F.avg("ms"))
    a, b = F.col(ours), F.col(other)
    return wide.where(a.isNotNull() & b.isNotNull()).select(
        "sample", a.alias("our_avg_ms"), b.alias("other_avg_ms"),
        F.coalesce(F.try_divide(b, a), F.lit(0.0)).alias("speedup"), (a < b).alias("faster"))
