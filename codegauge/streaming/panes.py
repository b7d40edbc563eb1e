"""Trends as panes: what a day adds up to is emitted once, when the watermark has passed the day, and longer windows are
put together from days.  State holds the open days only, whatever the length or the slide of a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS_OF_WEEK = 7
_SUMS = ["s", "validations", "passes"]


def daily_panes(history: DataFrame, keys: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Per day and ``keys``: sum of scores, number of rows and of passed ones, of a stream with ``ts``, ``trust_score`` and ``passed``.

    For append mode.  Rows more than ``delay`` behind the newest one may come too late for their day.
    """
    panes = history.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), *keys).agg(
        F.sum(F.col("trust_score").cast("long")).alias("s"), F.count(F.lit(1)).alias("validations"),
        F.sum(F.coalesce("passed", F.lit(False)).cast("long")).alias("passes"))
    return panes.select(F.to_date("window.start").alias("day"), *keys, *_SUMS)


def open_panes(spark: SparkSession, checkpoint: str, keys: Sequence[str] = ()) -> DataFrame:
    """The panes of days that a stopped stream has not closed, taken from its state."""
    state = spark.read.format("statestore").load(checkpoint)
    # the sums by their place, as two of them have one name
    sums = F.col("value").cast(f"struct<{', '.join(f'{n}: bigint' for n in _SUMS)}>").alias("sums")
    held = state.select("key.window", *[F.col(f"key.{k}").alias(k) for k in keys], sums).select("window", *keys, "sums.*")
    return held.select(F.to_date("window.start").alias("day"), *keys, *_SUMS)


def trend_of_panes(panes: DataFrame) -> DataFrame:
    """Mean score and count per day."""
    days = panes.groupBy("day").agg(F.sum("s").alias("s"), F.sum("validations").alias("validations"))
    return days.select("day", F.round(F.col("s") / F.col("validations"), 1).alias("avg_score"), "validations")


def weeks_of_panes(panes: DataFrame, days: int = DAYS_OF_WEEK) -> DataFrame:
    """Per user, windows of ``days`` days that slide by a day, each from as many panes: the leaderboard's input at every day."""
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda back: F.date_sub("day", back)))
    weeks = panes.select(start.alias("week_start"), "user", *_SUMS).groupBy("week_start", "user").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return weeks.select(
        "week_start", "user", "validations", F.round(F.col("s") / F.col("validations"), 1).alias("avg_score"),
        F.round(F.col("passes") / F.col("validations") * 100, 1).alias("pass_rate"))
