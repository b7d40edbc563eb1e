"""Change feed: ``path, modified_at, content_hash, ...`` snapshots of watched files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.functions import scalars as S
from codegauge.operators.skew import previous_in_group


def watched(feed: DataFrame) -> DataFrame:
    return feed.where(~S.in_excluded_dir(F.col("path")))


def latest_per_file(feed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Newest snapshot per path.  One row per path and task is left before the shuffle, so a path with a
    third of all snapshots is no hot spot."""
    others = [c for c in feed.columns if c != "path"]
    key = order[0] if len(order) == 1 else F.struct(*order)
    return feed.groupBy("path").agg(F.max_by(F.struct(*others), key).alias("s")).select("path", "s.*")


def change_detection(feed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Snapshots that differ from the one before in (modified_at, content_hash); a first one always counts."""
    now = F.struct("modified_at", "content_hash")
    rows = previous_in_group(feed, "path", order, now)
    return rows.where(~F.col("previous").eqNullSafe(now)).drop("previous")


def watch_summary(latest: DataFrame) -> DataFrame:
    """Tracked files, mean score, issues and the excellent / good / poor split."""
    n, score = F.count(F.lit(1)), F.col("score")
    return latest.agg(
        n.alias("total_files"), F.coalesce(F.try_divide(F.sum("score"), n), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.sum("issues"), F.lit(0)).alias("total_issues"),
        F.count_if(score >= 80).alias("excellent"), F.count_if((score >= 60) & (score < 80)).alias("good"),
        F.count_if(score < 60).alias("poor"))
