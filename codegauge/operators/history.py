"""Statistics over the validation history: ``id, ts, file_path, trust_score, passed, *_count, *_score, user,
project, branch, commit``.

``as_of`` is always given, never the clock, so a query can be repeated.  Every statistic is one aggregate
whose partial sums are formed before the shuffle; a user or project with a third of all rows costs no more
than the others.  Top-k lists are ordered with a name tie-break and never sort more than k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_COLUMNS = {
    "security": "security_score",
    "hallucinations": "hallucination_score",
    "logic": "logic_score",
    "best_practices": "best_practices_score",
}


def history_filter(history: DataFrame, as_of: str | Column, days: int | None = 30,
                   project: str | None = None, user: str | None = None) -> DataFrame:
    """Rows of the last ``days`` before ``as_of`` (all rows before it with ``days`` None), of one project and/or user
    if named.

    If the table is partitioned by ``day`` the same bounds also prune partitions.
    """
    as_of = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    history = history.where(F.col("ts") < as_of)
    if "day" in history.columns:
        history = history.where(F.col("day") <= F.to_date(as_of))
    if days is not None:
        start = as_of - F.make_dt_interval(F.lit(days))
        history = history.where(F.col("ts") >= start)
        if "day" in history.columns:
            history = history.where(F.col("day") >= F.to_date(start))
    if project is not None:
        history = history.where(F.col("project") == project)
    if user is not None:
        history = history.where(F.col("user") == user)
    return history


def _mean(column: str) -> Column:
    """Mean from an exact whole-number sum, to one decimal."""
    return F.round(F.try_divide(F.sum(column), F.count(column)), 1)


def _issues() -> Column:
    return sum((F.col(f"{s}_count") for s in ("high", "medium", "low")), F.col("critical_count"))


def overview(history: DataFrame) -> DataFrame:
    """Number of validations, mean score, pass rate, issues; zeros for an empty selection."""
    n = F.count(F.lit(1))
    return history.agg(
        n.alias("total_validations"),
        F.coalesce(_mean("trust_score"), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.round(F.try_divide(F.count_if("passed"), n) * 100, 1), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(F.sum(_issues()), F.lit(0)).alias("total_issues"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_issues"),
    )


def daily_trend(history: DataFrame) -> DataFrame:
    return history.groupBy(F.to_date("ts").alias("day")).agg(
        _mean("trust_score").alias("avg_score"), F.count(F.lit(1)).alias("validations")).orderBy("day")


def category_averages(history: DataFrame) -> DataFrame:
    return history.agg(*[
        F.coalesce(_mean(column), F.lit(0.0)).alias(name) for name, column in SCORE_COLUMNS.items()])


def project_breakdown(history: DataFrame, limit: int = 10) -> DataFrame:
    return history.groupBy("project").agg(
        F.count(F.lit(1)).alias("validations"),
        F.coalesce(_mean("trust_score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_issues"),
    ).orderBy(F.desc("validations"), "project").limit(limit)


def _by_user(history: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return history.groupBy("user").agg(
        n.alias("validations"), (F.sum("trust_score") / n).alias("mean_score"),
        F.round(F.count_if("passed") / n * 100, 1).alias("pass_rate"))


def user_rankings(history: DataFrame, limit: int = 10) -> DataFrame:
    top = _by_user(history).orderBy(F.desc("mean_score"), "user").limit(limit)
    return top.select("user", "validations", F.round("mean_score", 1).alias("avg_score"))


def leaderboard(history: DataFrame, limit: int = 10) -> DataFrame:
    """Best users with their rank.  The rank is taken over the ``limit`` rows that remain."""
    top = _by_user(history).orderBy(F.desc("mean_score"), "user").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("mean_score"), "user"))
    return top.select(rank.alias("rank"), "user", "validations", F.round("mean_score", 1).alias("avg_score"), "pass_rate")


def topk_groups(history: DataFrame, group: str, k: int) -> DataFrame:
    return history.groupBy(group).agg(
        F.count(F.lit(1)).alias("validations")).orderBy(F.desc("validations"), group).limit(k)


def team_stats(history: DataFrame, as_of: str, days: int = 30, project: str | None = None,
               user: str | None = None) -> dict[str, DataFrame]:
    """All statistics of one selection, by name."""
    rows = history_filter(history, as_of, days, project, user)
    return {
        "overview": overview(rows),
        "score_trend": daily_trend(rows),
        "category_averages": category_averages(rows),
        "project_breakdown": project_breakdown(rows),
        "user_rankings": user_rankings(rows),
    }


def recent_newest_first(history: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return history_filter(history, as_of, days).orderBy(F.desc("ts"), F.desc("id"))
