"""Selections over the issues table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def all_issues(*parts: DataFrame) -> DataFrame:
    """Issue sets one after another, duplicates kept; ``seq`` gives each file's report order."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def by_severity(issues: DataFrame, *severities: str) -> DataFrame:
    return issues.where(F.col("severity").isin(*severities))


def _top(df: DataFrame, keys: list[str], k: int, order: str = "seq") -> DataFrame:
    """First ``k`` rows per key.  The rank filter is also applied before the shuffle, so a key with very many
    rows sends at most ``k`` per task."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= k)


def first_issues(issues: DataFrame, k: int = 10) -> DataFrame:
    return _top(issues, ["file_id"], k)


def top_issues_per_file(issues: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` critical, then first ``k`` high issues of each file."""
    return _top(by_severity(issues, "critical", "high"), ["file_id", "severity"], k)


def top_fixes(fixes: DataFrame, k: int = 5) -> DataFrame:
    return _top(fixes, ["file_id"], k)


def distinct_rules(issues: DataFrame) -> DataFrame:
    return issues.select("category", "severity").distinct()


def worst_files(results: DataFrame, k: int = 20) -> DataFrame:
    """Lowest scores first, the length of a terminal listing."""
    return results.orderBy("trust_score", "path", "file_id").limit(k)
