"""From issues to scores.

``file_totals`` sums issues by file before they are shuffled: sums are fixed-width numbers, so a hash aggregate
leaves one short row per file and task.  Files without issues come in by a join on the same key.  Category and
trust scores are expressions on that row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge import constants as C
from codegauge.functions import scalars as S

SEVERITIES = list(C.SEVERITY_PENALTY)
KEYS = list(C.CATEGORY_OF_KEY)
ISSUE_STRUCT = ["seq", "rule_id", "severity", "category", "message", "line", "column", "suggestion"]


def effective_config(overrides: Mapping[str, Mapping] | None = None) -> dict[str, float]:
    """Enabled category keys with their weights: defaults, replaced per category.

    An override without a weight weighs 1.0, not the default; a disabled category is left out.
    """
    weights = {}
    for key, default in C.DEFAULT_WEIGHTS.items():
        override = (overrides or {}).get(key)
        if override is None:
            weights[key] = default
        elif override.get("enabled", True):
            weights[key] = float(override.get("weight", C.OVERRIDE_WEIGHT))
    return weights


def configured_weights(overrides: Mapping[str, Mapping] | None = None) -> dict[str, float]:
    """Weights of all four categories, enabled or not: JavaScript and TypeScript files are scored on these."""
    return effective_config({k: {**o, "enabled": True} for k, o in (overrides or {}).items()})


def effective_weights(configs: DataFrame, overrides: DataFrame) -> DataFrame:
    """The same rule for many configurations at once.

    ``configs(config_id)`` names the configurations, ``overrides(config_id, category_key, enabled, weight)``
    holds what they change; returns the enabled ``config_id, category_key, weight``.
    """
    defaults = F.explode(F.array(*[
        F.struct(F.lit(k).alias("category_key"), F.lit(w).alias("default_weight")) for k, w in C.DEFAULT_WEIGHTS.items()
    ]))
    base = configs.select("config_id", defaults.alias("d")).select("config_id", "d.*")
    changed = overrides.withColumn("present", F.lit(True))
    return (
        base.join(changed, ["config_id", "category_key"], "left")
        .where(F.coalesce("enabled", F.lit(True)))
        .select("config_id", "category_key",
                F.when(F.col("present"), F.coalesce("weight", F.lit(C.OVERRIDE_WEIGHT)))
                .otherwise(F.col("default_weight")).alias("weight"))
    )


def file_totals(files: DataFrame, issues: DataFrame, with_issues: bool = False) -> DataFrame:
    """One row per file: counts per severity, and penalty, issue and critical counts per category.

    ``with_issues`` adds the file's issues as one sorted array (for nested reports).
    """
    severity, category = F.col("severity"), F.col("category")
    sums = {"issue_count": F.count(F.lit(1))}
    sums |= {f"{s}_count": F.count_if(severity == s) for s in SEVERITIES}
    sums["unparsed"] = F.count_if(F.col("rule_id") == "syntax_error")
    for key, name in C.CATEGORY_OF_KEY.items():
        mine = category == name
        sums |= {
            f"{key}_penalty": F.sum(F.when(mine, S.severity_penalty(severity)).otherwise(0)),
            f"{key}_issues": F.count_if(mine),
            f"{key}_critical": F.count_if(mine & (severity == "critical")),
        }
    found = [value.alias(name) for name, value in sums.items()]
    if with_issues:
        found.append(F.array_sort(F.collect_list(F.struct(*ISSUE_STRUCT))).alias("issues"))
    per_file = issues.groupBy("file_id").agg(*found)

    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    every = files.select("file_id", path.alias("path")).join(per_file, "file_id", "left")
    columns = ["file_id", "path", *[F.coalesce(name, F.lit(0)).alias(name) for name in sums]]
    if with_issues:
        columns.append(F.coalesce("issues", F.array().cast(per_file.schema["issues"].dataType)).alias("issues"))
    return every.select(*columns)


def clamp_score(penalty: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(C.BASE_SCORE) - penalty)).cast("int")


def category_scores(totals: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``file_id, category_key, score, weight, issue_count, critical_count`` for every enabled category."""
    weights = effective_config() if weights is None else weights
    if not weights:
        return totals.where(F.lit(False)).select(
            "file_id", F.lit("").alias("category_key"), F.lit(0).alias("score"), F.lit(0.0).alias("weight"),
            F.lit(0).cast("long").alias("issue_count"), F.lit(0).cast("long").alias("critical_count"))
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(key).alias("category_key"), clamp_score(F.col(f"{key}_penalty")).alias("score"),
            F.lit(weight).alias("weight"), F.col(f"{key}_issues").alias("issue_count"),
            F.col(f"{key}_critical").alias("critical_count"))
        for key, weight in weights.items()
    ]))
    return totals.where(F.col("unparsed") == 0).select("file_id", rows.alias("c")).select("file_id", "c.*")


def trust_expression(weights: Mapping[str, float]) -> Column:
    """Weighted mean of the category scores of a totals row, cut to a whole number."""
    total = float(sum(weights.values()))
    if total <= 0:
        return F.lit(0)
    weighted = sum((clamp_score(F.col(f"{k}_penalty")) * F.lit(w) for k, w in weights.items()), F.lit(0.0))
    score = F.floor(weighted / F.lit(total)).cast("int")
    return F.when(F.col("unparsed") > 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))


def trust_scores(totals: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``totals`` plus ``trust_score`` and ``passed``."""
    weights = effective_config() if weights is None else weights
    return totals.withColumn("trust_score", trust_expression(weights)).withColumn(
        "passed", S.passed_flag(F.col("trust_score"), F.col("critical_count")))


def trust_from_scores(scores: DataFrame, weights: DataFrame, files: DataFrame) -> DataFrame:
    """Trust scores when each file has its own configuration: ``files(file_id, config_id)``.

    Long form: category scores meet their configuration's weights on ``(config_id, category_key)``; files
    whose categories are all disabled score 0.
    """
    wanted = scores.select("file_id", "category_key", "score").join(files.select("file_id", "config_id"), "file_id", "right")
    return (
        wanted.join(weights, ["config_id", "category_key"], "left")
        .groupBy("file_id")
        .agg(F.sum(F.col("score") * F.col("weight")).alias("ws"), F.sum("weight").alias("w"))
        .select("file_id", F.coalesce(F.floor(F.try_divide("ws", "w")), F.lit(0)).cast("int").alias("trust_score"))
    )


def category_pivot(scores: DataFrame) -> DataFrame:
    """Category scores side by side, 0 where a category was not scored."""
    wide = scores.groupBy("file_id").pivot("category_key", KEYS).agg(F.first("score"))
    return wide.select("file_id", *[F.coalesce(F.col(k), F.lit(0)).alias(f"{k}_score") for k in KEYS])


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a run, zeros when there are no files."""
    passed = F.count_if(F.col("passed"))
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("total_files"),
        F.coalesce(F.round(F.try_divide(F.sum("trust_score"), n), 1), F.lit(0.0)).alias("average_score"),
        passed.alias("passed"),
        (n - passed).alias("failed"),
        F.coalesce(F.sum("issue_count"), F.lit(0)).alias("total_issues"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_issues"),
        F.coalesce(F.round(F.try_divide(passed, n) * 100, 1), F.lit(0.0)).alias("pass_rate"),
    )


def run_gate(results: DataFrame, min_score: int = C.GATE_SCORE) -> DataFrame:
    """One row: does every file reach ``min_score`` without a critical issue."""
    ok = S.quality_gate(F.col("trust_score"), F.col("critical_count"), min_score)
    return results.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("gate_passed"))


def weights_table(spark: SparkSession, weights: Mapping[str, float] | None = None) -> DataFrame:
    rows = list((effective_config() if weights is None else weights).items())
    return spark.createDataFrame(rows, "category_key string, weight double")
