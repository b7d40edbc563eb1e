"""Report rows: nested JSON, SARIF, editor diagnostics and text edits.  Each file is an independent row, so a
report is written in parallel with ``df.write``; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.functions import scalars as S
from codegauge.operators import scoring
from codegauge.operators.issues import distinct_rules, top_fixes

SOURCE = "codegauge"
LINE_END = 1000  # a whole line, in editor columns


def json_results(files: DataFrame, issues: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """One nested row per file: path, score, pass flag, counts, category map, issue list."""
    weights = scoring.effective_config() if weights is None else weights
    totals = scoring.trust_scores(scoring.file_totals(files, issues, with_issues=True), weights)
    entries = [
        F.struct(F.lit(key).alias("key"), F.struct(
            scoring.clamp_score(F.col(f"{key}_penalty")).alias("score"), F.lit(weight).alias("weight"),
            F.col(f"{key}_issues").alias("issue_count")).alias("value"))
        for key, weight in weights.items()
    ]
    categories = F.map_from_entries(F.array(*entries)) if entries else F.create_map()
    return totals.select(
        "file_id", F.col("path").alias("file_path"), "trust_score", "passed", "critical_count", "high_count",
        F.when(F.col("unparsed") == 0, categories).alias("categories"),
        F.transform("issues", lambda i: F.struct(
            i["severity"].alias("severity"), i["category"].alias("category"), i["message"].alias("message"),
            i["line"].alias("line"), i["column"].alias("column"), i["suggestion"].alias("suggestion"))).alias("issues"),
    )


def json_report(files: DataFrame, issues: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The same rows as JSON text, one document per file; nulls are written out."""
    nested = json_results(files, issues, weights)
    body = F.struct(*[c for c in nested.columns if c != "file_id"])
    return nested.select("file_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def sarif_results(issues: DataFrame, files: DataFrame) -> DataFrame:
    """SARIF result objects; files without a path are left out, a missing line gives an empty region."""
    named = files.where(F.col("path").isNotNull()).select("file_id", "path")
    # a map, so that "no line" is an empty object while other nulls are still written out
    region = F.map_filter(F.create_map(F.lit("startLine"), "line"), lambda _, v: v.isNotNull())
    result = F.struct(
        F.concat_ws("_", "category", "severity").alias("ruleId"),
        S.sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(F.col("path").alias("uri")).alias("artifactLocation"),
            region.alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
        F.struct("suggestion", "category", "severity").alias("properties"),
    )
    return issues.join(named, "file_id").select("file_id", "seq", F.to_json(result, {"ignoreNullFields": "false"}).alias("result"))


def sarif_rules(issues: DataFrame) -> DataFrame:
    """One rule per (category, severity) pair that occurs."""
    return distinct_rules(issues).select(
        F.concat_ws("_", "category", "severity").alias("id"),
        F.concat(S.title_parts(F.col("category")), F.lit(" Issue")).alias("name"),
        F.concat(S.capitalize(F.col("severity")), F.lit(" "), "category", F.lit(" issue detected")).alias("short_text"),
        F.concat(F.lit("Detected a "), "severity", F.lit(" severity issue in the "), "category",
                 F.lit(" category during AI code validation.")).alias("full_text"),
        S.sarif_level(F.col("severity")).alias("level"),
    )


def diagnostics(issues: DataFrame) -> DataFrame:
    """Editor diagnostics: zero-based whole-line ranges; an issue without a line sits on the first."""
    row = F.when(F.coalesce(F.col("line"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("line")) - 1
    return issues.select(
        "file_id", "seq", row.alias("start_line"), F.lit(0).alias("start_char"), row.alias("end_line"),
        F.lit(LINE_END).alias("end_char"), S.diagnostic_severity(F.col("severity")).alias("severity"),
        "message", F.lit(SOURCE).alias("source"), F.col("category").alias("code"),
        F.when(F.length("suggestion") > 0, F.col("suggestion")).alias("related"))


def fix_edits(fixes: DataFrame, k: int = 5) -> DataFrame:
    """Quick-fix edits for the first ``k`` fixes of a file; a fix without a line cannot be placed."""
    return top_fixes(fixes, k).where(F.col("line").isNotNull()).select(
        "file_id", "seq",
        F.concat(F.lit("Fix: "), F.substring("message", 1, 50), F.lit("...")).alias("title"),
        (F.col("line") - 1).alias("start_line"), F.col("line").alias("end_line"),
        F.concat("suggested", F.lit("\n")).alias("new_text"))
