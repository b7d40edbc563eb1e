"""Shared inputs of the registered queries, on the Spark side and as SQL common table expressions.

Stand-ins: ``documents`` are text files, which take the line rules and have no tree, ``pages`` are script texts, ``events`` is the
validation history and the change feed, ``part`` grows the template corpus and the module graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge import corpus
from codegauge.catalog.line_rules import LINE_RULES, TEXT_PACKS
from codegauge.constants import MAX_LINE_LENGTH
from codegauge.corpus import sql_text
from codegauge.functions.syntax import ast_nodes
from codegauge.operators import lines as L
from codegauge.plans.validate import text_issues
from codegauge.session import spread, spread_rows

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-01-31 00:00:00"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the SQL that must give the same rows."""
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as files ---------------------------------------------------------------------------------------

def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.lit("text").alias("language"), F.col("text").alias("code"))


def doc_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_issues(doc_files(spark, sf_dir))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select(
        F.col("page_id").alias("file_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"),
        F.lit("javascript").alias("language"), F.col("html").alias("code"))


DOC_FILES = ("doc_files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.txt' AS path, text AS code FROM documents)")
DOC_LINES = (
    "doc_split AS (SELECT doc_id AS file_id, string_split(text, chr(10)) AS parts FROM documents), "
    "doc_lines AS (SELECT file_id, unnest(parts) AS line, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_no FROM doc_split)"
)


def rules_sql(name: str, *packs: str) -> str:
    rows = ", ".join(
        f"({sql_text(f'{pack}.{at + 1}')}, {sql_text(severity)}, {sql_text(category)}, {sql_text(message)}, {sql_text(suggestion)}, "
        f"{check}, {at}, {str(by_line).upper()}, {sql_text(pattern)})"
        for pack, at, severity, category, message, suggestion, check, by_line, pattern in LINE_RULES if pack in packs)
    return f"{name}(rule_id, severity, category, message, suggestion, chk, rnk, by_line, pattern) AS (VALUES {rows})"


DOC_ISSUES = ", ".join([
    DOC_LINES,
    rules_sql("text_rules", *TEXT_PACKS),
    f"""issues AS (
      SELECT file_id, rule_id, severity, category, message, line_no AS line, CAST(NULL AS INTEGER) AS "column", suggestion,
             CAST(chk AS BIGINT) * {L.CHECK_STEP} + CASE WHEN by_line THEN CAST(line_no AS BIGINT) * {L.MAJOR_STEP} + rnk
                                                     ELSE CAST(rnk AS BIGINT) * {L.MAJOR_STEP} + line_no END AS seq
      FROM doc_lines JOIN text_rules ON regexp_matches(line, pattern)
      UNION ALL
      SELECT file_id, 'line_too_long', 'low', 'best_practices', 'Line too long (' || length(line) || ' chars)', line_no,
             NULL, 'Break line to max {MAX_LINE_LENGTH} characters', {25 * L.CHECK_STEP} + CAST(line_no AS BIGINT)
      FROM doc_lines WHERE length(line) > {MAX_LINE_LENGTH})""",
])
DOC_TOTALS = DOC_ISSUES + ", " + DOC_FILES + """,
    keyed AS (SELECT *, CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END AS penalty,
                     CASE category WHEN 'hallucination' THEN 'hallucinations' ELSE category END AS category_key FROM issues),
    weights(category_key, weight) AS (VALUES ('security', 2.0::DOUBLE), ('hallucinations', 2.5::DOUBLE), ('logic', 1.0::DOUBLE), ('best_practices', 0.5::DOUBLE)),
    sums AS (SELECT file_id, category_key, sum(penalty) AS penalty, count(*) AS n, count(*) FILTER (severity = 'critical') AS crit
             FROM keyed GROUP BY 1, 2),
    scores AS (SELECT f.file_id, w.category_key, w.weight, greatest(0, least(100, 100 - coalesce(s.penalty, 0))) AS score,
                      coalesce(s.n, 0) AS issue_count, coalesce(s.crit, 0) AS critical_count
               FROM doc_files f CROSS JOIN weights w LEFT JOIN sums s ON s.file_id = f.file_id AND s.category_key = w.category_key),
    trust AS (SELECT file_id, CAST(floor(sum(score * weight) / sum(weight)) AS INTEGER) AS trust_score, sum(issue_count) AS issue_count,
                     sum(critical_count) AS critical_count FROM scores GROUP BY 1),
    results AS (SELECT t.file_id, f.path, t.trust_score, t.issue_count, t.critical_count,
                       t.trust_score >= 60 AND t.critical_count = 0 AS passed FROM trust t JOIN doc_files f USING (file_id))"""


# --- template corpus ------------------------------------------------------------------------------------------

def corpus_files(spark: SparkSession, sf_dir: str, language: str | None = None) -> DataFrame:
    files = corpus.code_files(spread_rows(table(spark, sf_dir, "part").select("p_partkey")))
    return files if language is None else files.where(F.col("language") == language)


def corpus_nodes(spark: SparkSession, sf_dir: str, kinds: Iterable[str] | None = None) -> DataFrame:
    return ast_nodes(corpus_files(spark, sf_dir, "python"), kinds)


def expected(*rules: str, columns: str = "file_id, rule_id, severity, line, message") -> str:
    return f"WITH {corpus.expected_sql(*rules)} SELECT {columns} FROM expected"


def shown(issues: DataFrame) -> DataFrame:
    return issues.select("file_id", "rule_id", "severity", "line", "message")


# --- events as history and change feed --------------------------------------------------------------------------

def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_of(table(spark, sf_dir, "events"))


def history_of(events: DataFrame) -> DataFrame:
    whole = F.floor("value")
    score = F.least(F.lit(100), whole).cast("int")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_path"),
        score.alias("trust_score"), ((score >= 60) & (F.col("event_type") != "error")).alias("passed"),
        (F.col("event_type") == "error").cast("int").alias("critical_count"),
        (whole % 3).cast("int").alias("high_count"), (whole % 5).cast("int").alias("medium_count"),
        (whole % 2).cast("int").alias("low_count"),
        F.least(F.lit(100), F.floor(F.col("value") * 2)).cast("int").alias("security_score"),
        F.least(F.lit(100), F.floor(F.col("value") * 1.5)).cast("int").alias("hallucination_score"),
        (100 - score).cast("int").alias("logic_score"),
        F.least(F.lit(100), whole + 50).cast("int").alias("best_practices_score"),
        F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("project"),
        F.lit("main").alias("branch"), F.lit(None).cast("string").alias("commit"))


HISTORY = """history AS (SELECT event_id AS id, ts, 'f' || user_id || '.py' AS file_path,
    CAST(least(100, floor(value)) AS INTEGER) AS trust_score, least(100, floor(value)) >= 60 AND event_type <> 'error' AS passed,
    CAST(event_type = 'error' AS INTEGER) AS critical_count, CAST(floor(value) AS INTEGER) % 3 AS high_count,
    CAST(floor(value) AS INTEGER) % 5 AS medium_count, CAST(floor(value) AS INTEGER) % 2 AS low_count,
    CAST(least(100, floor(value * 2)) AS INTEGER) AS security_score, CAST(least(100, floor(value * 1.5)) AS INTEGER) AS hallucination_score,
    100 - CAST(least(100, floor(value)) AS INTEGER) AS logic_score, CAST(least(100, floor(value) + 50) AS INTEGER) AS best_practices_score,
    CAST(user_id AS VARCHAR) AS "user", event_type AS project, 'main' AS branch FROM events)"""


def change_feed_of(events: DataFrame) -> DataFrame:
    """Snapshots of one path per user; the modification time moves once a day."""
    ts = F.col("ts").cast("timestamp")
    whole = F.floor("value")
    return events.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), ts.alias("ts"),
        F.col("event_id").alias("id"), F.date_trunc("day", ts).alias("modified_at"), F.md5("event_type").alias("content_hash"),
        F.least(F.lit(100), whole).cast("int").alias("score"), (whole % 5).cast("int").alias("issues"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed_of(table(spark, sf_dir, "events"))


FEED = """feed AS (SELECT 'f' || user_id || '.py' AS path, ts, event_id AS id, date_trunc('day', ts) AS modified_at, md5(event_type) AS content_hash,
    CAST(least(100, floor(value)) AS INTEGER) AS score, CAST(floor(value) AS INTEGER) % 5 AS issues FROM events)"""
