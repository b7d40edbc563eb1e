"""Queries over the validation history, the result cache, the change feed and its streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.catalog.common import (
    AS_OF, DOC_ISSUES, DOC_TOTALS, FEED, HISTORY, change_feed, change_feed_of, doc_files, history,
    history_of, query, table,
)
from codegauge import rules as R
from codegauge.functions import scalars as S
from codegauge.operators import accuracy, history as H, lines as L, reuse, skew, watch
from codegauge.operators.sketch import Wanted, pick
from codegauge.plans.validate import validate_texts
from codegauge.session import scratch_path, stage
from codegauge.sources import files as src, tables
from codegauge.streaming import panes, watch as stream

SINCE_14 = f"ts < TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY"
SINCE_30 = f"ts < TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"
SINCE_7 = f"ts < TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"


# --- history: scan, append, filter, export ------------------------------------------------------------------------

@query("validations_scan", f'WITH {HISTORY} SELECT id, file_path, trust_score, passed, "user", project FROM history WHERE {SINCE_14}')
def validations_scan(spark, sf_dir):
    """The history written by day and read back; the time filter prunes whole days."""
    path = scratch_path(spark, "history")
    tables.history_append(history(spark, sf_dir), path, "events")
    rows = H.history_filter(tables.read_history(spark, path), AS_OF, 14)
    return rows.select("id", "file_path", "trust_score", "passed", "user", "project")


@query("history_append", f"WITH {DOC_TOTALS}, h AS (SELECT file_id, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'low') AS l FROM issues GROUP BY 1), "
       "p AS (SELECT file_id, max(score) FILTER (category_key = 'security') AS s, max(score) FILTER (category_key = 'hallucinations') AS a, "
       "max(score) FILTER (category_key = 'best_practices') AS b FROM scores GROUP BY 1) "
       "SELECT path AS file_path, trust_score, passed, coalesce(h.h, 0) AS high_count, coalesce(h.l, 0) AS low_count, p.s AS security_score, "
       "p.a AS hallucination_score, p.b AS best_practices_score, 'anonymous' AS \"user\", 'main' AS branch FROM results JOIN p USING (file_id) LEFT JOIN h USING (file_id)")
def history_append(spark, sf_dir):
    """Scores of all documents appended to a history table, twice under one run, and read back."""
    path = scratch_path(spark, "appended")
    results = validate_texts(doc_files(spark, sf_dir))
    rows = stage(tables.history_rows(results, F.lit(AS_OF).cast("timestamp")), "history-rows")
    for _ in range(2):
        tables.history_append(rows, path, "documents")
    return tables.read_history(spark, path).select(
        "file_path", "trust_score", "passed", "high_count", "low_count", "security_score", "hallucination_score",
        "best_practices_score", "user", "branch")


@query("history_filter", f"WITH {HISTORY} SELECT id, \"user\", project, trust_score FROM history WHERE {SINCE_14} AND project = 'click'")
def history_filter(spark, sf_dir):
    return H.history_filter(history(spark, sf_dir), AS_OF, 14, project="click").select("id", "user", "project", "trust_score")


@query("history_export", f"WITH {HISTORY} SELECT id, epoch_us(ts) AS ts_us, trust_score FROM history WHERE {SINCE_7}")
def history_export(spark, sf_dir):
    """Newest first, written as JSON lines and read back."""
    path = scratch_path(spark, "export")
    tables.history_export(H.recent_newest_first(history(spark, sf_dir), AS_OF, 7), path)
    rows = spark.read.schema("id long, ts timestamp, trust_score int").option("timestampFormat", tables.TIME_FORMAT).json(path)
    return rows.select("id", F.unix_micros("ts").alias("ts_us"), "trust_score")


# --- history: statistics --------------------------------------------------------------------------------------------

@query("history_overview", f"WITH {HISTORY} SELECT count(*) AS total_validations, round(sum(trust_score) / count(*), 1) AS average_score, "
       "round(count(*) FILTER (passed) / count(*) * 100, 1) AS pass_rate, sum(critical_count + high_count + medium_count + low_count) AS total_issues, "
       f"sum(critical_count) AS critical_issues FROM history WHERE {SINCE_30}")
def history_overview(spark, sf_dir):
    return H.overview(H.history_filter(history(spark, sf_dir), AS_OF, 30))


@query("score_trend", f"WITH {HISTORY} SELECT CAST(ts AS DATE) AS day, round(sum(trust_score) / count(*), 1) AS avg_score, count(*) AS validations FROM history WHERE {SINCE_30} GROUP BY 1")
def score_trend(spark, sf_dir):
    return H.daily_trend(H.history_filter(history(spark, sf_dir), AS_OF, 30))


@query("category_averages", f"WITH {HISTORY} SELECT round(sum(security_score) / count(*), 1) AS security, round(sum(hallucination_score) / count(*), 1) AS hallucinations, "
       f"round(sum(logic_score) / count(*), 1) AS logic, round(sum(best_practices_score) / count(*), 1) AS best_practices FROM history WHERE {SINCE_30}")
def category_averages(spark, sf_dir):
    return H.category_averages(H.history_filter(history(spark, sf_dir), AS_OF, 30))


@query("project_breakdown", f"WITH {HISTORY} SELECT project, count(*) AS validations, round(sum(trust_score) / count(*), 1) AS avg_score, sum(critical_count) AS critical_issues "
       f"FROM history WHERE {SINCE_30} GROUP BY 1 ORDER BY validations DESC, project LIMIT 10")
def project_breakdown(spark, sf_dir):
    return H.project_breakdown(H.history_filter(history(spark, sf_dir), AS_OF, 30))


@query("user_rankings", f"WITH {HISTORY} SELECT \"user\", count(*) AS validations, round(sum(trust_score) / count(*), 1) AS avg_score FROM history WHERE {SINCE_30} "
       "GROUP BY 1 ORDER BY sum(trust_score) / count(*) DESC, \"user\" LIMIT 10")
def user_rankings(spark, sf_dir):
    return H.user_rankings(H.history_filter(history(spark, sf_dir), AS_OF, 30))


_BOARD = (f"WITH {HISTORY}, u AS (SELECT \"user\", count(*) AS validations, sum(trust_score) / count(*) AS m, count(*) FILTER (passed) / count(*) * 100 AS p FROM history "
          f"WHERE {SINCE_7} GROUP BY 1) SELECT row_number() OVER (ORDER BY m DESC, \"user\") AS rank, \"user\", validations, round(m, 1) AS avg_score, round(p, 1) AS pass_rate "
          "FROM u ORDER BY m DESC, \"user\" LIMIT 10")


@query("leaderboard", _BOARD)
def leaderboard(spark, sf_dir):
    return H.leaderboard(H.history_filter(history(spark, sf_dir), AS_OF, 7))


@query("leaderboard_rank", f"SELECT rank, \"user\" FROM ({_BOARD})")
def leaderboard_rank(spark, sf_dir):
    return H.leaderboard(H.history_filter(history(spark, sf_dir), AS_OF, 7)).select("rank", "user")


@query("topk_groups", f"WITH {HISTORY} SELECT \"user\", count(*) AS validations FROM history GROUP BY 1 ORDER BY validations DESC, \"user\" LIMIT 10")
def topk_groups(spark, sf_dir):
    return H.topk_groups(history(spark, sf_dir), "user", 10)


@query("running_stats", f"WITH {HISTORY} SELECT id, row_number() OVER w AS files, sum(CAST(passed AS INTEGER)) OVER w AS passed, sum(CAST(NOT passed AS INTEGER)) OVER w AS failed, "
       "sum(critical_count) OVER w AS critical, floor(sum(trust_score) OVER w / row_number() OVER w + 0.5) AS average FROM history WINDOW w AS (ORDER BY ts, id)")
def running_stats(spark, sf_dir):
    rows = history(spark, sf_dir).select("id", "ts", "passed", "critical_count", "trust_score")
    run = skew.running_totals(rows, ["ts", "id"], {
        "files": F.lit(1), "passed_n": F.col("passed").cast("int"), "failed": (~F.col("passed")).cast("int"),
        "critical": F.col("critical_count"), "score": F.col("trust_score")})
    return run.select("id", "files", F.col("passed_n").alias("passed"), "failed", "critical",
                      F.floor(F.col("score") / F.col("files") + 0.5).cast("double").alias("average"))


@query("duration_stats", "SELECT event_type AS tool, user_id AS sample, count(*) AS iterations, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, "
       "round(coalesce(stddev_samp(value), 0), 6) AS std_dev_ms, sum(1 + event_id % 40) AS lines_processed, "
       "round(sum(1 + event_id % 40) / (sum(value) / 1000), 4) AS lines_per_second FROM events GROUP BY 1, 2")
def duration_stats(spark, sf_dir):
    stats = accuracy.duration_stats(_durations(spark, sf_dir), "tool", "sample")
    return stats.select("tool", "sample", "iterations", F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms",
                        F.round("std_dev_ms", 6).alias("std_dev_ms"), "lines_processed",
                        F.round("lines_per_second", 4).alias("lines_per_second"))


def _durations(spark, sf_dir):
    """Recorded durations: the tool is the event type, the sample the user, the time the value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tool"), F.col("user_id").alias("sample"), F.col("value").alias("ms"),
        (1 + F.col("event_id") % 40).alias("lines"))


@query("tool_comparison", "WITH a AS (SELECT user_id AS sample, avg(value) FILTER (event_type = 'click') AS o, avg(value) FILTER (event_type = 'view') AS t FROM events GROUP BY 1) "
       "SELECT sample, round(o, 6) AS our_avg_ms, round(t, 6) AS other_avg_ms, round(t / o, 6) AS speedup, o < t AS faster FROM a WHERE o IS NOT NULL AND t IS NOT NULL")
def tool_comparison(spark, sf_dir):
    rows = accuracy.tool_comparison(_durations(spark, sf_dir), "click", "view")
    return rows.select("sample", *[F.round(c, 6).alias(c) for c in ("our_avg_ms", "other_avg_ms", "speedup")], "faster")


# --- scalar functions -------------------------------------------------------------------------------------------------

_SEV = "CASE user_id % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'odd' END"


def _severity():
    at = F.col("user_id") % 6
    chain = F.when(at == 0, "critical")
    for i, name in enumerate(["high", "medium", "low", "info"], 1):
        chain = chain.when(at == i, name)
    return chain.otherwise("odd")


def _scalar_of_severity(name, function, cases):
    sql = f"SELECT event_id, {_SEV} AS severity, CASE {_SEV} {cases} END AS result FROM events"

    @query(name, sql)
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "events").select("event_id", _severity().alias("severity"))
        return rows.select("*", function(F.col("severity")).alias("result"))


_scalar_of_severity("severity_penalty", S.severity_penalty, "WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0")
_scalar_of_severity("sarif_level", S.sarif_level, "WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'low' THEN 'note' WHEN 'info' THEN 'note' ELSE 'warning'")
_scalar_of_severity("diagnostic_severity", S.diagnostic_severity, "WHEN 'critical' THEN 1 WHEN 'high' THEN 1 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 2")

_CAMEL = "'get' || replace(p_brand, '#', '') || 'HTTPServer' || upper(p_name[1]) || replace(p_name[2:], ' ', '') || p_partkey || 'Id'"


def _camel():
    name = F.col("p_name")
    tail = F.replace(F.substr(name, F.lit(2)), F.lit(" "), F.lit(""))
    return F.concat(F.lit("get"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("HTTPServer"),
                    F.upper(F.substring(name, 1, 1)), tail, F.col("p_partkey").cast("string"), F.lit("Id"))


@query("to_snake_case", f"SELECT p_partkey, lower(regexp_replace(regexp_replace({_CAMEL}, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")
def to_snake_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.to_snake_case(_camel()).alias("snake"))


@query("to_pascal_case", "SELECT p_partkey, list_aggregate(list_transform(string_split(replace(p_name, ' ', '_') || '_' || p_type || '__x2Y', '_'), "
       "lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '') AS pascal FROM part")
def to_pascal_case(spark, sf_dir):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_type", F.lit("__x2Y"))
    return table(spark, sf_dir, "part").select("p_partkey", S.to_pascal_case(name).alias("pascal"))


_NAMES = "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_type WHEN 2 THEN replace(p_brand, '#', '') ELSE p_name END"


@query("case_predicates", f"SELECT p_partkey, regexp_matches(n, '^[a-z][a-z0-9_]*$') AS snake, regexp_matches(n, '^[A-Z][a-zA-Z0-9]*$') AS pascal, "
       f"upper(n) = n AND lower(n) <> n AS is_upper FROM (SELECT p_partkey, {_NAMES} AS n FROM part)")
def case_predicates(spark, sf_dir):
    at = F.col("p_partkey") % 4
    name = (F.when(at == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(at == 1, F.col("p_type"))
            .when(at == 2, F.replace("p_brand", F.lit("#"), F.lit(""))).otherwise(F.col("p_name")))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    n = F.col("n")
    return rows.select("p_partkey", S.is_snake_case(n).alias("snake"), S.is_pascal_case(n).alias("pascal"), S.is_upper(n).alias("is_upper"))


_CONFIG_JSON = '{"checks":{"best_practices":0.5,"hallucinations":2.5,"logic":1.0,"security":2.0},"min_score":70,"strict_mode":false}'


@query("config_hash", f"SELECT doc_id, substr(md5(replace(replace('{_CONFIG_JSON}', '70', CAST(50 + doc_id % 50 AS VARCHAR)), 'false', CAST(lang = 'fr' AS VARCHAR))), 1, 8) AS config_hash FROM documents")
def config_hash(spark, sf_dir):
    """One configuration per document: its own score to reach, and strict for one language."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", S.config_hash((50 + F.col("doc_id") % 50).cast("int"), F.col("lang") == "fr").alias("config_hash"))


@query("content_hash", f"SELECT doc_id, substr(sha256(text || ':' || substr(md5('{_CONFIG_JSON}'), 1, 8)), 1, 16) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.content_hash(F.col("text"), S.config_hash()).alias("content_hash"))


@query("change_hash", "SELECT doc_id, md5(text) AS change_hash FROM documents")
def change_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.change_hash(F.col("text")).alias("change_hash"))


@query("is_expired", f"SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) "
       f"< TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, true) AS expired FROM events")
def is_expired(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", S.is_expired(text, F.lit(AS_OF).cast("timestamp")).alias("expired"))


@query("round_1dp", "SELECT event_id, round(CAST(round(value * 100) AS INTEGER) / 7, 1) AS rounded FROM events")
def round_1dp(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", S.round_1dp(F.round(F.col("value") * 100).cast("int") / 7).alias("rounded"))


@query("import_base", "SELECT page_id, split_part(split_part(url, '://', 2), '.', 1) AS base FROM pages")
def import_base(spark, sf_dir):
    dotted = F.replace(F.substring_index("url", "://", -1), F.lit("/"), F.lit("."))
    return table(spark, sf_dir, "pages").select("page_id", S.import_base(dotted).alias("base"))


@query("title_case", "SELECT p_partkey, list_aggregate(list_transform(string_split(replace(p_name || '_' || p_type, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ') AS title FROM part")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.title_case(F.concat_ws("_", "p_name", "p_type")).alias("title"))


_PARAM = "CASE user_id % 7 WHEN 0 THEN 'user_name' WHEN 1 THEN 'max_size' WHEN 2 THEN 'is_open' WHEN 3 THEN 'row_items' WHEN 4 THEN 'kwargs' WHEN 5 THEN 'HAS_TEXT' ELSE 'x' END || event_type"


@query("param_kind", f"SELECT event_id, CASE WHEN regexp_matches(p, 'name|str|text|msg|message') THEN 'string' WHEN regexp_matches(p, 'count|num|size|length|index') THEN 'number' "
       "WHEN regexp_matches(p, 'is_|has_|flag|enable') THEN 'bool' WHEN regexp_matches(p, 'list|items|values|data') THEN 'list' "
       f"WHEN regexp_matches(p, 'dict|config|options|kwargs') THEN 'dict' ELSE 'none' END AS kind FROM (SELECT event_id, lower({_PARAM}) AS p FROM events)")
def param_kind(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("user_name", "max_size", "is_open", "row_items", "kwargs", "HAS_TEXT", "x")])
    name = F.concat(F.element_at(names, (F.col("user_id") % 7 + 1).cast("int")), "event_type")
    return table(spark, sf_dir, "events").select("event_id", S.param_kind(name).alias("kind"))


@query("detect_language", "SELECT page_id, CASE WHEN url LIKE '%/' AND page_id % 5 <> 3 THEN 'python' ELSE CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'javascript' ELSE 'python' END END AS language FROM pages")
def detect_language(spark, sf_dir):
    """The page's url with one of five endings; an unknown one, or an ending without a name before it, means python."""
    ends = F.array(*[F.lit(e) for e in (".py", ".MJS", ".tsx", ".min.js", ".rb")])
    path = F.concat("url", F.element_at(ends, (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", S.detect_language(path).alias("language"))


@query("module_name", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '.' || lang WHEN doc_id % 3 = 1 THEN source || '.d' || doc_id ELSE '' END AS module FROM documents")
def module_name(spark, sf_dir):
    i = F.col("doc_id")
    path = (F.when(i % 3 == 0, F.concat_ws("/", "source", "lang", F.lit("__init__.py")))
            .when(i % 3 == 1, F.concat(F.col("source"), F.lit("/d"), i.cast("string"), F.lit(".py"))).otherwise("__init__.py"))
    return table(spark, sf_dir, "documents").select("doc_id", S.module_name(path).alias("module"))


@query("ignore_filter", "SELECT doc_id FROM documents WHERE NOT (starts_with(source, 'src1') OR starts_with(source, 'src4'))")
def ignore_filter(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/src/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return src.drop_ignored(files, "/src", ["src1", "src4"]).select("doc_id")


@query("exclude_dirs", "SELECT doc_id FROM documents WHERE lang NOT IN ('fr', 'de')")
def exclude_dirs(spark, sf_dir):
    """Documents filed below a folder per language; two of the folders are excluded names."""
    folder = F.when(F.col("lang") == "fr", "node_modules").when(F.col("lang") == "de", ".git").otherwise("venv2")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/"), folder, F.lit("/x.py")).alias("path"))
    return watch.watched(files).select("doc_id")


# --- result cache -------------------------------------------------------------------------------------------------------

def _as_of():
    return F.lit(AS_OF).cast("timestamp")


_CACHE = f"""cached AS (
    SELECT substr(sha256(text || ':cfg'), 1, 16) AS content_hash, 'cfg' AS config_hash, CAST(length(text) % 101 AS INTEGER) AS trust_score,
           length(text) % 7 AS issues_count, CAST(length(text) % 2 AS BIGINT) AS critical_count,
           CASE WHEN length(text) % 13 = 0 THEN 'unknown' ELSE strftime(TIMESTAMP '{AS_OF}' - to_days(CAST(length(text) % 14 AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS ts,
           min(source || '/' || lang) AS file_path, CAST(length(text) % 50 AS DOUBLE) AS duration_ms, '{{"n":' || length(text) || '}}' AS result_json
    FROM documents WHERE lang <> 'fr' GROUP BY text),
    live AS (SELECT * FROM cached WHERE coalesce(TRY_CAST(ts AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false)),
    hashed AS (SELECT doc_id AS file_id, substr(sha256(text || ':cfg'), 1, 16) AS content_hash FROM documents)"""


def _cache(spark, sf_dir):
    """Results stored earlier for every text not in French, of different ages; some carry an unreadable time."""
    n = F.length("text")
    age = F.date_format(_as_of() - F.make_dt_interval((n % 14).cast("int")), "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, sf_dir, "documents").where(F.col("lang") != "fr").select(
        S.content_hash(F.col("text"), "cfg").alias("content_hash"), S.content_digest(F.col("text"), "cfg").alias("digest"),
        F.lit("cfg").alias("config_hash"), (n % 101).cast("int").alias("trust_score"),
        (n % 7).cast("long").alias("issues_count"), (n % 2).cast("long").alias("critical_count"),
        F.when(n % 13 == 0, "unknown").otherwise(age).alias("ts"), F.concat_ws("/", "source", "lang").alias("file_path"),
        (n % 50).cast("double").alias("duration_ms"), F.concat(F.lit('{"n":'), n.cast("string"), F.lit("}")).alias("result_json"))
    others = [c for c in rows.columns if c not in ("digest", "file_path")]
    return rows.groupBy("digest").agg(F.min("file_path").alias("file_path"), *[F.first(c).alias(c) for c in others]).select(*rows.columns)


def _hashes(spark, sf_dir):
    return reuse.content_hashes(doc_files(spark, sf_dir), "cfg")


@query("cache_scan", f"WITH {_CACHE} SELECT content_hash, trust_score, issues_count, ts, file_path FROM cached WHERE NOT ends_with(file_path, '/de')")
def cache_scan(spark, sf_dir):
    """The cache as JSON lines, those of German files cut off in the middle, which the scan must skip."""
    path = scratch_path(spark, "cache")
    entries = _cache(spark, sf_dir)
    body = F.to_json(F.struct(*entries.columns))
    bad = F.col("file_path").endswith("/de")
    entries.select(F.when(bad, F.substring(body, 1, 40)).otherwise(body).alias("value")).write.text(path)
    return tables.cache_scan(spark, path).select("content_hash", "trust_score", "issues_count", "ts", "file_path")


@query("cache_lookup", f"WITH {_CACHE} SELECT file_id, content_hash, trust_score, issues_count FROM hashed JOIN live USING (content_hash)")
def cache_lookup(spark, sf_dir):
    found = reuse.cache_lookup(_hashes(spark, sf_dir), _cache(spark, sf_dir), _as_of())
    return found.select("file_id", "content_hash", "trust_score", "issues_count")


@query("cache_miss", f"WITH {_CACHE} SELECT file_id, content_hash FROM hashed WHERE content_hash NOT IN (SELECT content_hash FROM live)")
def cache_miss(spark, sf_dir):
    return reuse.cache_miss(_hashes(spark, sf_dir), _cache(spark, sf_dir), _as_of()).select("file_id", "content_hash")


def _scan(files):
    return validate_texts(files).select("file_id", "trust_score", F.col("issue_count").alias("issues_count"))


@query("dedup_scan", f"WITH {DOC_TOTALS} SELECT file_id, trust_score, issue_count AS issues_count FROM results")
def dedup_scan(spark, sf_dir):
    return reuse.dedup_scan(doc_files(spark, sf_dir), _scan)


@query("incremental_scan", f"WITH {DOC_TOTALS}, {_CACHE} SELECT h.file_id, coalesce(l.trust_score, r.trust_score) AS trust_score, coalesce(l.issues_count, r.issue_count) AS issues_count, "
       "l.content_hash IS NOT NULL AS from_cache FROM hashed h LEFT JOIN live l USING (content_hash) JOIN results r USING (file_id)")
def incremental_scan(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    cache = _cache(spark, sf_dir)
    return reuse.incremental_scan(files, cache, _scan, _as_of(), ["trust_score", "issues_count"], config="cfg")


@query("cache_upsert", f"WITH {DOC_TOTALS}, {_CACHE}, fresh AS (SELECT content_hash, trust_score, issue_count AS issues_count, path FROM "
       "(SELECT h.content_hash, r.trust_score, r.issue_count, r.path, row_number() OVER (PARTITION BY content_hash ORDER BY h.file_id) AS rn "
       "FROM hashed h JOIN results r USING (file_id) WHERE h.content_hash NOT IN (SELECT content_hash FROM live)) WHERE rn = 1) "
       f"SELECT content_hash, trust_score, issues_count, '{AS_OF}' AS ts, path AS file_path FROM fresh "
       "UNION ALL SELECT content_hash, trust_score, issues_count, ts, file_path FROM live")
def cache_upsert(spark, sf_dir):
    """Files without a live entry are scanned and stored; their entries replace the expired ones."""
    files, cache = doc_files(spark, sf_dir), _cache(spark, sf_dir)
    missed = stage(reuse.cache_miss(_hashes(spark, sf_dir), cache, _as_of()), "misses")
    todo = pick(files, Wanted(reuse.representatives(missed), "file_id"))
    entries = reuse.cache_entries(validate_texts(todo), missed, F.lit(AS_OF), "cfg")
    stored = reuse.cache_table(spark, scratch_path(spark, "cache-table"))
    stored.merge(cache)
    stored.merge(entries.withColumn("result_json", F.lit(None).cast("string")))
    return stored.read().select("content_hash", "trust_score", "issues_count", "ts", "file_path")


@query("cache_cleanup", f"WITH {_CACHE} SELECT content_hash, CAST(NULL AS BIGINT) AS removed FROM live "
       "UNION ALL SELECT NULL, (SELECT count(*) FROM cached) - (SELECT count(*) FROM live)")
def cache_cleanup(spark, sf_dir):
    kept, removed = reuse.cache_cleanup(_cache(spark, sf_dir), _as_of())
    return kept.select("content_hash", F.lit(None).cast("long").alias("removed")).union(
        removed.select(F.lit(None).cast("string"), "removed"))


@query("score_distribution", f"WITH {_CACHE} SELECT CASE WHEN trust_score >= 80 THEN 'excellent' WHEN trust_score >= 60 THEN 'good' WHEN trust_score >= 40 THEN 'fair' ELSE 'poor' END AS band, "
       "count(*) AS entries FROM cached GROUP BY 1")
def score_distribution(spark, sf_dir):
    return reuse.score_distribution(_cache(spark, sf_dir))


@query("cache_metrics", f"WITH {_CACHE} SELECT count(*) AS total_validations, count(DISTINCT file_path) AS files_analyzed, sum(issues_count) AS total_issues_found, "
       "sum(trust_score) / count(*) AS avg_trust_score, sum(duration_ms) / count(duration_ms) AS avg_analysis_time_ms FROM cached")
def cache_metrics(spark, sf_dir):
    return reuse.cache_metrics(_cache(spark, sf_dir))


@query("cache_stats", f"WITH {_CACHE} SELECT count(*) AS entries, sum(strlen(result_json)) AS total_size_bytes, round(sum(strlen(result_json)) / (1024 * 1024), 2) AS total_size_mb FROM cached")
def cache_stats(spark, sf_dir):
    return reuse.cache_stats(_cache(spark, sf_dir))


# --- change feed and its streams ----------------------------------------------------------------------------------------

@query("latest_per_file", f"WITH {FEED} SELECT path, id, content_hash, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, id DESC) AS rn FROM feed) WHERE rn = 1")
def latest_per_file(spark, sf_dir):
    return watch.latest_per_file(change_feed(spark, sf_dir), ["ts", "id"]).select("path", "id", "content_hash", "score")


_CHANGES = (f"WITH {FEED} SELECT path, id, content_hash FROM (SELECT *, lag(modified_at) OVER w AS pm, lag(content_hash) OVER w AS ph FROM feed WINDOW w AS (PARTITION BY path ORDER BY ts, id)) "
            "WHERE pm IS DISTINCT FROM modified_at OR ph IS DISTINCT FROM content_hash")


@query("change_detection", _CHANGES)
def change_detection(spark, sf_dir):
    return watch.change_detection(change_feed(spark, sf_dir), ["ts", "id"]).select("path", "id", "content_hash")


_SUMMARY = (f"WITH {FEED}, latest AS (SELECT path, score, issues FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, id DESC) AS rn FROM feed) WHERE rn = 1) "
            "SELECT count(*) AS total_files, sum(score) / count(*) AS average_score, sum(issues) AS total_issues, count(*) FILTER (score >= 80) AS excellent, "
            "count(*) FILTER (score >= 60 AND score < 80) AS good, count(*) FILTER (score < 60) AS poor FROM latest")


@query("watch_summary", _SUMMARY)
def watch_summary(spark, sf_dir):
    return watch.watch_summary(watch.latest_per_file(change_feed(spark, sf_dir), ["ts", "id"]))


def _event_stream(spark, sf_dir):
    return stream.table_stream(spark, f"{sf_dir}/events.parquet")


@query("watch_source", f"WITH {FEED} SELECT path, id, content_hash FROM feed")
def watch_source(spark, sf_dir):
    feed = change_feed_of(_event_stream(spark, sf_dir))
    return stream.run_available(feed.select("path", "id", "content_hash"), "watch-source")[0]


@query("stream_change_detection", _CHANGES)
def stream_change_detection(spark, sf_dir):
    feed = change_feed_of(_event_stream(spark, sf_dir))
    return stream.changes_so_far(feed, "changes", ("ts", "id")).select("path", "id", "content_hash")


@query("stream_line_scan", f"WITH {DOC_ISSUES} SELECT file_id, rule_id, severity, line, message FROM issues")
def stream_line_scan(spark, sf_dir):
    docs = stream.table_stream(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.col("text").alias("code"))
    found = stream.line_scan(docs, R.PYTHON_PACKS).select("file_id", "rule_id", "severity", "line", "message")
    return stream.run_available(found, "line-scan")[0]


@query("stream_daily_trend", f"WITH {HISTORY} SELECT CAST(ts AS DATE) AS day, round(sum(trust_score) / count(*), 1) AS avg_score, count(*) AS validations FROM history GROUP BY 1")
def stream_daily_trend(spark, sf_dir):
    return panes.trend_of_panes(stream.panes_so_far(history_of(_event_stream(spark, sf_dir)), "daily-trend"))


@query("stream_weekly_users", f"WITH {HISTORY}, w AS (SELECT *, CAST(ts AS DATE) - CAST(unnest(range(0, 7)) AS INTEGER) AS week_start FROM history) "
       "SELECT week_start, \"user\", count(*) AS validations, round(sum(trust_score) / count(*), 1) AS avg_score, round(count(*) FILTER (passed) / count(*) * 100, 1) AS pass_rate "
       "FROM w GROUP BY 1, 2")
def stream_weekly_users(spark, sf_dir):
    return panes.weeks_of_panes(stream.panes_so_far(history_of(_event_stream(spark, sf_dir)), "weekly-users", ["user"]))


@query("stream_dedup", "SELECT DISTINCT md5(user_id || ':' || event_type) AS content_hash FROM events")
def stream_dedup(spark, sf_dir):
    """Content is the pair of user and event type; in one batch this is the set of distinct contents."""
    content = F.md5(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    rows = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), content.alias("content_hash"))
    return stream.run_available(stream.distinct_content(rows), "dedup")[0].select("content_hash")


@query("stream_watch_summary", f"WITH c AS (SELECT * FROM ({_CHANGES.replace('SELECT path, id, content_hash FROM', 'SELECT * FROM')})), "
       "latest AS (SELECT path, score, issues FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, id DESC) AS rn FROM c) WHERE rn = 1) "
       "SELECT count(*) AS total_files, sum(score) / count(*) AS average_score, sum(issues) AS total_issues, count(*) FILTER (score >= 80) AS excellent, "
       "count(*) FILTER (score >= 60 AND score < 80) AS good, count(*) FILTER (score < 60) AS poor FROM latest")
def stream_watch_summary(spark, sf_dir):
    """Changed snapshots merged into a latest-per-path table, then summed up: an unchanged file keeps its score."""
    feed, base = change_feed_of(_event_stream(spark, sf_dir)), scratch_path(spark, "latest")
    stream.running_latest(stream.detect_changes(feed, ("ts", "id")), "latest", base, **stream.STATE_STORE)
    table = stream.latest_table(spark, f"{base}/table", feed.schema)
    with stream.settings(spark, stream.STATE_STORE):
        table.merge(stage(stream.changes_held_back(spark, f"{base}/state", ("ts", "id")), "held-back"))
    return watch.watch_summary(table.read())
