"""Queries over documents and pages: sources, line rules, selections, scores, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge import rules as R
from codegauge.catalog.common import (
    DOC_FILES, DOC_ISSUES, DOC_LINES, DOC_TOTALS, corpus_files, doc_files, doc_issues, expected, page_files, query,
    rules_sql, shown, table,
)
from codegauge.catalog.line_rules import TEXT_PACKS
from codegauge.functions import scalars as S
from codegauge.operators import accuracy, issues as I, lines as L, literals, scoring
from codegauge.plans.validate import validate_texts
from codegauge.session import scratch_path, stage
from codegauge.sinks import reports
from codegauge.sources import files as src


# --- sources ----------------------------------------------------------------------------------------------------

def _written_tree(spark, sf_dir, extension):
    """Documents written out as text files in one folder per source, several documents to a file."""
    root = scratch_path(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("text", "source")
    docs.write.option("maxRecordsPerFile", 500).partitionBy("source").text(root)
    return root


@query("scan_files", "SELECT source, sum(length(text) + 1) AS n_chars FROM documents GROUP BY 1")
def scan_files(spark, sf_dir):
    files = src.scan_files(spark, _written_tree(spark, sf_dir, "txt"), "*.txt")
    source = F.url_decode(F.regexp_extract("path", "/source=([^/]*)/", 1))
    return files.groupBy(source.alias("source")).agg(F.sum(F.length("code")).alias("n_chars"))


@query("scan_directory", "SELECT source, sum(length(text) + 1) AS n_chars, 'my pkg' AS package FROM documents WHERE NOT starts_with(source, 'src1') GROUP BY 1")
def scan_directory(spark, sf_dir):
    """A tree below a folder with a space in its name, scanned from its root, without the ignored part."""
    root = scratch_path(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("text", "source")
    docs.write.option("maxRecordsPerFile", 500).partitionBy("source").text(f"{root}/my pkg")
    files = src.drop_ignored(src.scan_files(spark, root, "*.txt"), root, ["my pkg/source=src1"])
    # a module is named by its folders below the root
    module = F.split(S.module_name(F.col("rel_path")), "[.]")
    return files.groupBy(F.replace(module.getItem(1), F.lit("source="), F.lit("")).alias("source"), module.getItem(0).alias("package")).agg(
        F.sum(F.length("code")).alias("n_chars"))


@query("scan_files_multilang",
       "SELECT 'typescript' AS language, sum(length(doc_id || ',' || n_chars) + 1) AS n_chars FROM documents "
       "UNION ALL SELECT 'javascript', sum(length(doc_id || ',' || quality) + 1) FROM labels")
def scan_files_multilang(spark, sf_dir):
    """A tree of .tsx, .jsx and .txt files; the last kind must be skipped."""
    root = scratch_path(spark, "multi")
    docs = table(spark, sf_dir, "documents")
    docs.select("doc_id", "n_chars").write.option("extension", "tsx").csv(f"{root}/app")
    table(spark, sf_dir, "labels").select("doc_id", "quality").write.option("extension", "jsx").csv(f"{root}/lib/ui")
    docs.select("lang").write.text(f"{root}/notes")
    files = src.scan_files_multilang(spark, root)
    return files.groupBy("language").agg(F.sum(F.length("code")).alias("n_chars"))


@query("scan_code_table", f"WITH {DOC_FILES} SELECT file_id, length(code) AS n_chars, CAST(NULL AS VARCHAR) AS path FROM doc_files")
def scan_code_table(spark, sf_dir):
    files = src.scan_code_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return files.select("file_id", F.length("code").alias("n_chars"), "path")


_BODIES = """full_docs AS (SELECT * FROM documents WHERE doc_id % 11 NOT IN (3, 5)), batch AS (
    SELECT doc_id, 0 AS pos, source AS name, text AS code, CASE WHEN lang = 'en' THEN 80 ELSE 70 END AS min_score, lang = 'fr' AS strict, NULL AS error FROM full_docs
    UNION ALL SELECT doc_id, 1, 'unnamed', text, CASE WHEN lang = 'en' THEN 80 ELSE 70 END, lang = 'fr', NULL FROM full_docs
    UNION ALL SELECT doc_id, 2, source, '', CASE WHEN lang = 'en' THEN 80 ELSE 70 END, lang = 'fr', NULL FROM full_docs
    UNION ALL SELECT doc_id, NULL, NULL, NULL, 70, false, CASE doc_id % 11 WHEN 3 THEN 'malformed body' ELSE 'no files' END FROM documents WHERE doc_id % 11 IN (3, 5))"""


def _bodies(spark, sf_dir):
    """One request body per document: a named file, one without a name and one without code; no files in some, and
    some that are not JSON."""
    docs = table(spark, sf_dir, "documents")
    no_text = F.lit(None).cast("string")
    body = F.struct(
        F.array(
            F.struct(F.col("source").alias("name"), F.col("text").alias("code")),
            F.struct(no_text.alias("name"), F.col("text").alias("code")),
            F.struct(F.col("source").alias("name"), no_text.alias("code")),
        ).alias("files"),
        F.when(F.col("lang") == "en", 80).alias("min_score"),
        F.when(F.col("lang") == "fr", True).alias("strict"))
    text = F.when(F.col("doc_id") % 11 == 3, "not json").when(F.col("doc_id") % 11 == 5, '{"files":[]}').otherwise(F.to_json(body))
    return docs.select("doc_id", text.alias("body"))


@query("json_batch_source", f"WITH {_BODIES} SELECT doc_id, pos, name, md5(code) AS code_md5, min_score, strict, error FROM batch")
def json_batch_source(spark, sf_dir):
    files = src.batch_files(_bodies(spark, sf_dir))
    return files.select("doc_id", "pos", "name", F.md5("code").alias("code_md5"), "min_score", "strict", "error")


@query("batch_totals", f"WITH {DOC_TOTALS} SELECT file_id AS doc_id, CASE WHEN file_id % 11 IN (3, 5) THEN 0 ELSE 3 END AS total, "
       "CASE WHEN file_id % 11 IN (3, 5) THEN 0 WHEN passed THEN 3 ELSE 1 END AS passed, "
       "CASE WHEN file_id % 11 IN (3, 5) OR passed THEN 0 ELSE 2 END AS failed, file_id % 11 IN (3, 5) AS rejected FROM results")
def batch_totals(spark, sf_dir):
    """Three files per body, two of them the document's text and one empty (which passes); a body without files or
    with another text than JSON is answered too."""
    bodies = src.batch_files(_bodies(spark, sf_dir))
    files = bodies.where("error is null").select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("file_id"), "code")
    doc = F.split("file_id", ":").getItem(0).cast("long")
    rows = validate_texts(files).select(doc.alias("doc_id"), "passed")
    rejected = bodies.where("error is not null").select("doc_id", F.lit(None).cast("boolean").alias("passed"))
    return src.batch_totals(rows.unionByName(rejected), "doc_id")


# --- lines and line rules -----------------------------------------------------------------------------------------

@query("code_lines", f"WITH {DOC_LINES} SELECT file_id, line_no, line FROM doc_lines")
def code_lines(spark, sf_dir):
    return L.code_lines(doc_files(spark, sf_dir))


def _doc_pack(name, pack):
    sql = (f"WITH {DOC_LINES}, {rules_sql('r', name)} SELECT file_id, rule_id, severity, category, message, suggestion, "
           "line_no AS line FROM doc_lines JOIN r ON regexp_matches(line, pattern)")

    @query(name, sql)
    def run(spark, sf_dir):
        found = L.scan_lines(L.code_lines(doc_files(spark, sf_dir)), (pack,))
        return found.select("file_id", "rule_id", "severity", "category", "message", "suggestion", "line")


_doc_pack("line_secrets", R.SECRETS)
_doc_pack("line_placeholders", R.PLACEHOLDERS)


@query("line_too_long", f"WITH {DOC_ISSUES} SELECT file_id, line, message, severity, suggestion FROM issues WHERE rule_id = 'line_too_long'")
def line_too_long(spark, sf_dir):
    return L.scan_lines(L.code_lines(doc_files(spark, sf_dir)), (R.LONG_LINES,)).select(
        "file_id", "line", "message", "severity", "suggestion")


def _corpus_pack(pack, language="python"):
    """A pack over the template corpus; files that do not parse have no line issues in a full run, so the
    oracle lists only what the templates' own lines give."""
    @query(pack.name, expected(pack.name))
    def run(spark, sf_dir):
        files = corpus_files(spark, sf_dir)
        mine = files.where(F.col("language") == "python") if language == "python" else files.where(F.col("language") != "python")
        return shown(L.scan_lines(L.code_lines(mine), (pack,)))


for _pack in (R.PATH_TRAVERSAL, R.SSRF, R.DESERIALIZATION, R.INTERNAL_URL):
    _corpus_pack(_pack)
for _pack in (R.JS_SECURITY, R.JS_VULNERABLE_DEPS, R.JS_INVENTED_CALLS, R.JS_ENDPOINTS, R.JS_LOGIC):
    _corpus_pack(_pack, "javascript")

PAGE_LINES = (
    "page_split AS (SELECT page_id AS file_id, string_split(html, chr(10)) AS parts FROM pages), "
    "page_lines AS (SELECT file_id, unnest(parts) AS line, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_no FROM page_split)"
)


@query("js_best_practices",
       f"WITH {PAGE_LINES}, {rules_sql('r', 'js_best_practices')} SELECT file_id, rule_id, severity, message, line_no AS line "
       "FROM page_lines JOIN r ON regexp_matches(line, pattern) WHERE NOT regexp_matches(line, '^\\s*//')")
def js_best_practices(spark, sf_dir):
    found = L.scan_lines(L.code_lines(page_files(spark, sf_dir)), (R.JS_STYLE,))
    return found.select("file_id", "rule_id", "severity", "message", "line")


@query("js_comment_filter",
       "WITH conv AS (SELECT conv_id, turn, unnest(string_split(replace(text, '.', chr(10) || ' //'), chr(10))) AS line FROM conversations) "
       "SELECT conv_id, turn, count(*) FILTER (NOT regexp_matches(line, '^\\s*(//|/\\*|\\*)')) AS security, "
       "count(*) FILTER (NOT regexp_matches(line, '^\\s*(//|/\\*)')) AS imports, "
       "count(*) FILTER (NOT regexp_matches(line, '^\\s*//')) AS style FROM conv GROUP BY 1, 2")
def js_comment_filter(spark, sf_dir):
    """Lines left by each pack's comment test, on turns whose sentences were turned into comment lines."""
    text = F.replace("text", F.lit("."), F.lit("\n //"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(text, "\n", -1)).alias("line"))
    line = F.col("line")
    return lines.groupBy("conv_id", "turn").agg(*[
        F.count_if(~L.starts_comment(line, prefixes)).alias(name) for name, prefixes in (
            ("security", R.JS_SECURITY.skip_comments), ("imports", R.JS_IMPORT_SKIP), ("style", R.JS_STYLE.skip_comments))])


@query("js_fake_packages", expected("js_fake_packages"))
def js_fake_packages(spark, sf_dir):
    files = corpus_files(spark, sf_dir).where(F.col("language") != "python")
    return shown(L.scan_js_packages(L.code_lines(files)))


@query("package_lookup", expected("js_fake_packages", columns="file_id, line, severity"))
def package_lookup(spark, sf_dir):
    """The import-to-package join with the package table given by the caller: the planner picks the strategy."""
    lines = L.code_lines(corpus_files(spark, sf_dir).where(F.col("language") != "python"))
    return L.scan_js_packages(lines, L.invented_packages(spark)).select("file_id", "line", "severity")


@query("line_sql_strings",
       f"WITH {PAGE_LINES}, {rules_sql('r', 'line_sql_strings')} SELECT file_id, rule_id, line_no AS line FROM "
       "(SELECT file_id, line_no, replace(line, '<p>', '+ \"SELECT ') AS line FROM page_lines) JOIN r ON regexp_matches(line, pattern)")
def line_sql_strings(spark, sf_dir):
    """The opt-in pack, on pages whose paragraphs were turned into string concatenations."""
    files = page_files(spark, sf_dir).withColumn("code", F.replace("code", F.lit("<p>"), F.lit('+ "SELECT ')))
    return L.scan_lines(L.code_lines(files), R.OPT_IN_PACKS).select("file_id", "rule_id", "line")


@query("rule_line_join", f"WITH {DOC_LINES}, {rules_sql('r', *TEXT_PACKS)} SELECT file_id, rule_id, severity, "
       "line_no AS line FROM doc_lines JOIN r ON regexp_matches(line, pattern)")
def rule_line_join(spark, sf_dir):
    """A table of rules, read back as any caller's would be, joined with the lines that hold what a rule requires."""
    rows = [(rule.rule_id, rule.severity, rule.pattern) for pack in R.PYTHON_PACKS if pack is not R.LONG_LINES for rule in pack.rules]
    rules = stage(spark.createDataFrame(rows, "rule_id string, severity string, pattern string"), "rule-table")
    found = literals.pattern_matches(L.code_lines(doc_files(spark, sf_dir)), rules)
    return found.select("file_id", "rule_id", "severity", F.col("line_no").alias("line"))


_ITEM_RULES = ("rules AS (SELECT item_id, '(?i)' || ws[1] || '[^A-Za-z]+' || ws[2] || '[^A-Za-z]+' || ws[3] AS pattern FROM "
               "(SELECT item_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS ws FROM benchmark) WHERE len(ws) >= 3)")


@query("rule_table_join", f"WITH {DOC_LINES}, {_ITEM_RULES} SELECT file_id, line_no AS line, item_id FROM doc_lines JOIN rules ON regexp_matches(line, pattern)")
def rule_table_join(spark, sf_dir):
    """Rules made of the first words of every benchmark item, against every line of every document."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("ws")
    items = table(spark, sf_dir, "benchmark").select("item_id", words).where(F.size("ws") >= 3)
    rules = items.select("item_id", F.concat(F.lit("(?i)"), F.array_join(F.slice("ws", 1, 3), "[^A-Za-z]+")).alias("pattern"))
    found = literals.pattern_matches(L.code_lines(doc_files(spark, sf_dir)), rules)
    return found.select("file_id", F.col("line_no").alias("line"), "item_id")


@query("js_symbols",
       "SELECT page_id AS file_id, array_to_string(list_concat(regexp_extract_all(html, 'import\\s+(\\w+)\\s+from\\s*[\"'']([^\"'']+)[\"'']', 2), "
       "regexp_extract_all(html, 'import\\s+\\{([^}]+)\\}\\s+from\\s*[\"'']([^\"'']+)[\"'']', 2)), ',') AS imports, "
       "array_to_string(regexp_extract_all(html, 'function\\s+(\\w+)\\s*\\(([^)]*)\\)', 1), ',') AS functions, "
       "array_to_string(regexp_extract_all(html, 'class\\s+(\\w+)(?:\\s+extends\\s+(\\w+))?\\s*\\{', 1), ',') AS classes FROM "
       "(SELECT page_id, replace(replace(replace(html, '<p>', 'import {a} from ''x'' function f(a)'), '<div', 'class B extends C {'), "
       "'<nav>', 'import n from ''nav''') AS html FROM pages)")
def js_symbols(spark, sf_dir):
    """Symbols of pages whose tags were turned into declarations."""
    code = F.replace("code", F.lit("<p>"), F.lit("import {a} from 'x' function f(a)"))
    code = F.replace(F.replace(code, F.lit("<div"), F.lit("class B extends C {")), F.lit("<nav>"), F.lit("import n from 'nav'"))
    found = L.js_symbols(page_files(spark, sf_dir).withColumn("code", code))
    return found.select("file_id", *[F.array_join(c, ",").alias(c) for c in ("imports", "functions", "classes")])


# --- issues, scores, reports ----------------------------------------------------------------------------------------

@query("all_issues", f'WITH {DOC_ISSUES} SELECT file_id, rule_id, severity, category, message, line, suggestion, seq FROM issues')
def all_issues(spark, sf_dir):
    return I.all_issues(doc_issues(spark, sf_dir)).drop("column")


@query("issues_by_severity", f"WITH {DOC_ISSUES} SELECT file_id, rule_id, severity, line FROM issues WHERE severity IN ('critical', 'high')")
def issues_by_severity(spark, sf_dir):
    return I.by_severity(doc_issues(spark, sf_dir), "critical", "high").select("file_id", "rule_id", "severity", "line")


@query("distinct_rules", f"WITH {DOC_ISSUES} SELECT DISTINCT category, severity FROM issues")
def distinct_rules(spark, sf_dir):
    return I.distinct_rules(doc_issues(spark, sf_dir))


@query("first_issues", f"WITH {DOC_ISSUES} SELECT file_id, rule_id, line, rn FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn FROM issues) WHERE rn <= 10")
def first_issues(spark, sf_dir):
    return I.first_issues(doc_issues(spark, sf_dir)).select("file_id", "rule_id", "line", "rn")


@query("top_issues_per_file", f"WITH {DOC_ISSUES} SELECT file_id, severity, rule_id, line, rn FROM (SELECT *, row_number() OVER (PARTITION BY file_id, severity ORDER BY seq) AS rn "
       "FROM issues WHERE severity IN ('critical', 'high')) WHERE rn <= 5")
def top_issues_per_file(spark, sf_dir):
    return I.top_issues_per_file(doc_issues(spark, sf_dir)).select("file_id", "severity", "rule_id", "line", "rn")


def _totals(spark, sf_dir):
    return scoring.file_totals(doc_files(spark, sf_dir), doc_issues(spark, sf_dir))


def _results(spark, sf_dir):
    return scoring.trust_scores(_totals(spark, sf_dir))


@query("category_score", f"WITH {DOC_TOTALS} SELECT file_id, category_key, score, weight, issue_count FROM scores")
def category_score(spark, sf_dir):
    return scoring.category_scores(_totals(spark, sf_dir)).drop("critical_count")


@query("category_table", f"WITH {DOC_TOTALS} SELECT file_id, CASE category_key WHEN 'security' THEN 'Security' WHEN 'hallucinations' THEN 'Hallucinations' "
       "WHEN 'logic' THEN 'Logic' ELSE 'Best Practices' END AS category, score, issue_count, critical_count FROM scores")
def category_table(spark, sf_dir):
    rows = scoring.category_scores(_totals(spark, sf_dir))
    return rows.select("file_id", S.title_case(F.col("category_key")).alias("category"), "score", "issue_count", "critical_count")


@query("category_pivot", f"WITH {DOC_TOTALS} SELECT file_id, " + ", ".join(
       f"coalesce(max(score) FILTER (category_key = '{k}'), 0) AS {k}_score" for k in scoring.KEYS) + " FROM scores GROUP BY 1")
def category_pivot(spark, sf_dir):
    return scoring.category_pivot(scoring.category_scores(_totals(spark, sf_dir)))


@query("trust_score", f"WITH {DOC_TOTALS} SELECT file_id, path, trust_score, passed, issue_count FROM results")
def trust_score(spark, sf_dir):
    return validate_texts(doc_files(spark, sf_dir)).select("file_id", "path", "trust_score", "passed", "issue_count")


@query("severity_counts", f"WITH {DOC_ISSUES} SELECT doc_id AS file_id, " + ", ".join(
       f"count(i.file_id) FILTER (severity = '{s}') AS {s}_count" for s in scoring.SEVERITIES)
       + " FROM documents d LEFT JOIN issues i ON i.file_id = d.doc_id GROUP BY 1")
def severity_counts(spark, sf_dir):
    return _totals(spark, sf_dir).select("file_id", *[f"{s}_count" for s in scoring.SEVERITIES])


@query("passed_flag", f"WITH {DOC_TOTALS} SELECT file_id, passed FROM results")
def passed_flag(spark, sf_dir):
    return _results(spark, sf_dir).select("file_id", "passed")


@query("quality_gate", f"WITH {DOC_TOTALS} SELECT bool_and(trust_score >= 70 AND critical_count = 0) AS gate_passed FROM results")
def quality_gate(spark, sf_dir):
    return scoring.run_gate(_results(spark, sf_dir))


@query("trust_band", f"WITH {DOC_TOTALS} SELECT file_id, CASE WHEN trust_score >= 80 THEN 'good' WHEN trust_score >= 60 THEN 'warn' ELSE 'bad' END AS band FROM results")
def trust_band(spark, sf_dir):
    return _results(spark, sf_dir).select("file_id", S.trust_band(F.col("trust_score")).alias("band"))


@query("report_summary", f"WITH {DOC_TOTALS} SELECT count(*) AS total_files, round(sum(trust_score) / count(*), 1) AS average_score, "
       "count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, sum(issue_count) AS total_issues, "
       "sum(critical_count) AS critical_issues, round(count(*) FILTER (passed) / count(*) * 100, 1) AS pass_rate FROM results")
def report_summary(spark, sf_dir):
    return scoring.run_summary(_results(spark, sf_dir))


@query("worst_files", f"WITH {DOC_TOTALS} SELECT file_id, path, trust_score FROM results ORDER BY trust_score, path, file_id LIMIT 20")
def worst_files(spark, sf_dir):
    return I.worst_files(_results(spark, sf_dir)).select("file_id", "path", "trust_score")


@query("effective_weights", """WITH o AS (
    SELECT s_suppkey AS config_id, CASE s_nationkey % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'hallucinations' WHEN 2 THEN 'logic' ELSE 'best_practices' END AS category_key,
           s_acctbal > 2000 AS enabled, CASE WHEN s_acctbal > 5000 THEN round(s_acctbal / 1000) END AS weight FROM supplier),
  d(category_key, weight) AS (VALUES ('security', 2.0), ('hallucinations', 2.5), ('logic', 1.0), ('best_practices', 0.5))
  SELECT s.s_suppkey AS config_id, d.category_key, CAST(CASE WHEN o.config_id IS NOT NULL THEN coalesce(o.weight, 1.0) ELSE d.weight END AS DOUBLE) AS weight
  FROM supplier s CROSS JOIN d LEFT JOIN o ON o.config_id = s.s_suppkey AND o.category_key = d.category_key WHERE coalesce(o.enabled, true)""")
def effective_weights(spark, sf_dir):
    """One configuration per supplier, each overriding one category."""
    s = table(spark, sf_dir, "supplier")
    at = F.col("s_nationkey") % 4
    key = F.when(at == 0, "security").when(at == 1, "hallucinations").when(at == 2, "logic").otherwise("best_practices")
    overrides = s.select(
        F.col("s_suppkey").alias("config_id"), key.alias("category_key"), (F.col("s_acctbal") > 2000).alias("enabled"),
        F.when(F.col("s_acctbal") > 5000, F.round(F.col("s_acctbal") / 1000)).alias("weight"))
    return scoring.effective_weights(s.select(F.col("s_suppkey").alias("config_id")), overrides)


@query("report_json", f"WITH {DOC_TOTALS}, " + """nested AS (
    SELECT file_id, list(json_object('severity', severity, 'category', category, 'message', message, 'line', line, 'column', NULL, 'suggestion', suggestion) ORDER BY seq) AS items,
           count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM issues GROUP BY 1),
    cats AS (SELECT file_id, '{' || string_agg('"' || category_key || '":' || CAST(json_object('score', score, 'weight', weight, 'issue_count', issue_count) AS VARCHAR), ','
             ORDER BY CASE category_key WHEN 'security' THEN 1 WHEN 'hallucinations' THEN 2 WHEN 'logic' THEN 3 ELSE 4 END) || '}' AS body FROM scores GROUP BY 1)
  SELECT r.file_id, '{"file_path":"' || r.path || '","trust_score":' || r.trust_score || ',"passed":' || r.passed || ',"critical_count":' || coalesce(n.c, 0)
    || ',"high_count":' || coalesce(n.h, 0) || ',"categories":' || cats.body || ',"issues":' || coalesce(CAST(to_json(n.items) AS VARCHAR), '[]') || '}' AS json
  FROM results r JOIN cats USING (file_id) LEFT JOIN nested n USING (file_id)""")
def report_json(spark, sf_dir):
    return reports.json_report(doc_files(spark, sf_dir), doc_issues(spark, sf_dir))


@query("report_sarif_results", f"WITH {DOC_ISSUES}, {DOC_FILES} " + """SELECT file_id, seq, CAST(json_object(
    'ruleId', category || '_' || severity, 'level', CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END,
    'message', json_object('text', message),
    'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', path), 'region', json_object('startLine', line)))),
    'properties', json_object('suggestion', suggestion, 'category', category, 'severity', severity)) AS VARCHAR) AS result
    FROM issues JOIN doc_files USING (file_id)""")
def report_sarif_results(spark, sf_dir):
    return reports.sarif_results(doc_issues(spark, sf_dir), doc_files(spark, sf_dir))


@query("report_sarif_rules", f"WITH {DOC_ISSUES}, p AS (SELECT DISTINCT category, severity FROM issues) " + """
    SELECT category || '_' || severity AS id,
      CASE category WHEN 'security' THEN 'Security' WHEN 'hallucination' THEN 'Hallucination' WHEN 'logic' THEN 'Logic' ELSE 'Best_Practices' END || ' Issue' AS name,
      upper(severity[1]) || severity[2:] || ' ' || category || ' issue detected' AS short_text,
      'Detected a ' || severity || ' severity issue in the ' || category || ' category during AI code validation.' AS full_text,
      CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM p""")
def report_sarif_rules(spark, sf_dir):
    return reports.sarif_rules(doc_issues(spark, sf_dir))


@query("diagnostics", f"WITH {DOC_ISSUES} " + """SELECT file_id, seq, line - 1 AS start_line, 0 AS start_char, line - 1 AS end_line, 1000 AS end_char,
    CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS severity, message, 'codegauge' AS source,
    category AS code, suggestion AS related FROM issues""")
def diagnostics(spark, sf_dir):
    return reports.diagnostics(doc_issues(spark, sf_dir))


@query("accuracy_metrics", f"WITH {DOC_ISSUES}, " + """
    found AS (SELECT DISTINCT file_id FROM issues),
    cases AS (SELECT l.quality = 0 AS e, f.file_id IS NOT NULL AS f FROM labels l LEFT JOIN found f ON f.file_id = l.doc_id),
    c AS (SELECT count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND NOT f) AS tn, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (e AND NOT f) AS fn FROM cases),
    m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
    SELECT tp, tn, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM m""")
def accuracy_metrics(spark, sf_dir):
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), (F.col("quality") == 0).alias("expected"))
    return accuracy.accuracy_metrics(truth, doc_issues(spark, sf_dir))
