"""Queries over the template corpus: node table, syntax rules, fixes, custom analyzers, full validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.analyzers import Registry, line_analyzer, tree_analyzer
from codegauge.catalog.common import corpus_files, corpus_nodes, doc_files, doc_issues, DOC_ISSUES, DOC_LINES, expected, query, shown, table
from codegauge.constants import POPULAR_PACKAGES, STANDARD_LIBRARY
from codegauge.corpus import TEMPLATES, expected_sql, sql_text, template_files_sql
from codegauge.functions import scalars as S
from codegauge.functions.syntax import ERROR_KIND, ast_nodes as ast_nodes_of
from codegauge.operators import fixes as X, issues as I, lines as L, nodes as N
from codegauge.plans.validate import javascript_issues, validate
from codegauge.sinks import reports


# --- node table ---------------------------------------------------------------------------------------------------

@query("ast_nodes", f"WITH {expected_sql('syntax_error')}, codes(template, code) AS (VALUES "
       + ", ".join(f"({i}, {sql_text(t.code)})" for i, t in enumerate(TEMPLATES) if t.language == "python") + ") "
       "SELECT f.file_id, e.file_id IS NULL AS parsed, "
       "CASE WHEN e.file_id IS NULL THEN len(regexp_extract_all(code, '(?m)^ *(async )?def ')) ELSE 0 END AS functions, "
       "CASE WHEN e.file_id IS NULL THEN len(regexp_extract_all(code, '(?m)^ *class ')) ELSE 0 END AS classes, "
       "CASE WHEN e.file_id IS NULL THEN len(regexp_extract_all(code, '(?m)^ *(?:if|elif) ')) ELSE 0 END AS ifs, "
       "CASE WHEN e.file_id IS NULL THEN len(regexp_extract_all(code, '(?m)^ *while ')) ELSE 0 END AS whiles "
       "FROM code_files f JOIN codes USING (template) LEFT JOIN expected e USING (file_id)")
def ast_nodes(spark, sf_dir):
    """Counts of statement kinds per file, which the text alone also shows."""
    kind = F.col("kind")
    return corpus_nodes(spark, sf_dir).groupBy("file_id").agg(
        (F.count_if(kind == ERROR_KIND) == 0).alias("parsed"),
        F.count_if(kind.isin("FunctionDef", "AsyncFunctionDef")).alias("functions"),
        F.count_if(kind == "ClassDef").alias("classes"), F.count_if(kind == "If").alias("ifs"),
        F.count_if(kind == "While").alias("whiles"))


# --- syntax rules, one query each -----------------------------------------------------------------------------------

def _local(rule_id):
    @query(rule_id, expected(rule_id))
    def run(spark, sf_dir):
        return shown(N.local_issues(corpus_nodes(spark, sf_dir, N.local_kinds([rule_id])), [rule_id]))


for _rule in ("ast_dangerous_call", "ast_sql_injection", "ast_shell_true", "ast_os_system", "ast_const_if", "ast_const_while",
              "ast_empty_block", "ast_empty_function", "ast_ellipsis_function", "ast_missing_docstring", "ast_function_naming",
              "ast_class_naming", "ast_variable_naming", "ast_function_length", "ast_deep_nesting", "ast_bare_except",
              "ast_mutable_default"):
    _local(_rule)


_PARSER_SAYS = f"said(template, text) AS (VALUES (33, 'invalid syntax'), (34, {sql_text("'(' was never closed")}))"


@query("syntax_errors", f"WITH {expected_sql('syntax_error')}, {_PARSER_SAYS} "
       "SELECT e.file_id, e.rule_id, e.severity, e.line, 'Syntax error: ' || text AS message FROM expected e JOIN code_files USING (file_id) JOIN said USING (template)")
def syntax_errors(spark, sf_dir):
    return shown(N.syntax_error_issues(corpus_nodes(spark, sf_dir, [ERROR_KIND])))


def _bindings_sql():
    listed = {
        "ast_imports": [
            (10, "ai_helper_kit", "ai_helper_kit"), (10, "fp", "fast_parser_v3"), (10, "x", "lib77.x"), (10, "my_utils_pack.sub", "my_utils_pack.sub"),
            (10, "json", "json"), (10, "numpy", "numpy"), (10, "Path", "pathlib.Path"), (10, "django_extra", "django_extra"), (10, "leftpadlib", "leftpadlib"),
            (11, "tool", "json"), (11, "sys_like", "quick_one"), (3, "subprocess", "subprocess"), (4, "os", "os"), (13, "easy_get", "kit.easy_get"),
            (13, "base64", "base64"), (25, "os", "os"), (37, "path", "os.path"), (37, "p", "os.path"), (37, "sys", "sys")],
    }["ast_imports"]
    rows = ", ".join(f"({t}, {sql_text(a)}, {sql_text(n)})" for t, a, n in listed)
    return f"WITH {template_files_sql()}, b(template, alias, full_name) AS (VALUES {rows}) SELECT file_id, alias, full_name FROM code_files JOIN b USING (template)"


@query("ast_imports", _bindings_sql())
def ast_imports(spark, sf_dir):
    return N.import_bindings(corpus_nodes(spark, sf_dir, N.IMPORT_KINDS)).select("file_id", "alias", "full_name")


def _import_rule(rule_id):
    @query(rule_id, expected(rule_id))
    def run(spark, sf_dir):
        found = N.import_issues(N.import_bindings(corpus_nodes(spark, sf_dir, N.IMPORT_KINDS)), N.known_modules(spark))
        return shown(found.where(F.col("rule_id") == rule_id))


_import_rule("ast_fake_import")
_import_rule("ast_unknown_import")


# The plain tables of names, and the one package that the corpus imports by a likely-real name.
@query("known_modules", "SELECT unnest(string_split('" + " ".join([*STANDARD_LIBRARY, *POPULAR_PACKAGES, "django_extra"]) + "', ' ')) AS module")
def known_modules(spark, sf_dir):
    """The known-module table plus the packages the corpus itself imports by a likely-real name."""
    used = N.import_bindings(corpus_nodes(spark, sf_dir, N.IMPORT_KINDS)).where(F.col("full_name").startswith("django"))
    return N.known_modules(spark, used.select(S.import_base(F.col("full_name")).alias("module")))


@query("ast_undefined_call", expected("ast_undefined_call"))
def ast_undefined_call(spark, sf_dir):
    return shown(N.undefined_call_issues(N.symbols(corpus_nodes(spark, sf_dir, N.NAME_KINDS))))


@query("ast_unused_var", expected("ast_unused_var"))
def ast_unused_var(spark, sf_dir):
    return shown(N.unused_variable_issues(N.symbols(corpus_nodes(spark, sf_dir, N.NAME_KINDS))))


@query("ast_unreachable", expected("ast_unreachable"))
def ast_unreachable(spark, sf_dir):
    return shown(N.unreachable_issues(corpus_nodes(spark, sf_dir)))


@query("ast_infinite_loop", expected("ast_infinite_loop"))
def ast_infinite_loop(spark, sf_dir):
    return shown(N.infinite_loop_issues(corpus_nodes(spark, sf_dir, N.LOOP_KINDS)))


@query("ast_redundant_compare", expected("ast_redundant_compare"))
def ast_redundant_compare(spark, sf_dir):
    return shown(N.redundant_compare_issues(corpus_nodes(spark, sf_dir, N.COMPARE_KINDS)))


def _listed(columns, rows):
    values = ", ".join("(" + ", ".join([str(r[0])] + [v if isinstance(v, str) and v.startswith("=") else
                                                     ("NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else sql_text(v))
                                                     for v in r[1:]]) + ")" for r in rows)
    return f"WITH {template_files_sql()}, b(template, {columns}) AS (VALUES {values}) SELECT file_id, {columns} FROM code_files JOIN b USING (template)"


# Loops of the corpus: template, line, is there an exit below, is the test the constant True.
@query("descendant_join", _listed("line, has_exit, endless", [
    (16, 7, True, False), (18, 2, False, True), (18, 4, True, True), (18, 7, False, False), (18, 9, True, True),
    (19, 6, True, True), (19, 10, False, True), (19, 11, False, True), (21, 10, False, False), (21, 12, False, False),
    (22, 6, False, False), (28, 4, False, False)]))
def descendant_join(spark, sf_dir):
    return N.descendant_exits(corpus_nodes(spark, sf_dir, N.LOOP_KINDS)).select("file_id", "line", "has_exit", "endless")


# Statements of checked blocks: template, line, place in the block, place and kind of the block's first jump.  One function of
# template 27 has 53 statements and no jump.
_IN_BLOCKS = [
    (13, 8, 0, 1, "Return"), (13, 9, 1, 1, "Return"), (15, 5, 0, 1, "Return"), (15, 6, 1, 1, "Return"), (15, 7, 2, 1, "Return"), (15, 8, 3, 1, "Return"),
    (15, 12, 0, None, None), (15, 13, 1, None, None), (15, 14, 0, 0, "Raise"), (15, 15, 1, 0, "Raise"), (15, 17, 0, 0, "Return"), (15, 18, 1, 0, "Return"),
    (16, 3, 0, 0, "Continue"), (16, 4, 1, 0, "Continue"), (16, 8, 0, 0, "Break"), (16, 9, 1, 0, "Break"), (16, 11, 0, 0, "Raise"), (16, 12, 1, 0, "Raise"),
    (16, 14, 0, 0, "Raise"), (16, 15, 1, 0, "Raise"), (17, 5, 0, 2, "Return"), (17, 6, 1, 2, "Return"), (17, 8, 2, 2, "Return"),
    (19, 5, 0, None, None), (19, 6, 1, None, None), (19, 10, 2, None, None), (19, 8, 0, 1, "Return"), (19, 9, 1, 1, "Return"),
    (22, 11, 0, None, None), (22, 12, 1, None, None), (25, 16, 0, 1, "Return"), (25, 17, 1, 1, "Return"), (28, 6, 0, None, None), (28, 8, 1, None, None),
    (31, 5, 0, 1, "Return"), (31, 6, 1, 1, "Return"), (31, 10, 0, 1, "Return"), (31, 11, 1, 1, "Return"), (36, 7, 0, 1, "Return"), (36, 8, 1, 1, "Return"),
    (37, 10, 0, 1, "Return"), (37, 11, 1, 1, "Return"), (37, 18, 0, 1, "Return"), (37, 19, 1, 1, "Return")] + [(27, 5 + k, k, None, None) for k in range(53)]


@query("first_terminator", _listed("line, idx, stop_idx, stop_kind", _IN_BLOCKS))
def first_terminator(spark, sf_dir):
    """Every statement of a block with more than one, with the block's first jump if it has any."""
    return N.first_terminator(corpus_nodes(spark, sf_dir)).select(
        "file_id", "line", "idx", F.col("stop.idx").alias("stop_idx"), F.col("stop.kind").alias("stop_kind"))


# Names bound more than once or never used: template, name, line of the last assignment, used.
@query("last_binding", _listed("name, assign_line, loaded", [
    (5, "DB_PASSWORD", 2, True), (5, "api_key", 3, True), (5, "AWS_SECRET", 4, True), (5, "password", 6, True),
    (12, "out", 2, True), (13, "auto_run", 4, True), (14, "x", 2, True),
    (20, "total", 6, False), (20, "_", 3, False), (20, "used", 4, True), (20, "a", 7, True), (20, "b", 7, False),
    (25, "kind", 13, False), (26, "myVar", 20, True), (26, "MAX_SIZE", 21, True), (26, "_hidden", 22, True), (38, "unused_total", 2, False)]))
def last_binding(spark, sf_dir):
    table_ = N.symbols(corpus_nodes(spark, sf_dir, N.NAME_KINDS)).where(F.col("assign_line").isNotNull())
    return table_.select("file_id", "name", "assign_line", "loaded")


# Names called bare that nothing in the file binds, for the files that define or import some of theirs.
@query("name_difference", _listed("name", [
    (1, "raw"), (1, "run_query"), (1, "execute"), (4, "system"), (4, "f"), (5, "get"), (6, "Path"),
    (9, "call"), (12, "quick_merge"), (12, "process2"), (13, "simple_map"),
    (16, "return_code"), (18, "poll"), (18, "ready"), (19, "poll"), (20, "compute"), (20, "again"), (21, "go"), (22, "go"),
    (27, "step_a")] + [(27, f"step_{c}") for c in "bcdefghijklmnopqrstuvwxyz"] + [
    (28, "go"), (29, "go"), (30, "go"), (30, "stop"), (31, "sort")]))
def name_difference(spark, sf_dir):
    return N.called_but_unbound(corpus_nodes(spark, sf_dir, N.NAME_KINDS))


# Templates that name something; the others that parse have four empty lists.
_SYMBOLS = {
    3: ("subprocess", "", "", ""), 4: ("os", "", "", ""),
    10: ("ai_helper_kit,fast_parser_v3,lib77.x,my_utils_pack.sub,json,numpy,pathlib.Path,django_extra,leftpadlib", "", "", ""),
    11: ("smart_one,json,os,quick_one", "", "", ""), 13: ("kit.easy_get,base64", "fast_hash", "", "fast_hash"), 15: ("", "done,fail", "", "done,fail"),
    17: ("", "pick", "", "pick"), 19: ("", "outer,inner", "", "outer,inner"), 25: ("os", "public,Thing,method", "Thing", "public,method"),
    26: ("", "getUserName,HTTPServer2,my_class,Good1", "my_class,Good1", "getUserName,HTTPServer2"), 27: ("", "busy", "", "busy"),
    31: ("", "add,keep", "", "add,keep"), 36: ("", "Ünit,größe", "Ünit", "größe"), 37: ("os.path,os.path,sys", "Store,total,load", "Store", "total,load")}
_PARSED = [i for i, t in enumerate(TEMPLATES) if t.language == "python" and not any(issue[0] == "syntax_error" for issue in t.issues)]


@query("module_symbols", _listed("imports, exports, classes, functions", [(i, *_SYMBOLS.get(i, ("", "", "", ""))) for i in _PARSED]))
def module_symbols(spark, sf_dir):
    rows = N.module_symbols(corpus_nodes(spark, sf_dir, N.MODULE_KINDS))
    return rows.select("file_id", *[F.array_join(c, ",").alias(c) for c in ("imports", "exports", "classes", "functions")])


@query("function_signatures", _listed("name, line, params, returns", [
    (13, "fast_hash", 7, "x", ""), (15, "done", 4, "x", ""), (15, "fail", 11, "x", ""), (17, "pick", 4, "x", ""), (19, "outer", 4, "", ""), (19, "inner", 7, "", ""),
    (25, "public", 4, "", ""), (25, "method", 15, "", ""), (26, "getUserName", 4, "", ""), (26, "HTTPServer2", 8, "", ""),
    (27, "busy", 4, "job", ""), (31, "add", 4, "item,into,seen", ""), (31, "keep", 9, "item,into,names", ""),
    (36, "größe", 6, "wert", "list[int]"), (37, "load", 9, "file_name,items,count", ""), (37, "total", 17, "values,is_net", "")]))
def function_signatures(spark, sf_dir):
    rows = N.function_signatures(corpus_nodes(spark, sf_dir, N.SIGNATURE_KINDS))
    return rows.select("file_id", "name", "line", F.array_join("params", ",").alias("params"), F.coalesce("returns", F.lit("")).alias("returns"))


# --- whole runs -------------------------------------------------------------------------------------------------------

@query("dispatch_by_language", expected(
    "js_security", "js_vulnerable_deps", "js_fake_packages", "js_fake_methods", "js_placeholder_endpoints", "js_logic",
    "js_best_practices"))
def dispatch_by_language(spark, sf_dir):
    """Only JavaScript and TypeScript files reach the script rules."""
    files = corpus_files(spark, sf_dir)
    return shown(javascript_issues(files.where(F.col("language").isin("javascript", "typescript"))))


_RESULTS = f"WITH {expected_sql()}, " + """
    keyed AS (SELECT file_id, rule_id, CASE WHEN rule_id LIKE 'line_p%' OR rule_id LIKE 'line_s%' OR rule_id LIKE 'line_d%' OR rule_id LIKE 'line_i%' THEN
                CASE WHEN rule_id LIKE 'line_placeholders%' THEN 'hallucinations' ELSE 'security' END
              WHEN rule_id LIKE 'js_security%' OR rule_id LIKE 'js_vulnerable%' OR rule_id IN ('ast_dangerous_call', 'ast_sql_injection', 'ast_shell_true', 'ast_os_system') THEN 'security'
              WHEN rule_id LIKE 'js_fake%' OR rule_id LIKE 'js_placeholder%' OR rule_id IN ('ast_fake_import', 'ast_unknown_import', 'ast_undefined_call') THEN 'hallucinations'
              WHEN rule_id LIKE 'js_logic%' OR rule_id IN ('ast_unreachable', 'ast_infinite_loop', 'ast_unused_var', 'ast_const_if', 'ast_const_while', 'ast_empty_block', 'ast_empty_function',
                   'ast_ellipsis_function', 'ast_redundant_compare', 'syntax_error') THEN 'logic' ELSE 'best_practices' END AS category_key,
              CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END AS penalty, severity FROM expected),
    w(category_key, weight) AS (VALUES ('security', 2.0::DOUBLE), ('hallucinations', 2.5::DOUBLE), ('logic', 1.0::DOUBLE), ('best_practices', 0.5::DOUBLE)),
    s AS (SELECT f.file_id, w.category_key, w.weight, greatest(0, 100 - coalesce(sum(k.penalty), 0)) AS score FROM code_files f CROSS JOIN w
          LEFT JOIN keyed k ON k.file_id = f.file_id AND k.category_key = w.category_key GROUP BY 1, 2, 3),
    n AS (SELECT f.file_id, f.path, count(k.file_id) AS issue_count, count(k.file_id) FILTER (severity = 'critical') AS critical_count,
                 count(k.file_id) FILTER (rule_id = 'syntax_error') AS broken FROM code_files f LEFT JOIN keyed k USING (file_id) GROUP BY 1, 2),
    t AS (SELECT file_id, floor(sum(score * weight) / sum(weight)) AS score FROM s GROUP BY 1),
    r AS (SELECT n.file_id, n.path, CAST(CASE WHEN broken > 0 THEN 0 ELSE t.score END AS INTEGER) AS trust_score, issue_count, critical_count FROM n JOIN t USING (file_id))"""


@query("validate_corpus", _RESULTS + " SELECT file_id, path, trust_score, trust_score >= 60 AND critical_count = 0 AS passed, issue_count FROM r")
def validate_corpus(spark, sf_dir):
    """The full run over Python, JavaScript and TypeScript files."""
    return validate(corpus_files(spark, sf_dir)).results.select("file_id", "path", "trust_score", "passed", "issue_count")


@query("issue_line_join", f"WITH {DOC_ISSUES} SELECT i.file_id, i.rule_id, i.line, coalesce(l.line, '') AS original FROM issues i LEFT JOIN doc_lines l ON l.file_id = i.file_id AND l.line_no = i.line")
def issue_line_join(spark, sf_dir):
    joined = X.issue_lines(doc_issues(spark, sf_dir), L.code_lines(doc_files(spark, sf_dir)))
    return joined.select("file_id", "rule_id", "line", "original")


# --- fixes --------------------------------------------------------------------------------------------------------------

# The rules whose issues a fix can answer, with the kinds of nodes they read; the others are local rules.
_SOURCE_OF_FIX = {
    "fix_unreachable": (N.unreachable_issues, N.BLOCK_KINDS),
    "fix_infinite_loop": (N.infinite_loop_issues, N.LOOP_KINDS),
    "fix_unused": (lambda nodes: N.unused_variable_issues(N.symbols(nodes)), N.NAME_KINDS),
}


def corpus_fixes(spark, sf_dir, fix_id=None):
    """All fixes of the corpus, or one kind from just the rules it answers."""
    files = corpus_files(spark, sf_dir, "python")
    if fix_id is None:
        return X.suggest_fixes(validate(files).issues, L.code_lines(files))
    issues_of, kinds = _SOURCE_OF_FIX[fix_id] if fix_id in _SOURCE_OF_FIX else (N.local_issues, N.local_kinds())
    found = issues_of(ast_nodes_of(files, kinds))
    return X.suggest_fixes(found, L.code_lines(files)).where(F.col("fix_id") == fix_id)


# Every fix of the corpus by hand: template, line, new text.
FIXES = {
    "fix_sql_fstring": [(0, 2, 'cur.execute("SELECT * FROM t WHERE id = ? LIMIT 1", (key,))')],
    "fix_hardcoded": [
        (5, 2, 'DB_PASSWORD = os.environ.get("DB_PASSWORD")'), (5, 3, 'api_key = os.environ.get("API_KEY")'),
        (5, 4, 'AWS_SECRET = os.environ.get("AWS_SECRET")'), (5, 4, 'AWS_SECRET = os.environ.get("AWS_SECRET")')],
    "fix_eval": [(2, 2, "ast.literal_eval(text)")],
    "fix_shell": [(3, 3, "subprocess.run(cmd, shell=False)"), (3, 4, "subprocess.call(cmd, shell=1)")],
    "fix_import": [],
    "fix_unreachable": [
        (15, 7, "# DELETE: Unreachable code\n#     print(x)"), (15, 8, "# DELETE: Unreachable code\n#     print(1)"),
        (15, 15, "# DELETE: Unreachable code\n#         print(x)"), (15, 18, "# DELETE: Unreachable code\n#         print(3)"),
        (16, 4, "# DELETE: Unreachable code\n#     print(x)"), (16, 9, "# DELETE: Unreachable code\n#     return_code()"),
        (16, 12, "# DELETE: Unreachable code\n#     print(2)"), (16, 15, "# DELETE: Unreachable code\n#     print(3)")],
    "fix_infinite_loop": [(t, n, "# WARNING: Add break condition or timeout\nwhile True:\n    # Add: if condition: break\n    pass")
                          for t, n in ((18, 2), (19, 10), (19, 11))],
    "fix_unused": [(38, 2, "_ = unused_total  # Intentionally unused")],
    "fix_bare_except": [(30, 4, "except Exception:")],
    "fix_mutable_default": [(31, 4, "def add(item, into= None, seen={}, *, extra= None):\n    # Add at start of function: items = items or []")] * 2,
    "fix_docstring": [(25, 4, 'def public():\n    """TODO: Add description for public."""')],
}


def _fix_sql(fix_id, columns="file_id, line, suggested"):
    rows = ", ".join(f"({t}, {line}, {sql_text(text)})" for t, line, text in FIXES[fix_id]) or "(-1, 0, '')"
    return (f"WITH {template_files_sql()}, b(template, line, suggested) AS (VALUES {rows}) "
            f"SELECT {columns} FROM code_files JOIN b USING (template)")


def _fix(fix_id):
    @query(fix_id, _fix_sql(fix_id))
    def run(spark, sf_dir):
        return corpus_fixes(spark, sf_dir, fix_id).select("file_id", "line", "suggested")


for _id in FIXES:
    if _id not in ("fix_hardcoded", "fix_import"):
        _fix(_id)


@query("fix_hardcoded", f"WITH {DOC_ISSUES} SELECT i.file_id, i.line, regexp_extract(l.line, '(\\w+)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) || ' = os.environ.get(\"' || "
       "upper(regexp_extract(l.line, '(\\w+)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) || '\")' AS suggested FROM issues i JOIN doc_lines l ON l.file_id = i.file_id AND l.line_no = i.line "
       "WHERE i.category = 'security' AND regexp_matches(l.line, '(\\w+)\\s*=\\s*[\"'']([^\"'']+)[\"'']')")
def fix_hardcoded(spark, sf_dir):
    rows = X.suggest_fixes(doc_issues(spark, sf_dir), L.code_lines(doc_files(spark, sf_dir)))
    return rows.where(F.col("fix_id") == "fix_hardcoded").select("file_id", "line", "suggested")


@query("fix_import", "SELECT p_partkey AS file_id, 'import ' || CASE p_partkey % 3 WHEN 0 THEN 'sklearn' WHEN 1 THEN 'hashlib' END AS suggested FROM part WHERE p_partkey % 3 < 2")
def fix_import(spark, sf_dir):
    """Imports reported as missing by a custom rule: the rewrite needs the words "does not exist"."""
    at = F.col("p_partkey") % 3
    name = F.when(at == 0, "ML_helpers").when(at == 1, "my_fast_hash_kit").otherwise("plain")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), name.alias("name"))
    lines = rows.select("file_id", F.lit(1).alias("line_no"), F.concat(F.lit("import "), "name").alias("line"))
    found = rows.select(
        "file_id", F.lit("hallucination").alias("category"), F.concat(F.lit("Import '"), "name", F.lit("' does not exist")).alias("message"),
        F.lit(1).alias("line"), F.lit(0).cast("long").alias("seq"))
    return X.suggest_fixes(found, lines).select("file_id", "suggested")


@query("apply_fix", f"WITH {DOC_ISSUES}, hit AS (SELECT DISTINCT i.file_id, i.line FROM issues i WHERE i.category = 'security'), "
       "new AS (SELECT l.file_id, l.line_no, CASE WHEN h.file_id IS NOT NULL AND regexp_matches(l.line, '(\\w+)\\s*=\\s*[\"'']([^\"'']+)[\"'']') "
       "THEN regexp_extract(l.line, '(\\w+)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) || ' = os.environ.get(\"' || upper(regexp_extract(l.line, '(\\w+)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) || '\")' "
       "ELSE l.line END AS line FROM doc_lines l LEFT JOIN hit h ON h.file_id = l.file_id AND h.line = l.line_no) "
       "SELECT file_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS code_md5 FROM new GROUP BY 1")
def apply_fix(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    fixes = X.suggest_fixes(doc_issues(spark, sf_dir), L.code_lines(files))
    return X.apply_fixes(files, fixes).select("file_id", F.md5("code").alias("code_md5"))


def _all_fixes_sql():
    order = list(FIXES)
    rows = [(t, line, text, fix) for fix in order for t, line, text in FIXES[fix]]
    return ", ".join(f"({t}, {line}, {sql_text(text)})" for t, line, text, _ in rows)


@query("top_fixes", f"WITH {template_files_sql()}, b(template, line, suggested) AS (VALUES {_all_fixes_sql()}) SELECT file_id, line, suggested FROM code_files JOIN b USING (template)")
def top_fixes(spark, sf_dir):
    """No corpus file has more than five fixes, so all of them are listed; the cut itself is tested apart."""
    return I.top_fixes(corpus_fixes(spark, sf_dir)).select("file_id", "line", "suggested")


# The rule whose issues each fix answers.
_RULE_OF_FIX = {
    "fix_sql_fstring": "ast_sql_injection", "fix_hardcoded": "line_secrets", "fix_eval": "ast_dangerous_call", "fix_shell": "ast_shell_true",
    "fix_unreachable": "ast_unreachable", "fix_infinite_loop": "ast_infinite_loop", "fix_unused": "ast_unused_var",
    "fix_bare_except": "ast_bare_except", "fix_mutable_default": "ast_mutable_default", "fix_docstring": "ast_missing_docstring"}
_EDITS = ", ".join(sorted({f"({t}, {line}, {sql_text(text)}, {sql_text(_RULE_OF_FIX[fix])})" for fix, rows in FIXES.items() for t, line, text in rows}))


@query("fix_edits", f"WITH {expected_sql()}, new(template, line, suggested, rule) AS (VALUES {_EDITS}) "
       "SELECT e.file_id, 'Fix: ' || substr(e.message, 1, 50) || '...' AS title, e.line - 1 AS start_line, e.line AS end_line, n.suggested || chr(10) AS new_text "
       "FROM expected e JOIN code_files f USING (file_id) JOIN new n ON n.template = f.template AND n.line = e.line AND starts_with(e.rule_id, n.rule)")
def fix_edits(spark, sf_dir):
    return reports.fix_edits(corpus_fixes(spark, sf_dir)).select("file_id", "title", "start_line", "end_line", "new_text")


_ALTERNATIVE = "CASE p_partkey % 9 WHEN 0 THEN 'quick_sort' WHEN 1 THEN 'fast_hash' WHEN 2 THEN 'smart_parser' WHEN 3 THEN 'EASY_HTTP' WHEN 4 THEN 'ai_utils' WHEN 5 THEN 'ml_helpers' WHEN 6 THEN 'data_processor_fast_hash' WHEN 7 THEN 'text_analyzer' ELSE 'plain' END"


@query("alternative_module", f"SELECT {_ALTERNATIVE} || '_' || p_partkey AS module, CASE p_partkey % 9 WHEN 0 THEN 'sorted' WHEN 1 THEN 'hashlib' WHEN 2 THEN 'json' WHEN 3 THEN 'requests' "
       "WHEN 4 THEN 'openai' WHEN 5 THEN 'sklearn' WHEN 6 THEN 'hashlib' WHEN 7 THEN 'nltk' END AS alternative FROM part WHERE p_partkey % 9 < 8")
def alternative_module(spark, sf_dir):
    parts = F.array(*[F.lit(x) for x in ("quick_sort", "fast_hash", "smart_parser", "EASY_HTTP", "ai_utils", "ml_helpers",
                                         "data_processor_fast_hash", "text_analyzer", "plain")])
    name = F.concat_ws("_", F.element_at(parts, (F.col("p_partkey") % 9 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return X.alternative_modules(table(spark, sf_dir, "part").select(name.alias("module")))


# --- custom analyzers -----------------------------------------------------------------------------------------------------

def many_classes(tree, code, context):
    """One issue per class of a file."""
    import ast

    return [{"severity": "low", "category": "custom", "message": f"class {n.name}", "line": n.lineno}
            for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]


def breaks_on_classes(tree, code, context):
    """Fails on every file with a class; reports the others once."""
    if "class " in code:
        raise RuntimeError("no classes please")
    return [{"severity": "info", "category": "custom", "message": "plain", "line": 1}]


def _ship_by_value():
    import codegauge.catalog.tree as module

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(module)


_ship_by_value()

_CLASSES = [(25, 12, "class Thing"), (26, 12, "class my_class"), (26, 16, "class Good1"), (36, 2, "class Ünit"), (37, 6, "class Store")]
_PARSED = [i for i, t in enumerate(TEMPLATES) if t.language == "python" and not any(r[0] == "syntax_error" for r in t.issues)]


@query("custom_analyzer", _listed("line, message", _CLASSES))
def custom_analyzer(spark, sf_dir):
    registry = Registry()
    registry.register(tree_analyzer("many_classes")(many_classes))
    return registry.run(corpus_files(spark, sf_dir, "python"))[0].select("file_id", "line", "message")


@query("analyzer_should_run", _listed("line, message", [row for row in _CLASSES if "self" in TEMPLATES[row[0]].code]))
def analyzer_should_run(spark, sf_dir):
    """Run only on files that mention self: the test is a column, applied before Python sees a row."""
    registry = Registry()
    registry.register(tree_analyzer("many_classes", when=F.col("code").contains("self"))(many_classes))
    return registry.run(corpus_files(spark, sf_dir, "python"))[0].select("file_id", "line", "message")


@query("analyzer_isolation", f"WITH {template_files_sql()}, ok(template) AS (VALUES {', '.join(f'({i})' for i in _PARSED)}), "
       f"cls(template) AS (VALUES {', '.join(f'({i})' for i in sorted({c[0] for c in _CLASSES}))}) "
       "SELECT file_id, 'issue' AS outcome, 'plain' AS detail FROM code_files JOIN ok USING (template) WHERE template NOT IN (SELECT template FROM cls) "
       "UNION ALL SELECT file_id, 'failure', 'RuntimeError: no classes please' FROM code_files JOIN cls USING (template)")
def analyzer_isolation(spark, sf_dir):
    registry = Registry()
    registry.register(tree_analyzer("touchy")(breaks_on_classes))
    found, failed = registry.run(corpus_files(spark, sf_dir, "python"))
    return found.select("file_id", F.lit("issue").alias("outcome"), F.col("message").alias("detail")).union(
        failed.select("file_id", F.lit("failure"), "error"))


def _two_line_analyzers():
    registry = Registry()
    registry.register(line_analyzer("long_word", "very long word", "low", priority=50)(lambda line: line.rlike("[a-z]{15,}")))
    registry.register(line_analyzer("shout", "shouting", "info", priority=10)(lambda line: line.rlike("[A-Z]{4,}")))
    return registry


_TWO_SQL = (f"WITH {DOC_LINES} SELECT file_id, 'shout' AS rule_id, line_no AS line, 0 AS rnk FROM doc_lines WHERE regexp_matches(line, '[A-Z]{{4,}}') "
            "UNION ALL SELECT file_id, 'long_word', line_no, 1 FROM doc_lines WHERE regexp_matches(line, '[a-z]{15,}')")


@query("analyzer_priority", _TWO_SQL)
def analyzer_priority(spark, sf_dir):
    """Two line analyzers; the one with the lower priority number is listed first."""
    found, _ = _two_line_analyzers().run(doc_files(spark, sf_dir))
    rank = (F.col("seq") / F.lit(L.CHECK_STEP)).cast("int") - 100
    return found.select("file_id", "rule_id", "line", rank.alias("rnk"))


@query("analyzer_decorator", f"WITH {DOC_LINES} SELECT file_id, line_no AS line, 'shout' AS message FROM doc_lines WHERE contains(line, '!!')")
def analyzer_decorator(spark, sf_dir):
    @line_analyzer("shout", "shout")
    def shout(line):
        return line.contains("!!")

    registry = Registry()
    registry.register(shout)
    return registry.run(doc_files(spark, sf_dir))[0].select("file_id", "line", "message")


@query("analyzer_registry", f"SELECT rule_id AS name, count(*) AS hits FROM ({_TWO_SQL}) WHERE rule_id = 'shout' GROUP BY 1")
def analyzer_registry(spark, sf_dir):
    """Registered, listed, one taken out again: only the other one reports."""
    registry = _two_line_analyzers()
    registry.unregister("long_word")
    found, _ = registry.run(doc_files(spark, sf_dir))
    return found.where(F.col("rule_id").isin(registry.names())).groupBy(F.col("rule_id").alias("name")).agg(F.count(F.lit(1)).alias("hits"))
