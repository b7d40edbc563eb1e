"""Line and syntax rules against plain Python on small fixtures."""

import ast
import os
import re
import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codegauge import corpus, rules as R
from codegauge.functions.syntax import COLUMN_NAMES, ERROR_KIND, MAX_BATCH_ROWS, _walk, ast_nodes, node_rows
from codegauge.operators import lines as L, nodes as N
from codegauge.plans.validate import validate

ALL_PACKS = [*R.PYTHON_PACKS, *R.JS_PACKS, *R.OPT_IN_PACKS]


def by_hand(line):
    """(rule, message-free) hits of one line, straight from the rule table with Python's engine."""
    for pack in ALL_PACKS:
        if pack.skip_comments and line.strip().startswith(pack.skip_comments):
            continue
        for rule in pack.rules:
            if rule.longer_than is not None:
                hit = len(line) > rule.longer_than
            elif rule.contains_any:
                hit = any(t in line for t in rule.contains_any)
            else:
                hit = re.search(rule.pattern, line) is not None
            if hit:
                yield rule.rule_id


def lines_frame(spark, lines):
    return spark.createDataFrame([(i, 1, line) for i, line in enumerate(lines)], "file_id long, line_no int, line string")


def check_lines(spark, lines):
    got = {}
    for row in L.scan_lines(lines_frame(spark, lines), ALL_PACKS).collect():
        got.setdefault(row.file_id, []).append(row.rule_id)
    for i, line in enumerate(lines):
        assert sorted(got.get(i, [])) == sorted(by_hand(line)), line


def test_corpus_lines(spark):
    check_lines(spark, sorted({line for t in corpus.TEMPLATES for line in t.code.split("\n")}))


def test_unicode_lines(spark):
    check_lines(spark, [
        "password\u00a0=\u2003'x'", "PASSWORD\x1c=\x1f\"ü\"", "ſecret = 'a'", "toKen='x'", "RAISE NOTIMPLEMENTEDERROR",
        "raıse NotImplementedError", "# …", "#\u00a0TODO: implement", "# \u2028abc", "évar x", "var é", "\u00a0// eval(x)",
        "\x85* eval(x)", "yaml.load(x, éLoader=None)", "yaml.load(x, Loader=Noneé)", "https://10.١", "x" * 101, "😀" * 100, "\r",
        "password = 'x'\r", "await ünder;", "eval\u2009("])


PIECES = ["password", "API_KEY", "=", " ", "'", '"', "x", "# ", "todo: implement", "(", "open", "f'", "..", "eval", "yaml.load",
          "Loader", "None", "while", "true", ")", "{", "}", "break", "await", ";", "==", "var ", "//", "*", "console.log", "é", "\t"]


def test_random_lines(spark):
    batches = []

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(PIECES), max_size=9))
    def collect(parts):
        batches.append("".join(parts))

    collect()
    check_lines(spark, sorted(set(batches)))


def test_line_numbers(spark):
    files = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, "x\r\ny")], "file_id long, code string")
    rows = sorted(map(tuple, L.code_lines(files).collect()))
    assert rows == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, ""), (3, 1, "x\r"), (3, 2, "y")]


# --- node table ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("path", [ast.__file__, re.__file__, pytest.__file__])
def test_breadth_first_order(path):
    with open(path) as source:
        tree = ast.parse(source.read())
    assert [n for n, *_ in _walk(tree)] == list(ast.walk(tree))


def test_intervals_and_nesting():
    code = "if a:\n    for b in c:\n        while d:\n            x = 1\n    y = 2\n"
    rows = [dict(zip(COLUMN_NAMES, r)) for r in node_rows(code)]
    at = {(r["kind"], r["line"]): r for r in rows}
    loop, inner, after = at["For", 2], at["Assign", 4], at["Assign", 5]
    assert loop["pre"] < inner["pre"] <= loop["post"] < after["pre"] <= at["If", 1]["post"]
    assert (loop["nest"], inner["nest"], after["nest"]) == (2, 3, 1)


@pytest.mark.parametrize("code", ["def broken(:", "a\0b", "(" * 300 + ")" * 300, "x = (1,\n"])
def test_unparseable(code):
    rows = node_rows(code)
    assert len(rows) == 1 and dict(zip(COLUMN_NAMES, rows[0]))["kind"] == ERROR_KIND


def test_odd_constants():
    rows = node_rows("x = '\\ud800'\ny = " + "9" * 5000 + "\nz = b'a'\nw = 1j\n")
    assert sum(dict(zip(COLUMN_NAMES, r))["kind"] == "Constant" for r in rows) in (0, 4)  # very long numbers may not parse


def test_large_file_leaves_in_batches(spark):
    code = "".join(f"v{i} = {i}\n" for i in range(MAX_BATCH_ROWS // 2))
    nodes = ast_nodes(spark.createDataFrame([(7, code), (8, "x = 1")], "file_id long, code string"))
    counts = dict(map(tuple, nodes.groupBy("file_id").count().collect()))
    assert counts == {7: 3 * (MAX_BATCH_ROWS // 2) + 1, 8: 4}


def test_string_file_ids(spark):
    files = spark.createDataFrame([("a/b.py", "import os\n")], "file_id string, code string")
    assert ast_nodes(files).select("file_id").distinct().collect()[0][0] == "a/b.py"


# --- whole corpus ------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def run(spark):
    part = spark.range(len(corpus.TEMPLATES)).select(F.col("id").alias("p_partkey"))
    return validate(corpus.code_files(part))


def test_every_issue_with_message(run):
    got = {}
    for r in run.issues.collect():
        message = "Syntax error" if r.rule_id == "syntax_error" else r.message
        got.setdefault(r.file_id, []).append((r.rule_id, r.severity, r.line, message))
    for k, template in enumerate(corpus.TEMPLATES):
        assert sorted(got.get(k, []), key=str) == sorted(template.issues, key=str), k


def test_report_order(run):
    """Categories in run order, and inside a pack pattern by pattern or line by line."""
    rows = run.issues.where("file_id = 5").orderBy("seq").collect()
    assert [r.rule_id for r in rows] == ["line_secrets.1", "line_secrets.2", "line_secrets.3", "line_secrets.4"]
    rows = run.issues.where("file_id = 14").orderBy("seq").collect()
    assert [(r.line, r.rule_id) for r in rows if r.rule_id.startswith("line_")] == [
        (2, "line_placeholders.1"), (2, "line_placeholders.5"), (4, "line_placeholders.4"), (5, "line_placeholders.2"),
        (5, "line_placeholders.5"), (7, "line_placeholders.3"), (7, "line_placeholders.5")]
    rows = run.issues.where("file_id = 2").orderBy("seq").collect()
    assert [r.line for r in rows] == [2, 3, 4, 5, 6, 7]


def test_scores(run):
    scores = {r.file_id: r for r in run.results.collect()}
    assert len(scores) == len(corpus.TEMPLATES)
    assert all(0 <= r.trust_score <= 100 for r in scores.values())
    # two criticals and four highs: security 0, the rest 100: (2.5 + 1 + 0.5) * 100 / 6
    assert scores[2].trust_score == 66 and not scores[2].passed
    broken = next(i for i, t in enumerate(corpus.TEMPLATES) if t.issues and t.issues[0][0] == "syntax_error")
    assert scores[broken].trust_score == 0 and not scores[broken].passed
    assert run.category_scores.where(F.col("file_id") == broken).count() == 0
    assert run.category_scores.where("file_id = 2").count() == 4


def test_suggestions(run):
    s = {(r.file_id, r.rule_id, r.line): r.suggestion for r in run.issues.collect()}
    assert s[26, "ast_function_naming", 4] == "Rename to 'get_user_name'"
    assert s[26, "ast_function_naming", 8] == "Rename to 'http_server2'"
    assert s[26, "ast_class_naming", 12] == "Rename to 'MyClass'"
    assert s[26, "ast_variable_naming", 20] == "Rename to 'my_var'"
    assert s[2, "ast_dangerous_call", 5] == "Avoid __import__() or sanitize inputs carefully"
    assert s[24, "ast_redundant_compare", 3] == "This is always False, check if this is intentional"
    assert s[10, "ast_unknown_import", None] == "Verify 'leftpadlib' is installed: pip install leftpadlib"


def test_installed_packages_are_known(spark):
    files = spark.createDataFrame([(1, "import leftpadlib\nimport ai_thing\n")], "file_id long, code string")
    bindings = N.import_bindings(ast_nodes(files))
    known = N.known_modules(spark, spark.createDataFrame([("leftpadlib",)], "module string"))
    assert [r.rule_id for r in N.import_issues(bindings, known).collect()] == ["ast_fake_import"]
    assert {r.rule_id for r in N.import_issues(bindings).collect()} == {"ast_fake_import", "ast_unknown_import"}
    assert len(N.known_module_names()) == 241


def test_parser_needs_no_package_on_the_workers(tmp_path):
    """A session started elsewhere, whose workers cannot import the package."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from codegauge import build_session, validate
spark = build_session("local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
files = spark.createDataFrame([(1, "a.py", "python", "eval(x)")], "file_id long, path string, language string, code string")
print("SCORE", validate(files).results.first()["trust_score"])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "SCORE" in out.stdout, out.stderr[-2000:]


def test_staged_facts_hold_what_the_rules_read(spark):
    """The narrow table gives the issues of the whole node table, in fewer bytes than the sources."""
    files = corpus.code_files(spark.range(0, 2_000, 1, 1).select(F.col("id").alias("p_partkey"))).where("language = 'python'")
    nodes = ast_nodes(files)
    facts = N.staged_facts(nodes)
    order = ["file_id", "rule_id", "line", "message", "seq"]
    want = sorted(map(str, N.syntax_issues(nodes).select(*order).collect()))
    assert sorted(map(str, N.syntax_issues(facts).select(*order).collect())) == want and len(want) > 500
    assert {r.use for r in facts.select("use").distinct().collect()} == {"hit", "name", "block", "loop", "compare", "error"}
    staged = sum(os.path.getsize(urllib.parse.urlparse(path).path) for path in facts.inputFiles())
    assert staged < files.agg(F.sum(F.octet_length("code"))).first()[0]
