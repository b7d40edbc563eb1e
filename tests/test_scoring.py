"""Weights, disabled categories, reports and limits."""

import json

import pytest

from codegauge.operators import fixes as X, issues as I, scoring
from codegauge.plans.validate import validate
from codegauge.sinks import reports
from codegauge.sources import files as src

FILES = [
    (1, "a.py", "python", '"""Doc."""\neval(x)\npassword = "abc"\nprint(password)\n'),
    (2, "b.py", "python", '"""Doc."""\nvalue = 1\n'),
    (3, "c.js", "javascript", "eval(x)\nvar a = 1\n"),
    (4, None, "python", "def f(:\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_id long, path string, language string, code string")


def scores(validation):
    return {r.file_id: r.trust_score for r in validation.results.collect()}


def test_default_weights(files):
    # file 1: security 60 -> (120 + 250 + 100 + 50) / 6; file 2: logic 97; file 3: security 75
    assert scores(validate(files)) == {1: 86, 2: 99, 3: 91, 4: 0}


def test_override_without_weight_counts_one(files):
    # security weighs 1: (60 + 250 + 100 + 50) / 5
    assert scores(validate(files, {"security": {}}))[1] == 92


def test_disabled_category_leaves_python_scores_only(files):
    run = validate(files, {"security": {"enabled": False}})
    got = scores(run)
    assert got[1] == 100 and got[2] == 99
    assert got[3] == 95  # the script file keeps its security score, at weight 1
    assert {r.rule_id for r in run.issues.where("file_id = 1").collect()} == set()
    assert run.category_scores.where("file_id = 1").count() == 3


def test_everything_disabled(files):
    off = {k: {"enabled": False} for k in scoring.KEYS}
    got = scores(validate(files, off))
    assert got[1] == got[2] == got[4] == 0 and got[3] > 0


def test_unstaged_run_agrees(files):
    assert scores(validate(files, staged=False)) == scores(validate(files))


def test_weights_per_file(spark, files):
    run = validate(files)
    configs = spark.createDataFrame([("x",), ("off",)], "config_id string")
    overrides = spark.createDataFrame(
        [("x", "security", True, 4.0)] + [("off", k, False, None) for k in scoring.KEYS],
        "config_id string, category_key string, enabled boolean, weight double")
    weights = scoring.effective_weights(configs, overrides)
    which = spark.createDataFrame([(1, "x"), (2, "off"), (3, "x")], "file_id long, config_id string")
    got = dict(map(tuple, scoring.trust_from_scores(run.category_scores, weights, which).collect()))
    assert got == {1: 80, 2: 0, 3: 87}  # (240 + 250 + 100 + 50) / 8, none, (300 + 400) / 8


def test_empty_run(spark, files):
    none = files.where("false")
    row = scoring.run_summary(validate(none).results).first()
    assert tuple(row) == (0, 0.0, 0, 0, 0, 0, 0.0)


def test_sarif_and_json(files):
    run = validate(files)
    docs = {r.file_id: json.loads(r.json) for r in reports.json_report(files, run.issues).collect()}
    assert docs[1]["critical_count"] == 1 and docs[1]["categories"]["security"] == {"score": 60, "weight": 2.0, "issue_count": 2}
    assert docs[4]["categories"] is None and docs[4]["trust_score"] == 0
    rows = [json.loads(r.result) for r in reports.sarif_results(run.issues, files).collect()]
    assert all(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in rows)  # file 4 has no path
    assert {r["level"] for r in rows} <= {"error", "warning", "note"}


def test_sarif_region_without_line(spark):
    issues = spark.createDataFrame(
        [(1, "r", "high", "logic", "m", None, None, None, 1)],
        "file_id long, rule_id string, severity string, category string, message string, line int, column int, suggestion string, seq long")
    named = spark.createDataFrame([(1, "p.py")], "file_id long, path string")
    row = json.loads(reports.sarif_results(issues, named).first().result)
    assert row["locations"][0]["physicalLocation"]["region"] == {} and row["properties"]["suggestion"] is None


def test_top_lists_cut_after_k(spark):
    rows = [(f, "high" if s % 2 else "critical", s) for f in (1, 2) for s in range(30)]
    issues = spark.createDataFrame(rows, "file_id long, severity string, seq long")
    assert I.first_issues(issues).count() == 20
    top = I.top_issues_per_file(issues).collect()
    assert len(top) == 20 and max(r.seq for r in top) == 9
    fixes = issues.where("severity = 'high'")
    assert sorted(r.seq for r in I.top_fixes(fixes).where("file_id = 1").collect()) == [1, 3, 5, 7, 9]


def test_edits_need_a_line(spark):
    fixes = spark.createDataFrame([(1, 1, "m" * 60, 3, "new"), (1, 2, "n", None, "x")],
                                  "file_id long, seq long, message string, line int, suggested string")
    row, = reports.fix_edits(fixes).collect()
    assert (row.title, row.start_line, row.end_line, row.new_text) == ("Fix: " + "m" * 50 + "...", 2, 3, "new\n")


def test_apply_fix_ignores_missing_lines(spark):
    files = spark.createDataFrame([(1, "a\nb\nc"), (2, "x")], "file_id long, code string")
    fixes = spark.createDataFrame([(1, 2, "B\nBB"), (1, 9, "no")], "file_id long, line int, suggested string")
    assert dict(map(tuple, X.apply_fixes(files, fixes).collect())) == {1: "a\nB\nBB\nc", 2: "x"}


def test_batch_defaults(spark):
    bodies = spark.createDataFrame([("a", '{"files":[{"code":"x"},{"name":"n"}],"min_score":10}'), ("b", "not json"), ("c", "{}")],
                                   "id string, body string")
    rows = sorted(map(tuple, src.batch_files(bodies).collect()))
    assert rows == [("a", 0, "unnamed", "x", 10, False, None), ("a", 1, "n", "", 10, False, None),
                    ("b", None, None, None, 70, False, "malformed body"), ("c", None, None, None, 70, False, "no files")]


def test_scan_files(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "B.TSX").write_text("var a")
    (tmp_path / "notes.md").write_text("hello")
    one, = src.scan_files(spark, str(tmp_path)).collect()
    assert one.code == "x = 1\ny = 2\n" and one.language == "python"
    many = {r.path.rsplit("/", 1)[1]: r.language for r in src.scan_files_multilang(spark, str(tmp_path)).collect()}
    assert many == {"a.py": "python", "B.TSX": "typescript"}


def test_ignore_is_a_plain_prefix(spark):
    files = spark.createDataFrame([("d/tests/a.py",), ("d/tests_x/b.py",), ("d/src/tests/c.py",)], "path string")
    assert [r.path for r in src.drop_ignored(files, "d", ["tests"]).collect()] == ["d/src/tests/c.py"]
