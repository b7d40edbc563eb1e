"""End to end: files -> lines and nodes -> issues -> scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge import rules as R
from codegauge.constants import CATEGORY_OF_KEY
from codegauge.functions.syntax import ast_nodes
from codegauge.operators import lines as L
from codegauge.operators import nodes as N
from codegauge.operators import scoring
from codegauge.session import stage


@dataclass(frozen=True)
class Validation:
    issues: DataFrame
    totals: DataFrame
    results: DataFrame
    category_scores: DataFrame


def _enabled(packs: Sequence[R.Pack], weights: Mapping[str, float]) -> list[R.Pack]:
    unknown = {p.category for p in packs} - set(CATEGORY_OF_KEY.values())
    if unknown:
        raise ValueError(f"rule packs of unknown categories: {sorted(unknown)}")
    categories = {CATEGORY_OF_KEY[k] for k in weights}
    return [p for p in packs if p.category in categories]


def text_issues(files: DataFrame, packs: Sequence[R.Pack] = R.PYTHON_PACKS) -> DataFrame:
    """Line rules only, for texts that need no tree."""
    return L.scan_lines(L.code_lines(files), packs)


def python_issues(files: DataFrame, nodes: DataFrame, weights: Mapping[str, float],
                  extra: Sequence[R.Pack] = (), known: DataFrame | None = None) -> DataFrame:
    """Issues of Python files.  A file that does not parse has its syntax error and nothing else."""
    categories = [CATEGORY_OF_KEY[k] for k in weights]
    syntax = N.syntax_issues(nodes, known).where(
        F.col("category").isin(categories) | (F.col("rule_id") == "syntax_error"))
    packs = [*_enabled(R.PYTHON_PACKS, weights), *_enabled(extra, weights)]
    if not packs:
        return syntax
    by_line = L.scan_lines(L.code_lines(files), packs)
    broken = N.parse_errors(nodes).select("file_id")
    return syntax.unionByName(by_line.join(broken, "file_id", "left_anti"))


def javascript_issues(files: DataFrame) -> DataFrame:
    """Issues of JavaScript and TypeScript files; line rules over all four categories."""
    rows = L.code_lines(files)
    return L.scan_lines(rows, R.JS_PACKS).unionByName(L.scan_js_packages(rows))


def validate(files: DataFrame, overrides: Mapping[str, Mapping] | None = None, *,
             nodes: DataFrame | None = None, known: DataFrame | None = None,
             extra_packs: Sequence[R.Pack] = (), extra_issues: DataFrame | None = None,
             staged: bool = True) -> Validation:
    """Score ``files(file_id, path, language, code)``.

    Python texts are parsed once (``nodes`` if the caller has the node table already), TypeScript and
    JavaScript take the line rules.  With ``staged`` what the rules need of the parse, and the issues, are written to the shared
    folder, so their several readers do not repeat the parse or the scan.
    """
    weights = scoring.effective_config(overrides)
    keep = stage if staged else (lambda df, name: df)
    python = files.where(F.col("language") == "python")
    script = files.where(F.col("language").isin("javascript", "typescript"))
    if nodes is None:
        nodes = N.staged_facts(ast_nodes(python)) if staged else ast_nodes(python)
    issues = python_issues(python, nodes, weights, extra_packs, known).unionByName(javascript_issues(script))
    if extra_issues is not None:
        issues = issues.unionByName(extra_issues)
    issues = keep(issues, "issues")
    scored = [(files, weights)]
    if weights != scoring.configured_weights(overrides):  # a disabled category only leaves the Python scores
        scored = [(python, weights), (script, scoring.configured_weights(overrides))]
    totals = [scoring.file_totals(part, issues.join(part.select("file_id"), "file_id", "left_semi") if len(scored) > 1
                                  else issues) for part, _ in scored]
    every = reduce(DataFrame.unionByName, totals)
    results = reduce(DataFrame.unionByName, [scoring.trust_scores(t, w) for t, (_, w) in zip(totals, scored)])
    scores = reduce(DataFrame.unionByName, [scoring.category_scores(t, w) for t, (_, w) in zip(totals, scored)])
    return Validation(issues, every, results, scores)


def validate_texts(files: DataFrame, overrides: Mapping[str, Mapping] | None = None,
                   packs: Sequence[R.Pack] = R.PYTHON_PACKS) -> DataFrame:
    """Trust scores from line rules alone: one scan and one small shuffle."""
    weights = scoring.effective_config(overrides)
    return scoring.trust_scores(scoring.file_totals(files, text_issues(files, packs)), weights)
