"""Lines and line rules.

``code_lines`` explodes each text once; ``scan_lines`` runs any number of rule packs over the lines in a
single pass.  No shuffle: a line is independent of every other line, so a very long text, or a source that
holds a third of all texts, spreads over tasks as the scan splits it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge import rules as R
from codegauge.constants import JS_INVENTED_PACKAGES

ISSUE_COLUMNS = [
    "file_id", "rule_id", "severity", "category", "message", "line", "column", "suggestion", "seq",
]

# seq = check * CHECK_STEP + major * MAJOR_STEP + minor: a sort key for a file's issues in report order.
CHECK_STEP = 10**16
MAJOR_STEP = 10**8


def regex(pattern: str) -> str:
    """A pattern written for Unicode text, as the JVM engine must see it.

    ``d``: only a newline ends a line; ``U``: word, space and digit classes are Unicode.  The four ASCII
    separators 1C-1F also count as white space.
    """
    return "(?dU)" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def whole_pattern(pattern: Column) -> Column:
    """The same for patterns that are a column."""
    return F.concat(F.lit("(?dU)"), F.replace(pattern, F.lit(r"\s"), F.lit(r"[\s\x1c-\x1f]")))


def search(column: Column, pattern: str) -> Column:
    return column.rlike(regex(pattern))


def starts_comment(line: Column, prefixes: Sequence[str]) -> Column:
    """Trimmed line starts with one of the comment markers."""
    return search(line, r"^\s*(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


def code_lines(files: DataFrame, code: str = "code") -> DataFrame:
    """``file_id, line_no (1-based), line``; a trailing empty line is kept."""
    return (
        files.select("file_id", F.posexplode(F.split(F.col(code), "\n", -1)).alias("pos", "line"))
        .select("file_id", (F.col("pos") + 1).alias("line_no"), "line")
    )


def rule_condition(rule: R.LineRule, line: Column) -> Column:
    if rule.longer_than is not None:
        return F.length(line) > rule.longer_than
    if rule.contains_any:
        return reduce(or_, [line.contains(text) for text in rule.contains_any])
    hit = search(line, rule.pattern)
    if rule.needs:
        hit = line.contains(rule.needs) & hit
    if rule.needs_folded:
        hit = F.lower(line).contains(rule.needs_folded) & hit
    return hit


def _literal(value) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return f"{value}L"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_table(rows: Sequence[dict]) -> Column:
    """A constant array of structs, handed over as one SQL expression (a call per literal would be slow)."""
    structs = ("named_struct(" + ", ".join(f"'{k}', {_literal(v)}" for k, v in row.items()) + ")" for row in rows)
    return F.expr(f"array({', '.join(structs)})")


def one_of(column: str, names: Sequence[str]) -> Column:
    """``column IN (names)``, likewise as one expression."""
    return F.expr(f"`{column}` IN ({', '.join(_literal(n) for n in names)})")


def _meta_column(packs: Sequence[R.Pack]) -> tuple[list[tuple[R.Pack, int, R.LineRule]], Column]:
    entries = [(pack, i, rule) for pack in packs for i, rule in enumerate(pack.rules)]
    return entries, constant_table([
        {
            "rule_id": rule.rule_id, "severity": rule.severity, "category": pack.category, "message": rule.message,
            "suggestion": rule.suggestion, "check": pack.check, "rank": i, "by_line": pack.by_line,
        }
        for pack, i, rule in entries
    ])


def scan_lines(lines: DataFrame, packs: Sequence[R.Pack]) -> DataFrame:
    """Issues of all ``packs`` over ``lines``, one row per (rule, line), in one pass.

    Every line yields the array of the rules that fire on it, so each pattern is tried once per line and a line
    without a hit gives no row.
    """
    line = F.col("line")
    entries, meta = _meta_column(packs)
    conditions = []
    for pack, _, rule in entries:
        condition = rule_condition(rule, line)
        if pack.skip_comments:
            condition = condition & ~starts_comment(line, pack.skip_comments)
        conditions.append(condition)

    fired = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]))
    hits = lines.select("file_id", "line_no", F.length("line").alias("n_chars"), F.explode(fired).alias("rule_no"))

    m = F.element_at(meta, F.col("rule_no") + 1)
    line_no = F.col("line_no").cast("long")
    return hits.select("file_id", "line_no", "n_chars", m.alias("m")).select(
        "file_id",
        F.col("m.rule_id"),
        F.col("m.severity"),
        F.col("m.category"),
        F.replace(F.col("m.message"), F.lit("{n}"), F.col("n_chars").cast("string")).alias("message"),
        F.col("line_no").alias("line"),
        F.lit(None).cast("int").alias("column"),
        F.col("m.suggestion"),
        (
            F.col("m.check") * F.lit(CHECK_STEP)
            + F.when(F.col("m.by_line"), line_no * F.lit(MAJOR_STEP) + F.col("m.rank"))
            .otherwise(F.col("m.rank") * F.lit(MAJOR_STEP) + line_no)
        ).alias("seq"),
    )


def js_package_imports(lines: DataFrame) -> DataFrame:
    """One row per quoted package in an import/require: ``file_id, line, pkg, rank`` (comment lines skipped)."""
    line = F.col("line")
    found = F.regexp_extract_all(line, F.lit(regex(R.JS_IMPORT)), F.lit(1))
    return (
        lines.where((line.contains("import") | line.contains("require")) & ~starts_comment(line, R.JS_IMPORT_SKIP))
        .select("file_id", F.col("line_no").alias("line"), F.posexplode(found).alias("rank", "path"))
        .select("file_id", "line", F.split("path", "/").getItem(0).alias("pkg"), "rank")
    )


def invented_packages(spark) -> DataFrame:
    return spark.createDataFrame(JS_INVENTED_PACKAGES, "pkg string, severity string, alt string")


def scan_js_packages(lines: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Issues for imports of invented packages: imports joined with the package table on the name."""
    imports = js_package_imports(lines)
    if packages is None:
        packages = F.broadcast(invented_packages(lines.sparkSession))  # the fixed five-row table
    return imports.join(packages, "pkg").select(
        "file_id",
        F.lit("js_fake_packages").alias("rule_id"),
        "severity",
        F.lit("hallucination").alias("category"),
        F.concat(F.lit("Package '"), "pkg", F.lit("' likely doesn't exist")).alias("message"),
        "line",
        F.lit(None).cast("int").alias("column"),
        F.concat(F.lit("Use '"), "alt", F.lit("' instead")).alias("suggestion"),
        (F.lit(R.JS_IMPORT_CHECK * CHECK_STEP) + F.col("line").cast("long") * F.lit(MAJOR_STEP) + F.col("rank")).alias("seq"),
    )


def js_symbols(files: DataFrame) -> DataFrame:
    """Import sources, functions and classes of JavaScript texts, default imports first."""
    def all_of(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(F.col("code"), F.lit(regex(pattern)), F.lit(group))

    return files.select(
        "file_id",
        F.concat(all_of(R.JS_IMPORT_DEFAULT, 2), all_of(R.JS_IMPORT_NAMED, 2)).alias("imports"),
        all_of(R.JS_FUNCTION, 1).alias("functions"),
        all_of(R.JS_CLASS, 1).alias("classes"),
    )
