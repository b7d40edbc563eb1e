"""Custom analyzers.

Two kinds plug in:

* a *line analyzer* is a condition on the ``line`` column: it runs inside the JVM with the built-in rules;
* a *tree analyzer* is a Python function ``(tree, code, context) -> list of issues``: all tree analyzers run in
  one Arrow pass that parses each text once.

``when`` is a Column over the files table (the "should it run" test); files no analyzer wants never reach
Python.  An analyzer that raises loses its issues for that file and leaves a row in the failures table.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark import cloudpickle

from codegauge.operators.lines import CHECK_STEP, MAJOR_STEP

CUSTOM_BASE = 100  # custom checks are listed after the built-in ones


@dataclass(frozen=True)
class Analyzer:
    name: str
    run: Callable
    by_line: bool = False
    version: str = "0.1.0"
    author: str = "Unknown"
    description: str = ""
    priority: int = 100  # lower runs first
    when: Column | None = None
    severity: str = "medium"
    category: str = "custom"
    message: str = ""


def line_analyzer(name: str, message: str, severity: str = "medium", category: str = "custom", **options):
    """Decorator: ``function(line: Column) -> Column`` becomes a line analyzer."""
    return lambda function: Analyzer(name, function, True, severity=severity, category=category, message=message, **options)


def tree_analyzer(name: str, **options):
    """Decorator: ``function(tree, code, context) -> list[dict]`` becomes a tree analyzer.

    Each dict holds severity, category, message and optionally line, column, suggestion.
    """
    return lambda function: Analyzer(name, function, **options)


_ISSUE = ("rule_id string, severity string, category string, message string, line int, column int, "
          "suggestion string, seq long, error string")
_ARROW = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string(), pa.int64(), pa.string()]


def _tree_pass(jobs):
    """Arrow function over (file_id, path, code, wants array<boolean>)."""
    names = [part.split()[0] for part in _ISSUE.split(", ")]

    def rows_of(path, code, wants):
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        for (name, base, function), wanted in zip(jobs, wants):
            if not wanted:
                continue
            try:
                found = [
                    (name, i["severity"], i["category"], i["message"], i.get("line"), i.get("column"),
                     i.get("suggestion"), base + n, None)
                    for n, i in enumerate(function(tree, code, {"file_path": path}))
                ]
            except Exception as error:  # one analyzer must not stop the others
                found = [(name, None, None, None, None, None, None, base, f"{type(error).__name__}: {error}")]
            yield from found

    def run(batches):
        for batch in batches:
            owners, rows = [], []
            for at in range(batch.num_rows):
                path, code, wants = (batch.column(k)[at].as_py() for k in (1, 2, 3))
                for row in rows_of(path, code or "", wants):
                    owners.append(at)
                    rows.append(row)
            if rows:
                arrays = [batch.column(0).take(pa.array(owners, pa.int32()))]
                arrays += [pa.array(v, k) for v, k in zip(zip(*rows), _ARROW)]
                yield pa.RecordBatch.from_arrays(arrays, ["file_id", *names])

    return run


class Registry:
    """The analyzers of one session, by name."""

    def __init__(self):
        self._by_name: dict[str, Analyzer] = {}

    def register(self, analyzer: Analyzer) -> Analyzer:
        if analyzer.name in self._by_name:
            raise ValueError(f"analyzer {analyzer.name!r} is already registered")
        self._by_name[analyzer.name] = analyzer
        return analyzer

    def unregister(self, name: str) -> None:
        self._by_name.pop(name, None)

    def get(self, name: str) -> Analyzer | None:
        return self._by_name.get(name)

    def names(self) -> list[str]:
        return list(self._by_name)

    def in_order(self) -> list[Analyzer]:
        """By priority; equal priorities keep the order of registration."""
        return sorted(self._by_name.values(), key=lambda a: a.priority)

    def run(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(issues, failures) of all analyzers over ``files(file_id, path, code)``."""
        kind = files.schema["file_id"].dataType.simpleString()
        schema = T._parse_datatype_string(f"file_id {kind}, {_ISSUE}")
        ordered = list(enumerate(self.in_order()))
        by_line = [(i, a) for i, a in ordered if a.by_line]
        parts = [_line_issues(files, by_line)] if by_line else []
        trees = [(i, a) for i, a in ordered if not a.by_line]
        if trees:
            wants = [a.when if a.when is not None else F.lit(True) for _, a in trees]
            rows = files.where(reduce(lambda x, y: x | y, wants)).select(
                "file_id", "path", "code", F.array(*[F.coalesce(w, F.lit(False)) for w in wants]).alias("wants"))
            parts.append(rows.mapInArrow(_tree_pass([(a.name, _base(i), a.run) for i, a in trees]), schema))
        if not parts:
            parts = [files.sparkSession.createDataFrame([], schema)]
        everything = reduce(lambda a, b: a.unionByName(b), parts)
        issues = everything.where(F.col("error").isNull()).drop("error")
        failures = everything.where(F.col("error").isNotNull()).select("file_id", F.col("rule_id").alias("analyzer"), "error")
        return issues, failures


def _base(position: int) -> int:
    return (CUSTOM_BASE + position) * CHECK_STEP


def _line_issues(files: DataFrame, analyzers: list[tuple[int, Analyzer]]) -> DataFrame:
    """Issues of all line analyzers in one pass: texts are split once, and a line yields the analyzers that fire on it."""
    wants = [F.coalesce(a.when, F.lit(False)) if a.when is not None else F.lit(True) for _, a in analyzers]
    lines = files.where(reduce(lambda x, y: x | y, wants)).select(
        "file_id", F.array(*wants).alias("wants"), F.posexplode(F.split("code", "\n", -1)).alias("pos", "line"))
    fired = F.array_compact(F.array(*[
        F.when(F.col("wants")[k] & a.run(F.col("line")), F.lit(k)) for k, (_, a) in enumerate(analyzers)]))
    about = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in (
        ("rule_id", a.name), ("severity", a.severity), ("category", a.category), ("message", a.message), ("base", _base(i)))]) for i, a in analyzers])
    hits = lines.select("file_id", (F.col("pos") + 1).alias("line"), F.explode(fired).alias("k"))
    m = about[F.col("k")]
    return hits.select(
        "file_id", *[m[n].alias(n) for n in ("rule_id", "severity", "category", "message")],
        "line", F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("suggestion"),
        (m["base"] + F.col("line").cast("long") * F.lit(MAJOR_STEP)).alias("seq"), F.lit(None).cast("string").alias("error"))


def _ship_by_value() -> None:
    import codegauge.analyzers as module

    cloudpickle.register_pickle_by_value(module)


_ship_by_value()
