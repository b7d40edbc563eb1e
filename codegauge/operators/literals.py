"""Many patterns or words against many lines, as an equality join.

A line can only hold a word that shares every run of three bytes with it, so each word is listed under one of its
runs, the one that fewest words have, and lines meet words by their own runs.  Which runs are listed is a bitmap of at most two
megabytes; it is tested on whole batches of lines, so only listed runs leave the scan.  Patterns are listed by the longest text
that each of their matches must hold; the pattern itself is tried only on the lines that hold it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.session import stage

RUN = 3
#: Runs of one, two and three bytes are numbered behind one another.
_FIRST = (0, 0, 256, 256 + 65_536)
_ALL = _FIRST[RUN] + (1 << 24)


def _runs(bitmap: np.ndarray | None):
    """Arrow function: the distinct runs of each text, those of the bitmap, or, without one, those it can be listed under."""
    kinds = [size for size in range(1, RUN + 1) if bitmap is None or bitmap[_FIRST[size] // 8:(_FIRST[size] + 256 ** size) // 8].any()]

    def of(texts: pa.Array) -> pa.Array:
        texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(offsets) else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64)
        found, whose = [], []
        for size in kinds:
            places = max(0, len(data) - size + 1)
            number = np.zeros(places, dtype=np.int32)
            for k in range(size):
                number = (number << 8) | data[k:k + places]
            number += _FIRST[size]
            if bitmap is None:
                at = np.arange(places)
            else:
                at = np.flatnonzero((bitmap[number >> 3] >> (number & 7).astype(np.uint8)) & 1)
            owner = np.searchsorted(offsets, at, side="right") - 1
            inside = at + size <= offsets[owner + 1]
            if bitmap is None:      # a text shorter than a run is listed under all of it
                length = offsets[owner + 1] - offsets[owner]
                inside &= length >= RUN if size == RUN else length == size
            found.append(number[at[inside]].astype(np.int64))
            whose.append(owner[inside])
        pairs = np.unique(np.concatenate(whose) * _ALL + np.concatenate(found)) if kinds else np.zeros(0, dtype=np.int64)
        cuts = np.searchsorted(pairs // _ALL, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((pairs % _ALL).astype(np.int32)))
    return of


def _run_column(text: str | Column, bitmap: np.ndarray | None = None) -> Column:
    return F.arrow_udf(_runs(bitmap), "array<int>")(text)


def listed(needles: DataFrame, literal: str) -> DataFrame:
    """``needles`` with ``run__``: the run of its literal that is listed least often."""
    words = needles.select(F.col(literal).alias("word__")).where("word__ <> ''").distinct()
    each = stage(words.select("word__", F.explode(_run_column("word__")).alias("run__")), "runs")
    often = each.groupBy("run__").agg(F.count(F.lit(1)).alias("n__"))
    best = each.join(often, "run__").groupBy("word__").agg(F.min(F.struct("n__", "run__")).alias("b__")).select("word__", "b__.run__")
    return needles.join(best, F.col(literal) == F.col("word__")).drop("word__")


def _bitmap(index: DataFrame) -> np.ndarray:
    """Which runs are listed, one bit each: rows of 64 bits, some 260,000 at most."""
    word = F.call_function("shiftright", F.col("run__"), F.lit(6))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("run__").bitwiseAND(63))
    rows = index.groupBy(word.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(_ALL // 64 + 1, dtype=np.int64)
    words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint8)


def holding(rows: DataFrame, text: str, needles: DataFrame, literal: str) -> DataFrame:
    """Each row with each needle whose ``literal`` stands in the row's ``text``; both must be folded alike.

    Columns of the two must differ.  An empty or null literal stands nowhere, a null text holds nothing.
    """
    index = stage(listed(needles, literal), "listed")
    found = rows.withColumn("run__", _run_column(text, _bitmap(index))).where(F.size("run__") > 0)
    spread = found.withColumn("run__", F.explode("run__"))
    return spread.join(index, "run__").where(F.contains(text, literal)).drop("run__")


# --- patterns ---------------------------------------------------------------------------------------------------------

def folded(text: Column) -> Column:
    """Lower case in which any two letters that patterns ignoring case take as equal to a plain letter are equal to it."""
    return F.lower(F.translate(text, "ſıİ", "sii"))


def required_text(pattern: str) -> str:
    """A text that every match of the pattern holds, in lower case and plain letters; empty if none is found.

    The longest run of literals that stand on every way through the pattern.
    """
    try:
        parsed = _parser.parse(pattern)
    except Exception:       # written for another engine
        return ""
    found, now = [""], []

    def close() -> None:
        found.append("".join(now))
        now.clear()

    def walk(tokens) -> None:
        for op, value in tokens:
            name = str(op)
            if name == "LITERAL" and value < 128:
                now.append(chr(value).lower())
            elif name == "SUBPATTERN":
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                close()
                walk(value[2])
                close()
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
                close()

    walk(parsed)
    close()
    return max(found, key=len)


def _required(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(needs__=[required_text(p) for p in frame["pattern"]])


def pattern_matches(lines: DataFrame, rules: DataFrame, text: str = "line") -> DataFrame:
    """Each line with each rule of ``rules(pattern, ...)`` whose pattern is found in it; other columns of both are kept.

    Rules are rows, as many as the caller has.  A line meets the rules whose required text it holds; rules without one are tried on
    every line.  Null patterns and null lines match nothing.
    """
    from codegauge.operators.lines import whole_pattern

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema)
    known = stage(rules.where("pattern is not null").mapInPandas(_required, f"{kind}, needs__ string"), "rules")
    met = holding(lines.withColumn("folded__", folded(F.col(text))), "folded__", known.where("needs__ <> ''"), "needs__").drop("folded__")
    rest = known.where("needs__ = ''")
    if rest.limit(1).count():
        everywhere = F.lit(0)
        met = met.unionByName(lines.withColumn("all__", everywhere).join(rest.withColumn("all__", everywhere), "all__").drop("all__"))
    # unlike a plain match, the place of a match keeps a column's last pattern compiled from row to row
    return met.where(F.regexp_instr(text, whole_pattern(F.col("pattern"))) > 0).drop("needs__")


def _ship_by_value() -> None:
    import codegauge.operators.literals as module

    cloudpickle.register_pickle_by_value(module)


_ship_by_value()
