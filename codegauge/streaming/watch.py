"""Watching as Structured Streaming.

A watched tree arrives as snapshot rows ``path, ts, modified_at, code`` (one row per file and poll): files
changed in place are new rows, since a file source reads each path once.  Micro-batches are bounded by
``maxFilesPerTrigger``.  Every run names a folder for its state and output; a run with the same folder goes on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codegauge import rules as R
from codegauge.operators import lines as L
from codegauge.session import scratch_path, stage
from codegauge.sources.keyed import KeyedTable, newest
from codegauge.streaming.changes import STATE_STORE, changes_held_back, detect_changes
from codegauge.streaming.panes import daily_panes, open_panes

FILES_PER_TRIGGER = 64


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A parquet folder (or single file) as a stream of its files, so many to a micro-batch.

    The stream is given a pattern that matches just this path: a plain path would have to be a folder.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def run_available(stream: DataFrame, name: str, at: str | None = None, **conf: str) -> tuple[DataFrame, str]:
    """Run a stream over what is there now: all it has written in append mode, and the folder of its state.

    Both lie below ``at``, where a later run with the same folder goes on, or below a fresh folder of this application.
    ``conf`` holds for this query only.
    """
    spark = stream.sparkSession
    base = at or scratch_path(spark, name)
    with settings(spark, conf):
        stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").format(
            "parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), f"{base}/state"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def changes_so_far(feed: DataFrame, name: str, order: Sequence[str] = ("ts",), delay: str = "1 hour", at: str | None = None) -> DataFrame:
    """Run change detection over what is there: the changes emitted, and those among the rows the stream still holds back."""
    spark = feed.sparkSession
    emitted, state = run_available(detect_changes(feed, order, delay), name, at, **STATE_STORE)
    with settings(spark, STATE_STORE):
        return stage(emitted.unionByName(changes_held_back(spark, state, order)), name)


def panes_so_far(history: DataFrame, name: str, keys: Sequence[str] = (), delay: str = "1 day", at: str | None = None) -> DataFrame:
    """Run daily panes over what is there: those of closed days as emitted, those of open days from the state."""
    emitted, state = run_available(daily_panes(history, keys, delay), name, at)
    return emitted.unionByName(open_panes(history.sparkSession, state, keys))


def line_scan(stream: DataFrame, packs=R.PYTHON_PACKS) -> DataFrame:
    """Line rules on a stream of ``file_id, code``: stateless, same expressions as the batch scan."""
    return L.scan_lines(L.code_lines(stream), packs)


def distinct_content(stream: DataFrame, ttl: str = "7 days") -> DataFrame:
    """First row per ``content_hash`` within the time to live; state older than that is dropped."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["content_hash"])


def latest_table(spark: SparkSession, path: str, schema: T.StructType) -> KeyedTable:
    """The latest row per path as a table of buckets."""
    return KeyedTable(spark, path, schema, "path", newest("path", ["ts"], schema.names))


def running_latest(stream: DataFrame, name: str, at: str | None = None, **conf: str) -> DataFrame:
    """Run a stream into a latest-per-path table and return the table.

    Table and state lie below ``at``, so that a later run goes on; a batch rewrites the buckets of its paths only.
    """
    spark = stream.sparkSession
    base = at or scratch_path(spark, name)
    table = latest_table(spark, f"{base}/table", stream.schema)
    with settings(spark, conf):
        stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").foreachBatch(
            table.merge).start().awaitTermination()
    return table.read()
