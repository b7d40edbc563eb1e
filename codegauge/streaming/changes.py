"""Changes of watched files, followed in event time.

Snapshots arrive in any order.  Each path keeps a buffer of the rows that the watermark has not reached and the
snapshot it saw last; a timer at the earliest buffered time hands the rows that can have no predecessor any more to
the comparison, in time order, and takes them out of the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codegauge.operators.skew import previous_in_group

#: The store that keeps lists, values and timers for one key.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_LAST = "modified_at timestamp, content_hash string, ts timestamp"


def _millis(ts) -> int:
    """The first whole millisecond that is not before ``ts``."""
    return -int(-ts.timestamp() * 1_000_000 // 1_000)


class ChangeFollower(StatefulProcessor):
    def __init__(self, names: Sequence[str], schema: str, order: Sequence[str], forget_ms: int | None):
        self.names, self.schema, self.order, self.forget_ms = list(names), schema, list(order), forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.schema)
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(row[n] for n in self.names) for row in rows]
        if new:
            self.buffer.appendList(new)
            at = self.names.index("ts")
            self.handle.registerTimer(min(_millis(row[at]) for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(self.names, row)) for row in self.buffer.get()]
        due = sorted((r for r in rows if _millis(r["ts"]) <= passed), key=lambda r: tuple(r[n] for n in self.order))
        rest = [r for r in rows if _millis(r["ts"]) > passed]
        before = self.last.get() if self.last.exists() else None
        seen, at = ((before[0], before[1]), before[2]) if before else (None, None)
        changed = []
        for row in due:
            now = (row["modified_at"], row["content_hash"])
            forgotten = at is not None and self.forget_ms is not None and _millis(row["ts"]) - _millis(at) > self.forget_ms
            if now != seen or forgotten:
                changed.append(row)
            seen, at = now, row["ts"]
        if due:
            if rest:
                self.buffer.put([tuple(r[n] for n in self.names) for r in rest])
            else:
                self.buffer.clear()
            self.last.update((*seen, due[-1]["ts"]))
        newest = due[-1]["ts"] if due else before[2] if before else None
        if rest:
            self.handle.registerTimer(min(_millis(r["ts"]) for r in rest))
        elif self.forget_ms is not None and newest is not None:
            if _millis(newest) + self.forget_ms <= passed:
                self.last.clear()
            else:
                self.handle.registerTimer(_millis(newest) + self.forget_ms)
        return (Row(**row) for row in changed)

    def close(self) -> None:
        pass


def detect_changes(feed: DataFrame, order: Sequence[str] = ("ts",), delay: str = "1 hour", forget_ms: int | None = None) -> DataFrame:
    """Rows of ``feed(path, ts, modified_at, content_hash, ...)`` whose (modified_at, content_hash) differ from the path's one before.

    A row is compared once the watermark, ``delay`` behind the newest row, has passed its ``ts``: by then all rows
    before it are there, in whatever order they came.  Rows later than that are dropped.  Rows of one path with equal ``ts`` go by the
    further columns of ``order``.  Rows without ``path`` or ``ts`` have no place and are left out.

    State is the rows within the delay and one short record per path.  With ``forget_ms`` a snapshot that much later than the
    one before counts as the path's first, and the record goes once the watermark has passed that time.  Needs the
    settings ``STATE_STORE``.
    """
    known = feed.where("path is not null and ts is not null").withWatermark("ts", delay)
    follower = ChangeFollower(feed.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in feed.schema), order, forget_ms)
    return known.groupBy("path").transformWithState(follower, feed.schema, "Append", "EventTime")


def changes_held_back(spark: SparkSession, checkpoint: str, order: Sequence[str] = ("ts",), forget_ms: int | None = None) -> DataFrame:
    """The changes among the rows that a stopped stream still holds in its buffers, taken from its state."""
    state = spark.read.format("statestore").option("path", checkpoint)
    rest = state.option("stateVarName", "buffer").load().select("list_element.*")
    last = state.option("stateVarName", "last").load().select("key.path", "value.*")
    names = rest.columns
    both = rest.withColumn("old__", F.lit(1)).unionByName(last.withColumn("old__", F.lit(0)), allowMissingColumns=True)
    followed = previous_in_group(both, "path", ["old__", *order], F.struct("modified_at", "content_hash", "ts"))
    changed = ~F.struct("modified_at", "content_hash").eqNullSafe(F.struct("previous.modified_at", "previous.content_hash")) | F.col("previous").isNull()
    if forget_ms is not None:
        changed |= F.unix_millis("ts") - F.unix_millis("previous.ts") > forget_ms
    return followed.where((F.col("old__") == 1) & changed).select(*names)


def _ship_by_value() -> None:
    import codegauge.streaming.changes as module

    cloudpickle.register_pickle_by_value(module)


_ship_by_value()
