"""Streams over several micro-batches."""

import datetime
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from codegauge import Analyzer, Registry, line_analyzer, tree_analyzer
from codegauge.operators import reuse, watch
from codegauge.sources import tables
from codegauge.sources.keyed import KeyedTable, newest
from codegauge.streaming import panes, watch as stream
from codegauge.streaming.changes import detect_changes


@pytest.fixture(scope="module")
def feed_dir(spark, tmp_path_factory):
    """Twelve files of snapshots, written in time order."""
    root = str(tmp_path_factory.mktemp("feed"))
    for batch in range(12):
        ids = spark.range(batch * 10, batch * 10 + 10, 1, 1)
        ids.select(
            F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("path"),
            F.timestamp_seconds(F.col("id") * 60).alias("ts"),
            F.timestamp_seconds(F.floor(F.col("id") / 40) * 3600).alias("modified_at"),
            F.md5((F.floor(F.col("id") / 25)).cast("string")).alias("content_hash"),
            (F.col("id") % 101).cast("int").alias("score"), (F.col("id") % 7).cast("int").alias("issues"),
        ).write.mode("append").parquet(root)
    return root


def as_stream(spark, path, per_trigger):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


FIRST_DAY = 19_000
BEGIN = 1_700_000_000      # a watermark starts at second 0


def snapshots(spark, rows):
    return spark.createDataFrame(rows, "path string, ts long, modified_at long, content_hash string").select(
        "path", F.timestamp_seconds(F.col("ts") + BEGIN).alias("ts"), F.timestamp_seconds("modified_at").alias("modified_at"), "content_hash")


def test_changes_of_a_shuffled_feed(spark, tmp_path):
    """Rows of all times in every file, several batches: the answer is that of the whole table in time order."""
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(3)}", k, k // 20, rng.choice("ab")) for k in range(150)] + [("p0", 75, 3, "z"), ("p0", 75, 3, "a"), (None, 5, 0, "a"), ("p1", None, 0, "a")]
    rng.shuffle(rows)
    for k in range(0, len(rows), 40):
        snapshots(spark, rows[k:k + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at = str(tmp_path / "run")
    feed = as_stream(spark, str(tmp_path / "in"), 1)
    got = stream.changes_so_far(feed, "t-changes", ("ts", "content_hash"), "1 hour", at)
    whole = spark.read.parquet(str(tmp_path / "in")).where("path is not null and ts is not null")
    want = watch.change_detection(whole, ["ts", "content_hash"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))

    # a second run with the same folder goes on: what was held back is compared with what came since
    snapshots(spark, [("p0", 149, 7, "b"), ("p0", 151, 7, "c"), ("p2", 8_000, 9, "a"), ("p2", 9_000, 9, "a")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = stream.changes_so_far(feed, "t-changes", ("ts", "content_hash"), "1 hour", at)
    want = watch.change_detection(spark.read.parquet(str(tmp_path / "in")).where("path is not null and ts is not null"), ["ts", "content_hash"])
    assert sorted(map(str, again.select(want.columns).collect())) == sorted(map(str, want.collect()))
    with stream.settings(spark, stream.STATE_STORE):
        buffered = spark.read.format("statestore").option("stateVarName", "buffer").load(f"{at}/state")
        assert buffered.count() == 2       # only the rows within the delay stay


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    for rows in [[(20, "b")], [(5, "a"), (30, "b")], [(10, "a"), (40, "c")], [(41, "c")]]:
        snapshots(spark, [("p", ts, 0, h) for ts, h in rows]).coalesce(1).write.mode("append").parquet(str(tmp_path))
    got = stream.changes_so_far(as_stream(spark, str(tmp_path), 1), "t-late", delay="5 seconds")
    assert sorted(r.ts.timestamp() - BEGIN for r in got.collect()) == [5, 20, 40]      # 10 comes when 15 is passed


def test_forgotten_paths_leave_no_state(spark, tmp_path):
    for rows in [[("p", 10, 0, "a")], [("q", 500, 0, "a")], [("q", 900, 0, "a"), ("p", 901, 0, "a")], [("q", 950, 0, "a")]]:
        snapshots(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = detect_changes(as_stream(spark, str(tmp_path / "in"), 1), delay="10 seconds", forget_ms=100_000)
    emitted, state = stream.run_available(changes, "t-forget", str(tmp_path / "run"), **stream.STATE_STORE)
    assert sorted((r.path, r.ts.timestamp() - BEGIN) for r in emitted.collect()) == [("p", 10), ("p", 901), ("q", 500), ("q", 900)]


@pytest.mark.parametrize("per_trigger", [2, 5])
def test_latest_table_across_batches(spark, feed_dir, per_trigger):
    got = watch.watch_summary(stream.running_latest(as_stream(spark, feed_dir, per_trigger), "t-latest"))
    want = watch.watch_summary(watch.latest_per_file(spark.read.parquet(feed_dir), ["ts"]))
    assert got.first() == want.first()


def test_latest_table_goes_on_after_a_restart(spark, tmp_path):
    at = str(tmp_path / "run")

    def put(ts, paths):
        spark.createDataFrame([(p, ts, ts) for p in paths], "path string, t long, score int").select(
            "path", F.timestamp_seconds("t").alias("ts"), "score").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(1, ["a", "b", "c"])
    table = stream.running_latest(as_stream(spark, str(tmp_path / "in"), 1), "t-restart", at)
    assert {r.path: r.score for r in table.collect()} == {"a": 1, "b": 1, "c": 1}
    put(2, ["b"])
    table = stream.running_latest(as_stream(spark, str(tmp_path / "in"), 1), "t-restart", at)
    assert {r.path: r.score for r in table.collect()} == {"a": 1, "b": 2, "c": 1}


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "key long, ts long, v string", "key", newest("key", ["gen__", "ts"], ["key", "ts", "v"]), buckets=16)
    assert table.read().count() == 0 and table.versions() == []
    table.merge(spark.range(1_000).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("ts"), F.lit("old").alias("v")))
    one = spark.createDataFrame([(7, 0, "new"), (7, 5, "newer")], "key long, ts long, v string")
    table.merge(one)
    data = tmp_path / "t" / "data"
    assert len(list((data / "v0").glob("bucket__=*"))) == 16 and len(list((data / "v1").glob("bucket__=*"))) == 1
    assert {r.v for r in table.read().where("key = 7").collect()} == {"newer"} and table.read().count() == 1_000
    # a batch that is repeated starts from the version before it
    table.merge(spark.createDataFrame([(8, 0, "other")], "key long, ts long, v string"), version=1)
    assert {(r.key, r.v) for r in table.read().where("key in (7, 8)").collect()} == {(7, "old"), (8, "other")}
    # another process finds the table; replaced buckets go once nothing refers to them
    again = KeyedTable(spark, str(tmp_path / "t"), "key long, ts long, v string", "key", newest("key", ["gen__", "ts"], ["key", "ts", "v"]), buckets=16)
    for k in range(3):
        again.merge(spark.createDataFrame([(8, k, f"r{k}")], "key long, ts long, v string"))
    assert again.read().count() == 1_000 and again.read().where("key = 8").first().v == "r2"
    assert len(again.versions()) == 2 and sum(1 for _ in data.glob("v*/bucket__=*")) == 17
    again.merge(one.limit(0))
    assert len(again.versions()) == 2


def test_cache_hits_what_an_earlier_run_stored(spark, tmp_path):
    files = spark.createDataFrame([(k, f"p{k}", f"text {k % 4}") for k in range(12)], "file_id long, path string, code string")
    scored = files.select("file_id", "path", F.lit(80).alias("trust_score"), F.lit(1).cast("long").alias("issue_count"), F.lit(0).cast("long").alias("critical_count"))
    as_of = F.lit("2024-01-31").cast("timestamp")
    hashes = reuse.content_hashes(files, "c")
    for run in range(2):
        table = reuse.cache_table(spark, str(tmp_path / "cache"), 4)
        missed = reuse.cache_miss(hashes, table.read(), as_of)
        assert missed.count() == (12 if run == 0 else 0)
        entries = reuse.cache_entries(scored.join(missed, "file_id", "left_semi"), missed, F.lit("2024-01-30 00:00:00"), "c")
        table.merge(entries.withColumn("result_json", F.lit(None).cast("string")))
    assert table.read().count() == 4 and reuse.cache_lookup(hashes, table.read(), as_of).count() == 12


def test_history_of_a_repeated_run_stands_once(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.range(50).select("id", F.timestamp_seconds(F.col("id") * 10_000).alias("ts"))
    tables.history_append(rows, path, "run-1")
    tables.history_append(rows, path, "run-1")
    tables.history_append(rows.where("id < 5"), path, "run-2")
    assert sorted(r.id for r in tables.read_history(spark, path).collect()) == sorted([*range(50), *range(5)])


def test_dedup_across_batches(spark, feed_dir):
    got, _ = stream.run_available(stream.distinct_content(as_stream(spark, feed_dir, 3)), "t-dedup")
    assert got.count() == got.select("content_hash").distinct().count() == 5


def test_panes_over_several_batches(spark, tmp_path):
    """Twelve days in six files, rows up to a day late: closed days as emitted and open ones give the batch answer."""
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(4)}", FIRST_DAY * 86_400 + day * 86_400 + rng.randrange(86_400), rng.randrange(101), rng.random() < 0.5) for day in range(12) for _ in range(15)]
    rows.sort(key=lambda r: r[1] // 86_400 + rng.random())
    frame = "user string, t long, trust_score int, passed boolean"
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k:k + 30], frame).select("user", F.timestamp_seconds("t").alias("ts"), "trust_score", "passed").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    feed = as_stream(spark, str(tmp_path / "in"), 1)
    emitted, state = stream.run_available(panes.daily_panes(feed, ["user"]), "t-panes")
    closed = {r.day for r in emitted.collect()}
    left = {r.day for r in panes.open_panes(spark, state, ["user"]).collect()}
    assert len(closed) >= 9 and len(left) <= 3 and not closed & left
    both = stream.panes_so_far(feed, "t-panes-2", ["user"])
    want = {}
    for user, t, score, passed in rows:
        for back in range(7):
            n = want.setdefault((t // 86_400 - back, user), [0, 0, 0])
            n[0] += 1
            n[1] += score
            n[2] += passed
    got = {((r.week_start - datetime.date(1970, 1, 1)).days, r.user): (r.validations, r.avg_score, r.pass_rate) for r in panes.weeks_of_panes(both).collect()}
    half_up = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP))
    assert got == {k: (n, half_up(s / n), half_up(p / n * 100)) for k, (n, s, p) in want.items()}
    days = {(r.day - datetime.date(1970, 1, 1)).days: r.validations for r in panes.trend_of_panes(both).collect()}
    assert days == dict.fromkeys(range(FIRST_DAY, FIRST_DAY + 12), 15)


# --- custom analyzers ---------------------------------------------------------------------------------------------

FILES = [(1, "a.py", "x = 1\nTODO later\n"), (2, "b.py", "y = 2\n")]


def test_registry_rules(spark):
    registry = Registry()
    first = registry.register(line_analyzer("todo", "left to do")(lambda line: line.contains("TODO")))
    with pytest.raises(ValueError):
        registry.register(first)
    registry.register(line_analyzer("early", "assignment", priority=1)(lambda line: line.contains("=")))
    assert registry.names() == ["todo", "early"] and [a.name for a in registry.in_order()] == ["early", "todo"]
    issues, failures = registry.run(spark.createDataFrame(FILES, "file_id long, path string, code string"))
    rows = [(r.file_id, r.rule_id, r.line) for r in issues.orderBy("file_id", "seq").collect()]
    assert rows == [(1, "early", 1), (1, "todo", 2), (2, "early", 1)] and failures.count() == 0
    registry.unregister("early")
    registry.unregister("early")
    assert registry.get("early") is None and isinstance(registry.get("todo"), Analyzer)


def test_tree_analyzers_share_one_pass_and_fail_alone(spark):
    def names(tree, code, context):
        import ast
        return [{"severity": "low", "category": "custom", "message": n.id, "line": n.lineno}
                for n in ast.walk(tree) if isinstance(n, ast.Name)]

    def fails(tree, code, context):
        raise KeyError(context["file_path"])

    registry = Registry()
    registry.register(tree_analyzer("fails", priority=1)(fails))
    registry.register(tree_analyzer("names", when=F.col("path") == "b.py")(names))
    files = spark.createDataFrame([(2, "b.py", "y = 2\n"), (3, "c.py", "z = 3\n"), (4, "d.py", "def (\n")],
                                  "file_id long, path string, code string")
    issues, failures = registry.run(files)
    assert [(r.file_id, r.message) for r in issues.collect()] == [(2, "y")]
    assert sorted((r.file_id, r.error) for r in failures.collect()) == [(2, "KeyError: 'b.py'"), (3, "KeyError: 'c.py'")]
    assert Registry().run(files)[0].count() == 0
