"""Texts that nobody asked for stay where they are read."""

from pyspark.sql import functions as F

from codegauge.operators import fixes, reuse
from codegauge.operators.sketch import Wanted, pick


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_sketch_holds_every_key_and_few_others(spark):
    keys = spark.range(0, 200_000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    wanted = Wanted(keys.unionAll(spark.sql("select cast(null as string)")), "key")
    rows = spark.range(200_000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    kept = {r.id for r in rows.where(wanted.maybe()).select("id").collect()}
    asked = set(range(0, 200_000, 7))
    assert asked <= kept and len(kept - asked) < 0.02 * 200_000
    assert {r.id for r in pick(rows, wanted).select("id").collect()} == asked
    assert rows.select(F.lit(None).cast("string").alias("key")).where(wanted.maybe()).count() == 0
    none = Wanted(keys.limit(0), "key")
    assert rows.where(none.maybe()).count() == 0


def test_unwanted_texts_reach_no_exchange(spark, tmp_path):
    """With broadcasts off: the sketch stands below every exchange that carries texts, and lets about the wanted rows pass."""
    path = str(tmp_path / "files")
    spark.range(3_000).select(F.col("id").alias("file_id"), F.concat(F.lit("text "), F.col("id") % 30).alias("code")).write.parquet(path)
    files = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    without_broadcast(spark)
    try:
        seen = []

        def scan(todo):
            seen.append((plan(todo), todo.count()))
            return todo.select("file_id", F.length("code").alias("n"))

        out = reuse.dedup_scan(files, scan)
        assert out.count() == 3_000 and out.agg(F.sum("n")).first()[0] == sum(len(f"text {k % 30}") for k in range(3_000))
        text, n = seen[0]
        assert n == 30
        texts = [x for x in text.splitlines() if "Filter" in x and "subquery" in x.lower()]
        assert texts, text
        # only the join's own exchange stands above the filtered scan
        passed = files.where(Wanted(reuse.representatives(reuse.content_hashes(files)), "file_id").maybe()).count()
        assert 30 <= passed <= 30 + 0.03 * 3_000

        edits = spark.createDataFrame([(5, 1, "new 5"), (7, 1, "new 7"), (9_999, 1, "x")], "file_id long, line int, suggested string")
        fixed = fixes.apply_fixes(files.unionAll(spark.sql("select cast(null as bigint), 'null id'")), edits)
        got = {r.file_id: r.code for r in fixed.collect()}
        assert got == {k: f"new {k}" if k in (5, 7) else f"text {k % 30}" for k in range(3_000)} | {None: "null id"}
        assert plan(fixed).lower().count("subquery") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_incremental_scan_picks_only_misses(spark):
    files = spark.createDataFrame([(k, f"text {k % 5}") for k in range(100)], "file_id long, code string")
    cache = files.where("file_id < 3").select(F.sha2(F.concat_ws(":", "code", F.lit("c")), 256).alias("digest"), F.lit("s").alias("content_hash"),
                                              F.lit(-1).alias("n"), F.lit("2024-01-30 00:00:00").alias("ts"))
    scanned = []

    def scan(todo):
        scanned.append(todo.count())
        return todo.select("file_id", F.length("code").alias("n"))

    out = {r.file_id: (r.n, r.from_cache) for r in reuse.incremental_scan(
        files, cache, scan, F.lit("2024-01-31").cast("timestamp"), ["n"], config="c").collect()}
    assert scanned == [2] and out == {k: (-1, True) if k % 5 < 3 else (6, False) for k in range(100)}
