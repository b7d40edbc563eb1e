"""Hot keys, running values, graphs and reuse against brute force on small data."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codegauge.catalog import QUERIES, common, tree
from codegauge.catalog.common import corpus_files
from codegauge.catalog.graph import graph_files, module_edges
from codegauge.corpus import TEMPLATES
from codegauge.functions import scalars as S, syntax
from codegauge.functions.syntax import ERROR_KIND, ast_nodes
from codegauge.operators import fixes as X, history as H, lines as L, modules as M, nodes as N, reuse, scoring, skew, watch


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows share one key."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}") for i in range(600)]
    return spark.createDataFrame(rows, "id long, key string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_even_join_equals_join(spark, hot, how):
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("zz", 5), (None, 6)], "key string, v int")
    rows = hot.unionAll(spark.createDataFrame([(9_999, None)], hot.schema))
    plain, even = rows.join(small, "key", how), skew.even_join(rows, small, "key", how)
    assert sorted(map(str, even.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_even_join_deals_out_both_sides(spark, hot):
    """Also behind an aggregate on the key, whose partitioning a plain join would reuse."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.even_join(hot, hot.groupBy("key").agg(F.min("id").alias("first")), "key")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("half__") and sum("Exchange hashpartitioning(key" in x and "half__" in x for x in plan.splitlines()) == 2


def test_components_of_a_long_chain(spark):
    """Logarithmic rounds: 2,000 links in few jobs."""
    from codegauge.operators.components import connected_components

    edges = [(f"n{k:04}", f"n{k + 1:04}") for k in range(2_000)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    random.Random(2).shuffle(edges)
    tracker, group = spark.sparkContext.statusTracker(), "chain"
    spark.sparkContext.setJobGroup(group, group)
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out == {f"n{k:04}": "n0000" for k in range(2_001)} | {"x": "x", "y": "x"}
    assert jobs < 150


def test_running_totals(spark, hot):
    rows = sorted((r.key, r.id) for r in hot.collect())
    want, total = {}, 0
    for key, i in rows:
        total += i
        want[i] = total
    got = skew.running_totals(hot, ["key", "id"], {"total": F.col("id")})
    assert {r.id: r.total for r in got.collect()} == want


def test_previous_in_group(spark, hot):
    rows = sorted((r.key, r.id) for r in hot.collect())
    want = {b[1]: (a[1] if a[0] == b[0] else None) for a, b in zip([(None, None)] + rows, rows)}
    got = skew.previous_in_group(hot, "key", ["id"], F.col("id"))
    assert {r.id: r.previous for r in got.collect()} == want


def test_change_needs_both_equal(spark):
    rows = [("p", 1, 10, "a"), ("p", 2, 10, "a"), ("p", 3, 11, "a"), ("p", 4, 11, "b"), ("q", 5, 11, "b")]
    feed = spark.createDataFrame(rows, "path string, ts int, modified_at int, content_hash string")
    assert sorted(r.ts for r in watch.change_detection(feed, ["ts"]).collect()) == [1, 3, 4, 5]
    assert {(r.path, r.ts) for r in watch.latest_per_file(feed, ["ts"]).collect()} == {("p", 4), ("q", 5)}


# --- graphs -----------------------------------------------------------------------------------------------------

def reach(edges, nodes):
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            more = set().union(*(out[m] for m in out[n])) if out[n] else set()
            if not more <= out[n]:
                out[n] |= more
                changed = True
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_operators(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(18)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)}
    mods = spark.createDataFrame([(n,) for n in nodes], "module string")
    adjacency = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(sorted(edges))], "from_module string, to_module string, ord int")
    closed = reach(edges, nodes)

    got = {r.module: r.cycle_group for r in M.circular_dependencies(adjacency).collect()}
    want = {n: max(m for m in closed[n] if n in closed[m]) for n in nodes if n in closed[n]}
    assert got == want

    roots = nodes[:3]
    got = {r.module: r.hops for r in M.dependency_closure(
        mods, adjacency, spark.createDataFrame([(r,) for r in roots], "module string")).collect()}
    hops, front = {r: 0 for r in roots}, set(roots)
    for step in itertools.count(1):
        front = {b for a, b in edges if a in front} - set(hops)
        if not front:
            break
        hops.update(dict.fromkeys(front, step))
    assert got == hops

    both = reach(edges | {(b, a) for a, b in edges}, nodes)
    got = {r.module: r.cluster for r in M.dependency_clusters(mods, adjacency).collect()}
    assert got == {n: min(both[n] | {n}) for n in nodes}


def test_edges_to_package_members(spark):
    mods = spark.createDataFrame([(m,) for m in ("a", "a.b", "a.b.c", "ab", "x")], "module string")
    imports = spark.createDataFrame([("x", "a.b", 1), ("x", "a.b", 2), ("a", "a", 1), ("ab", "ab", 1), ("x", "zz", 3)], "module string, imp string, ord int")
    ranks = M.name_ranks(mods)
    assert [r.module for r in ranks.orderBy("rank").collect()] == ["a", "a.b", "a.b.c", "ab", "x"]
    edges = M.module_edges(imports, ranks)
    assert sorted(map(tuple, edges.collect())) == [("a", "a", 0, 2, 2)] + [("x", "a.b", 1, 2, 2)] * 2
    got = sorted(map(tuple, M.edge_pairs(edges, ranks).collect()))
    assert got == [("a", "a.b", "a"), ("a", "a.b.c", "a")] + sorted([("x", "a.b", "a.b"), ("x", "a.b.c", "a.b")] * 2)


def test_edges_to_a_package_with_a_third_of_all_modules(spark, monkeypatch):
    """Rows follow the imports, not importers times members; pairs come from equality joins."""
    names = [f"big.m{k}" for k in range(400)] + ["big"] + [f"o{k}" for k in range(800)]
    mods = spark.createDataFrame([(n,) for n in names], "module string")
    imports = spark.createDataFrame([(n, "big", 0) for n in names[::2]], "module string, imp string, ord int")
    ranks = M.name_ranks(mods)
    edges = M.module_edges(imports, ranks)
    rows = edges.collect()
    assert len(rows) == len(names[::2]) and {r.last - r.first + 1 for r in rows} == {401}
    assert {r.n_targets for r in rows} == {400, 401}
    monkeypatch.setattr(M, "RANKS_PER_BLOCK", 64)
    pairs = M.edge_pairs(edges, ranks)
    assert "NestedLoop" not in plan(pairs) and "Cartesian" not in plan(pairs)
    assert pairs.count() == sum(r.n_targets for r in rows)
    assert {r.to_module for r in pairs.where("from_module = 'o1'").collect()} == set(names[:401])


def test_long_chain_and_ring_in_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(M, "Rounds", type("Counted", (M.Rounds,), {"keep": lambda self, *a, **k: (written.append(self.base), M.Rounds.__mro__[1].keep(self, *a, **k))[1]}))
    for ring in (False, True):
        written.clear()
        edges = [(f"n{k:04d}", f"n{k + 1:04d}", 0) for k in range(2_000)] + ([("n2000", "n0007", 0), ("n0500", "zz", 0), ("zz", "zzz", 0)] if ring else [])
        random.Random(3).shuffle(edges)
        out = {r.module: r.cycle_group for r in M.circular_dependencies(spark.createDataFrame(edges, "from_module string, to_module string, ord int")).collect()}
        assert out == ({f"n{k:04d}": "n2000" for k in range(7, 2_001)} if ring else {})
        assert len(written) < (40 if ring else 30)


def test_rings_of_single_imports_and_their_tails(spark):
    rng = random.Random(4)
    for _ in range(3):
        nodes = [f"n{k:02d}" for k in range(40)]
        edges = {(n, rng.choice(nodes)) for n in nodes if rng.random() < 0.9} | {(rng.choice(nodes), rng.choice(nodes)) for _ in range(6)}
        closed = reach(edges, nodes)
        frame = spark.createDataFrame([(*e, 0) for e in edges], "from_module string, to_module string, ord int")
        got = {r.module: r.cycle_group for r in M.circular_dependencies(frame).collect()}
        assert got == {n: max(m for m in closed[n] if n in closed[m]) for n in nodes if n in closed[n]}


def test_closure_of_a_long_chain_writes_what_it_reaches(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 4)
    edges = [(f"n{k:03d}", f"n{k + 1:03d}", 0) for k in range(100)] + [("n050", "n010", 1), ("m1", "m2", 0)]
    names = sorted({x for a, b, _ in edges for x in (a, b)} | {f"x{k}" for k in range(50)})
    sizes = []
    plain = M.Deltas._write
    monkeypatch.setattr(M.Deltas, "_write", lambda self, df: (lambda out: (sizes.append(out[1]), out)[1])(plain(self, df)))
    closed = M.dependency_closure(spark.createDataFrame([(n,) for n in names], "module string"),
                                  spark.createDataFrame(edges, "from_module string, to_module string, ord int"),
                                  spark.createDataFrame([("n000",), ("gone",)], "module string"))
    assert {r.module: r.hops for r in closed.collect()} == {f"n{k:03d}": k for k in range(101)}
    assert sum(sizes) < 5 * 101      # once, and once per merge of four


def test_module_names(spark):
    paths = ["a.py", "p/b.py", "p/__init__.py", "__init__.py", "p/q/c.py.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(S.module_name(F.col("path"))).collect()
    assert [r[0] for r in rows] == ["a", "p.b", "p", "", "p.q.c"]


# --- reuse --------------------------------------------------------------------------------------------------------

def test_reuse_with_hot_copies(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(60)]
    files = spark.createDataFrame(rows, "file_id long, code string")
    scanned = []

    def scan(todo):
        scanned.append(todo.count())
        return todo.select("file_id", F.length("code").alias("n"))

    out = reuse.dedup_scan(files, scan)
    assert {r.file_id: r.n for r in out.collect()} == {i: len(t) for i, t in rows}
    assert scanned == [41]

    as_of = F.lit("2024-01-31").cast("timestamp")
    cache = files.where("file_id < 30").select(S.content_digest(F.col("code"), "c").alias("digest"), F.lit("shown").alias("content_hash"), F.lit(-1).alias("n"),
                                               F.lit("2024-01-30 00:00:00").alias("ts")).distinct()
    out = reuse.incremental_scan(files, cache, scan, as_of, ["n"], config="c")
    got = {r.file_id: (r.n, r.from_cache) for r in out.collect()}
    assert got == {i: (-1, True) if i % 3 == 0 or i < 30 else (len(t), False) for i, t in rows}


def test_expiry(spark):
    rows = spark.createDataFrame([("2024-01-24 00:00:00",), ("2024-01-23 23:59:59",), ("2024-01-30T10:11:12.123456",), ("never",), (None,)], "ts string")
    got = [r[0] for r in rows.select(S.is_expired(F.col("ts"), F.lit("2024-01-31").cast("timestamp"))).collect()]
    assert got == [False, True, False, True, True]


def test_empty_selections_give_zeros(spark):
    cols = "id long, ts timestamp, trust_score int, passed boolean, critical_count int, high_count int, medium_count int, low_count int, " \
           "security_score int, hallucination_score int, logic_score int, best_practices_score int, user string, project string"
    none = spark.createDataFrame([], cols)
    assert tuple(H.overview(none).first()) == (0, 0.0, 0.0, 0, 0)
    assert tuple(H.category_averages(none).first()) == (0.0, 0.0, 0.0, 0.0)
    assert H.leaderboard(none).count() == 0
    cache = spark.createDataFrame([], "trust_score int, issues_count long, file_path string, duration_ms double, result_json string")
    assert tuple(reuse.cache_metrics(cache).first()) == (0, 0, 0, 0.0, 0.0)
    assert reuse.cache_stats(cache).first().entries == 0
    assert tuple(watch.watch_summary(spark.createDataFrame([], "score int, issues int")).first()) == (0, 0.0, 0, 0, 0, 0)
    assert M.overall_trust(spark.createDataFrame([], "trust_score int")).first()[0] == 50
    assert scoring.run_gate(spark.createDataFrame([], "trust_score int, critical_count int")).first()[0] is True


# --- plans ----------------------------------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_scan_sums_before_the_shuffle(spark, tmp_path):
    from codegauge.operators import lines as L
    from codegauge import rules as R

    path = str(tmp_path / "docs")
    spark.range(40).select(F.col("id").alias("file_id"), F.lit("x").alias("path"), F.lit("a\nb").alias("code"), F.lit(1).alias("unused")
                           ).write.parquet(path)
    files = spark.read.parquet(path)
    text = plan(scoring.trust_scores(scoring.file_totals(files, L.scan_lines(L.code_lines(files), R.PYTHON_PACKS))))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert "unused" not in text


def test_history_filter_prunes_days(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.range(30).select("id", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int))").alias("ts")).withColumn(
        "day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    text = plan(H.history_filter(spark.read.parquet(path), "2024-01-31 00:00:00", 7))
    assert "PartitionFilters: [isnotnull(day" in text


def test_upsert_replaces_whatever_was_there(spark):
    cols = "digest string, ts string, n int"
    cache = spark.createDataFrame([("a", "unknown", 1), ("b", "2024-01-01", 2)], cols)
    entries = spark.createDataFrame([("a", "2024-01-05", 3), ("c", "2024-01-05", 4), ("c", "2024-01-06", 5)], cols)
    assert sorted(map(tuple, reuse.cache_upsert(cache, entries).collect())) == [
        ("a", "2024-01-05", 3), ("b", "2024-01-01", 2), ("c", "2024-01-06", 5)]


def test_scratch_is_cleared_by_application(spark):
    import os

    from codegauge.session import clear_scratch, scratch_path, stage

    rows = stage(spark.range(5), "probe")
    assert rows.count() == 5
    own = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    assert os.path.isdir(own)
    clear_scratch(spark)
    assert not os.path.isdir(own)


def test_issue_lines_are_never_broadcast(spark):
    """Spark sizes the lines of made-up texts like the table of keys behind them, far below what they hold."""
    files = spark.range(4).select(F.col("id").alias("file_id"), F.lit("a\nb\n\nd").alias("code"))
    issues = spark.createDataFrame([(0, 2), (1, 4), (2, 9), (3, None), (7, 1), (None, 1), (0, 2)], "file_id long, line int")
    joined = X.issue_lines(issues, L.code_lines(files))
    got = sorted(((r.file_id, r.line, r.original) for r in joined.collect()), key=str)
    assert got == sorted([(0, 2, "b"), (1, 4, "d"), (2, 9, ""), (3, None, ""), (7, 1, ""), (None, 1, ""), (0, 2, "b")], key=str)
    assert "Broadcast" not in plan(joined)


@pytest.mark.parametrize("files", ["corpus_files", "graph_files"])
def test_corpus_tasks_grow_with_the_rows(spark, tmp_path, files):
    """A table of 150,000 keys is small in bytes and one file; nulls and a repeated key do not gather in a task."""
    key = F.when(F.col("id") % 3 == 0, F.lit(46)).when(F.col("id") % 3 == 1, F.col("id"))
    spark.range(150_000).select(key.cast("long").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = {"corpus_files": corpus_files, "graph_files": graph_files}[files](spark, str(tmp_path)).groupBy(
        F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 150_000
    assert len(tasks) >= 15 and max(r["count"] for r in tasks) <= 11_000


PARSING = ["ast_const_if", "ast_dangerous_call", "ast_function_naming", "ast_sql_injection", "ast_nodes", "ast_deep_nesting",
           "ast_infinite_loop", "ast_ellipsis_function", "ast_imports", "ast_class_naming", "ast_mutable_default", "descendant_join",
           "ast_function_length", "module_symbols", "ast_os_system", "ast_redundant_compare", "ast_variable_naming", "ast_shell_true"]
FIXING = ["fix_docstring", "fix_eval", "fix_infinite_loop", "fix_mutable_default", "fix_shell", "fix_sql_fstring", "fix_unreachable",
          "fix_unused", "top_fixes"]


def test_queries_that_parse_follow_the_rows(spark, tmp_path):
    """150,000 keys in one small file: 15 tasks parse, whatever the cores known."""
    spark.range(150_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in PARSING:
        assert "RoundRobinPartitioning(15)" in plan(QUERIES[name](spark, str(tmp_path))), name


def test_rows_of_some_kinds_serve_their_reader_as_all_do(spark):
    """One file of each template, a broken one, an empty and a null text: same rows, same result, and no other rows."""
    readers = [
        (N.import_bindings, N.IMPORT_KINDS), (N.symbols, N.NAME_KINDS), (N.called_but_unbound, N.NAME_KINDS), (N.infinite_loop_issues, N.LOOP_KINDS),
        (N.descendant_exits, N.LOOP_KINDS), (N.redundant_compare_issues, N.COMPARE_KINDS), (N.module_symbols, N.MODULE_KINDS),
        (N.function_signatures, N.SIGNATURE_KINDS), (N.syntax_error_issues, [ERROR_KIND]), (N.local_issues, N.local_kinds()),
        (lambda nodes: N.local_issues(nodes, ["ast_class_naming"]), N.local_kinds(["ast_class_naming"]))]
    codes = [t.code for t in TEMPLATES] + ["def f(:", "", None]
    files = spark.createDataFrame(list(enumerate(codes)), "file_id long, code string")
    whole = ast_nodes(files).cache()
    for reader, kinds in readers:
        some = ast_nodes(files, kinds)
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.where(F.col("kind").isin(list(kinds))).collect())), kinds
        assert sorted(map(str, reader(some).collect())) == sorted(map(str, reader(whole).collect())), kinds
    whole.unpersist()


def test_rule_queries_take_only_the_kinds_they_read(spark, tmp_path, monkeypatch):
    """Rows that a rule drops at once never leave the parse; the node table's own query takes them all."""
    spark.range(46).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    asked = []
    monkeypatch.setattr(common, "ast_nodes", lambda files, kinds=None: asked.append(kinds) or ast_nodes(files, kinds))
    for name in PARSING:
        QUERIES[name](spark, str(tmp_path))
        assert (asked.pop() is None) == (name == "ast_nodes"), name


def test_a_text_without_a_wanted_node_ends_at_the_walk(monkeypatch):
    """Places, names and facts are worked out up to the last wanted node; a text that has none is only parsed and walked."""
    monkeypatch.setattr(syntax, "_label", lambda node, slot: pytest.fail(f"looked at a {type(node).__name__}"))
    assert syntax.node_rows("import a\nprint(a.b)\n", {"ClassDef"}) == []
    monkeypatch.undo()
    for code in [t.code for t in TEMPLATES if t.language == "python"] + ["", "x = 1\nclass A:\n    def f(self): return lambda: [1]\n"]:
        whole = syntax.node_rows(code)
        for kind in {row[5] for row in whole}:
            assert syntax.node_rows(code, {kind}) == [row for row in whole if row[5] == kind]


def test_fix_queries_take_only_the_kinds_they_read(spark, tmp_path, monkeypatch):
    """Nodes that the rules behind a fix drop at once never leave the parse, and the issues are those of the whole node table."""
    spark.range(46).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    asked = []
    monkeypatch.setattr(tree, "ast_nodes_of", lambda files, kinds=None: asked.append(kinds) or ast_nodes(files, kinds))
    for name in FIXING:
        QUERIES[name](spark, str(tmp_path))
    assert len(asked) == len(FIXING) - 1 and None not in asked  # top_fixes runs all rules on the staged table
    codes = [t.code for t in TEMPLATES] + ["match a:\n    case 1:\n        return 1\n        b\nx = 1 if a else 2\ntype T = int\nfor a in b:\n    del a\n    raise a\n    import c\n"]
    files = spark.createDataFrame(list(enumerate(codes)), "file_id long, code string")
    some, whole = (sorted(map(str, N.unreachable_issues(ast_nodes(files, k)).collect())) for k in (N.BLOCK_KINDS, None))
    assert some == whole and any("line=10" in row for row in some)


def test_fix_queries_never_broadcast_lines(spark, tmp_path):
    """The lines of 46 files, one of each template, look like 46 keys to Spark; each meets its issues by a shuffle."""
    spark.range(46).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    for name in FIXING:
        text = plan(QUERIES[name](spark, str(tmp_path)))
        assert "SortMergeJoin [file_id" in text and "BroadcastHashJoin" not in text, name


def test_module_edges_lists_every_member(spark, tmp_path):
    """One group of files: an import of a package leads to the package and all that lies in it."""
    spark.range(10).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.from_module, r.to_module, r.imp) for r in module_edges(spark, str(tmp_path)).collect())
    package = ["pkg_0", "pkg_0.core", "pkg_0.util"]
    assert got == sorted(
        [("pkg_0", "mod_4", "mod_4"), ("pkg_0.core", "pkg_0.util", "pkg_0.util"), ("mod_4", "mod_5", "mod_5"), ("mod_5", "mod_6", "mod_6"),
         ("mod_6", "mod_4", "mod_4"), ("mod_6", "mod_7", "mod_7"), ("mod_9", "pkg_0.core", "pkg_0.core")]
        + [(m, to, "pkg_0") for m in ("mod_7", "mod_8") for to in package])
