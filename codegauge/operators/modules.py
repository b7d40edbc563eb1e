"""Import graph of many files.

Base tables: ``modules(module, file_id, path)`` and ``imports(module, imp, ord)``.  A hub module that a third
of all files import is normal here, so joins on either end of an edge can be split at a hot name, and degree counts
are partial aggregates.  Iterated operators keep one row per module (labels, hops, colours), never pairs of
modules; every round is a written table that replaces the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codegauge import constants as C
from codegauge.functions import scalars as S
from codegauge.operators.components import Rounds, connected_components
from codegauge.operators.skew import even_join, running_totals
from codegauge.session import drop_path, scratch_path, stage


def modules(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files that parse, with their module name; caches are skipped and unparseable files are not in the graph.

    Files of a directory scan are named by their place below that directory (``rel_path``), others by their path.
    """
    parsed = nodes.where(F.col("kind") == "Module").select("file_id")
    place = F.col("rel_path" if "rel_path" in files.columns else "path")
    kept = files.where(~place.contains("__pycache__"))
    return kept.join(parsed, "file_id", "left_semi").select(S.module_name(place).alias("module"), "file_id", "path")


def module_imports(mods: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per imported name, in walk order; repeats are kept."""
    full = F.when(F.col("module").isNotNull(), F.concat_ws(".", "module", "name")).otherwise(F.col("name"))
    names = nodes.where((F.col("kind") == "alias")).select("file_id", full.alias("imp"), F.col("node_id").alias("ord"))
    return names.join(mods.select("file_id", "module"), "file_id").select("module", "imp", "ord")


def import_bases(imports: DataFrame) -> DataFrame:
    return imports.select(S.import_base(F.col("imp")).alias("base")).distinct()


def dotted_prefixes(name: Column) -> Column:
    """``a.b.c`` -> [a, a.b, a.b.c]."""
    parts = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def name_ranks(mods: DataFrame) -> DataFrame:
    """(module, rank) of the distinct names, walked as a tree: a package comes before its members, and those are adjacent.

    Comparing the lists of dotted parts gives that order.  Ranks come from range chunks, so no task sees all names.
    """
    names = mods.select("module").distinct().withColumn("parts", F.split("module", r"\.", -1))
    return running_totals(names, ["parts"], {"rank": F.lit(1)}).select("module", (F.col("rank") - 1).alias("rank"))


def name_intervals(ranks: DataFrame) -> DataFrame:
    """(imp, first, last): the ranks of what an import of each name takes in, itself and all below it.

    Each name counts once for each of its dotted prefixes; a package that holds a third of all modules is summed
    before the shuffle.
    """
    below = ranks.select("rank", F.explode(dotted_prefixes(F.col("module"))).alias("imp"))
    return below.groupBy("imp").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))


def module_edges(imports: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row per import that meets a module: (from_module, imp, first, last, n_targets).

    An import of a package depends on all its members; they are named as the interval of their ranks, so rows follow
    the imports, whatever a package holds.  A module does not depend on itself, which ``n_targets`` leaves out.
    ``edge_pairs`` lists the members.
    """
    inside = (F.col("module") == F.col("imp")) | F.startswith("module", F.concat("imp", F.lit(".")))
    targets = F.col("last") - F.col("first") + 1 - inside.cast("long")
    return even_join(imports.select("module", "imp"), name_intervals(ranks), "imp").select(
        F.col("module").alias("from_module"), "imp", "first", "last", targets.alias("n_targets")).where("n_targets > 0")


RANKS_PER_BLOCK = 512


def edge_pairs(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """``module -> other`` for every member of every edge's interval: a range join by blocks of ranks, on request only.

    Its output is the number of pairs, importers times members for a package.
    """
    block = lambda rank: F.floor(F.col(rank) / RANKS_PER_BLOCK)
    spans = edges.withColumn("block", F.explode(F.sequence(block("first"), block("last"))))
    names = ranks.select(F.col("module").alias("to_module"), "rank", block("rank").alias("block"))
    met = spans.join(names, "block").where("rank between first and last and to_module <> from_module")
    return met.select("from_module", "to_module", "imp")


def module_adjacency(imports: DataFrame, mods: DataFrame) -> DataFrame:
    """``module -> top-level module of the import``, repeats kept."""
    wanted = imports.select("module", S.import_base(F.col("imp")).alias("to_module"), "ord")
    names = mods.select(F.col("module").alias("to_module"))
    return even_join(wanted, names, "to_module", "left_semi").select(
        F.col("module").alias("from_module"), "to_module", "ord")


def dependency_graph(adjacency: DataFrame) -> DataFrame:
    """Adjacency lists in import order: one list per file, as long as its own import statements."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", "to_module"))), lambda p: p["to_module"])
    return adjacency.groupBy(F.col("from_module").alias("module")).agg(lists.alias("depends_on"))


def unused_modules(mods: DataFrame, imports: DataFrame) -> DataFrame:
    """Modules whose top-level name nobody imports."""
    base = S.import_base(F.col("module"))
    bases = import_bases(imports)
    named = mods.where(~F.col("module").endswith("__init__")).select("module", base.alias("base"))
    return even_join(named, bases, "base", "left_anti").select("module")


def missing_modules(imports: DataFrame, mods: DataFrame) -> DataFrame:
    """Imports whose top-level name is neither a module of the project nor on the short never-missing list."""
    wanted = imports.withColumn("base", S.import_base(F.col("imp"))).where(~F.col("base").isin(C.NEVER_MISSING))
    names = mods.select(F.col("module").alias("base"))
    lost = even_join(wanted, names, "base", "left_anti")
    return lost.select("module", F.col("imp").alias("import"), F.concat(
        F.lit("Module '"), "module", F.lit("' imports non-existent module '"), "imp", F.lit("'")).alias("message"))


def module_trust(mods: DataFrame, results: DataFrame) -> DataFrame:
    return mods.join(results.select("file_id", "trust_score"), "file_id").select("module", "trust_score")


def overall_trust(trust: DataFrame) -> DataFrame:
    """Mean module score cut to a whole number; 50 when nothing was scored."""
    return trust.agg(F.coalesce(
        F.floor(F.try_divide(F.sum("trust_score"), F.count("trust_score"))), F.lit(50)).cast("int").alias("overall_score"))


def degrees(mods: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Modules with the number of edges that leave and reach them."""
    rows = (
        mods.select("module", F.lit(0).alias("o"), F.lit(0).alias("i"))
        .union(adjacency.select("from_module", F.lit(1), F.lit(0)))
        .union(adjacency.select("to_module", F.lit(0), F.lit(1)))
    )
    return rows.groupBy("module").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def graph_summary(degree_table: DataFrame) -> DataFrame:
    return degree_table.agg(
        F.count(F.lit(1)).alias("modules"), F.sum("out_degree").alias("edges"),
        F.count_if(F.col("in_degree") == 0).alias("roots"), F.count_if(F.col("out_degree") == 0).alias("leaves"),
        F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"))


# --- iterated operators -------------------------------------------------------------------------------------

STEPS = 1  # hops worked out in one round: more of them mean fewer rounds with larger plans
LAYERS = 3  # layers trimmed in one round


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_module").alias("a"), F.col("to_module").alias("b")).distinct()


def _spread_values(edges: DataFrame, start: DataFrame, best, name: str) -> DataFrame:
    """Push the best value along fixed edges ``(a, b)`` until nothing changes: ``start(node, value)`` -> the same.

    ``best`` is F.max or F.min.  Offers are merged by node before the shuffle.  Both sides of the join over the edges
    are written tables, so it can be split at a hub.  A round writes one row per node; the one before it is deleted.
    """
    better = (lambda new, old: new > old) if best is F.max else (lambda new, old: new < old)
    rounds = Rounds(edges.sparkSession, name)
    state = start.select("node", "value")
    while True:
        after = state.withColumn("before", F.col("value"))
        for _ in range(STEPS):
            source = after.where(F.col("value").isNotNull()).select(F.col("node").alias("a"), "value")
            offers = edges.join(source, "a").groupBy(F.col("b").alias("node")).agg(best("value").alias("offer"))
            moved = F.coalesce(better(F.col("offer"), F.col("value")), F.col("value").isNull() & F.col("offer").isNotNull())
            after = after.join(offers, "node", "left").select(
                "node", "before", F.when(moved, F.col("offer")).otherwise(F.col("value")).alias("value"))
        moved = ~F.col("value").eqNullSafe(F.col("before"))
        kept, seen = rounds.keep(after.select("node", "value", "before"), moved=F.count_if(moved))
        state = kept.select("node", "value")
        if not seen["moved"]:
            return state


def dependency_clusters(mods: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Groups of modules connected by imports in either direction, named by their smallest member."""
    groups = connected_components(_pairs(adjacency)).withColumnRenamed("node", "module")
    return mods.select("module").join(groups, "module", "left").select(
        "module", F.coalesce("component", "module").alias("cluster"))


class Deltas:
    """A growing set of rows, kept as one small table per round.

    Tables of equal rank merge like the digits of a counter, so a row is rewritten at most once for each doubling of the number of
    rounds, and a reader opens few tables.
    """

    def __init__(self, spark, name: str):
        self.spark, self.base, self.number = spark, scratch_path(spark, name), 0
        self.tables: list[tuple[int, str]] = []      # (rank, path), larger ranks first

    def _write(self, df: DataFrame) -> tuple[str, int]:
        self.number += 1
        path, seen = f"{self.base}/{self.number}", Observation(f"delta_{self.number}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.schema = df.schema
        return path, seen.get["n"]

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The rows as written, and how many they are."""
        path, n = self._write(df)
        self.tables.append((0, path))
        while len(self.tables) > FAN_IN and len({rank for rank, _ in self.tables[-FAN_IN:]}) == 1:
            merged = self.tables[-FAN_IN:]
            whole, _ = self._write(self.spark.read.schema(self.schema).parquet(*(p for _, p in merged)))
            self.tables[-FAN_IN:] = [(merged[0][0] + 1, whole)]
            for _, old in merged[:-1]:
                drop_path(self.spark, old)
        return self.spark.read.schema(self.schema).parquet(path), n

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(p for _, p in self.tables))


FAN_IN = 8


def dependency_closure(mods: DataFrame, adjacency: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything the ``roots(module)`` depend on, directly or not, with the fewest import steps.

    Semi-naive: a round follows the edges of the last round's modules only and writes the new ones, so what is
    written follows the modules reached, not modules times steps.
    """
    pairs = stage(_pairs(adjacency), "closure-edges")
    reached = Deltas(mods.sparkSession, "closure")
    start = roots.select(F.col("module").alias("node")).distinct().join(mods.select(F.col("module").alias("node")), "node", "left_semi")
    frontier, n = reached.add(start.withColumn("hops", F.lit(0)))
    hops = 0
    while n:
        hops += 1
        ahead = pairs.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        new = ahead.join(reached.read().select("node"), "node", "left_anti").withColumn("hops", F.lit(hops))
        frontier, n = reached.add(new)
    return reached.read().select(F.col("node").alias("module"), "hops")


def _trim(pairs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Without edges that cannot lie on a cycle: their start is never reached or their end leads nowhere.

    A job peels several layers; the number of edges left tells when the last one was empty.
    """
    rounds = Rounds(pairs.sparkSession, name)
    now, seen = rounds.keep(pairs, n=F.count(F.lit(1)))
    while True:
        size, kept = seen["n"], now
        if not size:
            return now, 0
        for _ in range(LAYERS):
            ends = kept.select(F.col("a").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
                kept.select("b", F.lit(0), F.lit(1)))
            inner = ends.groupBy("n").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o + i = 2").select("n")
            kept = even_join(even_join(kept, inner.select(F.col("n").alias("a")), "a", "left_semi"),
                             inner.select(F.col("n").alias("b")), "b", "left_semi").select("a", "b")
        now, seen = rounds.keep(kept, n=F.count(F.lit(1)))
        if seen["n"] == size:
            return now, size


def _chains(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modules with a single import, followed to the end of their chain in a logarithmic number of rounds.

    Returns links (node, to, end), from each such module to the next and to the module with other than one import
    where its chain ends; rings (module, group), which consist of such modules; and the edges between all other
    modules with every chain replaced by one edge to its end.  Modules that lead into a ring, or to a module without imports,
    lie on no cycle and are left out.

    Each round doubles the steps: a module takes over where the module it points to points, and the largest name on
    the way.  Chains that end stop moving; as a chain has modules at every distance from its end, an equal number of movers in two rounds
    means that all of them go round.  Likewise the modules pointed at are the rings alone once their number stays.
    """
    spark = pairs.sparkSession
    links = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n = 1").select(
        F.col("a").alias("node"), F.col("b").alias("to")), "single-imports")
    rounds = Rounds(spark, "chains")
    measures = {"moved": F.count_if("moved"), "changed": F.count_if("changed")}
    now, _ = rounds.keep(links.select("node", "to", F.col("node").alias("best"), F.lit(True).alias("moved"), F.lit(True).alias("changed")), **measures)
    moved, pointed = -1, -1
    while True:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("best").alias("other"))
        after = even_join(now, ahead, "to", "left").select(
            "node", F.coalesce("further", "to").alias("to"), F.greatest("best", F.coalesce("other", "best")).alias("best"),
            F.col("further").isNotNull().alias("moved"), F.coalesce(F.col("other") > F.col("best"), F.lit(False)).alias("changed"))
        now, seen = rounds.keep(after, **measures)
        if not seen["moved"]:
            break
        if seen["moved"] == moved and not seen["changed"]:
            before, pointed = pointed, now.where("moved").select("to").distinct().count()
            if pointed == before:
                break
        moved = seen["moved"]
    going = now.where("moved")
    rings = going.join(going.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("module"), F.col("best").alias("group"))
    ends = now.where("not moved").select("node", F.col("to").alias("end"))
    whole = links.join(ends, "node")
    starts = pairs.join(links.select(F.col("node").alias("a")), "a", "left_anti")
    # an edge leads to the end of its chain; into a ring it leads nowhere
    led = starts.join(now.select(F.col("node").alias("b"), "to", "moved"), "b", "left").where("moved is null or not moved")
    return whole, stage(rings, "rings"), led.select("a", F.coalesce("to", "b").alias("b")).distinct()


def _on_chains(links: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(module, group) of chain modules on a cycle: those between two modules of one group, in doubling steps."""
    inner = links.join(groups.select(F.col("module").alias("end"), "group"), "end")
    entered = pairs.join(groups.select(F.col("module").alias("a"), F.col("group").alias("from_group")), "a").select(F.col("b").alias("node"), "from_group").distinct()
    marked = inner.join(entered, (inner["node"] == entered["node"]) & (inner["group"] == entered["from_group"]), "left").select(
        inner["node"], "to", "group", F.col("from_group").isNotNull().alias("mark"))
    rounds = Rounds(links.sparkSession, "chain-marks")
    now, seen = rounds.keep(marked, open=F.count_if(F.col("to").isNotNull() & F.col("mark")))
    while seen["open"]:
        passed = now.where("mark").select(F.col("to").alias("node")).distinct().withColumn("hit", F.lit(True))
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = even_join(now.join(passed, "node", "left"), ahead, "to", "left").select(
            "node", F.col("further").alias("to"), "group", (F.col("mark") | F.col("hit").isNotNull()).alias("mark"))
        now, seen = rounds.keep(after, open=F.count_if(F.col("to").isNotNull() & F.col("mark")))
    return now.where("mark").select(F.col("node").alias("module"), "group")


def circular_dependencies(adjacency: DataFrame) -> DataFrame:
    """Modules that (indirectly) import themselves, each with the name of its cycle group.

    The set is order-free: strongly connected groups of more than one module, and modules importing
    themselves; a group has the name of its largest module.  Chains of modules with one import are shortened to single
    edges first, so a long chain or ring takes a logarithmic number of rounds.  The rest is found by colouring: the largest name that
    reaches a module colours it; the modules of a colour that also reach back to that name form one group; what is
    left is tried again.  Work and storage stay linear in the edges per round.
    """
    spark = adjacency.sparkSession
    pairs, _ = Rounds(spark, "cycle-edges").keep(_pairs(adjacency), n=F.count(F.lit(1)))
    alone = pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("module"), F.col("a").alias("group"))
    proper = pairs.where(F.col("a") != F.col("b"))
    links, rings, shortened = _chains(proper)
    shortened = stage(shortened, "shortened")
    # a chain that leads back to where it left
    found = shortened.where("a = b").select(F.col("a").alias("module"), F.col("a").alias("group"))
    active, left = _trim(shortened.where("a <> b"), "cycle-trim")
    while left:
        names = active.select(F.col("a").alias("node")).union(active.select("b")).distinct()
        colours = _spread_values(active, names.select("node", F.col("node").alias("value")), F.max, "cycle-colours")
        ca = colours.select(F.col("node").alias("a"), F.col("value").alias("ca"))
        cb = colours.select(F.col("node").alias("b"), F.col("value").alias("cb"))
        backwards, _ = Rounds(spark, "cycle-back").keep(active.join(ca, "a").join(cb, "b").where(F.col("ca") == F.col("cb")).select(
            F.col("b").alias("a"), F.col("a").alias("b")), n=F.count(F.lit(1)))
        start = colours.select("node", F.when(F.col("node") == F.col("value"), F.col("value")).alias("value"))
        groups = _spread_values(backwards, start, F.max, "cycle-groups").where(F.col("value").isNotNull())
        sizes = groups.groupBy("value").count().where(F.col("count") > 1).select("value")
        found = found.union(groups.join(sizes, "value", "left_semi").select("node", "value"))
        gone = groups.select("node")
        rest = active.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(
            gone.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
        active, left = _trim(rest, "cycle-trim")
    found = stage(found.groupBy("module").agg(F.max("group").alias("group")), "cycle-found")
    both = found.unionAll(_on_chains(links, proper, found))
    names = both.groupBy("group").agg(F.max("module").alias("cycle_group"))
    named = even_join(both, names, "group").select("module", F.col("cycle_group").alias("group"))
    return named.unionAll(rings).unionAll(alone).groupBy("module").agg(F.max("group").alias("cycle_group"))
