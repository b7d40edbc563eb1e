"""Queries over a module graph grown from the part table.

Row k of ``part`` is one file; ten rows form a group g = k // 10:

====  ======================  ==================================================================
k%10  file                    imports
====  ======================  ==================================================================
0     pkg_g/__init__.py       os.path; in even groups also mod_(10g+4)
1     pkg_g/core.py           pkg_g.util, json
2     pkg_g/util.py           pkg_g.core (in groups with g%4 = 1)
3     broken_k.py             (does not parse)
4, 5  mod_k.py                mod_(k+1)
6     mod_k.py                even groups: mod_(k-2) (a ring) and, if g%4 = 0, mod_(k+1); odd groups: mod_(k+1)
7     mod_k.py                pkg_g and nowhere_g.x (missing)
8     mod_k.py                even groups: pkg_0 (a hub for the whole corpus); odd groups: itself
9     mod_k.py                pkg_g.core as c, and the unparseable broken_(k-6)
====  ======================  ==================================================================
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.catalog.common import query, table
from codegauge.functions.syntax import ast_nodes
from codegauge.operators import modules as M
from codegauge.operators.skew import even_join
from codegauge.plans.validate import validate
from codegauge.session import spread_rows, stage


def graph_files(spark, sf_dir):
    k = F.col("p_partkey")
    g, r = F.floor(k / 10), k % 10

    def say(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    even = g % 2 == 0
    path = (F.when(r == 0, say("pkg_", g, "/__init__.py")).when(r == 1, say("pkg_", g, "/core.py"))
            .when(r == 2, say("pkg_", g, "/util.py")).when(r == 3, say("broken_", k, ".py")).otherwise(say("mod_", k, ".py")))
    code = (
        F.when(r == 0, F.concat(F.lit("from os import path\n"), F.when(even, say("import mod_", g * 10 + 4, "\n")).otherwise("")))
        .when(r == 1, say("import pkg_", g, ".util\nimport json\n"))
        .when(r == 2, F.when(g % 4 == 1, say("from pkg_", g, " import core\n")).otherwise("SIZE = 1\n"))
        .when(r == 3, F.lit("def broken(:\n"))
        .when(r.isin(4, 5), say("import mod_", k + 1, "\n"))
        .when(r == 6, F.when(even, F.concat(say("import mod_", k - 2, "\n"), F.when(g % 4 == 0, say("import mod_", k + 1, "\n")).otherwise("")))
              .otherwise(say("import mod_", k + 1, "\n")))
        .when(r == 7, say("import pkg_", g, "\nfrom nowhere_", g, " import x\n"))
        .when(r == 8, F.when(even, F.lit("import pkg_0\n")).otherwise(say("import mod_", k, "\n")))
        .otherwise(say("import pkg_", g, ".core as c\nimport broken_", k - 6, "\n")))
    return spread_rows(table(spark, sf_dir, "part").select("p_partkey")).select(
        k.alias("file_id"), path.alias("path"), F.lit("python").alias("language"), code.alias("code"))


def graph(spark, sf_dir):
    files = graph_files(spark, sf_dir)
    nodes = stage(ast_nodes(files), "graph-nodes")
    mods = stage(M.modules(files, nodes), "graph-modules")
    return mods, stage(M.module_imports(mods, nodes), "graph-imports")


GRAPH = """k AS (SELECT p_partkey AS k, p_partkey // 10 AS g, p_partkey % 10 AS r FROM part),
  mods AS (SELECT k, g, r, CASE r WHEN 0 THEN 'pkg_' || g WHEN 1 THEN 'pkg_' || g || '.core' WHEN 2 THEN 'pkg_' || g || '.util' ELSE 'mod_' || k END AS module FROM k WHERE r <> 3),
  imports AS (
    SELECT module, 'os.path' AS imp, 1 AS ord FROM mods WHERE r = 0
    UNION ALL SELECT module, 'mod_' || (10 * g + 4), 2 FROM mods WHERE r = 0 AND g % 2 = 0
    UNION ALL SELECT module, 'pkg_' || g || '.util', 1 FROM mods WHERE r = 1
    UNION ALL SELECT module, 'json', 2 FROM mods WHERE r = 1
    UNION ALL SELECT module, 'pkg_' || g || '.core', 1 FROM mods WHERE r = 2 AND g % 4 = 1
    UNION ALL SELECT module, 'mod_' || (k + 1), 1 FROM mods WHERE r IN (4, 5)
    UNION ALL SELECT module, 'mod_' || (k - 2), 1 FROM mods WHERE r = 6 AND g % 2 = 0
    UNION ALL SELECT module, 'mod_' || (k + 1), 2 FROM mods WHERE r = 6 AND g % 4 <> 2
    UNION ALL SELECT module, 'pkg_' || g, 1 FROM mods WHERE r = 7
    UNION ALL SELECT module, 'nowhere_' || g || '.x', 2 FROM mods WHERE r = 7
    UNION ALL SELECT module, 'pkg_0', 1 FROM mods WHERE r = 8 AND g % 2 = 0
    UNION ALL SELECT module, module, 1 FROM mods WHERE r = 8 AND g % 2 = 1
    UNION ALL SELECT module, 'pkg_' || g || '.core', 1 FROM mods WHERE r = 9
    UNION ALL SELECT module, 'broken_' || (k - 6), 2 FROM mods WHERE r = 9),
  adj AS (SELECT i.module AS from_module, m.module AS to_module, i.ord FROM imports i JOIN mods m ON m.module = string_split(i.imp, '.')[1])"""
REACH = GRAPH + """, reach(a, b) AS (SELECT from_module, to_module FROM adj UNION SELECT r.a, e.to_module FROM reach r JOIN adj e ON e.from_module = r.b)"""


@query("module_scan", f"WITH {GRAPH} SELECT k AS file_id, module FROM mods")
def module_scan(spark, sf_dir):
    return graph(spark, sf_dir)[0].select("file_id", "module")


@query("import_bases", f"WITH {GRAPH} SELECT DISTINCT string_split(imp, '.')[1] AS base FROM imports")
def import_bases(spark, sf_dir):
    return M.import_bases(graph(spark, sf_dir)[1])


@query("module_edges", f"WITH {GRAPH} SELECT i.module AS from_module, m.module AS to_module, i.imp FROM imports i JOIN mods m "
       "ON (m.module = i.imp OR starts_with(m.module, i.imp || '.')) AND m.module <> i.module")
def module_edges(spark, sf_dir):
    """Every import with every file that it leads to: the edges as intervals of the name tree, then listed."""
    mods, imports = graph(spark, sf_dir)
    ranks = stage(M.name_ranks(mods), "name-ranks")
    # files may share a name: each of them is a target
    return M.edge_pairs(M.module_edges(imports, ranks), even_join(mods.select("module"), ranks, "module"))


@query("module_edge_pairs", f"WITH {GRAPH} SELECT i.module AS from_module, m.module AS to_module, i.imp FROM imports i JOIN mods m "
       "ON (m.module = i.imp OR starts_with(m.module, i.imp || '.')) AND m.module <> i.module")
def module_edge_pairs(spark, sf_dir):
    """The same edges, with every name they lead to."""
    mods, imports = graph(spark, sf_dir)
    ranks = stage(M.name_ranks(mods), "name-ranks")
    return M.edge_pairs(M.module_edges(imports, ranks), ranks)


@query("module_adjacency", f"WITH {GRAPH} SELECT from_module, to_module FROM adj")
def module_adjacency(spark, sf_dir):
    mods, imports = graph(spark, sf_dir)
    return M.module_adjacency(imports, mods).select("from_module", "to_module")


@query("dependency_graph", f"WITH {GRAPH} SELECT from_module AS module, string_agg(to_module, ',' ORDER BY ord) AS depends_on FROM adj GROUP BY 1")
def dependency_graph(spark, sf_dir):
    mods, imports = graph(spark, sf_dir)
    lists = M.dependency_graph(M.module_adjacency(imports, mods))
    return lists.select("module", F.array_join("depends_on", ",").alias("depends_on"))


@query("unused_modules", f"WITH {GRAPH} SELECT module FROM mods WHERE string_split(module, '.')[1] NOT IN (SELECT string_split(imp, '.')[1] FROM imports)")
def unused_modules(spark, sf_dir):
    return M.unused_modules(*graph(spark, sf_dir))


@query("missing_modules", f"WITH {GRAPH} SELECT module, imp AS \"import\", 'Module ''' || module || ''' imports non-existent module ''' || imp || '''' AS message FROM imports "
       "WHERE string_split(imp, '.')[1] NOT IN (SELECT module FROM mods) AND string_split(imp, '.')[1] NOT IN ('os', 'json')")
def missing_modules(spark, sf_dir):
    mods, imports = graph(spark, sf_dir)
    return M.missing_modules(imports, mods)


# Scores of the graph's files: every module lacks its docstring (no cost); imports unknown to the engine cost 8 points
# of hallucinations each (medium), the unused import bindings cost nothing, and SIZE is never used (3 points of logic).
_TRUST = f"""WITH {GRAPH}, cost AS (SELECT module, count(*) * 8 AS c FROM imports WHERE imp NOT IN ('os.path', 'json') GROUP BY 1),
  t AS (SELECT m.module, CAST(floor((100 * 2.0 + (100 - coalesce(c, 0)) * 2.5 + (100 - CASE WHEN r = 2 AND g % 4 <> 1 THEN 3 ELSE 0 END) + 50.0) / 6.0) AS INTEGER) AS trust_score
        FROM mods m LEFT JOIN cost USING (module))"""


@query("module_trust", _TRUST + " SELECT module, trust_score FROM t UNION ALL SELECT '(overall)', CAST(floor(sum(trust_score) / count(*)) AS INTEGER) FROM t")
def module_trust(spark, sf_dir):
    """Scores of all modules, and the project's mean."""
    files = graph_files(spark, sf_dir)
    nodes = stage(ast_nodes(files), "graph-nodes")
    trust = stage(M.module_trust(M.modules(files, nodes), validate(files, nodes=nodes).results), "module-trust")
    total = M.overall_trust(trust).select(F.lit("(overall)").alias("module"), F.col("overall_score").alias("trust_score"))
    return trust.unionByName(total)


@query("graph_summary", f"WITH {GRAPH}, d AS (SELECT m.module, (SELECT count(*) FROM adj WHERE from_module = m.module) AS o, (SELECT count(*) FROM adj WHERE to_module = m.module) AS i FROM mods m) "
       "SELECT count(*) AS modules, sum(o) AS edges, count(*) FILTER (i = 0) AS roots, count(*) FILTER (o = 0) AS leaves, max(i) AS max_in, max(o) AS max_out FROM d")
def graph_summary(spark, sf_dir):
    mods, imports = graph(spark, sf_dir)
    return M.graph_summary(M.degrees(mods, M.module_adjacency(imports, mods)))


@query("circular_dependencies", f"WITH RECURSIVE {REACH}, c AS (SELECT a AS module FROM reach WHERE a = b) "
       "SELECT c.module, (SELECT max(r.b) FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a WHERE r.a = c.module) AS cycle_group FROM c")
def circular_dependencies(spark, sf_dir):
    mods, imports = graph(spark, sf_dir)
    return M.circular_dependencies(M.module_adjacency(imports, mods))


@query("dependency_closure", f"WITH RECURSIVE {GRAPH}, roots AS (SELECT module FROM mods WHERE string_split(module, '.')[1] NOT IN (SELECT string_split(imp, '.')[1] FROM imports)), "
       "walk(module, hops) USING KEY (module) AS (SELECT module, 0 FROM roots UNION SELECT e.to_module, min(w.hops + 1) FROM walk w JOIN adj e ON e.from_module = w.module "
       "LEFT JOIN recurring.walk seen ON seen.module = e.to_module WHERE seen.module IS NULL GROUP BY 1) SELECT module, hops FROM walk")
def dependency_closure(spark, sf_dir):
    """Everything reachable from the modules nobody imports."""
    mods, imports = graph(spark, sf_dir)
    return M.dependency_closure(mods, M.module_adjacency(imports, mods), M.unused_modules(mods, imports))


@query("dependency_clusters", f"WITH RECURSIVE {GRAPH}, either AS (SELECT from_module AS a, to_module AS b FROM adj UNION SELECT to_module, from_module FROM adj), "
       "hub AS (SELECT module FROM mods WHERE g % 2 = 0 AND r = 8 OR g = 0), "
       "walk(a, b) AS (SELECT module, module FROM mods WHERE module NOT IN (SELECT module FROM hub) UNION SELECT w.a, e.b FROM walk w JOIN either e ON e.a = w.b WHERE e.b NOT IN (SELECT module FROM hub)), "
       "local AS (SELECT a AS module, min(b) AS cluster FROM walk GROUP BY 1), "
       "joined AS (SELECT DISTINCT w.a FROM walk w JOIN either e ON e.a = w.b JOIN hub h ON h.module = e.b WHERE e.b = 'pkg_0' OR e.b IN (SELECT module FROM hub)), "
       "linked AS (SELECT module FROM hub h WHERE EXISTS (SELECT 1 FROM either e WHERE e.a = h.module) UNION SELECT a FROM joined) "
       "SELECT l.module, CASE WHEN l.module IN (SELECT module FROM linked) THEN (SELECT min(module) FROM linked) ELSE l.cluster END AS cluster FROM local l "
       "UNION ALL SELECT module, CASE WHEN module IN (SELECT module FROM linked) THEN (SELECT min(module) FROM linked) ELSE module END FROM hub")
def dependency_clusters(spark, sf_dir):
    mods, imports = graph(spark, sf_dir)
    return M.dependency_clusters(mods, M.module_adjacency(imports, mods))
