"""A directory of several languages, from the files to scores and the import graph."""

from codegauge.functions.syntax import ast_nodes
from codegauge.operators import modules as M
from codegauge.plans.validate import validate
from codegauge.sources.files import drop_ignored, scan_files_multilang

TREE = {
    "app.py": '"""App."""\nimport pkg\nfrom pkg import core\n',
    "pkg/__init__.py": '"""Package."""\n',
    "pkg/core.py": '"""Core."""\nimport pkg.util\n',
    "pkg/util.PY": '"""Util."""\nimport pkg.core\neval(input)\n',
    "pkg/broken.py": "def broken(:\n",
    "pkg/__pycache__/old.py": "x = 1\n",
    "web/page.tsx": "eval(x);\n",
    "web/page.js": "let a = 1;\n",
    "vendor/lib.py": "import app\n",
    "notes/readme.txt": "eval(x)\n",
    "my dir/with+plus.py": '"""Odd name."""\nimport app\n',
}


def test_scan_ignore_validate_and_graph(spark, tmp_path):
    root = tmp_path / "a project"
    for name, code in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(code)
    files = drop_ignored(scan_files_multilang(spark, str(root)), str(root), ["vendor"])
    assert {r.rel_path: r.language for r in files.collect()} == {
        n: "javascript" if n.endswith(".js") else "typescript" if n.endswith(".tsx") else "python"
        for n in TREE if not n.startswith(("vendor", "notes"))}

    run = validate(files)
    scores = {r.path.split("a project/")[1]: r.trust_score for r in run.results.collect()}
    assert scores["app.py"] < 100       # two unknown imports
    assert scores["pkg/broken.py"] == 0 and scores["web/page.js"] == 100 and scores["web/page.tsx"] < 100 and scores["pkg/__init__.py"] == 100
    found = {(r.file_id.split("a project/")[1], r.rule_id) for r in run.issues.collect()}
    assert {("pkg/util.PY", "ast_dangerous_call"), ("pkg/broken.py", "syntax_error")} <= found

    nodes = ast_nodes(files.where("language = 'python'"))
    mods = M.modules(files, nodes)
    assert {r.module for r in mods.collect()} == {"app", "pkg", "pkg.core", "pkg.util.PY", "my dir.with+plus"}
    imports = M.module_imports(mods, nodes)
    ranks = M.name_ranks(mods)
    edges = M.module_edges(imports, ranks)
    pairs = {(r.from_module, r.to_module) for r in M.edge_pairs(edges, ranks).collect()}
    assert pairs == {("app", "pkg"), ("app", "pkg.core"), ("app", "pkg.util.PY"), ("my dir.with+plus", "app"), ("pkg.util.PY", "pkg.core"),
                     ("pkg.core", "pkg.util.PY")}       # only the lower-case ending is cut off, as the name rule says
    trust = {r.module: r.trust_score for r in M.module_trust(mods, run.results).collect()}
    assert set(trust) == {r.module for r in mods.collect()} and trust["pkg"] == 100
