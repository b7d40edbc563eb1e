"""Syntax rules over the ``ast_nodes`` table.

* Local rules look at one node row (its own, parent's and grandparent's facts): one pass, no shuffle.
* Name rules look at a file's names: one aggregate keyed by ``(file_id, name)`` gives the symbol table and
  every name rule is a filter on it.  The key splits even a single huge file.
* Block rules look at siblings: a window over ``(file_id, parent, field)``.
* Containment looks below a loop: a running window over the depth-first order instead of a range join.

Each rule's text is fixed; ``seq`` sorts a file's issues as a report lists them.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegauge import constants as C
from codegauge.functions import scalars as S
from codegauge.functions.syntax import ERROR_KIND
from codegauge.operators.lines import CHECK_STEP, MAJOR_STEP, constant_table, one_of, search
from codegauge.session import scratch_path

JUMPS = ["Return", "Raise", "Break", "Continue"]
EXITS = ["Break", "Return", "Raise"]

# Kinds of the nodes that the operators below read; those of the local rules stand in the rules (``local_kinds``).
IMPORT_KINDS = ["alias"]
BLOCK_KINDS = [kind.__name__ for kind in ast.stmt.__subclasses__()]
NAME_KINDS = ["Name", "FunctionDef", "ClassDef", "alias", "Call"]
LOOP_KINDS = ["While", "Constant", *EXITS]
COMPARE_KINDS = ["Compare", "Name"]
MODULE_KINDS = ["alias", "ClassDef", "FunctionDef", "Module"]
SIGNATURE_KINDS = ["FunctionDef", "arg"]

# Position of each check in a file's report.
CHECK = {
    "ast_calls": 2,
    "ast_imports": 7,
    "ast_undefined_call": 8,
    "ast_unreachable": 11,
    "ast_infinite_loop": 12,
    "ast_unused_var": 13,
    "ast_conditions": 14,
    "ast_empty": 15,
    "ast_redundant_compare": 16,
    "ast_missing_docstring": 18,
    "ast_naming": 19,
    "ast_function_length": 20,
    "ast_deep_nesting": 21,
    "ast_bare_except": 22,
    "ast_mutable_default": 23,
}


def _seq(check: str, major: Column, minor: Column | int = 0) -> Column:
    minor = F.lit(minor) if isinstance(minor, int) else minor
    return F.lit(CHECK[check] * CHECK_STEP) + major.cast("long") * F.lit(MAJOR_STEP) + minor.cast("long")


def _text(template: str, **values: Column) -> Column:
    """``"Rename to '{v}'"`` -> concat of literals and columns."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        key, rest = rest.split("}", 1)
        parts += [F.lit(before), values[key].cast("string")]
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(template)


def _issue(rule_id, severity, category, message, line, suggestion, seq) -> Column:
    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        col(rule_id).alias("rule_id"), col(severity).cast("string").alias("severity"), col(category).alias("category"),
        col(message).cast("string").alias("message"), col(line).cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"), col(suggestion).cast("string").alias("suggestion"), seq.alias("seq"),
    )


def c(name: str) -> Column:
    return F.col(name)


def _assigned_name() -> Column:
    """A plain name that an assignment statement binds directly."""
    return (c("kind") == "Name") & (c("field") == "targets") & (c("p_kind") == "Assign")


@dataclass(frozen=True)
class NodeRule:
    """A rule that one node row of one of the ``kinds`` decides.

    ``on`` says which node the issue belongs to: the row itself, its parent or its grandparent.  Texts may
    name ``{v}`` (the ``value`` column; in the suggestion, rewritten by ``rename``) and ``{n}`` (``number``).
    """

    rule_id: str
    kinds: str
    condition: Column
    severity: str
    category: str
    message: str
    suggestion: str
    check: str
    on: str = "node"
    value: str = "name"
    number: str = "nest"
    rename: str = ""
    minor: int = 0
    per_idx: bool = False  # several issues of one node: ordered by position
    depth_first: bool = False


def _local_rules() -> list[NodeRule]:
    name = c("name")
    private = name.startswith("_")
    single = c("body_n") == 1
    rules: list[NodeRule] = []

    def add(rule_id, kinds, condition, severity, category, message, suggestion, check, **more):
        rules.append(NodeRule(rule_id, kinds, condition, severity, category, message, suggestion, check, **more))

    # security: one walk over the calls of a file
    for function_name, (severity, message) in C.RISKY_CALLS.items():
        add("ast_dangerous_call", "Call", name == function_name, severity, "security", message,
            "Avoid {v}() or sanitize inputs carefully", "ast_calls")
    query = (c("field") == "args") & (c("idx") == 0) & (c("p_kind") == "Call") & c("p_name").isin("execute", "executemany", "raw")
    add("ast_sql_injection", "JoinedStr", query, "critical", "security", "Potential SQL injection via f-string",
        "Use parameterized queries with placeholders", "ast_calls", on="parent", minor=1)
    add("ast_sql_injection", "BinOp", (c("op") == "Mod") & query, "high", "security",
        "Potential SQL injection via string formatting", "Use parameterized queries instead of % formatting", "ast_calls",
        on="parent", minor=1)
    add("ast_shell_true", "Constant",
        c("const_truthy") & (c("field") == "value") & (c("p_kind") == "keyword")
        & (c("p_name") == "shell") & (c("gp_kind") == "Call") & c("gp_name").isin("call", "run"),
        "high", "security", "subprocess with shell=True is vulnerable to injection",
        "Remove shell=True and pass arguments as list", "ast_calls", on="grandparent", minor=2)
    add("ast_os_system", "Call", name == "system", "high", "security", "os.system() is vulnerable to command injection",
        "Use subprocess.run() with shell=False", "ast_calls", minor=3)

    # logic: constant conditions and empty bodies
    test = c("field") == "test"
    fix_it = "Remove the condition or fix the logic"
    add("ast_const_if", "Constant", test & (c("p_kind") == "If") & c("const_truthy"), "low", "logic", "If condition is always True",
        fix_it, "ast_conditions", on="parent")
    add("ast_const_if", "Constant", test & (c("p_kind") == "If") & ~c("const_truthy"), "low", "logic",
        "If condition is always False (body never executes)", fix_it, "ast_conditions", on="parent")
    add("ast_const_while", "Constant", test & (c("p_kind") == "While") & ~c("const_truthy"), "medium", "logic",
        "While condition is always False (loop never executes)", "Remove the loop or fix the condition", "ast_conditions",
        on="parent")
    add("ast_empty_block", "If For While With", single & (c("body_kind") == "Pass"), "info", "logic",
        "Empty {v} block", "Implement the block or remove it", "ast_empty", value="kind")
    abstract = "Implement the function or mark as abstract"
    add("ast_empty_function", "FunctionDef", single & (c("body_kind") == "Pass"), "medium", "logic", "Function '{v}' is empty",
        abstract, "ast_empty")
    add("ast_ellipsis_function", "FunctionDef",
        single & ((c("body_const_type") == "ellipsis") | (c("body_const_val") == "...")), "medium", "logic",
        "Function '{v}' has ellipsis body", abstract, "ast_empty")

    # best practices
    bare = ~F.coalesce(c("body_const_type") == "str", F.lit(False))
    doc = "ast_missing_docstring"
    add(doc, "Module", bare, "info", "best_practices", "Module is missing docstring",
        'Add module docstring: """Module description."""', doc, on="file")
    add(doc, "FunctionDef", bare & ~private, "info", "best_practices", "Function '{v}' is missing docstring",
        'Add docstring: """Description of what function does."""', doc)
    add(doc, "ClassDef", bare, "info", "best_practices", "Class '{v}' is missing docstring",
        'Add docstring: """Class description."""', doc)
    add("ast_function_naming", "FunctionDef", ~private & ~S.is_snake_case(name), "low", "best_practices",
        "Function '{v}' should use snake_case", "Rename to '{v}'", "ast_naming", rename="snake")
    add("ast_class_naming", "ClassDef", ~S.is_pascal_case(name), "low", "best_practices", "Class '{v}' should use PascalCase",
        "Rename to '{v}'", "ast_naming", rename="pascal")
    add("ast_variable_naming", "Name", _assigned_name() & ~private & ~S.is_snake_case(name) & ~S.is_upper(name), "low",
        "best_practices", "Variable '{v}' should use snake_case", "Rename to '{v}'", "ast_naming", on="parent",
        rename="snake", per_idx=True)
    add("ast_function_length", "FunctionDef", c("end_line") - c("line") + 1 > C.MAX_FUNCTION_LENGTH, "medium",
        "best_practices", "Function '{v}' is too long ({n} lines)",
        f"Break into smaller functions (max {C.MAX_FUNCTION_LENGTH} lines)", "ast_function_length", number="length")
    add("ast_deep_nesting", "If For While With Try", c("nest") > C.MAX_NESTING_DEPTH, "medium",
        "best_practices", "Deep nesting detected (depth: {n})", "Extract nested logic into separate functions",
        "ast_deep_nesting", depth_first=True)
    add("ast_bare_except", "ExceptHandler", ~c("typed"), "high", "best_practices",
        "Bare 'except:' catches all exceptions including KeyboardInterrupt",
        "Use 'except Exception:' or be more specific", "ast_bare_except")
    add("ast_mutable_default", "List Dict Set",
        (c("field") == "defaults") & (c("gp_kind") == "FunctionDef"), "medium",
        "best_practices", "Mutable default argument in '{v}'", "Use None as default and create inside function",
        "ast_mutable_default", on="grandparent", value="gp_name", per_idx=True)
    return rules


def _kinds(rules: Sequence[NodeRule]) -> list[str]:
    return sorted({k for r in rules for k in r.kinds.split()})


def _rule_numbers(rules: Sequence[NodeRule]) -> Column:
    """Numbers of the rules that fire on a row, null where one does not.

    Rows branch on their kind first and try only the rules of that kind.
    """
    by_rules: dict[tuple[int, ...], list[str]] = {}
    for kind in _kinds(rules):
        by_rules.setdefault(tuple(i for i, r in enumerate(rules) if kind in r.kinds.split()), []).append(kind)
    chain = None
    for numbers, kinds in by_rules.items():
        fired = F.array(*[F.when(rules[i].condition, F.lit(i)) for i in numbers])
        test = c("kind").isin(*kinds)
        chain = F.when(test, fired) if chain is None else chain.when(test, fired)
    return chain


def local_kinds(only: Sequence[str] | None = None) -> list[str]:
    """Kinds of the nodes that ``local_issues`` reads for these rules."""
    return _kinds([r for r in _local_rules() if only is None or r.rule_id in only])


def local_issues(nodes: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """All rules that one node row decides, in one pass over the node table.

    As with line rules, a row first yields the numbers of the rules that fire; texts are looked up in a
    constant table and filled in for those rows alone, which keeps the code run for every node small.
    """
    rules = [r for r in _local_rules() if only is None or r.rule_id in only]
    numbers = F.explode("rule_nos" if "rule_nos" in nodes.columns else _rule_numbers(rules)).alias("rule_no")
    kept = ["file_id", "node_id", "parent_id", "gp_id", "pre", "idx", "line", "p_line", "gp_line", "end_line", "kind", "name",
            "gp_name", "nest"]
    meta = constant_table([
        {
            "rule_id": r.rule_id, "severity": r.severity, "category": r.category, "message": r.message,
            "suggestion": r.suggestion, "base": CHECK[r.check] * CHECK_STEP + r.minor, "on": r.on, "value": r.value,
            "number": r.number, "rename": r.rename, "per_idx": r.per_idx, "depth_first": r.depth_first,
        }
        for r in rules
    ])
    hits = nodes.where(c("kind").isin(*_kinds(rules))).select(*kept, numbers).where(c("rule_no").isNotNull())
    hits = hits.select("*", F.element_at(meta, c("rule_no") + 1).alias("m"))
    on = c("m.on")
    value = F.when(c("m.value") == "kind", c("kind")).when(c("m.value") == "gp_name", c("gp_name")).otherwise(c("name"))
    number = F.when(c("m.number") == "length", c("end_line") - c("line") + 1).otherwise(c("nest"))
    owner = (F.when(c("m.depth_first"), c("pre")).when(on == "parent", c("parent_id")).when(on == "grandparent", c("gp_id"))
             .otherwise(c("node_id")))
    hits = hits.select(
        "file_id", "m", "idx", F.coalesce(value, F.lit("")).alias("v"), number.cast("string").alias("n"),
        F.when(on == "file", F.lit(1)).when(on == "parent", c("p_line")).when(on == "grandparent", c("gp_line"))
        .otherwise(c("line")).alias("line"),
        owner.cast("long").alias("owner"))
    renamed = (F.when(c("m.rename") == "snake", S.to_snake_case(c("v"))).when(c("m.rename") == "pascal", S.to_pascal_case(c("v")))
               .otherwise(c("v")))
    return hits.select(
        "file_id", "m.rule_id", "m.severity", "m.category",
        F.replace(F.replace(c("m.message"), F.lit("{n}"), c("n")), F.lit("{v}"), c("v")).alias("message"),
        "line", F.lit(None).cast("int").alias("column"),
        F.replace(c("m.suggestion"), F.lit("{v}"), renamed).alias("suggestion"),
        (c("m.base") + c("owner") * F.lit(MAJOR_STEP) + F.when(c("m.per_idx"), c("idx")).otherwise(F.lit(0))).alias("seq"))


# --- parse errors -------------------------------------------------------------------------------------------

def parse_errors(nodes: DataFrame) -> DataFrame:
    return _for(nodes, "error").where(c("kind") == ERROR_KIND).select("file_id", c("name").alias("msg"), "line")


def syntax_error_issues(nodes: DataFrame) -> DataFrame:
    issue = _issue("syntax_error", "critical", "logic", F.concat(F.lit("Syntax error: "), c("msg")), c("line"),
                   "Fix syntax errors before validation", F.lit(0).cast("long"))
    return parse_errors(nodes).select("file_id", issue.alias("i")).select("file_id", "i.*")


# --- names: imports, definitions, uses ----------------------------------------------------------------------

def import_bindings(nodes: DataFrame) -> DataFrame:
    """``file_id, alias, full_name, first_id``: what each imported name stands for, last import wins."""
    full = F.when(c("module").isNotNull(), F.concat_ws(".", "module", "name")).otherwise(c("name"))
    return (
        nodes.where(c("kind") == "alias")
        .select("file_id", "node_id", F.coalesce("asname", "name").alias("alias"), full.alias("full_name"))
        .groupBy("file_id", "alias")
        .agg(F.max_by("full_name", "node_id").alias("full_name"), F.min("node_id").alias("first_id"))
    )


def known_module_names(installed: list[str] | None = None) -> list[str]:
    """Standard library, popular packages and, if given, the packages installed where the code runs."""
    return sorted({*C.STANDARD_LIBRARY, *C.POPULAR_PACKAGES, *(installed or [])})


def known_modules(spark: SparkSession, installed: DataFrame | None = None) -> DataFrame:
    """The known-module dimension; ``installed(module)`` adds a table of further packages."""
    known = spark.createDataFrame([(m,) for m in known_module_names()], "module string")
    return known if installed is None else known.union(installed.select("module")).distinct()


def import_issues(bindings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Invented-looking and unknown imports; they carry no line."""
    base = S.import_base(c("full_name"))
    imports = bindings.withColumn("base", base)
    if known is None:
        unknown = imports.where(~one_of("base", known_module_names()))
    else:
        unknown = imports.join(known.select(c("module").alias("base")), "base", "left_anti")
    folded = F.lower("base")
    fake = search(folded, "|".join(C.SUSPICIOUS_MODULE_PATTERNS))
    real = search(folded, "|".join(C.LIKELY_REAL_PATTERNS))
    issue = F.when(fake, _issue(
        "ast_fake_import", "critical", "hallucination",
        _text("Import '{x}' appears to be hallucinated", x=c("full_name")), None,
        _text("Verify '{x}' exists or find a real alternative", x=c("base")), _seq("ast_imports", c("first_id")),
    )).when(~real, _issue(
        "ast_unknown_import", "medium", "hallucination",
        _text("Import '{x}' is not in standard/popular packages", x=c("full_name")), None,
        _text("Verify '{x}' is installed: pip install {x}", x=c("base")), _seq("ast_imports", c("first_id")),
    ))
    return unknown.select("file_id", issue.alias("i")).where(c("i").isNotNull()).select("file_id", "i.*")


def _invented_call() -> Column:
    return (c("kind") == "Call") & c("func_is_name") & search(F.lower("name"), "|".join(C.SUSPICIOUS_CALL_PATTERNS))


def _names() -> Column:
    """Rows that bind, use or suspiciously call a name."""
    return (_assigned_name() | ((c("kind") == "Name") & (c("ctx") == "Load")) | c("kind").isin("FunctionDef", "ClassDef", "alias")
            | F.coalesce(_invented_call(), F.lit(False)))


def symbols(nodes: DataFrame) -> DataFrame:
    """One row per (file, name): how the name is bound, used and called.

    ``import_name`` and ``assign_line`` belong to the last binding; ``calls`` lists the bare calls whose name
    looks invented (few), so the same aggregate answers the undefined-call rule.
    """
    kind = c("kind")
    assigned = _assigned_name()
    loaded = (kind == "Name") & (c("ctx") == "Load")
    defined = kind.isin("FunctionDef", "ClassDef")
    imported = kind == "alias"
    call = _invented_call()
    full = F.when(c("module").isNotNull(), F.concat_ws(".", "module", "name")).otherwise(c("name"))
    facts = nodes.where(assigned | loaded | defined | imported | call).select(
        "file_id",
        F.when(imported, F.coalesce("asname", "name")).otherwise(c("name")).alias("symbol"),
        "node_id",
        F.when(assigned, c("p_line")).alias("assign_line"),
        F.when(assigned, c("node_id")).alias("assign_id"),
        F.when(imported, full).alias("import_name"),
        F.when(imported, c("node_id")).alias("import_id"),
        loaded.alias("is_loaded"),
        (defined | assigned).alias("is_defined"),
        F.when(call, F.struct("node_id", "line")).alias("call"),
    )
    return facts.groupBy("file_id", c("symbol").alias("name")).agg(
        F.max_by("assign_line", "assign_id").alias("assign_line"),
        F.min("assign_id").alias("first_assign_id"),
        F.max_by("import_name", "import_id").alias("import_name"),
        F.min("import_id").alias("first_import_id"),
        F.bool_or("is_loaded").alias("loaded"),
        F.bool_or("is_defined").alias("defined"),
        F.collect_list("call").alias("calls"),
    )


def unused_variable_issues(table: DataFrame) -> DataFrame:
    issue = _issue("ast_unused_var", "low", "logic", _text("Variable '{v}' is assigned but never used", v=c("name")),
                   c("assign_line"), "Remove unused variable or prefix with _ if intentional",
                   _seq("ast_unused_var", c("first_assign_id")))
    unused = table.where(c("assign_line").isNotNull() & ~c("loaded") & ~c("name").startswith("_"))
    return unused.select("file_id", issue.alias("i")).select("file_id", "i.*")


def undefined_call_issues(table: DataFrame) -> DataFrame:
    """Bare calls of invented-looking names that the file neither defines, assigns nor imports."""
    missing = table.where(
        (F.size("calls") > 0) & ~c("defined") & c("import_name").isNull() & ~one_of("name", C.BUILTIN_NAMES))
    issue = _issue("ast_undefined_call", "critical", "hallucination",
                   _text("Function '{f}' appears hallucinated (not defined or imported)", f=c("name")), c("call.line"),
                   _text("Define '{f}' or import it from a real module", f=c("name")),
                   _seq("ast_undefined_call", c("call.node_id")))
    return missing.select("file_id", "name", F.explode("calls").alias("call")).select(
        "file_id", issue.alias("i")).select("file_id", "i.*")


def symbol_import_bindings(table: DataFrame) -> DataFrame:
    """The import bindings held in a symbol table."""
    return table.where(c("import_name").isNotNull()).select(
        "file_id", c("name").alias("alias"), c("import_name").alias("full_name"), c("first_import_id").alias("first_id"))


def called_but_unbound(nodes: DataFrame) -> DataFrame:
    """Names called bare minus names defined, imported or built in: ``file_id, name``."""
    called = nodes.where((c("kind") == "Call") & c("func_is_name")).select("file_id", "name").distinct()
    bound = nodes.where(c("kind").isin("FunctionDef", "ClassDef") | _assigned_name()).select("file_id", "name")
    imports = nodes.where(c("kind") == "alias").select("file_id", F.coalesce("asname", "name").alias("name"))
    unbuilt = called.where(~one_of("name", C.BUILTIN_NAMES))
    return unbuilt.join(bound.union(imports).distinct(), ["file_id", "name"], "left_anti")


# --- blocks and containment ---------------------------------------------------------------------------------

def _checked_block() -> Column:
    """A statement of a block that the unreachable-code rule looks at."""
    parent, field = c("p_kind"), c("field")
    body_of = ["FunctionDef", "AsyncFunctionDef", "For", "While", "AsyncFor", "With", "AsyncWith", "Try", "If"]
    handler = (parent == "ExceptHandler") & (c("gp_kind") == "Try") & (field == "body")
    return ((field == "body") & parent.isin(body_of)) | ((field == "orelse") & (parent == "If")) | handler


def first_terminator(nodes: DataFrame) -> DataFrame:
    """Statements of checked blocks with the block's first jump: ``stop = (idx, kind)``, null if none."""
    block = Window.partitionBy("file_id", "parent_id", "field")
    jump = F.when(c("kind").isin(JUMPS), F.struct("idx", "kind"))
    return (
        nodes.where(_checked_block() & (c("n_siblings") > 1))
        .select("file_id", "parent_id", "field", "idx", "kind", "line", "node_id",
                F.when(c("p_kind") == "ExceptHandler", c("gp_id")).otherwise(c("parent_id")).alias("owner_id"))
        .withColumn("stop", F.min(jump).over(block))
    )


def unreachable_issues(nodes: DataFrame) -> DataFrame:
    word = F.lower("stop.kind")
    issue = _issue("ast_unreachable", "medium", "logic", _text("Unreachable code after {w}", w=word), c("line"),
                   _text("Remove code after {w} statement", w=word),
                   _seq("ast_unreachable", c("owner_id"), c("node_id")))
    return first_terminator(nodes).where(c("idx") > c("stop.idx")).select(
        "file_id", issue.alias("i")).select("file_id", "i.*")


def _true_test() -> Column:
    return ((c("kind") == "Constant") & (c("field") == "test") & (c("p_kind") == "While")
            & (c("const_type") == "bool") & c("const_truthy"))


def descendant_exits(nodes: DataFrame) -> DataFrame:
    """For every ``while`` loop: is there a Break/Return/Raise anywhere below it, and is its test ``True``.

    Running the depth-first order backwards makes "next exit" a running value, so each file costs one sorted
    pass; no pairs of loops and exits are formed, however many of either a file has.
    """
    after = Window.partitionBy("file_id").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    is_loop = c("kind") == "While"
    is_exit = c("kind").isin(EXITS)
    true_test = _true_test()
    marks = nodes.where(is_loop | is_exit | true_test).select(
        "file_id", "node_id", "pre", "post", "line", is_loop.alias("is_loop"),
        F.when(is_exit, c("pre")).alias("exit_pre"),
        F.when(true_test, c("pre")).alias("true_pre"))
    return marks.select(
        "*",
        F.last("exit_pre", True).over(after).alias("next_exit"),
        F.last("true_pre", True).over(after).alias("next_true"),
    ).where(c("is_loop")).select(
        "file_id", "node_id", "line",
        F.coalesce(c("next_exit") <= c("post"), F.lit(False)).alias("has_exit"),
        # the test is the loop's first child, so it sits right after the loop in depth-first order
        F.coalesce(c("next_true") == c("pre") + 1, F.lit(False)).alias("endless"),
    )


def infinite_loop_issues(nodes: DataFrame) -> DataFrame:
    issue = _issue("ast_infinite_loop", "high", "logic", "Potential infinite loop (while True with no exit)", c("line"),
                   "Add break condition or ensure loop can exit", _seq("ast_infinite_loop", c("node_id")))
    return descendant_exits(nodes).where(c("endless") & ~c("has_exit")).select(
        "file_id", issue.alias("i")).select("file_id", "i.*")


def _compared() -> tuple[Column, Column]:
    """A comparison that may be redundant, and a name that is a side of a comparison."""
    compare = (c("kind") == "Compare") & (c("n_ops") == 1) & c("op").isin("Eq", "NotEq")
    operand = (c("kind") == "Name") & (c("p_kind") == "Compare") & (
        (c("field") == "left") | ((c("field") == "comparators") & (c("idx") == 0)))
    return compare, operand


def redundant_compare_issues(nodes: DataFrame) -> DataFrame:
    """``x == x`` and ``x != x``: a comparison and its two name operands meet on the comparison's id."""
    compare, operand = _compared()
    sides = nodes.where(compare | operand).select(
        "file_id", F.when(operand, c("parent_id")).otherwise(c("node_id")).alias("at"),
        F.when(compare, c("op")).alias("op"), F.when(compare, c("line")).alias("line"),
        F.when(operand & (c("field") == "left"), c("name")).alias("a"),
        F.when(operand & (c("field") == "comparators"), c("name")).alias("b"),
    ).groupBy("file_id", "at").agg(*[F.max(x).alias(x) for x in ("op", "line", "a", "b")])
    sign = F.when(c("op") == "Eq", "==").otherwise("!=")
    issue = _issue("ast_redundant_compare", "low", "logic", _text("Redundant comparison: {a} {s} {a}", a=c("a"), s=sign),
                   c("line"),
                   F.when(c("op") == "Eq", "This is always True, check if this is intentional")
                   .otherwise("This is always False, check if this is intentional"),
                   _seq("ast_redundant_compare", c("at")))
    return sides.where(c("op").isNotNull() & (c("a") == c("b"))).select(
        "file_id", issue.alias("i")).select("file_id", "i.*")


# --- tables drawn from nodes --------------------------------------------------------------------------------

def module_symbols(nodes: DataFrame) -> DataFrame:
    """Per file: imported names, exports, classes and public functions, in walk order."""
    kind = c("kind")
    full = F.when(c("module").isNotNull(), F.concat_ws(".", "module", "name")).otherwise(c("name"))
    is_class, is_function = kind == "ClassDef", (kind == "FunctionDef") & ~c("name").startswith("_")
    rows = nodes.where(kind.isin(MODULE_KINDS)).select(
        "file_id", "node_id",
        F.when(kind == "alias", full).alias("imp"),
        F.when(is_class | is_function, c("name")).alias("export"),
        F.when(is_class, c("name")).alias("cls"),
        F.when(is_function, c("name")).alias("fn"))

    def ordered(column: str) -> Column:
        pairs = F.collect_list(F.when(c(column).isNotNull(), F.struct("node_id", c(column).alias("v"))))
        return F.transform(F.array_sort(pairs), lambda p: p["v"])

    return rows.groupBy("file_id").agg(
        ordered("imp").alias("imports"), ordered("export").alias("exports"),
        ordered("cls").alias("classes"), ordered("fn").alias("functions"))


def function_signatures(nodes: DataFrame) -> DataFrame:
    """Public functions with their positional parameters (without self) and return annotation."""
    is_function = (c("kind") == "FunctionDef") & ~c("name").startswith("_")
    is_param = ((c("kind") == "arg") & (c("field") == "args") & (c("gp_kind") == "FunctionDef")
                & (c("name") != "self") & ~c("gp_name").startswith("_"))
    rows = nodes.where(is_function | is_param).select(
        "file_id", F.when(is_function, c("node_id")).otherwise(c("gp_id")).alias("function_id"),
        F.when(is_function, c("name")).alias("name"), F.when(is_function, c("line")).alias("line"),
        F.when(is_function, c("annotation")).alias("returns"),
        F.when(is_param, F.struct("idx", c("name").alias("v"))).alias("param"))
    return rows.groupBy("file_id", "function_id").agg(
        F.max("name").alias("name"), F.max("line").alias("line"), F.max("returns").alias("returns"),
        F.transform(F.array_sort(F.collect_list("param")), lambda p: p["v"]).alias("params"))


# --- one parse, one narrow table ----------------------------------------------------------------------------

def _uses() -> dict[str, tuple[Column, list[str]]]:
    """Which rows each group of rules reads, and of them which columns."""
    kind = c("kind")
    compare, operand = _compared()
    return {
        "hit": (F.size("rule_nos") > 0, ["rule_nos", "node_id", "parent_id", "gp_id", "pre", "idx", "line", "p_line", "gp_line", "end_line",
                                         "kind", "name", "gp_name", "nest"]),
        "name": (_names(), ["node_id", "kind", "field", "p_kind", "ctx", "func_is_name", "name", "asname", "module", "p_line", "line"]),
        "block": (_checked_block() & (c("n_siblings") > 1), [
            "node_id", "parent_id", "gp_id", "field", "idx", "n_siblings", "kind", "p_kind", "gp_kind", "line"]),
        "loop": ((kind == "While") | kind.isin(EXITS) | _true_test(), [
            "node_id", "kind", "field", "p_kind", "const_type", "const_truthy", "pre", "post", "line"]),
        "compare": (compare | operand, ["node_id", "parent_id", "kind", "p_kind", "field", "idx", "n_ops", "op", "name", "line"]),
        "error": (kind == ERROR_KIND, ["kind", "name", "line"]),
    }


def staged_facts(nodes: DataFrame) -> DataFrame:
    """What the syntax rules read of ``nodes``, worked out in the pass that parses and written by use.

    Rules that one row decides are decided here, so of those rows only the few with an issue are kept; the other rules keep the
    rows and columns they read.  ``use`` is the folder, so a rule reads its own rows alone; columns of other uses are
    null.  The result stands for the node table in ``syntax_issues`` and ``parse_errors``.
    """
    spark = nodes.sparkSession
    rules = _rule_numbers(_local_rules())
    numbered = nodes.withColumn("rule_nos", F.array_compact(F.coalesce(rules, F.array().cast("array<int>"))))
    uses = _uses()
    # a load counts once for its file and name anyway: its place is left out, so equal rows pack well
    load = (c("kind") == "Name") & (c("ctx") == "Load")
    tagged = numbered.withColumn("use", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(use)) for use, (cond, _) in uses.items()]))))
    columns = list(dict.fromkeys(x for _, names in uses.values() for x in names))

    def slim(name: str) -> Column:
        keep = c("use").isin(*[use for use, (_, names) in uses.items() if name in names])
        if name in ("node_id", "p_line", "line", "field", "p_kind"):
            keep = keep & ~((c("use") == "name") & load)
        return F.when(keep, c(name)).alias(name)

    facts = tagged.select("file_id", *[slim(n) for n in columns], "use")
    path = scratch_path(spark, "facts")
    facts.write.partitionBy("use").parquet(path)
    return spark.read.schema(facts.schema).parquet(path)


def _for(nodes: DataFrame, use: str) -> DataFrame:
    return nodes.where(c("use") == use) if "use" in nodes.columns else nodes


def syntax_issues(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Issues of every syntax rule.

    ``nodes`` feeds six branches; pass ``staged_facts`` of the node table, or the staged table itself, so that texts
    are parsed once and each branch reads only the columns it needs.
    """
    table = symbols(_for(nodes, "name"))
    parts = [
        local_issues(_for(nodes, "hit")),
        syntax_error_issues(nodes),
        import_issues(symbol_import_bindings(table), known),
        undefined_call_issues(table),
        unused_variable_issues(table),
        unreachable_issues(_for(nodes, "block")),
        infinite_loop_issues(_for(nodes, "loop")),
        redundant_compare_issues(_for(nodes, "compare")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
