"""Syntax trees as rows.

One Arrow function turns a batch of Python texts into flat node rows: the only step of the engine that leaves
the JVM.  It knows nothing about rules; a row carries a node's own facts, its place in the tree, the kind of
its first body statement and a few facts of its parent and grandparent, so that most rules are plain filters
and need neither a join nor a shuffle.

* ``node_id`` counts breadth-first, as ``ast.walk`` visits, because "last binding wins" depends on it.
* ``pre``/``post`` is a depth-first interval: B lies below A when ``A.pre < B.pre <= A.post``.
* ``nest`` counts the enclosing (and own) If/For/While/With/Try nodes.
* A text that cannot be parsed, for whatever reason, gives one row of kind ``SyntaxError`` and no nodes.

Output leaves the worker in batches of bounded size, so a huge file never becomes a huge row.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pyspark import cloudpickle

ERROR_KIND = "SyntaxError"
MAX_BATCH_ROWS = 20_000

# (column, Arrow type, SQL type) of a node row after file_id.
_COLUMNS = [
    ("node_id", pa.int32(), "int"),
    ("parent_id", pa.int32(), "int"),
    ("field", pa.string(), "string"),
    ("idx", pa.int32(), "int"),
    ("n_siblings", pa.int32(), "int"),
    ("kind", pa.string(), "string"),
    ("line", pa.int32(), "int"),
    ("end_line", pa.int32(), "int"),
    ("pre", pa.int32(), "int"),
    ("post", pa.int32(), "int"),
    ("nest", pa.int32(), "int"),
    ("name", pa.string(), "string"),  # def, class, name, attribute, alias, argument or keyword; Call: function name
    ("asname", pa.string(), "string"),
    ("module", pa.string(), "string"),  # alias rows: module of the enclosing from-import
    ("func_is_name", pa.bool_(), "boolean"),
    ("const_type", pa.string(), "string"),
    ("const_val", pa.string(), "string"),
    ("const_truthy", pa.bool_(), "boolean"),
    ("op", pa.string(), "string"),
    ("n_ops", pa.int32(), "int"),
    ("ctx", pa.string(), "string"),
    ("typed", pa.bool_(), "boolean"),  # except handler that names a type
    ("annotation", pa.string(), "string"),  # function: source of the return annotation
    ("body_kind", pa.string(), "string"),  # kind of the first statement of the body
    ("body_n", pa.int32(), "int"),
    ("body_const_type", pa.string(), "string"),  # ... and its constant, if it is a bare constant
    ("body_const_val", pa.string(), "string"),
    ("p_kind", pa.string(), "string"),
    ("p_name", pa.string(), "string"),
    ("p_line", pa.int32(), "int"),
    ("gp_id", pa.int32(), "int"),
    ("gp_kind", pa.string(), "string"),
    ("gp_name", pa.string(), "string"),
    ("gp_line", pa.int32(), "int"),
]
COLUMN_NAMES = [name for name, _, _ in _COLUMNS]

_NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try)
_FOLDED_INTO_PARENT = (ast.expr_context, ast.operator, ast.cmpop, ast.unaryop, ast.boolop)


def _text(value):
    """A string Arrow can hold (lone surrogates replaced)."""
    return value.encode("utf-8", "replace").decode("utf-8") if value is not None else None


def _const(node):
    value = node.value
    try:
        shown = value if isinstance(value, str) else str(value)
    except ValueError:  # an integer too long to print
        shown = None
    return type(value).__name__, _text(shown), bool(value)


_CLASSES: dict = {}  # a plain dict: it travels by value with the functions below, which a function cache does not


def _class_facts(kind):
    """What all nodes of a class share: (class name, field that names the node, folded, nesting, other facts).

    The other facts are None for a class that has none of the fields or kinds looked at there.
    """
    fields = kind._fields
    slot = next((s for s in ("name", "id", "attr", "arg") if s in fields), None)
    called, constant, alias = issubclass(kind, ast.Call), issubclass(kind, ast.Constant), issubclass(kind, ast.alias)
    other = (called, constant, alias, "op" in fields, "ops" in fields, issubclass(kind, ast.Compare), "ctx" in fields,
             issubclass(kind, ast.ExceptHandler), "body" in fields, "returns" in fields)
    found = _CLASSES[kind] = (kind.__name__, slot, issubclass(kind, _FOLDED_INTO_PARENT), issubclass(kind, _NESTING),
                              other if any(other) else None)
    return found


def _label(node, slot):
    if isinstance(node, ast.Call):
        return node.func.id if isinstance(node.func, ast.Name) else getattr(node.func, "attr", "")
    value = getattr(node, slot) if slot else None
    return value if isinstance(value, str) else None


def _walk(tree):
    """Breadth-first list of (node, parent position, field, idx, n_siblings)."""
    order = [(tree, -1, None, 0, 1)]
    is_node, add = ast.AST, order.append
    for at, entry in enumerate(order):  # the list grows while it is read
        node = entry[0]
        for field in node._fields:
            value = getattr(node, field, None)
            if isinstance(value, is_node):
                add((value, at, field, 0, 1))
            elif isinstance(value, list):
                n = len(value)
                for i, item in enumerate(value):
                    if isinstance(item, is_node):
                        add((item, at, field, i, n))
    return order


_NO_FACTS = (None,) * 11 + (None, 0, None, None)  # asname to annotation, then body_kind to body_const_val


def _own_facts(node, above, other):
    """``asname`` to ``body_const_val`` of one node."""
    called, constant, alias, op, ops, compare, ctx, handler, has_body, has_returns = other
    value = _const(node) if constant else (None, None, None)
    operator = node.op if op else node.ops[0] if ops else None
    body = node.body if has_body and isinstance(node.body, list) else ()
    first = body[0] if body else None
    bare = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant)
    body_const = _const(first.value) if bare else (None, None, None)
    returns = node.returns if has_returns else None
    try:
        annotation = _text(ast.unparse(returns)) if returns is not None else None
    except RecursionError:
        annotation = None
    return (
        node.asname if alias else None,
        above.module if alias and isinstance(above, ast.ImportFrom) else None,
        isinstance(node.func, ast.Name) if called else None,
        *value,
        type(operator).__name__ if operator is not None else None,
        len(node.ops) if compare else None,
        type(node.ctx).__name__ if ctx else None,
        node.type is not None if handler else None,
        annotation,
        type(first).__name__ if first is not None else None, len(body), body_const[0], body_const[1],
    )


def node_rows(code: str, wanted=None) -> list[tuple]:
    """Rows of one text, in ``COLUMN_NAMES`` order; of all its nodes, or of those of the ``wanted`` kinds."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        if wanted is not None and ERROR_KIND not in wanted:
            return []
        at = getattr(error, "lineno", None)
        row = dict.fromkeys(COLUMN_NAMES)
        row.update(node_id=0, kind=ERROR_KIND, line=at, name=_text(getattr(error, "msg", None) or str(error)))
        return [tuple(row.values())]

    order = _walk(tree)
    n = until = len(order)
    if wanted is not None:  # parents come first, so nothing behind the last wanted node is asked for
        until = max((at for at, entry in enumerate(order, 1) if type(entry[0]).__name__ in wanted), default=0)
        if not until:
            return []
    size = [1] * n
    for at in range(n - 1, 0, -1):
        size[order[at][1]] += size[at]
    pre, free, nest, kinds, labels, lines = [0] * n, [1] * n, [0] * n, [None] * n, [None] * n, [None] * n

    rows = []
    for at, (node, parent, field, idx, n_siblings) in enumerate(islice(order, until)):  # parents come first, so their facts are there
        kind, slot, folded, nesting, other = _CLASSES.get(type(node)) or _class_facts(type(node))
        if parent >= 0:
            start = pre[at] = free[parent]
            free[parent] = start + size[at]
            free[at] = start + 1
            nest[at] = nest[parent] + nesting
        else:
            start, nest[at] = 0, int(nesting)
        if folded:
            continue
        kinds[at] = kind
        label = labels[at] = _label(node, slot) if slot or kind == "Call" else None
        line = lines[at] = getattr(node, "lineno", None)
        if wanted is not None and kind not in wanted:
            continue
        above = order[parent][0] if parent >= 0 else None
        own = _own_facts(node, above, other) if other else _NO_FACTS
        gp = order[parent][1] if parent >= 0 else -1
        rows.append((
            at, parent if parent >= 0 else None, field, idx, n_siblings, kind, line, getattr(node, "end_lineno", None),
            start, start + size[at] - 1, nest[at], label, *own,
            *((kinds[parent], labels[parent], lines[parent]) if parent >= 0 else (None, None, None)),
            *((gp, kinds[gp], labels[gp], lines[gp]) if gp >= 0 else (None, None, None, None)),
        ))
    return rows


def _flatten(batches, wanted=None):
    """Record batches of (file_id, code) to record batches of node rows."""
    def emit(ids, owners, rows):
        columns = list(zip(*rows))
        arrays = [ids.take(pa.array(owners, pa.int32()))]
        arrays += [pa.array(values, kind) for values, (_, kind, _) in zip(columns, _COLUMNS)]
        return pa.RecordBatch.from_arrays(arrays, ["file_id", *COLUMN_NAMES])

    for batch in batches:
        ids, owners, rows = batch.column(0), [], []
        for at, code in enumerate(batch.column(1)):
            text = code.as_py()
            for row in node_rows(text if text is not None else "", wanted):
                owners.append(at)
                rows.append(row)
                if len(rows) >= MAX_BATCH_ROWS:
                    yield emit(ids, owners, rows)
                    owners, rows = [], []
        if rows:
            yield emit(ids, owners, rows)


def ast_nodes(files: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """The node table of ``files(file_id, code, ...)``; one row per syntax node.

    For a reader of some ``kinds`` only, the rows of the others are dropped where they arise: every text is parsed and walked
    whole, and the rows are those of the whole table with one of these kinds (``ERROR_KIND`` is one of its own).
    """
    wanted = None if kinds is None else frozenset(kinds)

    def flatten(batches):
        return _flatten(batches, wanted)

    kind = files.schema["file_id"].dataType.simpleString()
    schema = f"file_id {kind}, " + ", ".join(f"`{name}` {sql}" for name, _, sql in _COLUMNS)
    return files.select("file_id", "code").mapInArrow(flatten, T._parse_datatype_string(schema))


def _ship_by_value() -> None:
    """Send this module's functions with the task, so executors need no copy of the package."""
    import codegauge.functions.syntax as module

    cloudpickle.register_pickle_by_value(module)


_ship_by_value()
