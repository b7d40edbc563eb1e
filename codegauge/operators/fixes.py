"""Fix suggestions: issues joined with their source line, then a rewritten line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge import constants as C
from codegauge.operators.lines import code_lines, regex, search
from codegauge.operators.literals import holding
from codegauge.operators.sketch import Wanted
from codegauge.session import stage


def issue_lines(issues: DataFrame, lines: DataFrame) -> DataFrame:
    """Issues with the text of their line, empty when the issue has no line or the line does not exist.

    Both sides shuffle by (file_id, line), so one very long file spreads over all tasks.  The lines are never broadcast:
    Spark takes them to be as small as the table that their texts are made from.
    """
    text = lines.select("file_id", F.col("line_no").alias("line"), F.col("line").alias("original")).hint("merge")
    return issues.join(text, ["file_id", "line"], "left").withColumn("original", F.coalesce("original", F.lit("")))


def _says(text: str) -> Column:
    return F.col("message").contains(text)


def _says_folded(text: str) -> Column:
    return F.lower("message").contains(text)


def parameterised_query(line: Column) -> Column:
    """First f-string with one plain placeholder -> query text with ``?`` and a value tuple; null if none."""
    pattern = r"""^(.*?)f["'](.+?)\{(\w+)\}(.+?)["']"""
    return F.when(search(line, pattern), F.regexp_replace(line, regex(pattern), '$1"$2?$4", ($3,)'))


def environment_lookup(line: Column) -> Column:
    pattern = r"""(\w+)\s*=\s*["']([^"']+)["']"""
    name = F.regexp_extract(line, regex(pattern), 1)
    return F.when(search(line, pattern), F.concat(name, F.lit(' = os.environ.get("'), F.upper(name), F.lit('")')))


def _rules() -> list[tuple[str, str, Column, Column, float, bool]]:
    """(fix id, category, condition on the issue, new text or null, confidence, automatic), first match wins."""
    line = F.col("original")

    def swap(old: str, new: str) -> Column:
        return F.replace(line, F.lit(old), F.lit(new))

    variable = F.regexp_extract(line, regex(r"(\w+)\s*="), 1)
    no_list = F.regexp_replace(line, regex(r"=\s*\[\]"), "= None")
    function = F.regexp_extract(line, regex(r"def\s+(\w+)"), 1)
    imported = F.regexp_extract(line, regex(r"import\s+(\w+)"), 1)
    loop = "# WARNING: Add break condition or timeout\nwhile True:\n    # Add: if condition: break\n    pass"
    return [
        ("fix_sql_fstring", "security", _says("SQL injection") & _says("f-string"), parameterised_query(line), 0.8, False),
        ("fix_hardcoded", "security", _says_folded("hardcoded"), environment_lookup(line), 0.7, False),
        ("fix_eval", "security", _says("eval()"), swap("eval(", "ast.literal_eval("), 0.6, False),
        ("fix_shell", "security", _says("shell=True"), swap("shell=True", "shell=False"), 0.8, True),
        ("fix_import", "hallucination", _says("Import") & _says("does not exist"),
         F.when(imported != "", F.replace(line, imported, alternative_name(imported))), 0.5, False),
        ("fix_unreachable", "logic", _says("Unreachable"),
         F.concat(F.lit("# DELETE: Unreachable code\n# "), line), 0.9, True),
        ("fix_infinite_loop", "logic", _says_folded("infinite loop"), F.lit(loop), 0.6, False),
        ("fix_unused", "logic", _says_folded("unused"),
         F.when(variable != "", F.concat(F.lit("_ = "), variable, F.lit("  # Intentionally unused"))), 0.7, True),
        ("fix_bare_except", "best_practices", _says("Bare") & line.contains("except"),
         swap("except:", "except Exception:"), 0.95, True),
        ("fix_mutable_default", "best_practices", _says_folded("mutable default"),
         F.when(no_list != line, F.concat(no_list, F.lit("\n    # Add at start of function: items = items or []"))), 0.9, True),
        ("fix_docstring", "best_practices", _says_folded("missing docstring") & line.contains("def ") & (function != ""),
         F.concat(line, F.lit('\n    """TODO: Add description for '), function, F.lit('."""')), 0.8, True),
    ]


def suggest_fixes(issues: DataFrame, lines: DataFrame) -> DataFrame:
    """``file_id, seq, fix_id, message, line, original, suggested, confidence, auto_applicable``.

    Exactly one rule is looked at per issue, the first whose condition holds; if it has no text to offer,
    the issue has no fix.
    """
    joined = issue_lines(issues, lines)
    choice = None
    for fix_id, category, condition, suggested, confidence, auto in _rules():
        option = F.struct(F.lit(fix_id).alias("fix_id"), suggested.alias("suggested"),
                          F.lit(confidence).alias("confidence"), F.lit(auto).alias("auto_applicable"))
        wanted = (F.col("category") == category) & condition
        choice = F.when(wanted, option) if choice is None else choice.when(wanted, option)
    return (
        joined.select("file_id", "seq", "message", "line", "original", choice.alias("x"))
        .select("file_id", "seq", "x.fix_id", "message", "line", "original", "x.suggested", "x.confidence", "x.auto_applicable")
        .where(F.col("suggested").isNotNull())
    )


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Texts with fixed lines put in place: ``fixes(file_id, line, suggested)``.

    Each fix replaces its whole line, so of several fixes of one line the last in report order stays.
    Only texts that have a fix are split and rebuilt; the others pass by, told apart by a sketch of the fixed ids, and are
    not shuffled.  A text's lines are rewritten inside its own row from a map of its fixes.
    """
    edits = fixes.where(F.col("line").isNotNull()).groupBy("file_id", "line").agg(
        (F.max_by("suggested", "seq") if "seq" in fixes.columns else F.max("suggested")).alias("suggested"))
    per_file = stage(edits.groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.struct("line", "suggested"))).alias("edit_of")), "edits")
    rebuilt = F.array_join(F.transform(
        F.split("code", "\n", -1), lambda text, i: F.coalesce(F.try_element_at("edit_of", (i + 1)), text)), "\n")
    fixed = Wanted(per_file, "file_id")
    changed = files.where(fixed.maybe()).join(per_file, "file_id", "left").select(
        "file_id", F.when(F.col("edit_of").isNotNull(), rebuilt).otherwise(F.col("code")).alias("code"))
    return changed.unionAll(files.where(~fixed.maybe()).select("file_id", "code"))


def alternative_name(module: Column) -> Column:
    """Real module for an invented name, by the first listed part it contains; null if none."""
    chain = None
    for part, real in C.MODULE_ALTERNATIVES:
        hit = F.lower(module).contains(part)
        chain = F.when(hit, real) if chain is None else chain.when(hit, real)
    return chain


def alternative_modules(names: DataFrame, alternatives: DataFrame | None = None) -> DataFrame:
    """The same lookup as a join, for a table of alternatives: ``names(module)`` -> ``module, alternative``.

    ``alternatives(part, alternative, ord)`` is the fixed list unless given, and may be of any size: names meet parts by
    runs of letters, and of the parts a name holds the first by ``ord`` counts (ties: the smaller alternative).
    """
    if alternatives is None:
        rows = [(part, real, i) for i, (part, real) in enumerate(C.MODULE_ALTERNATIVES)]
        alternatives = names.sparkSession.createDataFrame(rows, "part string, alternative string, ord int")
    distinct = names.select("module", F.lower("module").alias("lowered")).distinct()
    met = holding(distinct, "lowered", alternatives.select("part", "alternative", "ord"), "part")
    return met.groupBy("module").agg(F.min(F.struct("ord", "alternative")).alias("first")).select("module", "first.alternative")
