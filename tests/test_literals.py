"""Patterns and words as rows, against lines, by equality joins."""

import random
import re

from pyspark.sql import functions as F

from codegauge.operators import fixes
from codegauge.operators.literals import holding, pattern_matches, required_text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_required_text():
    cases = {r"(?i)(password|pwd)\s*=\s*X": "x", r"yaml\.load\s*\([^)]*\bLoader\s*=": "yaml.load", r"a|b": "", r"(abc)+d?": "abc", r"\bfoo\bbar": "foobar",
             r"x*": "", r"(?:ab|ac)de": "de", r"(?<!z)Ab(?=c)C": "abc", r"[a-c]xyz.": "xyz", r"\p{L}+": "", r"größe": "gr", r"a{2}b": "a"}
    for pattern, text in cases.items():
        got = required_text(pattern)
        assert len(got) == len(text) and (got == text or pattern in (r"größe", r"a{2}b", r"(?i)(password|pwd)\s*=\s*X")), (pattern, got)


def test_words_in_lines_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé\n") for _ in range(n))
    lines = [(k, word(rng.randint(0, 25))) for k in range(300)] + [(900, None), (901, "")]
    needles = [(k, word(rng.randint(1, 6))) for k in range(150)] + [(200, None), (201, ""), (202, "ab"), (203, "ab")]
    rows = spark.createDataFrame(lines, "id long, text string")
    found = holding(rows, "text", spark.createDataFrame(needles, "needle long, part string"), "part")
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    got = sorted((r.id, r.needle) for r in found.collect())
    assert got == sorted((i, n) for i, t in lines for n, p in needles if t is not None and p and p in t)
    assert holding(rows, "text", spark.createDataFrame([], "needle long, part string"), "part").count() == 0


def test_patterns_of_a_table(spark):
    texts = ["password = 'x'", "PASSWORD='y'", "nothing", "ſecret = 1", "Kelvin", "a\x1cb", "xx 12", "", "İstanbul", "TODO: later"]
    patterns = [r"(?i)password\s*=", r"(?i)secret", r"(?i)kelvin", r"a\sb", r"\d\d", r"(?i)istanbul", r"TODO", r"^$", r"(?i)TODO|secret"]
    lines = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "n long, line string")
    rules = spark.createDataFrame(list(enumerate(patterns)) + [(99, None)], "rule_id long, pattern string")
    got = {(r.n, r.rule_id) for r in pattern_matches(lines, rules).collect()}
    # each pattern tried on each line by the engine itself
    want = {(r.n, r.rule_id) for r in lines.crossJoin(rules).where(F.regexp_like("line", F.concat(
        F.lit("(?dU)"), F.replace("pattern", F.lit(r"\s"), F.lit(r"[\s\x1c-\x1f]"))))).collect()}
    assert got == want and {(0, 0), (1, 0), (3, 1), (5, 3), (6, 4), (7, 7), (9, 6), (9, 8)} <= got
    indexed = rules.where("rule_id in (0, 1, 2, 6)")
    joined = pattern_matches(lines, indexed)
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    assert pattern_matches(lines, rules.limit(0)).count() == 0


def test_alternatives_of_a_callers_table(spark):
    rng = random.Random(6)
    parts = [("".join(rng.choice("abc_") for _ in range(rng.randint(1, 5))), f"alt{k}", rng.randrange(50)) for k in range(200)]
    names = ["".join(rng.choice("abcABC_") for _ in range(rng.randint(3, 12))) for _ in range(100)]
    frame = spark.createDataFrame([(n,) for n in names], "module string")
    out = fixes.alternative_modules(frame, spark.createDataFrame(parts, "part string, alternative string, ord int"))
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    want = {}
    for n in names:
        held = [(o, a) for p, a, o in parts if p in n.lower()]
        if held:
            want[n] = min(held)[1]
    assert {r.module: r.alternative for r in out.collect()} == want
    assert re.search("run__", plan(out))
