"""Scalar expressions, all built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge import constants as C


def _lookup(column: Column, table: dict, default=None) -> Column:
    chain = None
    for key, value in table.items():
        chain = F.when(column == key, F.lit(value)) if chain is None else chain.when(column == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def severity_penalty(severity: Column) -> Column:
    return _lookup(severity, C.SEVERITY_PENALTY, 0)


def sarif_level(severity: Column) -> Column:
    return _lookup(severity, C.SARIF_LEVEL, C.SARIF_DEFAULT_LEVEL)


def diagnostic_severity(severity: Column) -> Column:
    return _lookup(severity, C.DIAGNOSTIC_SEVERITY, C.DIAGNOSTIC_DEFAULT)


def category_key(category: Column) -> Column:
    """Issue category -> category key of the weights table."""
    return _lookup(category, {name: key for key, name in C.CATEGORY_OF_KEY.items()})


def to_snake_case(name: Column) -> Column:
    """Break before a capitalised word, then between a lower-case letter or digit and a capital."""
    words = F.regexp_replace(name, "(?d)(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1_$2"))


def capitalize(word: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2**31 - 1)))


def to_pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_", -1), capitalize), "")


def is_snake_case(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9_]*$")


def is_pascal_case(name: Column) -> Column:
    return name.rlike("^[A-Z][a-zA-Z0-9]*$")


def is_upper(name: Column) -> Column:
    """Has a cased letter and no lower-case one."""
    return (F.upper(name) == name) & (F.lower(name) != name)


def content_digest(content: Column, config: Column | str = "") -> Column:
    """SHA-256 of a text and the configuration it is judged by: equal digests mean equal results."""
    config = F.lit(config) if isinstance(config, str) else config
    return F.sha2(F.concat(content, F.lit(":"), config), 256)


def content_hash(content: Column, config: Column | str = "") -> Column:
    """The first 16 digits of the digest, for show and file names."""
    return F.substring(content_digest(content, config), 1, 16)


def config_hash(min_score: int | Column = C.GATE_SCORE, strict: bool | Column = False, weights: dict | None = None) -> Column:
    """Short hash of the settings a cached result depends on."""
    weights = C.DEFAULT_WEIGHTS if weights is None else weights
    settings = F.struct(
        F.struct(*[F.lit(float(weights[k])).alias(k) for k in sorted(weights)]).alias("checks"),
        (min_score if isinstance(min_score, Column) else F.lit(min_score)).alias("min_score"),
        (strict if isinstance(strict, Column) else F.lit(strict)).alias("strict_mode"),
    )
    return F.substring(F.md5(F.to_json(settings)), 1, 8)


def change_hash(content: Column) -> Column:
    return F.md5(content)


def is_expired(ts: Column, as_of: Column, ttl_days: int = C.CACHE_TTL_DAYS) -> Column:
    """Older than the time to live; an unreadable time counts as expired."""
    return F.coalesce(F.try_to_timestamp(ts) < as_of - F.make_dt_interval(F.lit(ttl_days)), F.lit(True))


def round_1dp(value: Column) -> Column:
    return F.round(value, 1)


def import_base(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def title_case(name: Column) -> Column:
    """``best_practices`` -> ``Best Practices``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def title_parts(name: Column) -> Column:
    """``best_practices`` -> ``Best_Practices``: every part capitalised, separators kept."""
    return F.array_join(F.transform(F.split(name, "_", -1), capitalize), "_")


def param_kind(name: Column) -> Column:
    chain = None
    for kind, words in C.PARAM_KINDS:
        hit = F.lower(name).rlike("|".join(words))
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("none")


def trust_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "warn").otherwise("bad")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def passed_flag(score: Column, critical: Column) -> Column:
    return (score >= C.PASS_SCORE) & (critical == 0)


def quality_gate(score: Column, critical: Column, min_score: int = C.GATE_SCORE) -> Column:
    return (score >= min_score) & (critical == 0)


def detect_language(path: Column) -> Column:
    # a name that is only an extension (".py") has none
    extension = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return _lookup(extension, C.LANGUAGE_OF_EXTENSION, C.DEFAULT_LANGUAGE)


def module_name(path: Column) -> Column:
    """Path below the root -> dotted module name; a package's ``__init__.py`` names the package."""
    folder = F.regexp_extract(path, "^(.*/)?", 0)
    last = F.regexp_extract(path, "([^/]*)$", 1)
    dotted = F.when(last == "__init__.py", F.rtrim(folder, F.lit("/"))).otherwise(
        F.concat(folder, F.replace(last, F.lit(".py"), F.lit(""))))
    return F.replace(dotted, F.lit("/"), F.lit("."))


def in_excluded_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/", -1), F.array(*[F.lit(d) for d in C.EXCLUDED_DIRS]))
