"""Sources of code: directory trees, tables, JSON batch bodies, change snapshots."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge import constants as C
from codegauge.functions import scalars as S

BATCH_SCHEMA = "files array<struct<name: string, code: string>>, min_score int, strict boolean"


def _skipped_by_spark(name: str) -> bool:
    """Names that file sources leave out while they list: those of hidden and of unfinished files and folders."""
    return (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
            or name.startswith(".") or name.endswith("._COPYING_"))


def _alternatives(pattern: str) -> list[str]:
    """A glob pattern with at most one pair of braces as plain patterns."""
    m = re.fullmatch(r"(.*?)\{(.*)\}(.*)", pattern)
    return [m[1] + part + m[3] for part in m[2].split(",")] if m else [pattern]


def _walk(patterns: list[str]) -> Callable:
    """Arrow function: (uri, top), a path with and without escapes, to (plain, code) of the skipped files at or below it."""
    def walk(store: fs.FileSystem, info: fs.FileInfo, skipped: bool) -> Iterator[fs.FileInfo]:
        skipped = skipped or _skipped_by_spark(info.base_name)
        if info.type == fs.FileType.Directory:
            for inner in store.get_file_info(fs.FileSelector(info.path)):
                yield from walk(store, inner, skipped)
        elif skipped and any(fnmatch.fnmatchcase(info.base_name, p) for p in patterns):
            yield info

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, top in zip(batch.column("uri").to_pylist(), batch.column("top").to_pylist()):
                store, path = fs.FileSystem.from_uri(uri)
                for info in walk(store, store.get_file_info(path), False):
                    with store.open_input_stream(info.path) as stream:
                        code = stream.read().decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([pa.array([top + info.path[len(path):]]), pa.array([code])], names=["plain", "code"])
    return run


def _skipped_files(spark: SparkSession, root, store, pattern: str) -> DataFrame:
    """Files that Spark's readers skip for a name of theirs or of a folder above, read by walks below the root's entries."""
    tops = [s.getPath().toUri() for s in store.listStatus(root)] if store.exists(root) else []
    start = [f"{u.getScheme()}://{u.getAuthority() or ''}" for u in tops]
    rows = [(at + u.getRawPath(), at + u.getPath()) for at, u in zip(start, tops)]
    if rows:
        try:
            fs.FileSystem.from_uri(rows[0][0])
        except Exception as error:
            raise ValueError(f"names with a leading underscore cannot be read from {rows[0][0]}: pass underscored=False") from error
    tops = spark.createDataFrame(rows, "uri string, top string").repartition(max(1, min(len(rows), 1_000)), "top")
    return tops.mapInArrow(_walk(_alternatives(pattern)), "plain string, code string")


def scan_files(spark: SparkSession, directory: str, pattern: str = "*.py", underscored: bool = True) -> DataFrame:
    """All files below ``directory`` whose name matches ``pattern``, one row per whole file.

    The path is the file id: the whole path with its escapes decoded.  ``rel_path`` is the part below ``directory``,
    as ignore entries and module names need it.  Spark's readers skip names with a leading underscore or dot, so
    ``__init__.py`` and the like are read by walks in tasks, one for each entry of ``directory``; ``underscored=False``
    leaves them out, for stores that only Spark can open.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("raw_path"), F.col("value").alias("code"))
    )
    # the store's own spelling of the root: scheme and all
    where = spark._jvm.org.apache.hadoop.fs.Path(directory)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    where = store.makeQualified(where)
    root = where.toUri().getPath().rstrip("/")
    # a plus sign in a path is itself; only percent escapes are decoded
    plain = F.url_decode(F.replace("raw_path", F.lit("+"), F.lit("%2B")))
    found = raw.select(plain.alias("plain"), "code")
    if underscored:
        found = found.unionByName(_skipped_files(spark, where, store, pattern))
    plain = F.col("plain")
    local = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rel = F.when(local.startswith(root + "/"), F.substr(local, F.lit(len(root) + 2))).otherwise(local)
    return found.select(plain.alias("file_id"), plain.alias("path"), rel.alias("rel_path"),
                      S.detect_language(plain).alias("language"), "code")


def scan_files_multilang(spark: SparkSession, directory: str) -> DataFrame:
    """Files with one of the known extensions, in any letter case; others are left out while the directory is listed."""
    names = ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in C.LANGUAGE_OF_EXTENSION)
    return scan_files(spark, directory, f"?*.{{{names}}}")


def scan_code_table(df: DataFrame, file_id: str, code: str, language: str = C.DEFAULT_LANGUAGE) -> DataFrame:
    """Code held in a column; such texts have no path."""
    return df.select(
        F.col(file_id).alias("file_id"), F.lit(None).cast("string").alias("path"),
        F.lit(language).alias("language"), F.col(code).alias("code"))


def drop_ignored(files: DataFrame, directory: str, ignore: Sequence[str]) -> DataFrame:
    """Without paths that start with an ignored entry; a plain prefix test, so ``tests`` also drops ``tests_x``.

    Files of a directory scan are tested on ``rel_path``; other tables on ``path`` below ``directory``.
    """
    scanned = "rel_path" in files.columns
    for entry in ignore:
        prefix = entry if scanned else f"{directory.rstrip('/')}/{entry}"
        files = files.where(~F.col("rel_path" if scanned else "path").startswith(prefix))
    return files


def batch_files(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Files of JSON batch bodies, with the documented defaults; ``pos`` numbers the files of a body.

    A body that is no JSON object, or names no files, gives one row with ``error`` set and no file.
    """
    keep = [c for c in bodies.columns if c != body]
    bad = "_malformed"
    parsed = bodies.select(*keep, F.from_json(body, f"{BATCH_SCHEMA}, {bad} string", {"columnNameOfCorruptRecord": bad}).alias("b")).select(
        *keep, "b", (F.col("b").isNull() | F.col(f"b.{bad}").isNotNull()).alias("malformed"))
    return parsed.select(
        *keep,
        F.coalesce("b.min_score", F.lit(C.GATE_SCORE)).alias("min_score"),
        F.coalesce("b.strict", F.lit(False)).alias("strict"),
        F.when(F.col("malformed"), "malformed body").when(F.coalesce(F.size("b.files"), F.lit(0)) <= 0, "no files").alias("error"),
        F.posexplode_outer("b.files").alias("pos", "file"),
    ).select(
        *keep, "pos", F.when(F.col("error").isNull(), F.coalesce("file.name", F.lit("unnamed"))).alias("name"),
        F.when(F.col("error").isNull(), F.coalesce("file.code", F.lit(""))).alias("code"), "min_score", "strict", "error")


def batch_totals(results: DataFrame, *keys: str) -> DataFrame:
    """Files, passed and failed ones by body; a row whose ``passed`` is null stands for a rejected body."""
    n, ok = F.count("passed"), F.count_if("passed")
    return results.groupBy(*keys).agg(
        n.alias("total"), ok.alias("passed"), (n - ok).alias("failed"), F.bool_or(F.col("passed").isNull()).alias("rejected"))


def _ship_by_value() -> None:
    import codegauge.sources.files as module

    cloudpickle.register_pickle_by_value(module)


_ship_by_value()
