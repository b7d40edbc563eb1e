"""A table with one row per key, kept in buckets that are replaced one by one.

``path/data/v<n>/bucket__=<b>`` holds bucket b as version n wrote it; ``path/manifest/v<n>`` lists where every bucket
of version n lies, and counts once its ``_SUCCESS`` file stands.  A merge reads and rewrites the buckets its rows fall
into and no others, so what it writes follows the batch as long as there are more buckets than touched ones.  All
of it lies in the store, so a new process goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge.session import drop_path

BUCKETS = 64
_BUCKET = "bucket__"


class KeyedTable:
    """``combine(old and new rows) -> one row per key`` says which row stays; new rows have ``gen__`` 1, old ones 0."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str,
                 combine: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.combine, self.buckets = spark, path.rstrip("/"), key, combine, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def versions(self) -> list[int]:
        """Versions whose manifest is complete, in order."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        store = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(where):
            return []
        found = [s.getPath() for s in store.listStatus(where)]
        done = [p.getName() for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(name[1:]) for name in done)

    def _manifest(self, version: int | None) -> dict[int, int]:
        """The version that holds each bucket; buckets without rows are missing."""
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/v{version}")
        return {r["bucket"]: r["version"] for r in rows.collect()}       # as many as there are buckets

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/v{v}/{_BUCKET}={b}" for b, v in sorted(held.items())))

    def read(self) -> DataFrame:
        known = self.versions()
        return self._rows(self._manifest(known[-1] if known else None))

    def merge(self, batch: DataFrame, version: int | None = None) -> None:
        """Put the rows of ``batch`` in.  A version that is written again starts from the one before it."""
        known = self.versions()
        version = (known[-1] + 1 if known else 0) if version is None else version
        before = [v for v in known if v < version]
        held = self._manifest(before[-1] if before else None)
        number = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = batch.select(*self.schema.names).withColumn("gen__", F.lit(1))
        touched = {r[0] for r in new.select(number).distinct().collect()}
        if not touched:
            return
        old = self._rows({b: v for b, v in held.items() if b in touched}).withColumn("gen__", F.lit(0))
        merged = self.combine(old.unionByName(new)).select(*self.schema.names)
        merged.withColumn(_BUCKET, number).repartition(len(touched), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(
            f"{self.path}/data/v{version}")
        after = held | {b: version for b in touched}
        self.spark.createDataFrame(list(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/v{version}")
        # what neither this version nor the one it came from needs
        for old_version in before[:-1]:
            for b, v in self._manifest(old_version).items():
                if v not in (after.get(b), held.get(b)):
                    drop_path(self.spark, f"{self.path}/data/v{v}/{_BUCKET}={b}")
            drop_path(self.spark, f"{self.path}/manifest/v{old_version}")


def newest(key: str, order: list[str], names: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of the rows of a key the one with the largest ``order`` stays; maxima are combined before the shuffle."""
    others = [n for n in names if n != key]

    def combine(rows: DataFrame) -> DataFrame:
        rank = F.struct(*order, *[n for n in others if n not in order])
        return rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("s")).select(key, "s.*")
    return combine
