"""What the operators share: table access, sizing, and Arrow slices of bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text over all rows: one number, from which partition counts follow."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each), 1)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in record batches whose ``column`` holds about ``most`` bytes (one row at least)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal ``key`` values of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for row, value in enumerate(keys):
            if held and start == row and value != now:
                yield pa.Table.from_batches(held)
                held = []
            elif row > start and value != now:
                held.append(batch.slice(start, row - start))
                yield pa.Table.from_batches(held)
                held, start = [], row
            now = value
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
