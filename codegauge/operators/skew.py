"""Joins and running values that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.session import shared_dir

def even_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` on ``key``, in a form that adaptive execution can split at a hot key of any size.

    It splits a large partition only where both sides of the join are plain shuffles.  A side that comes out of an
    aggregate on ``key`` is none, since its partitioning is reused; a second key that follows from the first makes
    Spark deal both sides out again.  ``small`` should have few rows to a key: they meet every part of a split.
    ``how`` may be inner, left, left_semi or left_anti.
    """
    half = F.pmod(F.xxhash64(F.col(key)), F.lit(2)).alias("half__")
    return big.select("*", half).join(small.select("*", half), [key, "half__"], how).drop("half__")


def range_chunks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` cut into consecutive, evenly filled chunks of the given order, with the ``chunk`` number.

    Range partitioning on the full order splits even a single repeated value of its first column.  The result
    is checkpointed, so that every later branch sees the same cuts.
    """
    shared_dir(df.sparkSession)
    return df.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()).checkpoint()


def running_totals(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums over a total order without bringing all rows to one task.

    Sums run inside each chunk; the totals of earlier chunks (one row per chunk) are added on top.
    """
    chunks = range_chunks(df.select("*", *[v.cast("long").alias(f"{k}__add") for k, v in sums.items()]), order)
    totals = chunks.groupBy("chunk").agg(*[F.sum(f"{k}__add").alias(f"{k}__sum") for k in sums])
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("chunk", *[
        F.coalesce(F.sum(f"{k}__sum").over(before), F.lit(0)).alias(f"{k}__before") for k in sums])
    inside = Window.partitionBy("chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = chunks.select("*", *[F.sum(f"{k}__add").over(inside).alias(f"{k}__run") for k in sums])
    # one row per chunk: bounded by the number of partitions
    out = own.join(F.broadcast(offsets), "chunk")
    return out.select(*df.columns, *[(F.col(f"{k}__run") + F.col(f"{k}__before")).alias(k) for k in sums])


def previous_in_group(df: DataFrame, group: str, order: Sequence[str], value: Column) -> DataFrame:
    """``df`` with ``previous``: ``value`` of the preceding row of the same group, null for the first.

    Chunks run over ``(group, order)``, so a group with a third of all rows spans many chunks.  Only a chunk's
    first row looks outside, at the last row of the chunk before it: one row per chunk.
    """
    keys = [group, *order]
    chunks = range_chunks(df.withColumn("value__now", value), keys)
    inside = Window.partitionBy("chunk").orderBy(*keys)
    lagged = chunks.select(
        "*", F.lag(F.struct(F.col(group).alias("g"), F.col("value__now").alias("v"))).over(inside).alias("prev__row"),
        F.row_number().over(inside).alias("rn__"))
    tails = chunks.groupBy("chunk").agg(
        F.max_by(F.struct(F.col(group).alias("g"), F.col("value__now").alias("v")), F.struct(*keys)).alias("tail"))
    entry = tails.select("chunk", F.lag("tail").over(Window.orderBy("chunk")).alias("tail__before"))
    joined = lagged.join(F.broadcast(entry), "chunk")
    prev = F.when(F.col("rn__") == 1, F.col("tail__before")).otherwise(F.col("prev__row"))
    return joined.withColumn("prev__row", prev).select(
        *df.columns, F.when(F.col("prev__row.g") == F.col(group), F.col("prev__row.v")).alias("previous"))
