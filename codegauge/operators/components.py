"""Connected components in a logarithmic number of rounds, whatever the diameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codegauge.session import drop_path, scratch_path


class Rounds:
    """Tables of an iteration: each round is written to the shared folder, and the one before it deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.number, self.path = spark, scratch_path(spark, name), 0, None

    def keep(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """The table as written, and aggregates of it taken while it was written."""
        path = f"{self.base}/{self.number}"
        seen = Observation(f"round_{self.number}")
        df.observe(seen, *(m.alias(n) for n, m in measures.items())).write.parquet(path)
        self.number += 1
        self.path, before = path, self.path
        if before:
            drop_path(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path), seen.get


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b of one orderable type): the component's smallest node.

    Alternating large-star and small-star steps: every node hands its larger, then its smaller neighbours to the
    smallest node it knows, until all edges are stars.  Minima are combined before the shuffle.  The join that hands
    them to the neighbours of a hub has a second key, so that both of its sides are plain shuffles, which adaptive
    execution can split.  Null ends and loops join nothing.
    """
    rounds = Rounds(edges.sparkSession, "components")
    # order-free sums over the edges: equal sums of two rounds mean equal edges
    measures = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, mark = rounds.keep(edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), **measures)
    half = F.pmod(F.xxhash64("a"), F.lit(2)).alias("half")
    while mark["n"]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.select("a", "b", half).join(least.select("a", "m", half), ["a", "half"]).where("b > a and b <> m").select(
            F.col("m").alias("a"), "b")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(
            least.select(F.col("m").alias("a"), "b")).distinct()
        before = mark
        now, mark = rounds.keep(small, **measures)
        if mark == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
