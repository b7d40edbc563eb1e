"""Approximate nearest neighbours with a forest of random-projection trees.

Equal vectors collapse first.  Each tree splits a bounded sample of the vectors by the median of a projection on the
line through two random points; every vector of the table then falls into one leaf of each tree.  A query walks all
trees through one priority queue, ordered by the squared margins it had to give up, and takes the leaves that come
out first.  Leaves and queries are dealt out together, and each task compares every query with its leaves in double
precision; the best of all tasks are ranked exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegauge.llm.common import parts_for, shuffle_partitions
from codegauge.llm.words import U, mix
from codegauge.session import stage

NEIGHBOURS = 5
TREES = 8
LEAF_ROWS = 256           # rows of the whole table that a leaf should hold
SAMPLE_ROWS = 20_000      # vectors the trees are fitted on, at most
LEAST_LEAF_SAMPLE = 4
SHARE = 0.10              # of all leaves that a query looks into; vectors with little structure need many
ROWS_PER_PART = 50_000
QUERIES_PER_BLOCK = 20_000


@dataclass
class Tree:
    """Inner node n: ``direction[n]``, ``cut[n]``, ``below[n]`` (child at or below the cut) and ``above[n]``; a child
    that is negative is leaf ``-child - 1``."""
    direction: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    leaves: int

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        if not len(self.cut):
            return np.zeros(len(rows), dtype=np.int64)
        node = np.zeros(len(rows), dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = node[live]
            side = np.einsum("ij,ij->i", rows[live], self.direction[at]) <= self.cut[at]
            node[live] = np.where(side, self.below[at], self.above[at])
            live = live[node[live] >= 0]
        return -node - 1


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over the rows of ``sample`` with at most about ``leaf`` of them in a leaf."""
    direction, cut, below, above, leaves = [], [], [], [], 0
    work = [(np.arange(len(sample)), None)]
    while work:
        rows, parent = work.pop()
        child = None
        if len(rows) > leaf:
            for _ in range(5):      # equal points have no line through them
                a, b = rng.choice(rows, 2, replace=False)
                line = sample[a] - sample[b]
                length = float(np.linalg.norm(line))
                if length > 1e-9:
                    shadow = sample[rows] @ (line / length)
                    middle = float(np.median(shadow))
                    low = shadow <= middle
                    if low.any() and not low.all():
                        child = len(cut)
                        direction.append(line / length)
                        cut.append(middle)
                        below.append(0)
                        above.append(0)
                        work += [(rows[low], (below, child)), (rows[~low], (above, child))]
                        break
        if child is None:
            leaves += 1
            child = -leaves
        if parent is not None:
            parent[0][parent[1]] = child
    return Tree(np.array(direction).reshape(len(cut), sample.shape[1] if sample.ndim == 2 else 0), np.array(cut),
                np.array(below, dtype=np.int64), np.array(above, dtype=np.int64), leaves)


@dataclass
class RandomForest:
    trees: list[Tree]

    @property
    def offsets(self) -> np.ndarray:
        """The number of each tree's first leaf among all leaves."""
        return np.concatenate(([0], np.cumsum([t.leaves for t in self.trees])))

    def search(self, query: np.ndarray, count: int) -> list[int]:
        """The ``count`` leaves nearest to the query, over all trees."""
        offsets = self.offsets
        shadows = [t.direction @ query - t.cut if len(t.cut) else None for t in self.trees]
        queue = [(0.0, k, 0 if len(t.cut) else -1) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found = []
        while queue and len(found) < count:
            given_up, k, node = heapq.heappop(queue)
            tree, shadow = self.trees[k], shadows[k]
            while node >= 0:
                margin = shadow[node]
                near, far = (tree.below[node], tree.above[node]) if margin <= 0 else (tree.above[node], tree.below[node])
                heapq.heappush(queue, (given_up + float(margin) ** 2, k, int(far)))
                node = int(near)
            found.append(int(offsets[k]) - node - 1)
        return found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _parts(leaves: np.ndarray, parts: int) -> np.ndarray:
    return (mix(leaves.astype(U)) % U(parts)).astype(np.int64)


def _index(forest: RandomForest, dim: int, parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = forest.offsets
        for batch in batches:
            rows = _unit(_matrix(batch.column("vector"), dim)) if batch.num_rows else np.zeros((0, dim))
            for k, tree in enumerate(forest.trees):
                leaf = tree.place(rows) + offsets[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_parts(leaf, parts)), pa.array(leaf), batch.column("ids"), batch.column("vector")],
                    names=["part", "leaf", "ids", "vector"])
    return run


def _visits(forest: RandomForest, dim: int, parts: int, count: int, blocks: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _unit(_matrix(batch.column("vector"), dim)) if batch.num_rows else np.zeros((0, dim))
            at, part, leaves = [], [], []
            for n, row in enumerate(rows):
                found = np.array(forest.search(row, count), dtype=np.int64)
                home = _parts(found, parts)
                for p in np.unique(home).tolist():
                    at.append(n)
                    part.append(p)
                    leaves.append(found[home == p])
            take = pa.array(at, pa.int64())
            query = batch.column("query").take(take)
            block = (mix(query.to_numpy().view(U)) % U(blocks)).astype(np.int64) if at else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(part, dtype=np.int64)), pa.array(block), query, batch.column("vector").take(take),
                 pa.array(leaves, pa.list_(pa.int64()))], names=["part", "block", "query", "vector", "leaves"])
    return run


def _compare(dim: int, keep: int):
    def run(index, queries):
        empty = pa.table({"query": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not index.num_rows or not queries.num_rows:
            return empty
        index = index.combine_chunks()
        ids_column = index.column("ids").combine_chunks()
        least = pa.compute.list_element(ids_column, 0).to_numpy()
        rows = _matrix(index.column("vector").combine_chunks(), dim)
        leaf = index.column("leaf").to_numpy()
        order = np.lexsort((least, leaf))           # within a leaf by id, so that stable sorts break ties by it
        leaf, rows, least = leaf[order], rows[order], least[order]
        unit = _unit(rows)
        own = _matrix(queries.column("vector").combine_chunks(), dim)
        own_unit = _unit(own)
        lists = queries.column("leaves").combine_chunks()
        wanted = pa.compute.list_flatten(lists).to_numpy()
        asker = pa.compute.list_parent_indices(lists).to_numpy()
        by_leaf = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[by_leaf], asker[by_leaf]
        pairs_q, pairs_r = [], []
        for one in np.unique(wanted).tolist():
            low, high = np.searchsorted(leaf, one), np.searchsorted(leaf, one, side="right")
            if low == high:
                continue
            all_asking = asker[np.searchsorted(wanted, one):np.searchsorted(wanted, one, side="right")]
            step = max(1, 4_000_000 // int(high - low))
            for k in range(0, len(all_asking), step):
                asking = all_asking[k:k + step]
                # rounded, so that equal cosines tie whatever the order of summation
                near = np.round(own_unit[asking] @ unit[low:high].T, 12)
                best = np.argsort(-near, axis=1, kind="stable")[:, :keep]
                pairs_q.append(np.repeat(asking, best.shape[1]))
                pairs_r.append((best + low).ravel())
        if not pairs_q:
            return empty
        q, r = np.concatenate(pairs_q), np.concatenate(pairs_r)
        score = np.einsum("ij,ij->i", own[q], rows[r]) / (np.linalg.norm(own[q], axis=1) * np.linalg.norm(rows[r], axis=1))
        rank = np.lexsort((least[r], -score, q))
        q, r, score = q[rank], r[rank], score[rank]
        again = np.zeros(len(q), dtype=bool)        # the same row out of leaves of two trees
        again[1:] = (q[1:] == q[:-1]) & (least[r][1:] == least[r][:-1])
        q, r, score = q[~again], r[~again], score[~again]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < keep
        return pa.table({"query": queries.column("query").combine_chunks().take(pa.array(q[top])),
                         "ids": ids_column.take(pa.array(order[r[top]])), "score": pa.array(score[top])})
    return run


def nearest(vectors: DataFrame, every: int = 50, neighbours: int = NEIGHBOURS, column: str = "embedding", share: float = SHARE,
            trees: int = TREES, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found rows of every query, by cosine in double precision.

    Queries are the rows of ``vectors`` (vec_id, ``column``; more columns are ignored) whose ``vec_id`` is divisible by
    ``every``; candidates are all rows but the query's own.  Ranks begin at 1; equal scores go by the smaller
    ``vec_id``.  A vector that is null, zero, or holds a null or non-finite component takes no part, nor does one
    whose length is not the commonest (the larger of equally common ones), or whose ``vec_id`` is null.  Rows that
    repeat a ``vec_id`` are one row, with the smallest of its vectors.  With fewer candidates than ``neighbours`` a
    query gets those there are; an empty table gives no rows.

    The forest is fitted on at most ``SAMPLE_ROWS`` vectors and holds every row.  A query looks into ``share`` of all
    leaves, at least two for each tree; recall rises with it.
    """
    spark = vectors.sparkSession
    value = F.col("vector")
    fit_for_use = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & value.isNotNull() & fit_for_use)
    common = known.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    dim = common[0]["dim"]
    known = known.where(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    keep = neighbours + 1
    # of equal vectors only the smallest ids can be among a query's nearest
    ranked = known.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= keep)
    distinct = stage(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    total = distinct.count()
    steps = 1 << 30
    share_of_sample = min(1.0, SAMPLE_ROWS / total)
    picked = distinct.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(steps)) < int(share_of_sample * steps)).select("rep", "vector").toArrow()
    if not picked.num_rows:
        picked = distinct.select("rep", "vector").orderBy("rep").limit(1).toArrow()
    order = np.argsort(picked.column("rep").to_numpy())
    sample = _unit(_matrix(picked.column("vector").combine_chunks(), dim))[order]
    rng = np.random.default_rng(seed)
    leaf = max(LEAST_LEAF_SAMPLE, LEAF_ROWS * len(sample) // total)
    forest = RandomForest([grow(sample, leaf, rng) for _ in range(trees)])
    count = max(2 * trees, int(np.ceil(share * forest.offsets[-1])))

    asked = known.where(F.col("vec_id") % every == 0).join(distinct.select("vector", "rep"), "vector").select("vec_id", "rep")
    asked = stage(asked, "queries")
    distinct_queries = asked.select("rep").distinct().join(distinct.select("rep", "vector"), "rep").select(F.col("rep").alias("query"), "vector")
    parts = parts_for(total * trees, ROWS_PER_PART, shuffle_partitions(spark))
    blocks = parts_for(asked.count(), QUERIES_PER_BLOCK)
    # trees and queries cost far more than their bytes: spread them before the work
    spread = distinct_queries.repartition(shuffle_partitions(spark), "query")
    visits = spread.mapInArrow(_visits(forest, dim, parts, count, blocks),
                               "part long, block long, query long, vector array<double>, leaves array<long>")
    index = distinct.select("ids", "vector").mapInArrow(_index(forest, dim, parts), "part long, leaf long, ids array<long>, vector array<double>")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = index.groupBy("part", "block").cogroup(visits.groupBy("part", "block")).applyInArrow(
        _compare(dim, keep), "query long, ids array<long>, score double")
    flat = found.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = flat.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= keep)
    answer = asked.withColumnRenamed("vec_id", "query_id").join(best.drop("n"), asked["rep"] == best["query"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answer.withColumn("rank", rank.cast("int")).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
