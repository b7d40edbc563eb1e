"""N-gram Jaccard join with Bayesian candidate pruning.

Exact copies collapse into one class first.  Every class gets a MinHash signature; classes that agree on a band
of three values are candidates.  Bands link each class to the smallest class of its band group, never to all, and
the components of those links gather everything that could be similar.  Inside a component, blocks of classes
meet block by block: a pair that shares a band is compared a few MinHash values at a time and dropped as soon as
the posterior probability of reaching the threshold (uniform prior) falls below the tolerance; what is left is
verified on the full shingle sets.  Pairs stay inside a task as arrays; only per-class counts leave it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.common import by_key, shuffle_partitions, slices
from codegauge.llm.words import U, mix, shingles, split_words
from codegauge.operators.components import connected_components
from codegauge.operators.skew import even_join
from codegauge.session import stage

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 3        # a pair at 0.8 shares no band with probability 3e-8
STEP = 8                   # MinHash values compared before each look at the posterior
TOLERANCE = 1e-9
BLOCK_SHINGLES, BLOCK_CLASSES = 200_000, 1_500
_RANDOM = np.random.Generator(np.random.PCG64(7))
_TURN = _RANDOM.integers(0, 2**63, size=(2, BANDS * ROWS), dtype=np.int64).astype(U)
_TURN[1] = _TURN[1] * U(2) + U(1)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash signature (32 bits a value) of each non-empty text."""
    heads = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(heads), BANDS * ROWS), dtype=np.uint32)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat((hashes ^ _TURN[0, i]) * _TURN[1, i], heads) >> U(32) if len(heads) else 0
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    wide = sig.astype(U).reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), dtype=U)
    for r in range(ROWS):
        key = mix(key + wide[:, :, r] + U(r + 1))
    return mix(key + np.arange(1, BANDS + 1, dtype=U))


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, offsets = shingles(split_words(batch.column("text")), WORDS)
        has = np.diff(offsets) > 0
        sig = signatures(hashes, offsets)
        kept = batch.filter(pa.array(has))
        yield pa.RecordBatch.from_arrays([
            kept.column("doc_id"), kept.column("digest"), pa.array(np.diff(offsets)[has], pa.int64()),
            pa.array([row.tobytes() for row in sig], pa.binary()),
            pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sig).ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
        ], names=["doc_id", "digest", "n_shingles", "sig", "bands"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, offsets = shingles(split_words(batch.column("text")), WORDS)
        sig = signatures(hashes, offsets)
        bags = [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([
            batch.column("node"), batch.column("component"), batch.column("blocks"),
            pa.array([row.tobytes() for row in sig], pa.binary()), pa.array(bags, pa.binary())],
            names=["node", "component", "blocks", "sig", "bag"])


def matches_needed(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest agreeing ones that keep a pair: P(J >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def similar_pairs(sig: np.ndarray, bags: list[np.ndarray], side: np.ndarray | None, threshold: float, needed: dict[int, int]):
    """Index pairs (i < j) with Jaccard at or above the threshold; with ``side`` only pairs across the two sides."""
    bands = band_keys(sig)
    sizes = np.array([len(b) for b in bags])
    left, right = (np.arange(len(bags)),) * 2 if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    out_i, out_j = [], []
    height = max(1, 4_000_000 // max(1, len(right)))
    for top in range(0, len(left), height):
        rows = left[top:top + height]
        near = np.zeros((len(rows), len(right)), dtype=bool)
        for b in range(BANDS):
            near |= bands[rows, b][:, None] == bands[right, b][None, :]
        if side is None:
            near &= rows[:, None] < right[None, :]
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        agreed = np.zeros(len(i), dtype=np.int64)
        for n, least in needed.items():
            agreed += (sig[i, n - STEP:n] == sig[j, n - STEP:n]).sum(axis=1)
            live = agreed >= least
            i, j, agreed = i[live], j[live], agreed[live]
        shared = _shared(bags, i, j)
        good = shared / np.maximum(sizes[i] + sizes[j] - shared, 1) >= threshold
        out_i.append(i[good])
        out_j.append(j[good])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int),) * 2


def _shared(bags: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of each pair's intersection; many pairs among few sets are counted as a matrix product, in strips."""
    members = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(members):
        return np.array([len(np.intersect1d(bags[a], bags[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], dtype=np.int64)
    place = np.full(len(bags), -1)
    place[members] = np.arange(len(members))
    owner = np.repeat(np.arange(len(members)), [len(bags[m]) for m in members])
    _, code, count = np.unique(np.concatenate([bags[m] for m in members]), return_inverse=True, return_counts=True)
    keep = count[code] > 1
    ranks = np.cumsum(count > 1) - 1
    code, owner = ranks[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total = np.zeros((len(members), len(members)), dtype=np.float32)
    strip = 1024
    width = int(code[-1]) + 1 if len(code) else 0
    cuts = np.searchsorted(code, np.arange(0, width + strip, strip))
    for k in range(len(cuts) - 1):
        grid = np.zeros((len(members), strip), dtype=np.float32)
        grid[owner[cuts[k]:cuts[k + 1]], code[cuts[k]:cuts[k + 1]] - k * strip] = 1
        total += grid @ grid.T
    return total[place[i], place[j]].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each index is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def _verify(threshold: float, tolerance: float):
    needed = matches_needed(threshold, tolerance)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, "meeting"):
            nodes, order = np.unique(group.column("node").to_numpy(), return_index=True)    # repeated rows count once
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint32).reshape(group.num_rows, -1)[order]
            raw = group.column("bag").to_pylist()
            bags = [np.frombuffer(raw[k], dtype=U) for k in order.tolist()]
            block = group.column("block").to_numpy()[order]
            high, blocks = group.column("high")[0].as_py(), group.column("blocks")[0].as_py()
            cross = group.column("low")[0].as_py() != high
            i, j = similar_pairs(sig, bags, block == high if cross else None, threshold, needed)
            links = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(nodes[_roots(len(nodes), i, j)][some]),
                 pa.array(np.full(some.sum(), blocks == 1))],
                names=["node", "links", "root", "last"])
    return run


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of every document of ``docs`` (doc_id, text; more columns are ignored).

    Documents with the same text form a class, named by its smallest id (``copy_of``).  Two classes are linked when
    the Jaccard similarity of their sets of five-word shingles is at least ``threshold``; ``n_links`` counts the
    linked classes and ``class_id`` is the smallest id among all documents reachable over links.  A text of one to
    four words has one shingle, all of it.  A null text or one without words has no shingles: it links to nothing
    and is its own class.  Rows that repeat a ``doc_id`` are one document, with the text of the smallest digest.
    Rows with a null ``doc_id`` come back with null ids and no links.  An empty table gives no rows.

    A link at the threshold is missed with a probability below 1e-7 (no shared band), plus the tolerance at each
    look; shingles are compared by 64-bit hashes within a pair.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    signed = stage(known.where("doc_id is not null").select("doc_id", "text", digest).mapInArrow(
        _sign, "doc_id long, digest binary, n_shingles long, sig binary, bands array<long>"), "signatures")
    # one text per id, one id per text
    member = signed.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    classes = member.groupBy("digest").agg(F.min("doc_id").alias("node"))
    classed = stage(even_join(member, classes, "digest").select("doc_id", "digest", "node"), "classes")
    heads = stage(signed.join(classed.where("doc_id = node").select("doc_id", "digest"), ["doc_id", "digest"]).select(
        F.col("doc_id").alias("node"), "digest", "n_shingles", "bands"), "heads")

    keys = heads.select("node", F.explode("bands").alias("key"))
    firsts = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    edges = even_join(keys, firsts.select("key", "first"), "key").where("node <> first").select(
        F.col("first").alias("a"), F.col("node").alias("b"))
    sized = stage(connected_components(edges).join(heads.select("node", "digest", "n_shingles").distinct(), "node"), "candidates")
    blocks = sized.groupBy("component").agg(F.greatest(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    wanted = sized.join(blocks, "component").select(F.col("node").alias("doc_id"), "component", "blocks", "digest")
    texts = known.join(wanted, "doc_id").where(F.unhex(F.sha2("text", 256)) == F.col("digest")).select(
        F.col("doc_id").alias("node"), "component", "blocks", "text")
    sets = texts.mapInArrow(_sets, "node long, component long, blocks int, sig binary, bag binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meet = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("node", "sig", "bag", "block", "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                       F.concat_ws(".", "component", F.least("block", "other"), F.greatest("block", "other")).alias("meeting"))
    found = stage(meet.repartition(parts, "meeting").sortWithinPartitions("meeting").mapInArrow(
        _verify(threshold, tolerance), "node long, links long, root long, last boolean"), "links")

    # where all of a candidate group met in one task its roots are final; roots of the others are links to follow
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"), F.min("last").alias("last"))
    groups = connected_components(found.where("not last").select(F.col("root").alias("a"), F.col("node").alias("b")))
    linked = links.join(groups, "node", "left").select(
        "node", "n_links", F.when(F.col("last"), F.col("root")).otherwise(F.coalesce("component", "node")).alias("class_id"))
    with_words = classed.join(linked, "node", "left").select(
        "doc_id", F.coalesce("class_id", "node").alias("class_id"), F.col("node").alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    alone = known.select("doc_id").distinct().join(classed, "doc_id", "left_anti").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionAll(alone)
