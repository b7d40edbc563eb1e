"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of shingles, each class at most half again as large as the one
below.  For a class, every document is cut into overlapping windows so long that any passage of the class's
largest item lies whole in one of them, and whose size therefore bounds the Jaccard similarity of an item and the
window around it from below, however long the document is.  Window and item signatures hold the minimum of each
bin of a one-permutation MinHash; one equal bin makes a candidate.  Candidates are verified by exact containment:
the share of the item's distinct shingles that the whole document holds.

The benchmark is a query set: it is cut into blocks of bounded size, and each block passes over all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge.llm.common import slices
from codegauge.llm.words import U, mix, shingles, split_words
from codegauge.session import stage

WORDS = 5
THRESHOLD = 0.8
BINS = 64
GROWTH = 1.5
BLOCK_SHINGLES = 4_000_000       # of benchmark items, about 64 MB in each task


@dataclass
class SizeClass:
    """Items of one class: bin minima as sorted (key, item) pairs."""
    largest: int
    keys: np.ndarray
    owners: np.ndarray


@dataclass
class Block:
    """One block of benchmark items: ids, distinct shingles by item, size classes."""
    ids: list
    bags: list[np.ndarray]
    classes: list[SizeClass]
    keys: np.ndarray                # of all classes, sorted

    @classmethod
    def build(cls, ids: list, texts: list) -> Block:
        hashes, offsets = shingles(split_words(pa.array(texts, pa.string())), WORDS)
        bags = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        level = [int(np.log(max(len(b), 1)) / np.log(GROWTH)) for b in bags]
        classes = []
        for k in sorted(set(level)):
            members = [i for i, b in enumerate(bags) if level[i] == k and len(b)]
            if not members:
                continue
            keys, owners = [], []
            for i in members:
                keys.append(bin_minima(bags[i]))
                owners.append(np.full(len(keys[-1]), i))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            classes.append(SizeClass(max(len(bags[i]) for i in members), keys[order], owners[order]))
        return cls(ids, bags, classes, np.unique(np.concatenate([c.keys for c in classes])) if classes else np.zeros(0, U))


def _turned(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes + U(0xD1B54A32D192ED03))


def bin_minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each bin that the set fills.  A value's bin is the value modulo ``BINS``, so equal values of two
    signatures are always of the same bin."""
    turned = _turned(hashes)
    bins = turned % U(BINS)
    order = np.lexsort((turned, bins))
    head = np.ones(len(order), dtype=bool)
    head[1:] = bins[order][1:] != bins[order][:-1]
    return turned[order][head]


def candidates(hashes: np.ndarray, offsets: np.ndarray, block: Block) -> set[tuple[int, int]]:
    """(text, item) pairs in which a window of the text and the item agree in a bin.

    A window's minimum in a bin can only equal an item's where the text holds that very shingle, so the texts are
    probed for the items' minima, and bins are compared in the windows around the hits alone.
    """
    found: set[tuple[int, int]] = set()
    if not len(block.keys) or not len(hashes):
        return found
    turned = _turned(hashes)
    at = np.minimum(np.searchsorted(block.keys, turned), len(block.keys) - 1)
    hits = np.flatnonzero(block.keys[at] == turned)
    owners = np.searchsorted(offsets, hits, side="right") - 1
    values = turned[hits]
    for group in block.classes:
        first = np.searchsorted(group.keys, values)
        last = np.searchsorted(group.keys, values, side="right")
        for k in np.flatnonzero(last > first).tolist():
            text = int(owners[k])
            items = [i for i in group.owners[first[k]:last[k]].tolist() if (text, i) not in found]
            if not items:
                continue
            low, high, place, value, stride = int(offsets[text]), int(offsets[text + 1]), int(hits[k]), values[k], group.largest
            number = (place - low) // stride
            for start in {max(0, number - 1) * stride + low, number * stride + low}:   # the windows that hold this place
                window = turned[start:min(high, start + 2 * stride)]
                if window[window % U(BINS) == value % U(BINS)].min() == value:
                    found.update((text, i) for i in items)
                    break
    return found


def _search(block: Block, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, offsets = shingles(split_words(batch.column("text")), WORDS)
            ids = batch.column("doc_id").to_pylist()
            rows, bags = [], {}
            for text, item in sorted(candidates(hashes, offsets, block)):
                if text not in bags:
                    bags[text] = np.unique(hashes[offsets[text]:offsets[text + 1]])
                bag = block.bags[item]
                shared = len(np.intersect1d(bag, bags[text], assume_unique=True))
                if shared / len(bag) >= threshold:
                    rows.append((ids[text], item, shared, len(bag)))
            if rows:
                doc, item, shared, size = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array([block.ids[i] for i in item], pa.int64()), pa.array(shared, pa.int64()),
                     pa.array(size, pa.int64()), pa.array([s / n for s, n in zip(shared, size)], pa.float64())],
                    names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])
    return run


def blocks(benchmark: DataFrame, most: int = BLOCK_SHINGLES) -> Iterator[Block]:
    """The items in blocks of about ``most`` shingles, streamed to the driver one block at a time."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        size = len(row["text"]) // 4 + 1
        if ids and held + size > most:
            yield Block.build(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += size
    if ids:
        yield Block.build(ids, texts)


_FOUND = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every document and item with containment at or above
    ``threshold``: the share of the item's distinct five-word shingles that ``docs`` (doc_id, text) row holds.

    A text or item of one to four words has one shingle, all of it, so a short item is found only as a whole text.
    Null or wordless texts and items hold nothing and are never reported.  Rows that repeat a ``doc_id`` or
    ``item_id`` are judged each by itself; a null id is reported as null.  Empty tables give no rows; other columns
    are ignored.  Shingles are compared by 64-bit hashes.  An item all of whose shingles stand together in a
    document is always a candidate in at least one of 64 bins unless another shingle of its window, at most four
    times as long as the item, is smaller in every bin that the item fills.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(benchmark):
        if out is not None:      # several blocks: only one of them is held at a time
            out = stage(out, "contained")
        found = known.mapInArrow(_search(block, threshold), _FOUND)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], _FOUND) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that hold no benchmark item at ``threshold``; all columns as they are.

    Rows are judged one by one: rows with a null or repeated ``doc_id`` like any other.  Null, empty and wordless texts hold
    nothing and stay, as everything does if the benchmark is empty or wordless; an empty table gives no rows.  A text of
    any length is judged whole.  Each block of the benchmark is a pass of its own over what the one before kept, so one block is held at a time.
    """
    kinds: T.StructType = docs.schema

    def clean(block: Block):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                hashes, offsets = shingles(split_words(batch.column("text")), WORDS)
                bad, bags = set(), {}
                for text, item in candidates(hashes, offsets, block):
                    if text not in bags:
                        bags[text] = np.unique(hashes[offsets[text]:offsets[text + 1]])
                    bag = block.bags[item]
                    if len(np.intersect1d(bag, bags[text], assume_unique=True)) / len(bag) >= threshold:
                        bad.add(text)
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))
        return run
    for number, block in enumerate(blocks(benchmark)):
        docs = (stage(docs, "clean") if number else docs).mapInArrow(clean(block), kinds)
    return docs
