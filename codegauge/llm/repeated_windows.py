"""Substring dedup: every fixed-length window of words that an earlier document also holds goes.

Texts are dealt into batches of a few megabytes by a hash of ``doc_id``.  Each batch rolls a Rabin-Karp hash over
its windows and keeps one entry per distinct hash, with the smallest document that holds it, so that a window
which a third of all documents share weighs one entry per batch.  The entries go to hash buckets as packed
arrays; a bucket finds the smallest document of each hash and answers every batch with one bit per entry.  The
batches then roll their hashes again, merge the repeated windows into maximal word intervals and cut them.

Two shuffles carry the corpus: its text, and eight bytes for each distinct window of a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.common import parts_for, shuffle_partitions, text_bytes
from codegauge.llm.words import U, split_words, windows

WINDOW = 13
BATCH_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20
#: Text of a task, for tables so large that the session's number of partitions would mean more.
TASK_BYTES = 64 << 20

_ENTRIES = "bucket int, batch long, hashes binary, ids binary, counts binary"
_ANSWERS = "batch long, bucket int, bits binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                     ("kept_text", pa.string()), ("kept_sha256", pa.string())])


class _Batch:
    """The windows of one batch: documents by (doc_id, text), entries by their first place."""

    def __init__(self, group: pa.Table, length: int):
        known = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids_array = known.column("doc_id").combine_chunks()
        ids = pa.compute.fill_null(self.ids_array, 0).to_numpy()
        null = self.ids_array.is_null().to_numpy(zero_copy_only=False)
        self.words = split_words(known.column("text"))
        hashed, at = windows(self.words.hashes(), self.words.first, length)
        doc = np.searchsorted(self.words.first, at, side="right") - 1
        if null.any():
            take = ~null[doc]
            hashed, at, doc = hashed[take], at[take], doc[take]
        self.at, self.window_ids = at, ids[doc]
        order = np.argsort(hashed, kind="stable")
        ranked = hashed[order]
        head = np.ones(len(ranked), dtype=bool)
        head[1:] = ranked[1:] != ranked[:-1]
        firsts = order[head]                       # smallest place, hence smallest document, of each hash
        inverse = np.empty(len(ranked), dtype=np.int64)
        inverse[order] = np.cumsum(head) - 1
        by_place = np.argsort(firsts, kind="stable")
        rank = np.empty(len(firsts), dtype=np.int64)
        rank[by_place] = np.arange(len(firsts))
        self.entry_of = rank[inverse] if len(ranked) else inverse
        firsts = firsts[by_place]
        self.hashes, self.entry_ids = hashed[firsts], self.window_ids[firsts]

    def by_bucket(self, buckets: int):
        """(bucket, entries) in a fixed order."""
        bucket = (self.hashes >> U(20)) % U(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(bucket[part[0]]), part


def _entries(length: int, buckets: int):
    def run(key, group):
        batch = _Batch(group, length)
        out = {"bucket": [], "batch": [], "hashes": [], "ids": [], "counts": []}
        for bucket, part in batch.by_bucket(buckets):
            ids = batch.entry_ids[part]
            heads = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1))
            out["bucket"].append(bucket)
            out["batch"].append(key[0].as_py())
            out["hashes"].append(batch.hashes[part].tobytes())
            out["ids"].append(ids[heads].tobytes())
            out["counts"].append(np.diff(np.append(heads, len(ids))).astype(np.uint32).tobytes())
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()),
                                               ("ids", pa.binary()), ("counts", pa.binary())]))
    return run


def _answers(group):
    parts = [np.frombuffer(x, dtype=U) for x in group.column("hashes").to_pylist()]
    hashes = np.concatenate(parts)
    ids = np.concatenate([
        np.repeat(np.frombuffer(i, dtype=np.int64), np.frombuffer(c, dtype=np.uint32))
        for i, c in zip(group.column("ids").to_pylist(), group.column("counts").to_pylist())])
    order = np.argsort(hashes, kind="stable")
    ranked, owners = hashes[order], ids[order]
    head = np.ones(len(ranked), dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(head)
    least = np.minimum.reduceat(owners, starts)
    later = np.empty(len(ranked), dtype=bool)
    later[order] = owners > np.repeat(least, np.diff(np.append(starts, len(ranked))))
    cuts = np.cumsum([len(x) for x in parts])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(later, cuts)]
    return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _cut(length: int, buckets: int, with_text: bool):
    def run(docs, answers):
        batch = _Batch(docs, length)
        words = batch.words
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
        gone = np.zeros(len(batch.hashes), dtype=bool)
        for bucket, part in batch.by_bucket(buckets):
            gone[part] = np.unpackbits(np.frombuffer(bits[bucket], dtype=np.uint8), count=len(part)).astype(bool)
        repeated = gone[batch.entry_of] | (batch.window_ids > batch.entry_ids[batch.entry_of])
        at = batch.at[repeated]
        # overlapping windows merge: +1 where one starts, -1 behind its end
        step = np.zeros(len(words.starts) + 1, dtype=np.int32)
        step[at] += 1
        step[at + length] -= 1
        kept = np.cumsum(step[:-1]) == 0
        sums = np.concatenate(([0], np.cumsum(~kept)))
        removed = sums[words.first[1:]] - sums[words.first[:-1]]
        texts = kept_texts(words, kept)
        out = {"doc_id": batch.ids_array, "n_words": pa.array(words.counts, pa.int64()),
               "n_removed": pa.array(removed, pa.int64()),
               "kept_text": pa.array([t.decode("utf-8") if with_text else None for t in texts], pa.string()),
               "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
        return pa.table(out, schema=_RESULT)
    return run


def kept_texts(words, kept: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    buffer = np.append(words.buffer, np.uint8(0x20))
    last = np.zeros(len(words.starts), dtype=bool)
    has = words.counts > 0
    last[words.first[1:][has] - 1] = True
    buffer[words.ends[~last]] = 0x20
    step = np.zeros(len(buffer) + 1, dtype=np.int8)
    step[words.starts[kept]] += 1
    np.add.at(step, (words.ends + ~last)[kept], -1)
    mask = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    out = buffer[mask].tobytes()
    held = np.concatenate(([0], np.cumsum(mask)))[words.text_offsets]
    return [out[a:b].rstrip(b" ") for a, b in zip(held[:-1].tolist(), held[1:].tolist())]


def remove_repeated_windows(docs: DataFrame, length: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 of every row of ``docs`` (doc_id, text; more columns are ignored).

    A word goes when a window of ``length`` words that covers it has the same words as a window of a document
    with a smaller ``doc_id``; windows are judged on the texts as given.  Null texts are empty.  Rows that repeat
    a ``doc_id`` are each cut against smaller ids only, never against each other; a row with a null ``doc_id``
    has no place in the order: it loses nothing and costs others nothing.  Texts shorter than a window stay whole.
    An empty table gives no rows.  ``kept_text`` is null unless ``with_text``.

    Window identity is a 64-bit hash.  With n distinct windows a false match is expected n**2 / 2**65 times.
    """
    spark = docs.sparkSession
    size = text_bytes(docs)
    tasks = parts_for(size, TASK_BYTES, shuffle_partitions(spark))
    batches = parts_for(size, BATCH_BYTES)
    buckets = parts_for(size, BUCKET_BYTES, shuffle_partitions(spark))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(key, F.lit(batches)).alias("batch")).repartition(tasks, "batch")
    entries = dealt.groupBy("batch").applyInArrow(_entries(length, buckets), _ENTRIES).repartition(tasks, "bucket")
    answers = entries.groupBy("bucket").applyInArrow(_answers, _ANSWERS).repartition(tasks, "batch")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _cut(length, buckets, with_text),
        "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
