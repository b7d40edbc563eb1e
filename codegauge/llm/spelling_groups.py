"""Spelling variants by a frontier that walks a trie as joins.

Words are counted per slice of texts and summed by Spark.  Those that occur often enough form two tries, one over the
words and one over the reversed words, each a table of edges (node, letter, child); a node is the hash of the prefix
that leads to it.  A frontier of states (word, position, node, edits) meets the edge table once per letter: the next
letter is followed as it is, or, while no edit has been made, replaced by a larger one or left out.  A state at the end
of its word with one edit stands on a node; if a word ends there, the two are near, which is checked on the words.

One edit leaves one half of a word as it is, so a word starts behind its first half in the forward trie and behind its
second half in the backward one, and the edit falls where nodes have few children.  Replacing by larger letters and
leaving out are enough, as the other word of a pair makes the opposite edit.  Walks are as long as half a word; words of
more than ``TRIE_LETTERS`` letters are found by the hashes of all their one-letter deletions instead, in one join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codegauge.llm.common import slices
from codegauge.llm.words import BASE, INVERSE, U, Words, marked_words, mix, text_buffer
from codegauge.operators.components import Rounds
from codegauge.operators.skew import even_join
from codegauge.session import scratch_path, stage

LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
SLIP_EVERY = 97          # of the planted slips
TRIE_LETTERS = 48        # longer words are compared by their deletions

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The checksum's table follows from its polynomial.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def letter_runs(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z, and the number of letters of each."""
    buffer, offsets = text_buffer(texts)
    lead = buffer == 0xC3                   # in UTF-8, the lead byte of exactly U+00C0 to U+00FF
    follow = np.zeros(len(buffer), dtype=bool)
    follow[1:] = lead[:-1]
    words = marked_words(_LOWER[buffer], offsets, _LETTER[buffer] | lead | follow)
    wide = np.concatenate(([0], np.cumsum(follow)))
    return words, words.ends - words.starts - (wide[words.ends] - wide[words.starts])


def checksums(words: Words, heads: np.ndarray) -> np.ndarray:
    """CRC-32 of each word behind what ``heads`` (one checksum to a word) has read before."""
    sizes = words.ends - words.starts
    state = heads.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    stops = np.searchsorted(-sizes[order], -np.arange(min(int(sizes.max(initial=0)), 64)), side="left")
    for k, n in enumerate(stops.tolist()):
        at = order[:n]
        now = state[at]
        state[at] = _CRC[(now ^ words.buffer[words.starts[at] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(sizes > 64).tolist():
        out[k] = zlib.crc32(words.buffer[words.starts[k]:words.ends[k]].tobytes(), int(heads[k]))
    return out


def _strings(words: Words, take: np.ndarray) -> pa.Array:
    step = np.zeros(len(words.buffer) + 1, dtype=np.int8)
    np.add.at(step, words.starts[take], 1)
    np.add.at(step, words.ends[take], -1)
    data = words.buffer[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate(([0], np.cumsum(words.ends[take] - words.starts[take]))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(take), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _counted(least: int, slips: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, letters = letter_runs(batch.column("text"))
            slipped: list[str] = []
            plain = np.ones(len(letters), dtype=bool)
            if slips:
                ids = batch.column("doc_id").to_pylist()
                known = np.repeat(np.array([i is not None for i in ids], dtype=bool), words.counts)
                heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
                check = checksums(words, np.repeat(heads, words.counts))
                hit = known & (check % np.uint32(SLIP_EVERY) == 0)
                plain = ~hit
                for k in np.flatnonzero(hit & (letters > least)).tolist():
                    word = words.buffer[words.starts[k]:words.ends[k]].tobytes().decode("utf-8")
                    at = int(check[k]) % len(word)
                    slipped.append(word[:at] + word[at + 1:])
            found = _strings(words, np.flatnonzero(plain & (letters >= least)))
            counts = pa.chunked_array([found, pa.array(slipped, pa.string())]).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])
    return run


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, slips: bool = False) -> DataFrame:
    """(word, n) over all texts of ``docs``; one row per distinct word of a slice is shuffled."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(_counted(least_letters, slips), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and direction: where its frontier starts, and the nodes behind its first, second, ... letter."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        for back in (False, True):
            ways = [w[::-1] for w in words] if back else words
            codes = np.array(ways, dtype=f"U{TRIE_LETTERS}").view(np.uint32).reshape(len(ways), TRIE_LETTERS).astype(U)
            nodes = np.empty((len(ways), TRIE_LETTERS), dtype=U)
            now = np.full(len(ways), 2 + back, dtype=U)
            for k in range(TRIE_LETTERS):
                now = mix(now * BASE + codes[:, k] + U(1))
                nodes[:, k] = now
            inside = np.arange(TRIE_LETTERS) < sizes[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)),
                                             pa.array(nodes[inside].view(np.int64)))
            start = sizes - sizes // 2 if back else sizes // 2
            yield pa.RecordBatch.from_arrays([pa.array(ways, pa.string()), pa.array([back] * len(ways)), pa.array(start.astype(np.int32)), lists],
                                             names=["way", "back", "start", "nodes"])


def _walk(paths: DataFrame, nearest_root: int) -> DataFrame:
    """(word, near) candidates: the words on whose end a state with one edit comes to stand.

    No frontier starts less than ``nearest_root`` letters behind a root, so there are no edges there.
    """
    spark = paths.sparkSession
    behind = F.posexplode(F.slice("nodes", F.lit(nearest_root), F.size("nodes"))).alias("k", "node")
    place = F.col("k") + nearest_root            # letters that lead to the node
    edges = stage(paths.select("way", "nodes", behind).where(place < F.size("nodes")).select(
        F.col("node").alias("from"), F.substring("way", place + 1, F.lit(1)).alias("letter"),
        F.element_at("nodes", place + 1).alias("child")).distinct(), "edges")
    word = F.when(F.col("back"), F.reverse("way")).otherwise(F.col("way"))
    ends = paths.select(F.element_at("nodes", -1).alias("node"), word.alias("near"))
    frontier = paths.select("way", "back", F.col("start").alias("position"), F.element_at("nodes", F.col("start")).alias("node"), F.lit(0).alias("edits"))
    base, written, number = scratch_path(spark, "frontier"), [], 0
    letter = F.substring("way", F.col("position") + 1, F.lit(1))
    over = F.col("position") == F.char_length("way")
    while True:
        on = (F.col("letter") == F.col("next")) | ((F.col("edits") == 0) & (F.col("letter") > F.col("next")))
        now = frontier.withColumn("next", letter)
        followed = now.join(edges, (F.col("node") == F.col("from")) & on).select(
            "way", "back", (F.col("position") + 1).alias("position"), F.col("child").alias("node"),
            (F.col("edits") + (F.col("letter") != F.col("next")).cast("int")).alias("edits"))
        left_out = now.where("edits = 0").select("way", "back", F.col("position") + 1, "node", F.lit(1))
        after = followed.unionAll(left_out).where(~over | (F.col("edits") == 1))
        seen = Observation(f"frontier_{number}")
        path = f"{base}/{number}"
        after.observe(seen, F.count_if(~over).alias("open")).write.parquet(path)
        written.append(path)
        number += 1
        frontier = spark.read.schema(after.schema).parquet(path).where(~over)
        if not seen.get["open"]:
            break
    # every round's finished states; the rounds together hold each state once
    done = spark.read.schema(after.schema).parquet(*written).where(over)
    return done.join(ends, "node").select(word.alias("word"), "near")


def _deletions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word its number, the hash of the whole (place -1) and of each deletion of one letter."""
    for batch in batches:
        for word, number in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist()):
            codes = np.array([word], dtype=f"U{len(word)}").view(np.uint32).astype(U) + U(1)
            n = len(codes)
            down, up = np.full(n, INVERSE, dtype=U), np.full(n + 1, BASE, dtype=U)
            down[0] = up[0] = U(1)
            np.multiply.accumulate(up, out=up)
            prefix = np.concatenate((np.zeros(1, dtype=U), np.cumsum(codes * np.multiply.accumulate(down), dtype=U)))
            # letters behind the deleted one move up by one place
            without = prefix[:-1] + (prefix[-1] - prefix[1:]) * BASE
            keys = mix(np.concatenate((prefix[-1:], without)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, number, dtype=np.int64)), pa.array(np.arange(-1, n)), pa.array(keys.view(np.int64))],
                names=["id", "place", "key"])


def _long_pairs(long_words: DataFrame) -> DataFrame:
    """(word, near) candidates among long words: equal but for a letter at one place, or one the other without a letter."""
    named = stage(long_words.select("word", F.xxhash64("word").alias("id")), "long_words")
    keys = stage(named.mapInArrow(_deletions, "id long, place long, key long"), "deletions")
    whole = keys.where("place = -1").select(F.col("id").alias("other"), "key")
    parts = keys.where("place >= 0")
    pairs = parts.select("id", "key").distinct().join(whole, "key").select("id", "other").unionAll(
        parts.join(parts.select(F.col("id").alias("other"), "key", "place"), ["key", "place"]).where("id < other").select("id", "other")).distinct()
    other = named.select(F.col("word").alias("near"), F.col("id").alias("other"))
    return pairs.join(named, "id").join(other, "other").select("word", "near")


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, near), both directions: words of ``words(word)`` that differ by one letter put in, left out or replaced.

    The words are distinct and have at least ``least_letters`` letters.
    """
    size = F.char_length("word")
    paths = stage(words.where(size <= TRIE_LETTERS).select("word").mapInArrow(
        _paths, "way string, back boolean, start int, nodes array<long>"), "paths")
    found = _walk(paths, least_letters // 2).unionAll(_long_pairs(words.where(size >= TRIE_LETTERS).select("word")))
    checked = found.where(F.levenshtein("word", "near", 1) == 1)
    return stage(checked.unionAll(checked.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct(), "near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, twice as far with every round."""
    rounds = Rounds(forms.sparkSession, "roots")
    now, _ = rounds.keep(forms.select("word", F.col("form").alias("root")), n=F.count(F.lit(1)))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = F.coalesce(F.col("further") != F.col("root"), F.lit(False))
        after = even_join(now, ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), moved.alias("moved"))
        now, seen = rounds.keep(after, n=F.count_if("moved"))
        now = now.drop("moved")
        if not seen["n"]:
            return now


def spelling_groups(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: float = RATIO,
                    slips: bool = False) -> DataFrame:
    """Words of ``docs`` (doc_id, text; more columns are ignored) and the commoner spelling each may be a variant of.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only, of at least ``least_letters``
    letters and ``least_count`` occurrences over all texts.  Result: word, form (its near word of largest n, ties to the smallest
    in code-point order, if that n is at least ``ratio`` times the word's; else null), root (the last form reached from
    it, itself if it has none), n (occurrences), n_near (words one edit away) and form_n.  With a ratio above one
    forms lead to ever larger counts, so they never go round in a circle; smaller ratios raise an error.

    With ``slips``, a run whose checksum behind ``<doc_id>:`` is divisible by ``SLIP_EVERY`` loses one letter first.  A
    null text has no words; texts with a null ``doc_id`` are counted without slips; repeated rows count each time.  A
    table without such words gives no rows.  Words of any length are compared whole.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above one")
    if least_letters < 2:
        raise ValueError("a word of one letter has no half to start from")
    counted = stage(word_counts(docs, least_letters, slips).where(F.col("n") >= least_count), "words")
    near = near_words(counted, least_letters)
    sized = near.join(counted.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = sized.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best"))
    large = -F.col("best.minus") >= F.col("n") * ratio
    judged = stage(counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"),
        F.when(large, -F.col("best.minus")).alias("form_n")), "judged")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
