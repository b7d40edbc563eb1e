"""Line dedup by pairwise alignment.

Copies of a whole text collapse first.  Two texts overlap where a run of lines with enough words stands in both; such a
run is covered by its shortest stretches of lines that reach five words, so each line gives at most two keys, the
shortest stretch that begins and the one that ends with it.  A key's first holder is paired with every later text
that holds it: each stretch of a text that any earlier document holds is thus in the pair with one that holds it, and a
text has no more pairs than stretches, whatever the number of holders.

Each pair is aligned by patience diff over the lines they share: equal heads and tails, then the longest ascending run of lines unique in
both, then what lies between; a longest common subsequence where no line is unique.  Aligned blocks with at least five
words go from the later text; what moved is aligned again with what is left, and what no order reaches is aligned at
the stretch that paired the two.

A line and a stretch are known by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge.llm.common import slices
from codegauge.llm.words import BASE, INVERSE, U, Words, mix, split_words, text_buffer
from codegauge.operators.skew import even_join
from codegauge.session import stage

LEAST_WORDS = 5        # a block with fewer words is never common
PASSES = 3             # alignments of one pair, each over what the ones before left
LCS_CELLS = 20_000     # larger stretches without unique lines are left to the stretches that paired the texts
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x09, 0x0B, 0x0C, 0x0D]] = True
_OWN = "__line_dedup_"


def text_lines(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Lines of texts (as ``Words``, empty lines included), a hash of each, and their numbers of words.

    The hash sums the words with their places in the line and the white space other than spaces with its own, so equal
    hashes stand for equal lines.
    """
    buffer, offsets = text_buffer(texts)
    breaks = np.flatnonzero(buffer == 0x0A)
    filled = np.flatnonzero(np.diff(offsets) > 0)       # a text of length zero has no line
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    counts[filled] = np.diff(np.searchsorted(breaks, offsets))[filled] + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    starts, stops = np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int64)
    heads, tails = np.zeros(first[-1], dtype=bool), np.zeros(first[-1], dtype=bool)
    heads[first[:-1][filled]] = True
    tails[first[1:][filled] - 1] = True
    starts[heads], starts[~heads] = offsets[:-1][filled], breaks + 1
    stops[tails], stops[~tails] = offsets[1:][filled], breaks
    words = split_words(texts)
    bounds = np.searchsorted(words.starts, starts)
    n_words = np.searchsorted(words.starts, stops) - bounds
    line = np.repeat(np.arange(len(starts)), n_words)
    place = (words.starts - starts[line]).astype(U)
    hashes = words.hashes()
    blanks = np.flatnonzero(_BLANK[buffer])
    blank_line = np.searchsorted(starts, blanks, side="right") - 1
    odd = (blanks - starts[blank_line]).astype(U) * U(256) + buffer[blanks]
    size = (stops - starts).astype(U)
    total = size * BASE
    some = n_words > 0
    if len(hashes):
        total[some] += np.add.reduceat(mix(hashes + place * BASE), bounds[some])
    np.add.at(total, blank_line, mix(odd * BASE))
    return Words(buffer, offsets, starts, stops, first), mix(total), n_words


def stretches(first: np.ndarray, hashes: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last line and the hash of each shortest stretch of lines with enough words, by first line.

    Text d has lines ``first[d]:first[d + 1]``.  Any run of lines with enough words is the union of those in it.
    """
    n = len(hashes)
    line = np.arange(n, dtype=np.int64)
    low, high = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    before = np.concatenate(([0], np.cumsum(n_words)))
    stop = np.searchsorted(before, before[:-1] + LEAST_WORDS)              # one after the last line
    start = np.searchsorted(before, before[1:] - LEAST_WORDS, side="right") - 1
    ahead, behind = stop <= high, start >= low
    starts = np.concatenate((line[ahead], start[behind]))
    stops = np.concatenate((stop[ahead], line[behind] + 1))
    both = np.unique(starts * (n + 1) + stops)
    starts, stops = both // (n + 1), both % (n + 1)
    down, up = np.full(n, INVERSE, dtype=U), np.full(n, BASE, dtype=U)
    down[:1] = up[:1] = U(1)
    prefix = np.concatenate((np.zeros(1, dtype=U), np.cumsum(hashes * np.multiply.accumulate(down), dtype=U)))
    total = (prefix[stops] - prefix[starts]) * np.multiply.accumulate(up)[starts]
    return starts, stops - 1, mix(total + (stops - starts).astype(U) * BASE)


def _stretch_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: hash, first and last line of each shortest stretch; hash and words (five at most) of every line."""
    for batch in slices(batches, "text"):
        lines, hashes, n_words = text_lines(batch.column("text"))
        few = np.minimum(n_words, LEAST_WORDS).astype(np.uint8)
        spans = list(zip(lines.first[:-1].tolist(), lines.first[1:].tolist()))
        start, last, key = stretches(lines.first, hashes, n_words)
        sums = pa.array(np.searchsorted(start, lines.first).astype(np.int32))
        base = np.repeat(lines.first[:-1], np.diff(sums.to_numpy()))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("digest"), *(pa.ListArray.from_arrays(sums, pa.array(values)) for values in (
                key.view(np.int64), (start - base).astype(np.int32), (last - base).astype(np.int32))),
            pa.array([hashes[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([few[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["doc_id", "digest", "keys", "starts", "ends", "sequence", "words"])


def _subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence, as places."""
    n = len(b)
    best = [[0] * (n + 1)]
    for x in reversed(a):
        row = [0] * (n + 1)
        for j in range(n - 1, -1, -1):
            row[j] = best[-1][j + 1] + 1 if x == b[j] else max(best[-1][j], row[j + 1])
        best.append(row)
    best.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < n:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i of a, j of b), ascending in both.

    A stretch gives its equal head and tail, then the longest ascending run of lines that are unique in both
    stretches, and continues between those; one without such lines gives a longest common subsequence, if it is not too long.
    """
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, ie, j, je = work.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        left, right = {}, {}
        for k in range(i, ie):
            left[a[k]] = -1 if a[k] in left else k
        for k in range(j, je):
            right[b[k]] = -1 if b[k] in right else k
        both = [(left[x], k) for x, k in right.items() if k >= 0 and left.get(x, -1) >= 0]
        if not both:
            if (ie - i) * (je - j) <= LCS_CELLS and not set(a[i:ie]).isdisjoint(b[j:je]):
                out += [(i + p, j + q) for p, q in _subsequence(a[i:ie], b[j:je])]
            continue
        both.sort(key=lambda p: p[1])
        tails, ends, back = [], [], [-1] * len(both)
        for n, (at, _) in enumerate(both):
            k = bisect_left(tails, at)
            if k == len(tails):
                tails.append(at)
                ends.append(n)
            else:
                tails[k], ends[k] = at, n
            back[n] = ends[k - 1] if k else -1
        anchors, n = [], ends[-1]
        while n >= 0:
            anchors.append(both[n])
            n = back[n]
        anchors.reverse()
        for (p, q), (pe, qe) in zip(anchors, [*anchors[1:], (ie, je)]):
            work.append((p, pe, q, qe))
        work.append((i, anchors[0][0], j, anchors[0][1]))
    return sorted(out)


def aligned_lines(sequence: list[int], words: bytes, shared: list[tuple[int, int, int]]) -> set[int]:
    """Lines of the later text of a pair that go.

    ``sequence`` and ``words`` are hashes and words of its lines; ``shared`` are the stretches that pair it with the earlier
    text: first and last line here, first line there.
    """
    earlier = {at + k: sequence[start + k] for start, end, at in shared for k in range(end - start + 1)}
    places = sorted(earlier)
    first = [earlier[i] for i in places]
    own = sorted({k for start, end, _ in shared for k in range(start, end + 1)})
    inside, gone = set(own), set()
    for _ in range(PASSES):
        left = [j for j in own if j not in gone]
        if not left:
            return gone
        before = len(gone)
        for p, q in patience(first, [sequence[j] for j in left]):
            i, j = places[p], left[q]
            if j in gone:
                continue
            low = high = 0          # the block that this pair of lines lies in
            while j + low - 1 in inside and earlier.get(i + low - 1) == sequence[j + low - 1]:
                low -= 1
            while j + high + 1 in inside and earlier.get(i + high + 1) == sequence[j + high + 1]:
                high += 1
            if sum(words[j + low:j + high + 1]) >= LEAST_WORDS:
                gone.update(range(j + low, j + high + 1))
        if len(gone) == before:
            break
    for start, end, _ in shared:
        gone.update(range(start, end + 1))
    return gone


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per later text the blocks that its alignments with earlier ones take away."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        blocks = []
        columns = (batch.column(n).to_pylist() for n in ("sequence", "words", "shared"))
        for sequence, words, shared in zip(*columns):
            sequence = np.frombuffer(sequence, dtype=U).tolist()
            pairs: dict[int, list[tuple[int, int, int]]] = {}
            for s in shared:
                pairs.setdefault(s["first"], []).append((s["start"], s["end"], s["at"]))
            lines = np.array(sorted(set().union(*(aligned_lines(sequence, words, p) for p in pairs.values()))), dtype=np.int32)
            cuts = np.flatnonzero(np.diff(lines) != 1) + 1
            blocks.append([{"start": int(x[0]), "end": int(x[-1])} for x in np.split(lines, cuts)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(blocks, kind)], names=["doc_id", "digest", "blocks"])


def _distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of later copies, and the lines of the other texts, one document each."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    outlines = stage(known.where("doc_id is not null and text <> ''").mapInArrow(
        _stretch_rows, "doc_id long, digest binary, keys array<long>, starts array<int>, ends array<int>, sequence binary, words binary"), "outlines")
    # one text per id, one id per text
    member = outlines.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    heads = member.groupBy("digest").agg(F.min("doc_id").alias("head"))
    named = stage(even_join(member, heads, "digest"), "named")
    own = stage(outlines.join(named.where("doc_id = head").select("doc_id", "digest"), ["doc_id", "digest"], "left_semi"
                              ).dropDuplicates(["doc_id"]), "heads")
    return named.where("doc_id <> head").select("doc_id", "digest"), own


def line_removals(docs: DataFrame) -> DataFrame:
    """What goes from each document that loses lines: (doc_id, digest, whole, blocks).

    ``whole``: all of it, as a copy of an earlier document; ``blocks``: first and last line numbers, from 0.  ``digest``
    is the SHA-256 of the text meant.
    """
    copies, own = _distinct_texts(docs)
    held = own.select("doc_id", F.explode(F.arrays_zip("keys", "starts", "ends")).alias("s")).select(
        "doc_id", F.col("s.keys").alias("key"), F.col("s.starts").alias("start"), F.col("s.ends").alias("end"))
    shared = held.groupBy("key").agg(F.min("doc_id").alias("first"), F.min_by("start", "doc_id").alias("at"), F.max("doc_id").alias("last")).where("first < last")
    met = even_join(held, shared.select("key", "first", "at"), "key").where("doc_id <> first")
    # a text's pairs: no longer than its own lines
    pairs = met.groupBy("doc_id").agg(F.collect_list(F.struct("first", "start", "end", "at")).alias("shared"))
    aligned = pairs.join(own.select("doc_id", "digest", "sequence", "words"), "doc_id").mapInArrow(
        _align, "doc_id long, digest binary, blocks array<struct<start: int, end: int>>")
    blocks = aligned.select("doc_id", "digest", F.lit(False).alias("whole"), "blocks")
    return blocks.unionAll(copies.select("doc_id", "digest", F.lit(True), F.lit(None).cast("array<struct<start:int,end:int>>")))


def _rebuild(names: list[str], counts: Sequence[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            touched = batch.column(_OWN + "whole").is_valid()
            at = np.flatnonzero(touched.to_numpy(zero_copy_only=False))
            removed = np.zeros(batch.num_rows, dtype=np.int64)
            left = []
            for row, text, whole, blocks in zip(at.tolist(), *(c.take(pa.array(at)).to_pylist() for c in (
                    texts, batch.column(_OWN + "whole"), batch.column(_OWN + "blocks")))):
                lines = text.split("\n")
                kept, after = [], 0
                for block in [] if whole else sorted((b["start"], b["end"]) for b in blocks):
                    kept += lines[after:block[0]]
                    after = max(after, block[1] + 1)
                kept += [] if whole else lines[after:]
                left.append("\n".join(kept))
                removed[row] = len(lines) - len(kept)
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.compute.replace_with_mask(texts, touched, pa.array(left, texts.type))
            if counts:
                columns[counts[0]] = pa.compute.add(
                    pa.compute.cast(pa.compute.fill_null(pa.compute.count_substring(texts, "\n"), 0), pa.int64()),
                    pa.compute.cast(pa.compute.greater(pa.compute.fill_null(pa.compute.binary_length(texts), 0), 0), pa.int64()))
                columns[counts[1]] = pa.array(removed)
            yield pa.RecordBatch.from_pydict(columns)
    return run


def dedup_lines(docs: DataFrame, counts: Sequence[str] = ()) -> DataFrame:
    """``docs`` without the lines that align with an earlier document.

    Earlier means a smaller ``doc_id``.  A line is what stands between line feeds.  A block of consecutive lines with at
    least five words in all goes if any earlier document holds it too, so single short lines that recur by chance
    stay.  How many documents hold it makes no difference.  A later copy of a whole text loses all of it, however
    short its lines, and keeps its row with an empty text.  ``counts`` names two columns for the numbers of lines and
    of lines removed; names that ``docs`` has raise an error.

    Null and empty texts stay as they are.  A row with a null ``doc_id`` has no place in the order: it loses nothing
    and costs others nothing.  Rows that repeat a ``doc_id`` are one document, with the text of the smallest digest;
    a row with that id and another text stays whole.  An empty table gives no rows; all other columns pass through.
    """
    if set(counts) & set(docs.columns):
        raise ValueError(f"columns {sorted(set(counts) & set(docs.columns))} are there already")
    gone = line_removals(docs).select(*(F.col(c).alias(_OWN + c) for c in ("doc_id", "digest", "whole", "blocks")))
    joined = docs.join(gone, (docs["doc_id"].cast("long") == gone[_OWN + "doc_id"])
                       & (F.unhex(F.sha2(docs["text"], 256)) == gone[_OWN + "digest"]), "left").drop(_OWN + "doc_id", _OWN + "digest")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    return joined.mapInArrow(_rebuild(docs.columns, counts), schema)
