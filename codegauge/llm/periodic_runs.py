"""Periodic runs by maximal-pair enumeration.

A run of period q and length q + l is the maximal pair of its first l words and the same words q further on: equal,
with different words before them and behind them.  Suffixes of each text are sorted by prefix doubling, their common
prefixes give the tree of LCP intervals, and the tree is walked from its leaves up.  Each interval keeps its suffixes
by text place with the class of each, the word on its left; where two children of an interval of depth l join,
suffixes of different classes that are next to each other in the text and at most l / (exponent - 1) apart are maximal
pairs, hence runs, and nothing has to be extended.  Between the two places of a run's least period there is no third
place of the same l words, as two periods that fit into l words have a common divisor that is a period as well; so
neighbours are enough, and joining the smaller child into the larger one costs n log n.

Texts do not meet, so nothing is shuffled.  Everything but the walk over intervals that can hold a pair is done with
NumPy on slices of many texts.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.common import slices
from codegauge.llm.words import BASE, U, Words, mix, split_words

LEAST_LENGTH = 6
LEAST_EXPONENT = 4

_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string, starts array<long>, lengths array<long>, periods array<long>, collapsed_text string")


def least_depth(length: int, exponent: int) -> int:
    """The fewest words that the two halves of a run's maximal pair share, over all periods."""
    return min(max(length - q, (exponent - 1) * q) for q in range(1, length + 1))


def planted_order(counts: np.ndarray, first: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """The word that stands at each place after every tenth text (by checksum of its id) was made periodic."""
    source = np.arange(int(first[-1]), dtype=np.int64)
    for text, (n, key) in enumerate(zip(counts.tolist(), ids)):
        if not n or key is None:
            continue
        check = zlib.crc32(str(key).encode())
        if check % 10:
            continue
        g = check // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        low = int(first[text])
        source[low + a:low + n] = low + a + np.arange(n - a) % p
    return source


def _same_start(hashes: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """The texts in which ``depth`` words stand at two places with different words on their left."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    if n < depth:
        return np.zeros(0, dtype=np.int64)
    key = hashes[:n - depth + 1].copy()
    for k in range(1, depth):
        key = key * BASE + hashes[k:n - depth + 1 + k]
    whole = text[:n - depth + 1] == text[depth - 1:]
    at = np.flatnonzero(whole)
    key = mix(key[at] + mix(text[at].astype(U) + U(1)))
    bare = np.zeros(n, dtype=bool)          # nothing on the left
    bare[first[:-1][counts > 0]] = True
    order = np.argsort(key)
    key, at = key[order], at[order]
    bare, left = bare[at], hashes[at - 1]
    same = (key[1:] == key[:-1]) & ((left[1:] != left[:-1]) | bare[1:] | bare[:-1])
    return np.unique(text[at[1:][same]])


def sorted_suffixes(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of several texts, sorted within each text, and the words each shares with the one before it.

    ``words`` are numbers of words, texts behind one another; ``end`` is the end of the text for each place.
    """
    n = len(words)
    _, dense, size = np.unique(end * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[dense]          # how many suffixes are smaller
    live = np.flatnonzero(size[dense] > 1)
    levels, h = [rank.astype(np.int32 if n < 2**31 else np.int64)], 1
    while len(live):
        now = levels[-1]
        ahead = live + h
        behind = np.zeros(len(live), dtype=np.int64)
        inside = ahead < end[live]
        behind[inside] = now[ahead[inside]].astype(np.int64) + 1
        key = now[live].astype(np.int64) * (n + 1) + behind
        order = np.argsort(key)
        key, group = key[order], now[live][order]
        place = np.arange(len(key))
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        group_start = np.maximum.accumulate(np.where(new_group, place, 0))
        key_start = np.maximum.accumulate(np.where(new_key, place, 0))
        after = now.copy()
        after[live[order]] = group + (key_start - group_start)
        levels.append(after)
        heads = np.flatnonzero(new_key)
        sizes = np.diff(np.append(heads, len(key)))
        live = np.sort(live[order[np.repeat(sizes > 1, sizes)]])
        h *= 2
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    shared = np.zeros(n, dtype=np.int64)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    i, j = order[near - 1], order[near]
    got = np.zeros(len(near), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = i + got, j + got
        able = np.flatnonzero((p < end[i]) & (q < end[j]))
        equal = able[levels[k][p[able]] == levels[k][q[able]]]
        got[equal] += 1 << k
    shared[near] = got
    return order, shared


def _join(large: list[int], small: list[int], depth: int, left: dict[int, int] | np.ndarray, length: int, exponent: int, out: list) -> list[int]:
    """Both children's places in text order; maximal pairs between them are added to ``out``."""
    if len(large) < len(small):
        large, small = small, large
    reach = depth // (exponent - 1)
    spots = [bisect_left(large, x) for x in small]
    for x, k in zip(small, spots):
        for y in large[max(k - 1, 0):k + 1]:
            i, j = (x, y) if x < y else (y, x)
            q = j - i
            if q <= reach and depth + q >= length and left[i] != left[j]:
                out.append((i, depth + q, q))
    if len(small) * 16 < len(large):
        for x, k in zip(reversed(small), reversed(spots)):
            large.insert(k, x)
    else:
        large += small
        large.sort()
    return large


def interval_pairs(places: list[int], shared: list[int], left: np.ndarray, length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal pairs in one tree of LCP intervals.

    ``places`` are suffixes in order; ``shared[k]`` belongs to places k - 1 and k.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    for k in range(1, len(places) + 1):
        depth = shared[k] if k < len(places) else -1
        held = [places[k - 1]]
        while stack and stack[-1][0] > depth:
            below, other = stack.pop()
            held = _join(other, held, below, left, length, exponent, out)
        if stack and stack[-1][0] == depth:
            below, other = stack.pop()
            held = _join(other, held, depth, left, length, exponent, out)
        stack.append((depth, held))
    return out


def find_runs(hashes: np.ndarray, first: np.ndarray, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, starts counted over all texts, by start and period.

    Text d has the words ``first[d]:first[d + 1]``, known by their hashes.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    depth = least_depth(length, exponent)
    texts = _same_start(hashes, first, depth)
    if not len(texts):
        return none
    counts = np.diff(first)[texts]
    stops = np.cumsum(counts)
    at = np.arange(int(stops[-1])) + np.repeat(first[:-1][texts] - (stops - counts), counts)
    _, word = np.unique(hashes[at], return_inverse=True)
    end = np.repeat(stops, counts)
    order, shared = sorted_suffixes(word.astype(np.int64), end)
    left = np.empty(len(word), dtype=np.int64)
    left[1:] = word[:-1]
    left[stops - counts] = -1
    # trees of intervals of at least that depth
    inner = shared >= depth
    heads = np.flatnonzero(~inner & np.append(inner[1:], False))
    size = np.diff(np.append(np.flatnonzero(~inner), len(shared)))
    size = size[size > 1]
    member = np.repeat(heads - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    cuts = np.cumsum(size) - size
    if not len(cuts):
        return none
    place, prefix = order[member], shared[member].copy()
    prefix[cuts] = 0
    tree = np.repeat(np.arange(len(cuts)), size)
    by_place = place[np.lexsort((place, tree))]
    gaps = np.diff(by_place, prepend=0)
    gaps[cuts] = np.iinfo(np.int64).max
    classes = left[place]
    # one class on the left holds no maximal pair, nor do places further apart than the longest prefix allows
    able = (np.minimum.reduceat(classes, cuts) != np.maximum.reduceat(classes, cuts)) & (
        np.minimum.reduceat(gaps, cuts) <= np.maximum.reduceat(prefix, cuts) // (exponent - 1))
    found: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(able).tolist():
        low, high = cuts[k], cuts[k] + size[k]
        found += interval_pairs(place[low:high].tolist(), prefix[low:high].tolist(), left, length, exponent)
    if not found:
        return none
    runs = np.array(sorted(found), dtype=np.int64)
    runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))]     # the least period of each stretch
    runs[:, 0] = at[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def joined_words(words: Words, source: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space; word i of the text is word ``source[i]`` of the buffer."""
    take = source[kept]
    sizes = words.ends[take] - words.starts[take] + 1
    stops = np.cumsum(sizes)
    buffer = np.append(words.buffer, np.uint8(0x20))
    at = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(words.starts[take] - (stops - sizes), sizes)
    out = buffer[np.minimum(at, len(buffer) - 1)]
    out[stops - 1] = 0x20
    joined = out.tobytes()
    held = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(kept)))[words.first]]
    return [joined[a:max(a, b - 1)] for a, b in zip(held[:-1].tolist(), held[1:].tolist())]


def _runs(length: int, exponent: int, planted: bool, details: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split_words(batch.column("text"))
            first = words.first
            ids = batch.column("doc_id").to_pylist()
            source = planted_order(words.counts, first, ids) if planted else np.arange(int(first[-1]))
            hashes = words.hashes()[source] if len(source) else np.zeros(0, dtype=U)
            runs = find_runs(hashes, first, length, exponent)
            kept = np.ones(len(source) + 1, dtype=bool)
            step = np.zeros(len(source) + 1, dtype=np.int64)
            np.add.at(step, runs[:, 0] + runs[:, 2], 1)
            np.add.at(step, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(step)[:-1] == 0
            texts = joined_words(words, source, kept)
            low = np.searchsorted(runs[:, 0], first[:-1])
            high = np.searchsorted(runs[:, 0], first[1:])
            out = {n: [] for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "starts", "lengths", "periods")}
            for text, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
                own = [(s - int(first[text]), n, p) for s, n, p in runs[a:b].tolist()]
                best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                for name, value in zip(("start", "length", "period"), best):
                    out[name].append(value)
                out["n_runs"].append(len(own))
                out["exponent_milli"].append(1000 * best[1] // best[2] if own else None)
                out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest())
                for name, values in zip(("starts", "lengths", "periods"), zip(*own) if own else ((), (), ())):
                    out[name].append(list(values) if details else None)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(pa.array(out[n], pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")),
                pa.array(out["runs_sha256"], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                *(pa.array(out[n], lists) for n in ("starts", "lengths", "periods")),
                pa.array([t.decode("utf-8") if details else None for t in texts], pa.string())],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
                       "starts", "lengths", "periods", "collapsed_text"])
    return run


def periodic_runs(docs: DataFrame, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, planted: bool = False,
                  details: bool = True) -> DataFrame:
    """The periodic runs of every row of ``docs`` (doc_id, text; more columns are ignored), one row each.

    A run is a stretch of consecutive words with least period q and at least ``length`` and ``exponent * q`` words
    (``exponent`` of three or more) that no neighbouring word extends with that period.  n_runs counts them; start, length,
    period and exponent_milli speak of the longest (ties: smaller start, then period; null without runs), ``starts``,
    ``lengths`` and ``periods`` list all by start and period.  ``collapsed_text`` is what is left when each run keeps
    its first q words, joined by one space.  Digests: of all runs, and of the collapsed text.  Without ``details``
    lists and text are null.  With ``planted``, every tenth text by checksum of its id is made periodic first.

    A null text is empty: no runs.  A row with a null ``doc_id`` is read as it is (nothing is planted in it); rows
    that repeat a ``doc_id`` or a text are worked out on their own.  An empty table gives no rows.  A very long text is worked
    out whole in its task: some 100 bytes a word.  Words are told apart by a 64-bit hash within one slice of texts.
    """
    if exponent < 3:
        raise ValueError("exponent must be at least 3")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(_runs(length, exponent, planted, details), _SCHEMA)
