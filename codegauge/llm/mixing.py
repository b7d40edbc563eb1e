"""Mixing sources to target weights by proportionate-fair scheduling.

Each source is cut into blocks of equal size.  With target parts k of K in all, block i of a source (from 0) may
start at slot floor(i K / k) and must have its slot before ceil((i + 1) K / k); earliest-deadline-first over the
released blocks meets every deadline, so after any number of slots each source is less than one block away from
its share.  Integer parts make the schedule repeat every K slots: one period is worked out on the driver, and each
document's slot follows from its block number.  When a source runs dry, a new phase starts with the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.operators.skew import running_totals
from codegauge.session import stage

BLOCK_CHARS = 1 << 16
PARTS = 1_000
MOST_SOURCES = 1_000     # the schedule is a driver-side table of at most sources x parts slots; more sources raise


def period(parts: Mapping[object, int]) -> dict[object, list[int]]:
    """The slots of each source's blocks within one period of ``sum(parts)`` slots."""
    total = sum(parts.values())
    names = list(parts)
    coming = [[] for _ in range(total)]
    for n, name in enumerate(names):
        k = parts[name]
        for i in range(k):
            coming[i * total // k].append((-(-(i + 1) * total // k), n, i))
    ready, slots = [], {name: [0] * parts[name] for name in names}
    for slot in range(total):
        for block in coming[slot]:
            heapq.heappush(ready, block)
        deadline, n, i = heapq.heappop(ready)
        assert slot < deadline
        slots[names[n]][i] = slot
    return slots


@dataclass
class Lane:
    """One source's phases: first block, first slot, parts, period length and slots within it."""
    first: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    parts: int = 1
    period: list[int] = field(default_factory=list)
    slots: list[np.ndarray] = field(default_factory=list)


def lanes(blocks: Mapping[object, int], parts: Mapping[object, int]) -> dict[object, Lane]:
    """The whole schedule of sources with so many blocks each."""
    out = {name: Lane(parts=parts[name]) for name in blocks}
    done = dict.fromkeys(blocks, 0)
    live = {name: parts[name] for name in sorted(blocks, key=lambda x: (x is not None, x)) if blocks[name]}
    start = 0
    while live:
        slots, length = period(live), sum(live.values())
        end = min((blocks[s] - done[s] - 1) // k * length + slots[s][(blocks[s] - done[s] - 1) % k] for s, k in live.items()) + 1
        for s, k in live.items():
            lane = out[s]
            lane.first.append(done[s])
            lane.start.append(start)
            lane.period.append(length)
            lane.slots.append(np.array(slots[s], dtype=np.int64))
            done[s] += end // length * k + sum(x < end % length for x in slots[s])
        start += end
        live = {s: k for s, k in live.items() if done[s] < blocks[s]}
    return out


def integer_parts(weights: Mapping[object, float], total: int = PARTS) -> dict[object, int]:
    """Parts of ``total`` (at least two per source) in proportion to the weights, by largest remainder, one at least."""
    total = max(total, 2 * len(weights))
    scale = (total - len(weights)) / max(sum(weights.values()), 1e-300)
    exact = {s: 1 + w * scale for s, w in weights.items()}
    parts = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (parts[s] - exact[s], s is not None, s))[:total - sum(parts.values())]:
        parts[s] += 1
    return parts


def _place(schedule: dict[object, Lane]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            source = batch.column("source").to_pylist()
            slot, release, deadline, parts, of = (np.zeros(len(block), dtype=np.int64) for _ in range(5))
            rows: dict[object, list[int]] = {}
            for row, name in enumerate(source):
                rows.setdefault(name, []).append(row)
            for name, at in rows.items():
                lane = schedule[name]
                own = block[at]
                phase = np.searchsorted(lane.first, own, side="right") - 1
                i = own - np.array(lane.first)[phase]
                start, length = np.array(lane.start)[phase], np.array(lane.period)[phase]
                within = np.array([lane.slots[p][r] for p, r in zip(phase.tolist(), (i % lane.parts).tolist())])
                slot[at] = start + i // lane.parts * length + within
                release[at] = start + i * length // lane.parts
                deadline[at] = start - (-(i + 1) * length // lane.parts)
                parts[at], of[at] = lane.parts, length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "source", "position", "block")), *map(pa.array, (slot, release, deadline, parts, of))],
                names=["doc_id", "source", "position", "block", "slot", "release", "deadline", "parts", "of_parts"])
    return run


def mix_slots(docs: DataFrame, weights: Mapping[object, float] | None = None, block_chars: int = BLOCK_CHARS,
              parts: int = PARTS) -> DataFrame:
    """Where each document of ``docs`` (doc_id, source, text; more columns are ignored) goes in the mix.

    Returns doc_id, source, position (characters of its source before it, in ``doc_id`` order), block, slot, release,
    deadline, parts and of_parts (its source's target share while its block was placed).  Reading by (slot, position)
    gives the mix.  ``weights`` are targets by source, rounded to ``parts`` whole parts; a source without one counts
    as one part.  By default a source weighs the square root of its characters.

    A block is ``block_chars`` characters of a source; a document belongs to the block in which it starts, and one
    longer than a block leaves the next ones without a start.  Nothing is repeated or left out: when a source ends,
    the others go on in their proportions.  A null source is a source of its own.  Null texts have no characters.
    Rows that repeat (doc_id, source) are one document and come back as one row, nulls included.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")).agg(
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("size"))
    # running sums over all rows in (source, doc_id) order; a source's own start at its first row
    run = running_totals(sized, ["source", "doc_id"], {"run": F.col("size")}).withColumn("before", F.col("run") - F.col("size"))
    run = stage(run.select("doc_id", "source", "before", "run"), "mix_positions")
    starts = run.groupBy("source").agg(F.min("before").alias("start"), F.max("run").alias("end"))
    found = starts.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them before mixing")
    size = {r["source"]: r["end"] - r["start"] for r in found}
    blocks = {s: max(1, -(-n // block_chars)) for s, n in size.items()}
    if weights is None:
        target = integer_parts({s: float(n) ** 0.5 for s, n in size.items()}, parts) if size else {}
    else:
        known = {s: w for s, w in weights.items() if s in size and w > 0}
        target = {s: 1 for s in size} | (integer_parts(known, parts) if known else {})
    schedule = lanes(blocks, target)
    edges = spark.createDataFrame([(s, r["start"], blocks[s] - 1) for r in found for s in [r["source"]]],
                                  "of string, start long, last long")
    placed = run.join(F.broadcast(edges), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", (F.col("before") - F.col("start")).alias("position"),
        F.least(F.floor((F.col("before") - F.col("start")) / block_chars), F.col("last")).cast("long").alias("block"))
    return placed.mapInArrow(_place(schedule), (
        "doc_id long, source string, position long, block long, slot long, release long, deadline long, parts long, of_parts long"))


def mix(docs: DataFrame, weights: Mapping[object, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with mix_block, mix_slot and mix_position (columns of these names are replaced); rows as given."""
    slots = mix_slots(docs, weights, block_chars).select(
        F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("block").alias("mix_block"),
        F.col("slot").alias("mix_slot"), F.col("position").alias("mix_position"))
    own = docs.drop("mix_block", "mix_slot", "mix_position")
    return own.join(slots, own["doc_id"].cast("long").eqNullSafe(slots["__mix_id"])
                    & own["source"].eqNullSafe(slots["__mix_source"])).drop("__mix_id", "__mix_source")
