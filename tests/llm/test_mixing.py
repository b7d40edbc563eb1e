import heapq

import pytest

from codegauge.llm.mixing import integer_parts, lanes, mix, mix_slots, period
from tests.conftest import SMALL
from tests.llm import helpers as H


def slot_by_slot(blocks, parts):
    """(source, block) of each slot: earliest deadline first, a new phase whenever a source is done."""
    order, done, names = [], dict.fromkeys(blocks, 0), sorted(blocks, key=lambda x: (x is not None, x))
    while live := [s for s in names if done[s] < blocks[s]]:
        total, t, base = sum(parts[s] for s in live), 0, dict(done)
        while all(done[s] < blocks[s] for s in live):
            ready = []
            for n, s in enumerate(live):
                i = done[s] - base[s]
                if i * total // parts[s] <= t:
                    heapq.heappush(ready, (-(-(i + 1) * total // parts[s]), n, s))
            s = ready[0][2]
            order.append((s, done[s]))
            done[s] += 1
            t += 1
            for x in live:
                assert abs((done[x] - base[x]) * total - parts[x] * t) < total     # less than one block away
    return order


@pytest.mark.parametrize("blocks,parts", [
    ({"a": 30, "b": 50, "c": 1}, {"a": 5, "b": 3, "c": 2}), ({"a": 400, None: 7, "z": 90}, {"a": 1, None: 97, "z": 2}),
    ({"a": 5}, {"a": 10}), ({}, {}), ({c: k + 1 for k, c in enumerate("abcdefgh")}, {c: (k * 7) % 5 + 1 for k, c in enumerate("abcdefgh")})])
def test_lanes_are_the_schedule(blocks, parts):
    expected = {pair: n for n, pair in enumerate(slot_by_slot(blocks, parts))}
    for s, lane in lanes(blocks, parts).items():
        for j in range(blocks[s]):
            p = max(k for k, first in enumerate(lane.first) if first <= j)
            i = j - lane.first[p]
            assert lane.start[p] + i // lane.parts * lane.period[p] + lane.slots[p][i % lane.parts] == expected[s, j]


def test_period_uses_every_slot_once():
    slots = period({"a": 333, "b": 667, "c": 1})
    assert sorted(x for v in slots.values() for x in v) == list(range(1001))


def test_parts_add_up():
    parts = integer_parts({"a": 0.5, "b": 0.25, None: 0.25, "zero": 0.0})
    assert sum(parts.values()) == 1000 and min(parts.values()) == 1
    assert integer_parts({}) == {} and sum(integer_parts({k: 1.0 for k in range(900)}).values()) == 1800


def test_blocks_and_slots(spark):
    rng = H.seeded(10)
    rows = [(k, "x" * rng.choice([0, 1, 30, 99, 500]), rng.choice(["big", "big", "big", "s", None])) for k in range(400)]
    weights = {"big": 0.2, "s": 0.5, None: 0.3}
    out = mix_slots(H.docs(spark, rows), weights, block_chars=100).collect()
    assert len(out) == len(rows)
    at, blocks = {}, {}
    for i, t, s in rows:
        at[i, s] = blocks.get(s, 0)
        blocks[s] = blocks.get(s, 0) + len(t)
    blocks = {s: max(1, -(-n // 100)) for s, n in blocks.items()}
    slot = {pair: n for n, pair in enumerate(slot_by_slot(blocks, integer_parts(weights)))}
    for r in out:
        assert r["position"] == at[r["doc_id"], r["source"]]
        assert r["block"] == min(r["position"] // 100, blocks[r["source"]] - 1)
        assert r["slot"] == slot[r["source"], r["block"]] and r["release"] <= r["slot"] < r["deadline"]


def test_awkward_cases(spark):
    rows = H.awkward_rows()
    out = mix_slots(H.docs(spark, rows), block_chars=1000).collect()
    assert {(r["doc_id"], r["source"]) for r in out} == {(r[0], r[2] if len(r) > 2 else "a") for r in rows} and len(out) == len({(r["doc_id"], r["source"]) for r in out})
    frame = H.docs(spark, rows).selectExpr("*", "1 AS mix_slot", "2 AS slot", "3 AS position")
    mixed = mix(frame)
    assert mixed.count() == len(rows) and mixed.columns == [*(c for c in frame.columns if c != "mix_slot"), "mix_block", "mix_slot", "mix_position"]
    assert mix_slots(H.docs(spark, [])).collect() == [] and mix(H.docs(spark, [])).collect() == []
    assert mix_slots(H.docs(spark, rows), {"unknown": 1.0, "a": 2.0}).count() == len(out)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mix_slots(table, block_chars=2_000).collect()
    assert len(out) == table.count() and all(r["release"] <= r["slot"] < r["deadline"] for r in out)
