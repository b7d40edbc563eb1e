import collections

import codegauge.llm.decontamination as D
from codegauge.llm.decontamination import Block, blocks, contained_items, drop_contaminated
from tests.conftest import SMALL
from tests.llm import helpers as H

ITEMS = "item_id long, text string, n_shared int, doc_id long"


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0, -1) for i, t in rows], ITEMS)


def brute(docs, bench, threshold=0.8):
    out = collections.Counter()
    for i, t in docs:
        bag = H.shingles(t)
        for k, x in bench:
            item = H.shingles(x)
            if item and (n := len(item & bag)) / len(item) >= threshold:
                out[i, k, n, len(item)] += 1
    return out


def found(df):
    return collections.Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in df.collect())


def test_passages_in_long_documents(spark):
    rng = H.seeded(8)
    bench = [(k, H.gibberish(rng, n)) for k, n in enumerate([5, 6, 9, 14, 30, 60, 200, 900])]
    docs = []
    for n in range(60):
        w = H.gibberish(rng, rng.choice([10, 300, 4000])).split()
        for _, t in rng.sample(bench, rng.choice([0, 1, 2])):
            part = t.split()
            for _ in range(rng.choice([0, 0, 1, 2])):         # near the threshold
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = part
        docs.append((n, " ".join(w)))
    expected = brute(docs, bench)
    assert found(contained_items(H.docs(spark, docs), items(spark, bench))) == expected and len(expected) > 20
    kept = {r["doc_id"] for r in drop_contaminated(H.docs(spark, docs), items(spark, bench)).collect()}
    assert kept == {i for i, _ in docs} - {k[0] for k in expected}


def test_awkward_cases(spark):
    docs = H.awkward_rows()
    bench = [(1, "two three four five six seven"), (2, None), (3, ""), (4, "word"), (None, "three four five six seven eight"), (1, "x y"),
             (5, H.LONG[:2_000])]
    frame = H.docs(spark, docs)
    assert found(contained_items(frame, items(spark, bench))) == brute([d[:2] for d in docs], bench)
    clean = drop_contaminated(frame, items(spark, bench))
    assert clean.columns == frame.columns
    assert contained_items(H.docs(spark, []), items(spark, bench)).collect() == []
    assert contained_items(frame, items(spark, [])).collect() == []
    assert drop_contaminated(frame, items(spark, [])).count() == len(docs)


def test_blocks_hold_every_item_and_agree_with_one(spark):
    rng = H.seeded(9)
    bench = items(spark, [(k, H.gibberish(rng, 20)) for k in range(30)])
    assert sorted(i for b in blocks(bench, 40) for i in b.ids) == list(range(30))
    assert Block.build([1], [""]).keys.tolist() == []


def test_rows_are_cleaned_block_by_block(spark, monkeypatch):
    rng = H.seeded(10)
    bench = [(k, H.gibberish(rng, 20)) for k in range(12)]
    docs = [(k, H.gibberish(rng, 50) + (" " + bench[k % 12][1] if k % 3 else "")) for k in range(40)]
    whole = D.blocks
    monkeypatch.setattr(D, "blocks", lambda benchmark: whole(benchmark, 60))
    assert len(list(D.blocks(items(spark, bench)))) > 2
    assert {r["doc_id"] for r in drop_contaminated(H.docs(spark, docs), items(spark, bench)).collect()} == {k for k in range(40) if k % 3 == 0}


def test_whole_table(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert found(contained_items(docs, bench)) == expected and expected
