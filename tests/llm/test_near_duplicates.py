import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegauge.llm.jaccard_join import BLOCK_CLASSES, band_keys, jaccard_groups, matches_needed, signatures, similar_pairs
from codegauge.llm.line_dedup import LEAST_WORDS, aligned_lines, dedup_lines, patience
from corpus_pipeline import line_dedup
from tests.conftest import SMALL
from tests.llm import helpers as H


def brute_groups(rows, threshold=0.8):
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(t or "")
    import hashlib
    texts = {i: min(ts, key=lambda t: hashlib.sha256(t.encode()).digest()) for i, ts in texts.items()}
    head = {}
    for i in sorted(texts):
        head.setdefault(texts[i], i)
    bags = {i: H.shingles(t) for t, i in head.items()}
    nodes = [i for i in bags if bags[i]]
    parent, links = {i: i for i in nodes}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, a in enumerate(nodes):
        for b in nodes[n + 1:]:
            shared = len(bags[a] & bags[b])
            if shared and shared / (len(bags[a]) + len(bags[b]) - shared) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = set()
    for i, t in texts.items():
        h = head[t]
        out.add((i, find(h), h, links[h]) if bags[h] else (i, i, i, 0))
    if any(i is None for i, _ in rows):
        out.add((None, None, None, 0))
    return out


def groups(df, **options):
    rows = [tuple(r) for r in jaccard_groups(df, **options).select("doc_id", "class_id", "copy_of", "n_links").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_bayes_table_rises_and_keeps_true_pairs():
    need = matches_needed(0.8, 1e-9)
    assert sorted(need.values()) == list(need.values())
    rng = np.random.default_rng(3)
    for n, least in need.items():
        assert (rng.binomial(n, 0.8, 20_000) >= least).all()
    assert need[72] > 72 * 0.3


def test_pairs_in_a_block_equal_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**62, 400).astype(np.uint64)
    bags = []
    for k in range(120):
        keep = rng.random(400) > rng.choice([0.02, 0.08, 0.12, 0.3])
        bags.append(np.unique(np.concatenate([base[keep], rng.integers(1, 2**62, rng.integers(1, 40)).astype(np.uint64)])))
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    sig = signatures(np.concatenate(bags), offsets)
    expected = {(i, j) for i in range(120) for j in range(i + 1, 120)
                if (s := len(np.intersect1d(bags[i], bags[j]))) / (len(bags[i]) + len(bags[j]) - s) >= 0.8}
    need = matches_needed(0.8, 1e-9)
    i, j = similar_pairs(sig, bags, None, 0.8, need)
    assert set(zip(i.tolist(), j.tolist())) == expected and len(expected) > 500
    side = np.arange(120) % 2 == 0
    i, j = similar_pairs(sig, bags, side, 0.8, need)
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == {p for p in expected if side[p[0]] != side[p[1]]}
    assert band_keys(sig).shape == (120, 24)


def test_large_group_over_several_blocks(spark):
    rng = H.seeded(5)
    base = H.gibberish(rng, 120).split()
    n = BLOCK_CLASSES + 400
    rows = []
    for k in range(n):
        w = list(base)
        w[rng.randrange(len(w))] = f"v{k}"
        rows.append((k, " ".join(w)))
    rows += [(n + k, H.gibberish(rng, 60)) for k in range(20)]
    out = groups(H.docs(spark, rows))
    grouped = [r for r in out if r[0] < n]
    assert {r[1] for r in grouped} == {0} and all(r[1] == r[0] and r[3] == 0 for r in out if r[0] >= n)
    bags = [H.shingles(t) for _, t in rows[:n]]
    links = {r[0]: r[3] for r in grouped}
    for a in rng.sample(range(n), 5):
        assert links[a] == sum(len(bags[a] & b) / len(bags[a] | b) >= 0.8 for k, b in enumerate(bags) if k != a)


def test_groups_of_awkward_cases(spark):
    rows = [r for r in H.awkward_rows()]
    assert groups(H.docs(spark, rows)) == brute_groups([r[:2] for r in rows])
    assert groups(H.docs(spark, [])) == set()


def test_groups_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert groups(table) == brute_groups([(r["doc_id"], r["text"]) for r in table.collect()])


# --- lines ------------------------------------------------------------------------------------------------------

def brute_lines(rows):
    """(doc_id, text left) where every doc_id and its text come once: each run of lines is looked up in all earlier documents."""
    heads, runs, out = {}, set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        parts = t.split("\n")
        if t in heads:
            out[i] = ""
            continue
        heads[t] = i
        n = [len(H.words(x)) for x in parts]
        # the shortest runs that reach enough words, from each start: longer ones are made of them
        spans = []
        for a in range(len(parts)):
            b, total = a, 0
            while b < len(parts) and total < LEAST_WORDS:
                total += n[b]
                b += 1
            if total >= LEAST_WORDS:
                spans.append((a, b))
        for b in range(1, len(parts) + 1):
            a, total = b, 0
            while a > 0 and total < LEAST_WORDS:
                a -= 1
                total += n[a]
            if total >= LEAST_WORDS:
                spans.append((a, b))
        gone = {k for a, b in spans if tuple(parts[a:b]) in runs for k in range(a, b)}
        runs |= {tuple(parts[a:b]) for a, b in spans}
        out[i] = "\n".join(x for k, x in enumerate(parts) if k not in gone)
    for i, t in rows:
        if i is None or not t:
            out[i] = t
    return out


def test_patience_aligns_unique_lines_in_order():
    assert patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert patience([5, 1, 2, 5], [5, 2, 1, 5])[0] == (0, 0)
    assert patience([1, 1, 2], [2, 1, 1]) == [(2, 0)]
    assert patience([0, 1, 1, 2, 2, 9], [8, 2, 1, 1, 2, 7]) == [(1, 2), (2, 3), (3, 4)]      # no line is unique on both sides
    assert patience([], [1]) == [] and patience([1], [2]) == []
    rng = H.seeded(6)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_lines_planted(spark):
    rng = H.seeded(7)
    pool = [H.gibberish(rng, rng.choice([2, 3, 9, 14])) for _ in range(40)]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.3 else H.gibberish(rng, 8) for _ in range(rng.randint(1, 12)))) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(5)] + [(210, "a\tb c d e"), (211, "a b\tc d e\r"), (212, "a b c d e"), (213, "a\tb c d e"), (300, "\n\n"), (301, pool[0] + "\n\n" + pool[1])]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(H.docs(spark, rows)).collect()}
    assert out == brute_lines(rows)


def test_lines_awkward_cases(spark):
    rows = [r for r in H.awkward_rows() if r[0] not in (1, 9)]
    frame = H.docs(spark, rows)
    done = dedup_lines(frame)
    assert done.columns == frame.columns
    out = done.collect()
    expected = brute_lines([r[:2] for r in rows if r[0] is not None])
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["text"] for r in out if r["doc_id"] is not None} == expected
    assert sorted((r["text"] for r in out if r["doc_id"] is None), key=str) == sorted((r[1] for r in rows if r[0] is None), key=str)
    # the same row twice is one document; another text of that id is left alone
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f g"), (0, "a b c d e f\nz")]
    left = sorted(r["text"] for r in dedup_lines(H.docs(spark, twice)).collect())
    assert len(left) == 4 and "a b c d e f\nz" in left and left.count("") in (1, 2)
    assert dedup_lines(H.docs(spark, [])).collect() == []


def test_lines_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {r["doc_id"]: r["text"] for r in dedup_lines(table).collect()}
    assert out == brute_lines([(r["doc_id"], r["text"]) for r in table.collect()])


def brute_blocks(rows):
    """(doc_id, text left) by the rule of whole blocks, each run of lines looked up in all earlier documents."""
    heads, runs, out = {}, set(), {}
    for i, t in sorted(rows):
        parts = t.split("\n")
        if t in heads:
            out[i] = ""
            continue
        heads[t] = i
        spans = [(a, b) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1) if len(H.words(" ".join(parts[a:b]))) >= LEAST_WORDS]
        gone = {n for a, b in spans if tuple(parts[a:b]) in runs for n in range(a, b)}
        runs |= {tuple(parts[a:b]) for a, b in spans}
        out[i] = "\n".join(x for n, x in enumerate(parts) if n not in gone)
    return out


def test_pairs_are_aligned_in_passes():
    words = bytes([5] * 6)
    same = [(0, 0, 10), (1, 1, 11), (2, 2, 12)]
    assert aligned_lines([1, 2, 3], words, same) == {0, 1, 2}
    moved = [(0, 0, 12), (1, 1, 11), (2, 2, 10), (3, 3, 30), (4, 4, 20)]
    assert aligned_lines([1, 2, 3, 4, 5], words, moved) == {0, 1, 2, 3, 4}
    # the middle line is too short by itself and goes as part of two blocks
    assert aligned_lines([1, 2, 1, 7, 8, 9], bytes([3, 2, 3, 1, 1, 1]), [(0, 1, 5), (1, 2, 6)]) == {0, 1, 2}


def test_a_table_with_the_names_of_the_counts(spark):
    rows = [(1, "a b c d e\nf"), (2, "a b c d e\ng")]
    frame = H.docs(spark, rows).withColumn("n_removed", F.lit(1)).withColumn("n_lines", F.lit(2))
    with pytest.raises(ValueError):
        dedup_lines(frame, counts=("n_lines", "n_removed"))
    out = line_dedup(spark, frame, SMALL)
    assert out.columns == frame.columns and {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()} == {1: (rows[0][1], 1), 2: ("g", 1)}


def test_lines_meet_every_earlier_holder(spark):
    one, two, more = "a b c d e", "f g h i j", "k l m n o"
    rows = [(1, f"{one}\n{two}"), (2, f"{two}\n{one}"), (3, f"{two}\n{one}\n{more}")]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(H.docs(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "", 3: more}


def test_lines_go_by_one_rule_at_every_count(spark):
    block = "a short one\na longer line of six words\nend"
    rows = [(k, f"own{k} text of document number {k}\n{block}") for k in range(1_300)]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(H.docs(spark, rows)).collect()}
    assert out == {k: t if k == 0 else t.split("\n")[0] for k, t in rows}


def test_blocks_of_short_lines(spark):
    rng = H.seeded(12)
    verse = "\n".join(H.gibberish(rng, 3) for _ in range(20))
    rows = [(1, "x\ny z"), (2, "x\ny z"), (3, f"first\n{verse}\nlast"), (4, f"other\n\n{verse}"), (5, "x"), (6, "x\ny")]
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(H.docs(spark, rows).drop("n_removed"), counts=("n_lines", "n_removed")).collect()}
    assert out == {1: ("x\ny z", 0), 2: ("", 2), 3: (rows[2][1], 0), 4: ("other\n", 20), 5: ("x", 0), 6: ("x\ny", 0)}


def test_blocks_equal_brute_force(spark):
    rng = H.seeded(13)
    pool = ["", " ", *(H.gibberish(rng, rng.choice([1, 2, 3, 7])) for _ in range(12))]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.8 else H.gibberish(rng, 4) for _ in range(rng.randint(1, 14)))) for k in range(200)]
    rows = [r for r in rows if r[1]]
    assert {r["doc_id"]: r["text"] for r in dedup_lines(H.docs(spark, rows)).collect()} == brute_blocks(rows)


def test_blocks_of_awkward_cases(spark):
    rows = H.awkward_rows()
    frame = H.docs(spark, rows)
    done = dedup_lines(frame)
    assert done.columns == frame.columns
    out = done.collect()
    assert len(out) == len(rows)
    assert sorted((r["text"] for r in out if r["doc_id"] is None), key=str) == sorted((r[1] for r in rows if r[0] is None), key=str)
    left = {r["doc_id"]: r["text"] for r in out}
    assert (left[2], left[3], left[4], left[5], left[10]) == ("", None, "", "   \n\t ", "")
    assert dedup_lines(H.docs(spark, [])).collect() == []
