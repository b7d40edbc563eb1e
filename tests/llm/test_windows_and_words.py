import hashlib

import numpy as np
import pyarrow as pa
import pytest

from codegauge.llm.common import by_key, slices
from codegauge.llm.repeated_windows import remove_repeated_windows
from codegauge.llm.words import shingles, split_words, windows
from tests.conftest import SMALL
from tests.llm import helpers as H


def brute(rows, length):
    first, out = {}, []
    for i, text in rows:
        w = H.words(text)
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    for i, text in rows:
        w = H.words(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k:k + length])] < i:
                gone[k:k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_words_are_runs_between_the_six_blanks():
    texts = ["  a b\x0b\x0cc\r\nd ", "", None, "x\x1cy\x85z w", "tail", "漢 字", " "]
    words = split_words(pa.array(texts))
    raw = bytes(words.buffer)
    found = [[raw[a:b].decode() for a, b in zip(words.starts[i:j], words.ends[i:j])] for i, j in zip(words.first[:-1], words.first[1:])]
    assert found == [H.words(t) for t in texts]


def test_equal_words_and_windows_have_equal_hashes():
    rng = H.seeded(1)
    texts = [H.gibberish(rng, 300), "q " * 200, "z" * 500 + " " + "z" * 499]
    words = split_words(pa.array(texts))
    plain = [w for t in texts for w in H.words(t)]
    hashes = words.hashes()
    assert len(set(zip(plain, hashes.tolist()))) == len(set(plain)) == len(set(hashes.tolist()))
    rolled, at = windows(hashes, words.first, 13)
    keys = [tuple(plain[k:k + 13]) for k in at.tolist()]
    assert len(set(zip(keys, rolled.tolist()))) == len(set(keys)) == len(set(rolled.tolist()))


def test_short_texts_have_one_shingle():
    hashes, offsets = shingles(split_words(pa.array(["a b", "", "a b", "a b c d e f", "a c"])), 5)
    assert np.diff(offsets).tolist() == [1, 0, 1, 2, 1]
    assert hashes[0] == hashes[1] and hashes[0] != hashes[-1]


def test_slices_and_keys_keep_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 3, 3, 3], "text": ["aa", "bb", "c" * 50, "", None, "d"]})
    assert [r for s in slices([batch], "text", 4) for r in s.column("text").to_pylist()] == batch.column("text").to_pylist()
    groups = list(by_key([batch.slice(0, 4), batch.slice(4, 0), batch.slice(4)], "k"))
    assert [g.column("k").to_pylist() for g in groups] == [[1, 1], [2], [3, 3, 3]]


def test_planted_passages(spark):
    rng = H.seeded(2)
    passage = H.gibberish(rng, 60)
    rows = [(k, H.gibberish(rng, 40) + " " + (passage if k % 3 == 0 else "") + " " + H.gibberish(rng, 30)) for k in range(60)]
    rows += [(100 + k, rows[5][1]) for k in range(30)] + [(200, H.gibberish(rng, 12)), (201, "a b c " * 40)]
    assert got(remove_repeated_windows(H.docs(spark, rows))) == brute(rows, 13)


@pytest.mark.parametrize("length", [1, 2, 13])
def test_awkward_cases(spark, length):
    rows = [r[:2] for r in H.awkward_rows()]
    assert got(remove_repeated_windows(H.docs(spark, H.awkward_rows()), length)) == brute(rows, length)


def test_kept_text_and_empty_table(spark):
    rows = [(1, "a b c d"), (2, "x a b c y")]
    out = {r["doc_id"]: r["kept_text"] for r in remove_repeated_windows(H.docs(spark, rows), 3).collect()}
    assert out == {1: "a b c d", 2: "x y"}
    assert remove_repeated_windows(H.docs(spark, [])).collect() == []


def test_whole_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(remove_repeated_windows(table)) == brute([(r["doc_id"], r["text"]) for r in table.collect()], 13)
