import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from codegauge.llm.learning import fit_logistic
from codegauge.llm.quality import Density, QualityModel, keep_good, score_quality, statistics
from codegauge.llm.toxicity import ToxicModel, score_toxicity
from tests.llm import helpers as H

MIDDLE = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, text string"


def auc(y, score):
    order = np.argsort(score, kind="stable")
    values, where, count = np.unique(np.asarray(score)[order], return_inverse=True, return_counts=True)
    rank = np.empty(len(y))
    rank[order] = (np.cumsum(count) - (count - 1) / 2)[where]
    pos = np.asarray(y) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def judged(spark, out, label, modulus, remainder):
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == remainder) and 0 <= r["score"] <= 1 for i, r in rows.items())
    marked = [(r[label], rows[r["doc_id"]]) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()]
    return [(y, r) for y, r in marked if r["held_out"]]


def test_quality_on_held_out_labels(spark):
    out = score_quality(*(spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels")))
    held = judged(spark, out, "quality", 4, 2)
    assert auc([y for y, _ in held], [r["score"] for _, r in held]) > 0.98
    assert np.mean([y == r["predicted"] for y, r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for _, r in held)


def test_toxicity_on_held_out_labels(spark):
    out = score_toxicity(*(spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels")))
    held = judged(spark, out, "toxic", 5, 0)
    assert auc([y for y, _ in held], [r["score"] for _, r in held]) > 0.8
    assert np.mean([y == r["predicted"] for y, r in held]) > 0.93


def test_density_is_the_shrunk_gaussian():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]])
    d = Density.fit(rows)
    cov = np.linalg.inv(d.whiten.T @ d.whiten)
    x = rows[:5]
    expected = [-0.5 * (v - d.mean) @ np.linalg.solve(cov, v - d.mean) - 0.5 * np.log(np.linalg.det(cov)) for v in x]
    assert np.allclose(d.log_density(x), expected)
    assert np.allclose(np.diag(cov), rows.var(axis=0), rtol=0.05)


def test_constant_columns_do_not_break_the_factor():
    rows = np.tile(np.arange(3.0), (4, 1))
    model = QualityModel.fit(np.concatenate([rows, rows + 1]), np.array([1] * 4 + [0] * 4))
    assert np.isfinite(model.score(rows)).all()


def test_statistics_of_empty_and_null_texts_are_finite():
    rows = statistics(pa.array(["", None, "   ", "a", H.LONG]))
    assert np.isfinite(rows).all() and (rows[0] == rows[1]).all()


def test_logistic_separates():
    a, b = fit_logistic(np.array([0.0, 1, 2, 3, 10]), np.array([0, 0, 1, 1, 1]))
    assert b > 0 and a + b * 3 > 0 > a
    assert np.isfinite(fit_logistic(np.zeros(4), np.array([1, 1, 1, 1]))).all()


def all_maximal(scores):
    """Maximal-scoring segments of a list by the recursive definition: best (shortest, leftmost), then both sides."""
    best, span = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-9:
                best, span = total, (a, b + 1)
    if span is None:
        return []
    a, b = span
    return all_maximal(scores[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in all_maximal(scores[b:])]


def test_segments_are_all_maximal_ones():
    rng = H.seeded(11)
    model = ToxicModel([], [], -0.7, 1.0, 1.0, 0.0, 1.0)
    for _ in range(300):
        scores = [rng.choice([1.13, 2.41, 0.57]) if rng.random() < 0.35 else -0.7 for _ in range(rng.randint(0, 30))]
        places = np.array([k for k, s in enumerate(scores) if s > 0], dtype=np.int64)
        found = model.segments(places, np.array([scores[k] for k in places]))
        expected = all_maximal(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in found], [s for *_, s in expected])


def test_segments_of_many_single_hits_are_found_in_linear_time():
    model = ToxicModel([], [], -0.7, 1.0, 1.0, 0.0, 1.0)
    n = 1_000_000
    begun = time.process_time()
    apart = model.segments(np.arange(n, dtype=np.int64) * 10, np.full(n, 1.0))
    rising = model.segments(np.arange(n, dtype=np.int64) * 2, np.full(n, 1.0))
    assert time.process_time() - begun < 20
    assert len(apart) == n and [(a, b) for a, b, _ in rising] == [(0, 2 * n - 1)]


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "clash") for i, q, t in rows], LABELS)


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_awkward_cases(spark, score):
    bad = {k: k % 6 == 0 for k in range(100, 400)}
    rows = H.awkward_rows() + [(k, "vile*** vile*** " * 9 if b else f"fine words number {k} stand here") for k, b in bad.items()]
    marks = [(k, int(not b), int(b)) for k, b in bad.items()] + [(None, 1, 1), (1, None, None), (2, 7, 7), (102, 0, 1), (-1, 1, 0)]
    out = score(H.docs(spark, rows), labels(spark, marks)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in out)
    by_id = {r["doc_id"]: r["predicted"] for r in out}
    assert all(by_id[k] == (b if score is score_toxicity else not b) for k, b in bad.items())
    empty = {r["score"] for r in out if r["doc_id"] in (3, 4)}
    assert len(empty) == 1
    assert score(H.docs(spark, []), labels(spark, marks)).collect() == []
    for few in ([], [(101, 1, 0)]):
        assert len({r["score"] for r in score(H.docs(spark, rows), labels(spark, few)).collect()}) == 1


def test_keep_good_passes_all_columns(spark):
    rows = [(k, f"fine words number {k} stand here" if k % 2 else "### $$$ " * 30) for k in range(80)]
    frame = H.docs(spark, rows)
    kept = keep_good(frame, labels(spark, [(k, k % 2, 0) for k in range(80)]))
    assert kept.schema == frame.schema and {r["doc_id"] for r in kept.collect()} == set(range(1, 80, 2))
