import __spark_entry__ as entry
import corpus_pipeline
import pytest

from codegauge.llm.catalog import QUERIES
from tests.conftest import SMALL
from tests.llm import helpers as H
from tests.llm.test_decontamination import brute as brute_items
from tests.llm.test_near_duplicates import brute_groups, brute_lines


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark):
    """Every stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SMALL)
    before = texts(good)
    assert good.columns == columns and 0 < len(before) < docs.count()
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert sum(before.get(i) is None for i, q in marks.items() if q == 1) <= 0.02 * len(marks)

    lines = stages["line_dedup"](spark, good, SMALL)
    expected = {i: t for i, t in brute_lines(list(before.items())).items() if t == before[i] or t.strip()}
    after = texts(lines)
    assert lines.columns == columns and after == expected
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = stages["ngram_jaccard_join"](spark, lines, SMALL)
    kept = texts(single)
    assert single.columns == columns and set(kept) == {g[1] for g in brute_groups(list(after.items()))}

    clean = stages["benchmark_decontamination"](spark, single, SMALL)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert clean.columns == columns and set(texts(clean)) == set(kept) - {k[0] for k in brute_items(list(kept.items()), bench)}

    mixed = stages["source_mixing"](spark, clean, SMALL)
    assert texts(mixed) == texts(clean) and {"mix_slot", "mix_block", "mix_position"} < set(mixed.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, name, stage):
    frame = H.docs(spark, H.awkward_rows())
    out = stage(spark, frame, SMALL)
    rows = out.collect()
    assert out.columns[:len(frame.columns)] == frame.columns
    if name == "source_mixing":
        assert len(rows) == frame.count()
    assert stage(spark, H.docs(spark, []), SMALL).collect() == []


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    known = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(known)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
