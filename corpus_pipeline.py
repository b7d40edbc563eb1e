"""Corpus cleaning as five stages, each one operator on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Rows with a null ``doc_id`` pass the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.common import table
from codegauge.llm.decontamination import drop_contaminated
from codegauge.llm.jaccard_join import jaccard_groups
from codegauge.llm.line_dedup import dedup_lines
from codegauge.llm.mixing import mix
from codegauge.llm.quality import keep_good
from codegauge.session import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good go on; the model learns from the labelled ones among ``docs``."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document go, and with them documents of which nothing is left.

    Null and empty texts, and rows without an id, go on as they are.  ``n_chars``, if there is one, follows the text.
    """
    lines, removed = (f"{'_' * (1 + max(map(len, docs.columns)))}{name}" for name in ("lines", "removed"))
    out = dedup_lines(docs, counts=(lines, removed))
    out = out.where((F.col(removed) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).drop(lines, removed)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id goes on."""
    later = jaccard_groups(docs).where("class_id <> doc_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slot in the mix; reading by (mix_slot, mix_position) gives the training order."""
    return mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: SQL cannot express the classifier, the alignment or the schedule; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
