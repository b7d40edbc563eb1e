"""Toxicity by maximum-scoring segments.

Every token has a log-odds score: how much likelier documents labelled toxic are to hold it than the others, under
Dirichlet priors that centre a word on its prefixes (six, five, four bytes) and those on the overall rate.  All
tokens without evidence share one slightly negative score.  A linear scan finds every maximal-scoring segment of a
text.  Segment scores follow an extreme-value law with the rate and the constant of the clean training texts, so
each segment has an expected number of chance occurrences in a text of that length; a text's evidence is the sum
of the negative logarithms over its significant segments, mapped to a probability by a logistic calibration.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.common import slices
from codegauge.llm.learning import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample, sigmoid
from codegauge.llm.words import U, Words, split_words
from codegauge.session import stage

CUT = 0.5
PREFIXES = (4, 5, 6)
LEVELS = len(PREFIXES) + 1             # the last level is the whole word
STRENGTH = 2.0                         # pseudo-documents behind each prior
LEAST_ODDS = 1.0                       # a token counts as evidence from this log-odds on
SURE = 2.5                             # ... at this many standard deviations below its estimate
NO_LETTER = np.ones(256, dtype=bool)   # letters: a-z and everything beyond ASCII
NO_LETTER[0x61:0x7B] = False
NO_LETTER[0x80:] = False


def tokens(texts: pa.Array) -> Words:
    lowered = pa.compute.utf8_lower(pa.compute.fill_null(texts, ""))
    return split_words(lowered, NO_LETTER)


def level_hashes(words: Words, level: int, take: np.ndarray | None = None) -> np.ndarray:
    """Hash of each token's prefix at a level, or of the whole token; levels have different hashes."""
    starts, ends = (words.starts, words.ends) if take is None else (words.starts[take], words.ends[take])
    if level < len(PREFIXES):
        ends = np.minimum(ends, starts + PREFIXES[level])
    return Words(words.buffer, words.text_offsets, starts, ends, words.first).hashes() ^ U(level + 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a unit, pre-aggregated by slice."""
    for batch in slices(batches, "text"):
        words = tokens(batch.column("text"))
        y = batch.column("y").to_numpy()
        owner = np.repeat(np.arange(len(y)), words.counts)
        whole = level_hashes(words, LEVELS - 1)
        order = np.lexsort((whole, owner))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (whole[order][1:] != whole[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        once = np.sort(order[head])               # one occurrence of each word in each document, in place order
        parent = np.zeros(len(once), dtype=U)
        for level in range(LEVELS):
            unit = level_hashes(words, level, once)
            docs = owner[once]
            rank = np.lexsort((docs, unit))
            u, d = unit[rank], docs[rank]
            new_unit = np.ones(len(u), dtype=bool)
            new_unit[1:] = u[1:] != u[:-1]
            new_pair = new_unit.copy()
            new_pair[1:] |= d[1:] != d[:-1]
            at = np.flatnonzero(new_unit)
            if len(at):
                toxic = np.add.reduceat(new_pair * (y[d] == 1), at)
                clean = np.add.reduceat(new_pair * (y[d] == 0), at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), level, dtype=np.int32)), pa.array(u[at].view(np.int64)),
                     pa.array(parent[rank][at].view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array(clean.astype(np.int64))],
                    names=["level", "unit", "parent", "toxic", "clean"])
            parent = unit


@dataclass
class ToxicModel:
    """Sorted units and their log-odds by level, the score of all other tokens, and the calibration."""
    units: list[np.ndarray]
    odds: list[np.ndarray]
    rest: float
    rate: float
    constant: float
    a: float
    b: float

    def token_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the tokens with positive log-odds: the longest known unit of a token decides."""
        scores = np.zeros(len(words.starts))
        live = np.arange(len(words.starts))
        for level, (units, odds) in enumerate(zip(self.units, self.odds)):
            if not len(live) or not len(units):
                break
            unit = level_hashes(words, level, live)
            at = np.minimum(np.searchsorted(units, unit), len(units) - 1)
            known = units[at] == unit
            live = live[known]
            scores[live] = odds[at[known]]
        places = np.flatnonzero(scores > 0)
        return places, scores[places]

    def segments(self, places: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Every maximal-scoring segment (first token, behind last token, score), in order (Ruzzo and Tompa).

        Runs of other tokens only lower the running total, so the scan steps from one positive token to the next.  Each
        candidate links to the nearest one before it whose total before is smaller; the search for a place to join
        follows those links, which keeps the scan linear.
        """
        stack: list[tuple[int, int, float, float, int]] = []    # start, end, total before, total behind, link
        total, last = 0.0, None
        for place, score in zip(places.tolist(), scores.tolist()):
            if last is not None:
                total += self.rest * (place - last - 1)
            low, total, last = total, total + score, place
            start, high = place, total
            k = len(stack) - 1
            while True:
                while k >= 0 and stack[k][2] >= low:
                    k = stack[k][4]
                if k < 0 or stack[k][3] >= high:
                    break
                start, _, low, _, before = stack[k]
                del stack[k:]
                k = before
            stack.append((start, place + 1, low, high, k))
        return [(s, e, high - low) for s, e, low, high, _ in stack]

    def evidence(self, segments: list[tuple[int, int, float]], length: int) -> float:
        """Sum of -ln(expected chance segments of this score or more) over the significant segments."""
        offset = np.log(max(self.constant * length, 1e-12))
        return float(sum(max(self.rate * score - offset, 0.0) for _, _, score in segments))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(self.a + self.b * np.log1p(evidence))


def _found(model: ToxicModel, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(tokens, segments) of each text."""
    words = tokens(texts)
    places, scores = model.token_scores(words)
    cuts = np.searchsorted(places, words.first)
    for text, count in enumerate(words.counts.tolist()):
        a, b = cuts[text], cuts[text + 1]
        yield count, model.segments(places[a:b] - words.first[text], scores[a:b]) if b > a else []


def _train(model: ToxicModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(_found(model, batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([[s for _, _, s in segments] for _, segments in found], pa.list_(pa.float64()))],
                names=["y", "n", "scores"])
    return run


def _scorer(model: ToxicModel | None, cut: float, base: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if model is None:
                found, score = [(0, [])] * batch.num_rows, np.full(batch.num_rows, base)
            else:
                found = list(_found(model, batch.column("text")))
                score = model.probability(np.array([model.evidence(s, n) for n, s in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32)),
                 pa.array([",".join(f"{a}:{b}:{s:.3f}" for a, b, s in segments) for _, segments in found], pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "passages"])
    return run


def _rate(odds: np.ndarray, share: np.ndarray, rest: float) -> float:
    """The positive root of E[exp(rate * score)] = 1 for clean texts."""
    def excess(rate):
        return float((share * np.exp(rate * odds)).sum() + (1 - share.sum()) * np.exp(rate * rest)) - 1
    low, high = 1e-3, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0,
                 sample_rows: int = SAMPLE_ROWS) -> tuple[ToxicModel | None, float]:
    """The model, or None without labels of both classes, and the smoothed share of toxic labels.

    The units kept are words and prefixes of at most ``sample_rows`` labelled texts whose odds are high beyond
    chance, with the longer units below them, which may clear a word again; the tables that reach
    the driver are bounded by that sample.
    """
    sample = stage(labelled_sample(docs, labels, "toxic", modulus, remainder, sample_rows).select("doc_id", "text", "y"), "toxic_sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)
    if not n_toxic or not n_clean:
        return None, base
    prior = n_toxic / (n_toxic + n_clean)
    counted = stage(sample.select("y", "text").mapInArrow(
        _count, "level int, unit long, parent long, toxic long, clean long").groupBy("level", "unit").agg(
        F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic_units")
    above, kept = None, []
    for level in range(LEVELS):
        now = counted.where(F.col("level") == level).drop("level")
        if above is None:
            now = now.withColumn("prior", F.lit(prior)).withColumn("gate", F.lit(False))
        else:
            now = now.join(above, "parent", "left")
        rate = ((F.col("toxic") + STRENGTH * F.col("prior")) / (F.col("toxic") + F.col("clean") + STRENGTH))
        now = now.withColumn("rate", rate).withColumn("odds", F.log(F.col("rate") / (1 - F.col("rate"))) - float(np.log(prior / (1 - prior))))
        deviation = F.sqrt(1 / (F.col("toxic") + STRENGTH * F.col("prior")) + 1 / (F.col("clean") + STRENGTH * (1 - F.col("prior"))))
        stands_out = F.col("odds") - SURE * deviation >= LEAST_ODDS
        # below a unit that stands out, a longer one needs no more than even odds
        now = stage(now.withColumn("out", stands_out | (F.col("gate") & (F.col("rate") >= 0.5))), "toxic_level")
        above = now.select(F.col("unit").alias("parent"), F.col("rate").alias("prior"), (F.col("gate") | F.col("out")).alias("gate"))
        kept.append(now)
    # a unit is wanted if it stands out, if a unit above it does, or if one below it is wanted
    units, odds, rest_toxic, clean_words = [None] * LEVELS, [None] * LEVELS, 0.0, []
    below = None
    for level in reversed(range(LEVELS)):
        wanted = kept[level]
        if below is not None:
            wanted = wanted.join(below.select(F.col("parent").alias("unit"), F.lit(True).alias("held")).distinct(), "unit", "left")
        else:
            wanted = wanted.withColumn("held", F.lit(False))
        wanted = wanted.where(F.col("gate") | F.col("out") | F.coalesce("held", F.lit(False)))
        below = wanted
        rows = wanted.select("unit", F.when(F.col("out"), F.col("odds")).otherwise(F.lit(0.0)).alias("odds"), "toxic", "clean").toArrow()
        unit = rows.column("unit").to_numpy().view(U)
        order = np.argsort(unit)
        units[level] = unit[order]
        value = rows.column("odds").to_numpy()
        odds[level] = value[order]
        if level == LEVELS - 1:
            good = value > 0
            rest_toxic = rows.column("toxic").to_numpy()[good].sum()
            clean_words = [value[good], rows.column("clean").to_numpy()[good]]
    total = counted.where(F.col("level") == LEVELS - 1).agg(F.sum("toxic"), F.sum("clean")).first()
    share_toxic = min(rest_toxic / max(total[0], 1), 0.99)
    share = (clean_words[1] + 0.5 / max(1, len(clean_words[1]))) / (total[1] + 1)
    rest = float(np.log((1 - share_toxic) / (1 - share.sum()))) if len(share) else -0.01
    rest = min(rest, -0.01)
    model = ToxicModel(units, odds, rest, _rate(clean_words[0], share, rest) if len(share) else 1.0, 1.0, 0.0, 1.0)
    found = sample.select("y", "text").mapInArrow(_train(model), "y int, n long, scores array<double>").toArrow()
    y, n = found.column("y").to_numpy(), found.column("n").to_numpy()
    scores = found.column("scores").to_pylist()
    chance = sum(float(np.exp(-model.rate * LEAST_ODDS)) * size for size in n[y == 0])
    model.constant = (sum(len(s) for s, label in zip(scores, y) if label == 0) + 0.5) / max(chance, 1e-9)
    evidence = np.array([model.evidence([(0, 0, s) for s in each], size) for each, size in zip(scores, n)])
    order = np.lexsort((evidence, y))
    model.a, model.b = fit_logistic(np.log1p(evidence[order]), y[order])
    return model, base


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, cut: float = CUT,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row of ``docs`` (doc_id, text; more columns are ignored).

    ``score`` is the estimated probability of toxic label 1; ``passages`` lists the maximal-scoring segments as
    ``first token:behind last token:score``.  Tokens are runs of letters, in lower case.  Null texts are empty; a
    text without tokens has no passage, and the score of no evidence.  Rows with a null or repeated ``doc_id`` are
    scored like any other; a null id is not held out.  Labels other than 0 and 1 are ignored; without labels of both
    classes every score is the smoothed share of label 1 (0.5 without labels).  An empty table gives no rows.
    """
    model, base = fit_toxicity(docs, labels, modulus, remainder, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder), "text")
    return rows.mapInArrow(_scorer(model, cut, base), "doc_id long, held_out boolean, score double, predicted int, passages string")
