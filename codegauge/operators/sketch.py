"""A sketch of a set of keys, tested before anything is shuffled.

Picking the few rows of a wide table whose keys are wanted is a semi join, and where the keys are too many to broadcast it
deals out the whole table.  A sketch of the keys, a Bloom filter whose bits for one key lie in one 64-bit word, is
small whatever the table holds.  It is built by partial aggregation, reaches the scan as a scalar subquery, and is tested inside the
scan's own stage.  The exact join behind it then sees the wanted rows and about one in a hundred others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.session import stage

BITS_PER_KEY = 16
MOST_WORDS = 1 << 20       # 8 MB: a sketch of more keys than a 4 million lets more rows pass, never fewer
LEAST_WORDS = 1 << 6


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The word that holds a key's bits, and those bits."""
    h = F.xxhash64(key)
    mask = None
    for turn in range(4):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * turn).bitwiseAND(63).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(words)), mask


def key_sketch(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """One row with an array ``words`` that stands for the values of ``key``, and the array's length.

    ``count`` is about how many keys there are.  Nulls stand for nothing.
    """
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, count * BITS_PER_KEY // 64 - 1).bit_length()))
    word, mask = _place(F.col(key), words)
    filled = keys.where(F.col(key).isNotNull()).select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    empty = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    dense = filled.unionAll(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    one = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda s: s["mask"]).alias("words"))
    return one, words


class Wanted:
    """A set of keys and its sketch: ``maybe(column)`` is true for every key of the set and for few others."""

    def __init__(self, keys: DataFrame, key: str):
        self.key = key
        self.keys = stage(keys.select(key).where(F.col(key).isNotNull()).distinct(), "wanted")
        one, self.words = key_sketch(self.keys, key, self.keys.count())
        self.sketch = stage(one, "sketch")

    def maybe(self, column: str | None = None) -> Column:
        word, mask = _place(F.col(column or self.key), self.words)
        held = F.element_at(self.sketch.scalar(), (word + 1).cast("int")).bitwiseAND(mask)
        return F.coalesce((held == mask) & F.col(column or self.key).isNotNull(), F.lit(False))


def pick(rows: DataFrame, wanted: Wanted) -> DataFrame:
    """Rows whose key is wanted; the others are dropped where they are read."""
    return rows.where(wanted.maybe()).join(wanted.keys, wanted.key, "left_semi")
