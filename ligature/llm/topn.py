"""Problem 6: the N best items of every group.

Method: a mergeable aggregate that holds one bounded heap of N items per group. It is filled before the
shuffle, inside the scan's own tasks, so that of a group with millions of items at most N leave each
task; the heaps of a group are then merged. Items compare by score, then by the smaller identifier, an
order without ties, which makes merging associative: any split of the rows gives the same result.

The heap of all groups of a task is one sorted block of columns. New rows are first held against the
worst kept item of their group (the heap's root) and dropped if they cannot enter; those left are merged
by one sort. The block is flushed when it reaches ``state_rows``, so a task's memory is bounded whatever
the number of groups; a flushed heap is simply one more partial result.

Merging has two rounds. Round one salts the group with ``salts`` buckets, so that the partial heaps of a
hot group (N items times the number of tasks) are spread; round two sees at most N items per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType


class _Heaps:
    """Bounded heaps of all groups of one task, as columns sorted by group, score desc, item."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.g, self.s, self.i = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.full, self.root = np.empty(0, np.int64), np.empty(0)

    def push(self, g: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        if len(self.full):
            at = np.minimum(np.searchsorted(self.full, g), len(self.full) - 1)
            enters = (self.full[at] != g) | (s >= self.root[at])
            g, s, i = g[enters], s[enters], i[enters]
        if not len(g):
            return
        g, s, i = np.concatenate([self.g, g]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        # an item delivered again keeps its best score only
        order = np.lexsort((-s, i, g))
        g, s, i = g[order], s[order], i[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
        g, s, i = g[first], s[first], i[first]
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
        kept = place < self.n
        self.g, self.s, self.i = g[kept], s[kept], i[kept]
        last = place[kept] == self.n - 1
        self.full, self.root = self.g[last], self.s[last]

    def pop_all(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(self.g), pa.array(self.s), pa.array(self.i)], ["g", "s", "i"])
        self.__init__(self.n)
        return out


def _partial(n: int, state_rows: int, buffer_rows: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, held, rows = _Heaps(n), [], 0

        def drain() -> None:
            nonlocal held, rows
            if held:
                heaps.push(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, rows = [], 0

        for b in batches:
            if b.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns[:3]))
                rows += b.num_rows
            if rows >= buffer_rows:
                drain()
                if len(heaps.g) >= state_rows:
                    yield heaps.pop_all()
        drain()
        if len(heaps.g):
            yield heaps.pop_all()

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, salts: int = 8, state_rows: int = 2_000_000) -> DataFrame:
    """The ``n`` distinct items with the highest score of every group: (group, item, score).

    ``group`` and ``item`` are integers. Of equal scores the smaller item goes first. An item that comes
    several times counts once, with its best score. Rows whose group, item or score is null, or whose score
    is NaN, are never kept; infinities are ordinary scores. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    schema = StructType([StructField("g", LongType()), StructField("s", df.select(F.lit(0.0)).schema[0].dataType), StructField("i", LongType())])
    rows = df.select(F.col(f"`{group}`").cast("long").alias("g"), F.col(f"`{score}`").cast("double").alias("s"), F.col(f"`{item}`").cast("long").alias("i"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    partial = _partial(n, state_rows)
    heaps = rows.mapInArrow(partial, schema)
    # a pair's deliveries meet in one bucket, as the salt depends on the item alone
    salted = heaps.repartition(F.col("g"), F.pmod(F.xxhash64("i"), F.lit(salts))).mapInArrow(partial, schema)
    merged = salted.repartition(F.col("g")).mapInArrow(_partial(n, 1 << 62), schema)
    return merged.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score))
