"""Radius joins in a metric space, by pivots.

Words are assigned to the nearest of k pivots. If two words lie within r of each other, the second is, by
the triangle inequality, no farther from the first one's pivot than from its own plus 2 r; so every word is
copied to all cells whose pivot is that near, and each pair is found in the first word's own cell.

Within a cell the join is exact and linear in the number of words, whatever the radius: two words within r of
each other are equal once at most r letters are taken out of each, so they share a hash of such a remainder.
Words of more than ``LONG`` letters have too many remainders; they are cut into 2 r + 1 pieces, of which r edits
(a swap spoils two at most) leave one whole, and meet on a piece and its place. No cell is ever gathered in one
task. Random words lie about equally far from each other, so the more pivots, the more copies; a few are enough
to spread the work, and their number changes the cost only.

The distance is the unrestricted Damerau-Levenshtein distance, which satisfies the triangle inequality.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ligature.llm.names import damerau
from ligature.workspace import scatter

#: Words longer than this are joined by pieces. A matter of cost: both joins are exact.
LONG = 24
#: Rows of one table of distances; a block of very long words has fewer rows instead of more memory.
_CELLS = 4_000_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=1)))), np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def distances(texts: list[str], pivot: str) -> np.ndarray:
    """Damerau-Levenshtein distance of all texts to one pivot, blocks of texts of like length at once."""
    out = np.zeros(len(texts), np.int64)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        rows = max(1, min(len(order) - at, _CELLS // ((len(texts[order[at]]) + 3) * (len(pivot) + 2))))
        while rows > 1 and rows * (len(texts[order[at + rows - 1]]) + 3) * (len(pivot) + 2) > 2 * _CELLS:
            rows //= 2
        block = order[at : at + rows]
        out[block] = _block([texts[i] for i in block], pivot)
        at += rows
    return out


def _block(texts: list[str], pivot: str) -> np.ndarray:
    a, lengths = _codes(texts)
    n, width = a.shape
    b = np.frombuffer(pivot.encode("utf-32-le", "surrogatepass"), np.uint32)
    m = len(b)
    rows = np.arange(n)
    d = np.full((width + 2, m + 2, n), width + m, np.int16 if width + m < 30_000 else np.int32)
    d[1:, 1, :] = np.arange(width + 1)[:, None]
    d[1, 1:, :] = np.arange(m + 1)[:, None]
    row_of = np.zeros((m, n), np.int64)  # last row whose letter is the pivot's j-th
    for i in range(1, width + 1):
        match = np.zeros(n, np.int64)
        same = a[:, i - 1][None, :] == b[:, None]
        for j in range(1, m + 1):
            k, eq = row_of[j - 1], same[j - 1]
            best = np.minimum(d[i, j] + ~eq, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            swap = (k > 0) & (match > 0)
            if swap.any():
                s = np.flatnonzero(swap)
                best[s] = np.minimum(best[s], d[k[s], match[s], s] + (i - k[s] - 1) + 1 + (j - match[s] - 1))
            d[i + 1, j + 1] = best
            match = np.where(eq, j, match)
        row_of[same] = i
    return d[lengths + 1, m + 1, rows]


def remainders(word: str, most: int) -> set[str]:
    """The word with at most ``most`` of its letters taken out."""
    out = {word}
    for k in range(1, min(most, len(word)) + 1):
        out.update("".join(word[i] for i in kept) for kept in itertools.combinations(range(len(word)), len(word) - k))
    return out


def _pieces(length: int, n: int) -> list[tuple[int, int]]:
    """Begin and end of n pieces of a word, as even as can be."""
    cuts = [length * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def meeting_keys(word: str, radius: int) -> tuple[set[int], set[int]]:
    """Hashes a word is looked up by, and hashes it is found by: words within the radius share one."""
    asked, found = set(), set()
    if len(word) <= LONG + radius:
        asked = {zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in remainders(word, radius)}
        found |= asked
    if len(word) > LONG - radius:
        n = 2 * radius + 1
        for i, (a, b) in enumerate(_pieces(len(word), n)):
            found.add(zlib.crc32(f"{len(word)}|{i}|{word[a:b]}".encode("utf-8", "surrogatepass")))
        asked = set(asked)
        for length in range(max(1, len(word) - radius), len(word) + radius + 1):
            for i, (a, b) in enumerate(_pieces(length, n)):
                for s in range(max(0, a - radius), a + radius + 1):
                    if s + b - a <= len(word):
                        asked.add(zlib.crc32(f"{length}|{i}|{word[s : s + b - a]}".encode("utf-8", "surrogatepass")))
    return asked, found


def radius_pairs(words: DataFrame, scope: str, word: str, radius: int = 1, most_pivots: int = 4) -> DataFrame:
    """All pairs of words of one scope at a distance of 1 to ``radius``: (scope, word_a, word_b, distance), word_a < word_b.

    ``words`` has distinct (scope, word) rows; null and empty words make no pair. The number of pivots follows
    the square root of the number of words up to ``most_pivots``; it changes only the cost, not the result.
    """
    rows = words.select(F.col(scope).cast("string").alias("scope"), F.col(word).alias("word")).where("scope is not null and word <> ''").distinct()
    # a bounded sample, the same in every run: the words with the smallest hashes
    pivots = [r.word for r in rows.select("word").distinct().orderBy(F.xxhash64("word"), "word").limit(most_pivots).collect()]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            texts = pdf.word.tolist()
            d = np.stack([distances(texts, p) for p in pivots], axis=1)
            home = d.argmin(axis=1)
            near = d <= d.min(axis=1)[:, None] + 2 * radius
            at, cell = np.nonzero(near)
            keys = [meeting_keys(t, radius) for t in texts]
            asked = [sorted(keys[i][0]) if c == home[i] else [] for i, c in zip(at, cell, strict=True)]
            yield pd.DataFrame({"scope": pdf.scope.values[at], "word": pdf.word.values[at], "cell": cell, "asked": asked, "found": [sorted(keys[i][1]) for i in at]})

    # a number is given, as few bytes may mean much work here
    placed = scatter(rows, "scope", "word").mapInPandas(assign, "scope string, word string, cell int, asked array<long>, found array<long>")
    placed = placed.select("scope", "word", "cell", F.xxhash64("scope", "word").alias("at"), "asked", "found")
    # only numbers are exploded and joined; the words come back for the pairs that are left
    meet = lambda keys: F.explode(F.transform(keys, lambda k: F.xxhash64("scope", "cell", k)))
    a = placed.where(F.size("asked") > 0).select(F.col("at").alias("a"), meet("asked").alias("key"))
    b = placed.select(F.col("at").alias("b"), meet("found").alias("key"))
    # what is exploded looks small before it is; so no side is ever broadcast
    met = a.join(b.hint("merge"), "key").where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = rows.select(F.xxhash64("scope", "word").alias("at"), "scope", "word")
    near = met.join(named.select(F.col("at").alias("a"), "scope", F.col("word").alias("x")).hint("merge"), "a").join(named.select(F.col("at").alias("b"), F.col("scope").alias("scope_b"), F.col("word").alias("y")).hint("merge"), "b")
    near = near.where((F.col("scope") == F.col("scope_b")) & (F.col("x") != F.col("y")))
    # a swap counts twice in the plain distance, which the JVM computes; the metric itself decides on the rest
    near = near.where(F.levenshtein("x", "y", 2 * radius) >= 0).select("scope", F.least("x", "y").alias("word_a"), F.greatest("x", "y").alias("word_b")).distinct()

    @F.pandas_udf("int")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([damerau(i, j, radius) for i, j in zip(x, y, strict=True)], dtype="int32")

    return near.withColumn("distance", exact("word_a", "word_b")).where(F.col("distance") <= radius).withColumnRenamed("scope", scope)
