"""Similarities of texts and of word lists.

Set measures are array functions in the JVM. The ratios by longest common subsequence have no built-in; they
run in Arrow batches over distinct pairs, with the subsequence kept in the bits of one integer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _parts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words of all words; null if a side has none."""
    common, x, y = _parts(a, b)
    return F.when((x > 0) & (y > 0), common / (x + y - common))


def dice(a: Column, b: Column) -> Column:
    common, x, y = _parts(a, b)
    return F.when((x > 0) & (y > 0), 2 * common / (x + y))


def overlap(a: Column, b: Column) -> Column:
    common, x, y = _parts(a, b)
    return F.when((x > 0) & (y > 0), common / F.least(x, y))


def mean_known(a: Column, b: Column) -> Column:
    """Mean of two values that leaves out nulls, 0 if both are null."""
    return F.coalesce((a + b) / 2, a, b, F.lit(0.0))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one bit of an integer for each letter of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of letters in the longest common subsequence; two empty texts are equal."""
    if a == b:
        return 1.0
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio between the shared words, and the shared words with either rest; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not left or not right):
        return 1.0
    c, l, r = " ".join(common), " ".join(common + left), " ".join(common + right)
    return max(ratio(l, r), ratio(c, l) if common else 0.0, ratio(c, r) if common else 0.0)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of its length, or shorter at the ends, of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    # a window that begins (or, at the front, ends) with a letter the shorter text lacks is never the only best
    n, best, letters = len(a), 0.0, set(a)
    windows = [b[:end] for end in range(1, min(n, len(b) + 1)) if b[end - 1] in letters] + [b[i : i + n] for i, ch in enumerate(b) if ch in letters]
    for window in windows:
        if 2 * min(n, len(window)) > best * (n + len(window)):
            best = max(best, ratio(a, window))
            if best == 1.0:
                break
    return best


SCORERS = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio}


def scorer(name: str):
    """The named ratio as a function of two columns; null if a side is null."""
    score = SCORERS[name]

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        kept: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in kept:
                kept[x, y] = score(x, y)
            out.append(kept[x, y])
        return pd.Series(out, dtype="float64")

    return run


#: Ratios of a pair of names, their cores and their addresses, as ``all_ratios`` gives them.
RATIOS = ("name_ratio", "name_token_sort", "name_token_set", "core_ratio", "core_joined_ratio", "core_token_set", "core_partial", "addr_ratio", "addr_token_sort", "addr_token_set")


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in RATIOS]))
def all_ratios(name_a: pd.Series, name_b: pd.Series, core_a: pd.Series, core_b: pd.Series, addr_a: pd.Series, addr_b: pd.Series) -> pd.DataFrame:
    """All ratios at once; every pair of texts of a batch is compared once. Nulls give null."""
    names, cores, addresses = {}, {}, {}
    out = []
    for x, y, p, q, s, t in zip(name_a, name_b, core_a, core_b, addr_a, addr_b, strict=True):
        n = names.get((x, y))
        if n is None:
            n = names[x, y] = (None,) * 3 if x is None or y is None else (ratio(x, y), token_sort_ratio(x, y), token_set_ratio(x, y))
        k = cores.get((p, q))
        if k is None:
            k = cores[p, q] = (None,) * 4 if p is None or q is None else (ratio(p, q), ratio(p.replace(" ", ""), q.replace(" ", "")), token_set_ratio(p, q), partial_ratio(p, q))
        a = addresses.get((s, t))
        if a is None:
            a = addresses[s, t] = (None,) * 3 if s is None or t is None else (ratio(s, t), token_sort_ratio(s, t), token_set_ratio(s, t))
        out.append((*n, *k, *a))
    return pd.DataFrame(out, columns=list(RATIOS))
