"""Blocking keys of records: words, neighbouring words and the joined name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ligature.functions.text import LEGAL_WORDS, tokens

KEY_TYPES = ("nw", "aw", "nb", "ab", "nj")


def _bigrams(words: Column) -> Column:
    made = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit("_"), F.get(words, i + 1)))
    return F.when(F.size(words) >= 2, made).otherwise(F.array().cast("array<string>"))


def core_words(words: Column) -> Column:
    """Name words that are no legal form."""
    return F.filter(words, lambda w: ~w.isin(*LEGAL_WORDS))


def record_keys(records: DataFrame, key_types: Sequence[str] = KEY_TYPES, hashed: bool = False) -> DataFrame:
    """Distinct (entity_id, key, is_name) of records with columns entity_id, country, name, addr.

    A key is ``country|type|value``; hashed, it is its 64-bit hash. All types come from one scan. Empty texts
    have no keys; the joined name needs four letters.
    """
    unknown = set(key_types) - set(KEY_TYPES)
    if unknown:
        raise ValueError(f"unknown key types: {sorted(unknown)}")
    n, a = tokens(F.col("name")), tokens(F.col("addr"))
    joined = F.array_join(core_words(n), "")
    values = {"nw": n, "aw": a, "nb": _bigrams(n), "ab": _bigrams(a), "nj": F.when(F.length(joined) >= 4, F.array(joined)).otherwise(F.array().cast("array<string>"))}
    def typed(kind: str) -> Column:
        return F.transform(values[kind], lambda v: F.struct(F.concat(F.col("country"), F.lit(f"|{kind}|"), v).alias("key"), F.lit(int(kind[0] == "n")).alias("is_name")))

    parts = [typed(t) for t in key_types]
    out = records.select("entity_id", F.explode(F.array_distinct(F.concat(*parts))).alias("k")).select("entity_id", "k.key", "k.is_name")
    return out.withColumn("key", F.xxhash64("key")) if hashed else out


def word_keys(records: DataFrame) -> DataFrame:
    """Distinct (entity_id, key) with key ``country|word`` over name and address words together."""
    words = F.array_distinct(F.concat(tokens(F.col("name")), tokens(F.col("addr"))))
    return records.select("entity_id", F.explode(F.transform(words, lambda w: F.concat(F.col("country"), F.lit("|"), w))).alias("key"))
