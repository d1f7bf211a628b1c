"""Features of the second stage: an entity's other candidates, and noise in words and numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ligature.functions.similarity import ratio, scorer
from ligature.functions.text import LEGAL_WORDS, tokens

CONFIDENT = 0.9


def context_features(pairs: DataFrame, least: float = 0.01) -> DataFrame:
    """Pairs with p1 of at least ``least`` and their standing among the entity's candidates.

    A pair's best other is the entity's best p1, or the second best (0 if there is none) for the best itself.
    """
    kept = pairs.where(F.col("p1") >= least)
    w = Window.partitionBy("s1_id")
    source = F.substring("cand_id", 1, 2)
    same = Window.partitionBy("s1_id", source)
    sure = (F.col("p1") >= CONFIDENT).cast("int")
    out = kept.withColumns({
        "p1_rank": F.row_number().over(w.orderBy(F.desc("p1"), "cand_id")), "p1_gap_to_best": F.round(F.max("p1").over(w) - F.col("p1"), 9),
        "n_above_half": F.sum((F.col("p1") >= 0.5).cast("int")).over(w), "n_confident": F.sum(sure).over(w), "same_all": F.sum(sure).over(same),
    })
    second = F.max(F.when(F.col("p1_rank") == 2, F.col("p1"))).over(w)
    best = F.max("p1").over(w)
    out = out.withColumn("p1_best_other", F.when(F.col("p1") >= best, F.coalesce(second, F.lit(0.0))).otherwise(best))
    out = out.withColumn("n_confident_same_source", F.col("same_all") - sure).withColumn("n_confident_other_source", F.col("n_confident") - F.col("same_all"))
    return out.withColumn("has_confident_other", (F.col("n_confident") - sure > 0).cast("int")).drop("same_all")


def cross_features(pairs: DataFrame, most: int = 3) -> DataFrame:
    """Per pair the best likeness with up to ``most`` of the entity's other confident candidates; null if there is none."""
    w = Window.partitionBy("s1_id").orderBy(F.desc("p1"), "cand_id")
    best = pairs.where(F.col("p1") >= CONFIDENT).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    o = best.select("s1_id", F.col("cand_id").alias("o_id"), F.col("name_c").alias("o_name"), F.col("addr_c").alias("o_addr"))
    x = pairs.select("s1_id", "cand_id", "name_c", "addr_c").join(o.hint("merge"), "s1_id").where(F.col("cand_id") != F.col("o_id"))
    both = (F.col("addr_c") != "") & (F.col("o_addr") != "")
    x = x.withColumns({"ka": F.when(both, F.col("addr_c")), "kb": F.when(both, F.col("o_addr"))})
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"(?U)(\d+)"), 1))
    x = x.withColumns({
        "joined": scorer("ratio")(F.replace("name_c", F.lit(" "), F.lit("")), F.replace("o_name", F.lit(" "), F.lit(""))), "token_set": scorer("token_set")("name_c", "o_name"), "ratio": scorer("ratio")("name_c", "o_name"), "addr_token_set": scorer("token_set")("ka", "kb"), "addr_ratio": scorer("ratio")("ka", "kb"),
        "shared": F.size(F.array_intersect(numbers("addr_c"), numbers("o_addr"))), "empty": ((F.col("addr_c") == "") & (F.col("o_addr") == "")).cast("int"),
    })
    best_of = x.groupBy("s1_id", "cand_id").agg(*[F.max(n).alias(f"other_{n}") for n in ("token_set", "ratio", "joined", "addr_token_set", "addr_ratio", "shared", "empty")])
    return pairs.join(best_of.hint("merge"), ["s1_id", "cand_id"], "left")


def _close(a: Column, b: Column) -> Column:
    longest, gap = F.greatest(F.length(a), F.length(b)), F.abs(F.length(a) - F.length(b))
    return (a == b) | ((longest >= 2) & (gap <= 1) & (F.levenshtein(a, b) <= 1))


def number_noise(pairs: DataFrame) -> DataFrame:
    """Numbers of the candidate that equal a number of the entity, perhaps but for one digit."""
    d = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"(?U)(\d+)"), 1))
    x = pairs.withColumns({"ds": d("addr_s"), "dc": d("addr_c")})
    near = F.size(F.filter("dc", lambda n: F.exists("ds", lambda m: _close(n, m))))
    exact = F.size(F.array_intersect("ds", "dc"))
    out = x.withColumns({"num_close_shared": near, "num_close_only": near - exact, "num_conflict_close": ((F.size("ds") > 0) & (F.size("dc") > 0) & (near == 0)).cast("int")})
    return out.drop("ds", "dc")


def word_frequencies(reference: DataFrame) -> DataFrame:
    """(word, n): reference names that hold the word, legal forms aside."""
    words = F.filter(F.array_distinct(tokens(F.col("name"))), lambda w: ~w.isin(*LEGAL_WORDS))
    return reference.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@F.pandas_udf(StructType([StructField("a", ArrayType(StringType())), StructField("b", ArrayType(StringType())), StructField("least", DoubleType())]))
def _unmatched(left: pd.Series, right: pd.Series, matched: pd.Series) -> pd.DataFrame:
    """Words of either side whose best ratio with a word of the other is below ``matched``, and the worst best ratio."""
    out = []
    for a, b, m in zip(left, right, matched, strict=True):
        if not len(a) or not len(b):
            out.append((None, None, None))
            continue
        rated = [[ratio(x, y) for y in b] for x in a]
        best_a, best_b = [max(r) for r in rated], [max(c) for c in zip(*rated, strict=True)]
        out.append(([x for x, r in zip(a, best_a, strict=True) if r < m], [y for y, r in zip(b, best_b, strict=True) if r < m], min(*best_a, *best_b)))
    return pd.DataFrame(out, columns=["a", "b", "least"])


def word_noise(pairs: DataFrame, frequencies: DataFrame, matched: float = 0.8) -> DataFrame:
    """Unmatched words of either side, the commonest of them, and the worst of the words' best ratios; null if a side has no word.

    The words of a pair are compared within its row; only those without a partner are counted against ``frequencies``.
    """
    words = lambda c: F.filter(F.array_distinct(tokens(F.col(c))), lambda w: ~w.isin(*LEGAL_WORDS))
    rated = pairs.withColumn("u", _unmatched(words("name_s"), words("name_c"), F.lit(matched)))
    rated = rated.withColumns({"s1_unmatched": F.when(F.col("u.a").isNotNull(), F.size("u.a")), "rec_unmatched": F.when(F.col("u.b").isNotNull(), F.size("u.b")), "min_word_ratio": F.col("u.least")})
    side = lambda n, c: F.transform(c, lambda w: F.struct(F.lit(n).alias("side"), w.alias("word")))
    words = rated.select("s1_id", "cand_id", F.explode(F.concat(side("s1", F.col("u.a")), side("rec", F.col("u.b")))).alias("w")).select("s1_id", "cand_id", "w.side", "w.word")
    known = words.join(frequencies, "word", "left").withColumn("f", F.log1p(F.coalesce("n", F.lit(0))))
    most = known.groupBy("s1_id", "cand_id").agg(*[F.max(F.when(F.col("side") == n, F.col("f"))).alias(f"{n}_unmatched_freq") for n in ("s1", "rec")])
    return rated.drop("u").join(most.hint("merge"), ["s1_id", "cand_id"], "left")


#: Features of the second stage in their order; those of the first stage that it reads again, where the pairs have them.
CONTEXT = ("p1", "p1_rank", "p1_gap_to_best", "p1_best_other", "n_confident", "n_confident_same_source", "n_confident_other_source", "n_above_half", "has_confident_other",
           "other_token_set", "other_ratio", "other_joined", "other_addr_token_set", "other_addr_ratio", "other_shared", "other_empty")
FIRST_STAGE = ("name_token_set", "core_joined_ratio", "addr_token_set", "num_shared", "num_conflict", "legal_conflict", "block_score_rel", "block_rank", "addr_c_empty", "name_c_foreign", "is_source3", "r_rank", "r_score", "r_best_other", "r_gap")
NOISE = ("num_close_shared", "num_close_only", "num_conflict_close", "s1_unmatched", "rec_unmatched", "s1_unmatched_freq", "rec_unmatched_freq", "min_word_ratio")


def feature_columns(pairs: DataFrame) -> list[str]:
    """What the second stage's model reads: the context, and of the rest what the pairs have."""
    return [*CONTEXT, *[c for c in (*FIRST_STAGE, *NOISE) if c in pairs.columns]]
