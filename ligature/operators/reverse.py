"""The index the other way round: for each pool record the best reference records, and features of competition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ligature.operators.blocking import build_index, rank_candidates, shared_keys


def reverse_table(reference_keys: DataFrame, pool_keys: DataFrame, n_reference: int, max_df: int, top_k: int = 10) -> DataFrame:
    """(record_id, s1_id, r_score, r_rank): the ``top_k`` reference records of each pool record.

    df counts over all reference records, idf is ln(n_reference / df).
    """
    index = build_index(pool_keys, reference_keys, n_reference, max_df)
    best = rank_candidates(shared_keys(pool_keys, index), top_k)
    return best.select(F.col("s1_id").alias("record_id"), F.col("cand_id").alias("s1_id"), F.col("score_all").alias("r_score"), F.col("block_rank").alias("r_rank"))


def reverse_features(pairs: DataFrame, table: DataFrame, top_k: int = 10) -> DataFrame:
    """``pairs`` (s1_id, cand_id, ...) with r_rank, r_score, r_best_other and r_gap.

    A pair that is not in the table has rank top_k + 1 and score 0; r_best_other is the record's best score,
    or its second best if this reference record is the best, 0 if there is none.
    """
    own = table.select(F.col("record_id").alias("cand_id"), "s1_id", "r_rank", "r_score")
    tops = table.groupBy(F.col("record_id").alias("cand_id")).agg(F.max(F.when(F.col("r_rank") == 1, F.col("r_score"))).alias("best"), F.max(F.when(F.col("r_rank") == 2, F.col("r_score"))).alias("second"))
    out = pairs.join(own.hint("merge"), ["s1_id", "cand_id"], "left").join(tops.hint("merge"), "cand_id", "left")
    other = F.coalesce(F.when(F.col("r_rank") == 1, F.col("second")).otherwise(F.col("best")), F.lit(0.0))
    out = out.withColumn("r_best_other", other).withColumn("r_rank", F.coalesce("r_rank", F.lit(top_k + 1))).withColumn("r_score", F.coalesce("r_score", F.lit(0.0)))
    return out.withColumn("r_gap", F.round(F.col("r_score") - F.col("r_best_other"), 9)).drop("best", "second")
