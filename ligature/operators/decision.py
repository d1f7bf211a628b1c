"""Rules that turn probabilities into matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def global_threshold(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.col("probability") >= threshold)


def relative_threshold(pairs: DataFrame, threshold: float, share: float) -> DataFrame:
    """At least ``threshold`` and at least ``share`` of the entity's best."""
    best = F.max("probability").over(Window.partitionBy("s1_id"))
    return pairs.withColumn("best", best).where((F.col("probability") >= threshold) & (F.col("probability") >= share * F.col("best"))).drop("best")


def expected_f05(pairs: DataFrame, missing_rate: float = 0.0) -> DataFrame:
    """The number of best candidates that maximises the expected F0.5 of the entity.

    With candidates by falling probability and N the expected number of true ones, found or not, the first k
    have 1.25 * sum / (k + N / 4); none at all has the probability that nothing is true. The first k with the
    greatest value is taken, none if none is as good. Of equal probabilities the smaller id goes first.
    """
    by_p = Window.partitionBy("s1_id").orderBy(F.desc("probability"), "cand_id")
    running = by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("s1_id")
    p = F.col("probability")
    f = pairs.withColumn("k", F.row_number().over(by_p)).withColumn("cum", F.sum(p).over(running)).withColumn("n", F.sum(p).over(whole) / (1 - missing_rate))
    f = f.withColumn("none", F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - p))).over(whole)) * (1 - missing_rate))
    f = f.withColumn("f_k", F.round(1.25 * F.col("cum") / (F.col("k") + 0.25 * F.col("n")), 12))
    first = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("f_k"), "k"))
    best = f.withColumn("place", first).where("place = 1").select("s1_id", F.when(F.col("none") >= F.col("f_k"), 0).otherwise(F.col("k")).alias("best_k"))
    return f.join(best, "s1_id").where(F.col("k") <= F.col("best_k")).select(*pairs.columns)


def one_owner(pairs: DataFrame) -> DataFrame:
    """Each candidate stays with its most probable entity; ties go to the smaller entity id."""
    w = Window.partitionBy("cand_id").orderBy(F.desc("probability"), "s1_id")
    return pairs.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def to_lists(pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids), ids in order."""
    return pairs.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("matched_entity_ids"))
