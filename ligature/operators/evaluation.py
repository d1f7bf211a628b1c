"""Per-entity F0.5 and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ligature.sources.tables import id_list


def f05(n_true: Column, n_pred: Column, n_correct: Column) -> Column:
    """1 if both lists are empty, 0 if nothing is right, else the F measure that weighs precision twice."""
    precision, recall = n_correct / F.nullif(n_pred, F.lit(0)), n_correct / F.nullif(n_true, F.lit(0))
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when(n_correct == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def score_per_entity(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(source1_entity_id, n_true, n_pred, n_correct, f05) for every entity of the truth.

    Both sides have (source1_entity_id, matched_entity_ids); a missing prediction is an empty one.
    """
    both = truth.select("source1_entity_id", id_list("matched_entity_ids").alias("t")).join(predicted.select("source1_entity_id", id_list("matched_entity_ids").alias("p")), "source1_entity_id", "left")
    both = both.withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    n = both.select("source1_entity_id", F.size("t").alias("n_true"), F.size("p").alias("n_pred"), F.size(F.array_intersect("t", "p")).alias("n_correct"))
    return n.withColumn("f05", f05(F.col("n_true"), F.col("n_pred"), F.col("n_correct")))


def report(scores: DataFrame) -> DataFrame:
    """One row: macro F0.5, over entities with and without matches, micro precision and recall, totals."""
    t, p, c = F.sum("n_true"), F.sum("n_pred"), F.sum("n_correct")
    return scores.agg(
        F.count("*").alias("entities"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.avg(F.when(F.col("n_true") > 0, F.col("f05"))), 6).alias("matched_f05"),
        F.round(F.avg(F.when(F.col("n_true") == 0, F.col("f05"))), 6).alias("single_f05"), F.round(F.try_divide(c, p), 6).alias("micro_precision"), F.round(F.try_divide(c, t), 6).alias("micro_recall"),
        t.alias("n_true"), p.alias("n_pred"), c.alias("n_correct"),
    )


def candidate_recall(truth_pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, and their share."""
    hit = truth_pairs.join(candidates.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    return hit.agg(F.count("*").alias("true_pairs"), F.sum(F.coalesce("hit", F.lit(0))).alias("found")).withColumn("recall", F.round(F.try_divide("found", "true_pairs"), 6))


def rank_auc(scored: DataFrame, score: str, label: str, group: list[str] | None = None, parts: int = 32) -> DataFrame:
    """Area under the ROC curve by average ranks, for each group: (group..., positives, negatives, auc).

    Counts are gathered by score first, so ties and size cost nothing. Distinct scores are cut into ``parts``
    ranges; ranks are counted within a range and the ranges below it added, so no task sees all scores. Null
    and NaN scores are left out.
    """
    keys = group or []
    s = F.col(score).cast("double")
    n = scored.where(F.col(score).isNotNull() & ~F.isnan(s)).groupBy(*keys, s.alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    edges = sorted(set(n.approxQuantile("s", [i / parts for i in range(1, parts)], 0.01)))
    n = n.withColumn("part", sum(((F.col("s") >= e).cast("int") for e in edges), F.lit(0)))
    totals = n.groupBy(*keys, "part").agg(F.sum("neg").alias("all_neg"))
    under = F.sum("all_neg").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "part", F.coalesce(under, F.lit(0)).alias("under"))
    below = F.sum("neg").over(Window.partitionBy(*keys, "part").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("neg")
    wins = n.withColumn("below", below).join(totals, [*keys, "part"]).withColumn("wins", F.col("pos") * (F.col("below") + F.col("under") + F.col("neg") / 2))
    out = wins.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("wins").alias("w"))
    return out.withColumn("auc", F.round(F.try_divide(F.col("w"), F.col("positives") * F.col("negatives")), 6)).drop("w")


def feature_table(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Each feature by itself: (feature, auc, direction, separation, missing_percent, mean_true, mean_false)."""
    long = labelled.select("label", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["label"], columns, "feature", "value")
    auc = rank_auc(long, "value", "label", ["feature"]).select("feature", "auc")
    mean = lambda k: F.round(F.avg(F.when(F.col("label") == k, F.col("value"))), 4)
    seen = long.groupBy("feature").agg(F.round(100 * F.avg(F.col("value").isNull().cast("int")), 4).alias("missing_percent"), mean(1).alias("mean_true"), mean(0).alias("mean_false"))
    way = F.when(F.col("auc") >= 0.5, "higher = match").otherwise("lower = match")
    return auc.join(seen, "feature").select("feature", "auc", way.alias("direction"), F.round(F.abs(F.col("auc") - 0.5) * 2, 6).alias("separation"), "missing_percent", "mean_true", "mean_false")


def error_labels(pairs: DataFrame, chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """``pairs`` (s1_id, cand_id, ...) with error (FN, FP, ok, rejected) and owner of the record (this, another, nobody)."""
    on = ["s1_id", "cand_id"]
    owners = truth.groupBy("cand_id").agg(F.min("s1_id").alias("owner_id"))
    x = pairs.join(chosen.select(*on, F.lit(True).alias("chosen")), on, "left").join(truth.select(*on, F.lit(True).alias("hit")), on, "left").join(owners, "cand_id", "left")
    hit, yes = F.col("hit").isNotNull(), F.col("chosen").isNotNull()
    error = F.when(hit & ~yes, "FN").when(~hit & yes, "FP").when(hit, "ok").otherwise("rejected")
    owner = F.when(F.col("owner_id").isNull(), "nobody").when(F.col("owner_id") == F.col("s1_id"), "this").otherwise("another")
    return x.withColumns({"error": error, "owner": owner}).drop("chosen", "hit", "owner_id")


def buckets(value: Column, edges: list[float]) -> Column:
    """Names of intervals that hold their upper edge, the first one its lower edge too; null outside."""
    out = F.lit(None).cast("string")
    for i in reversed(range(len(edges) - 1)):
        low, high = edges[i], edges[i + 1]
        inside = (value <= high) & ((value >= low) if i == 0 else (value > low))
        out = F.when(inside, F.lit(f"{'[' if i == 0 else '('}{low}, {high}]")).otherwise(out)
    return out


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of a sweep with the greatest macro F0.5; of equal ones the lowest threshold."""
    return sweep.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def threshold_sweep(truth: DataFrame, pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, macro_f05, n_pred, n_correct) for every threshold in one job; pairs have (s1_id, cand_id, probability)."""
    entities = truth.select(F.col("source1_entity_id").alias("s1_id"), F.size(id_list("matched_entity_ids")).alias("n_true"))
    true_pairs = truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(id_list("matched_entity_ids")).alias("cand_id"), F.lit(1).alias("hit"))
    labelled = pairs.join(entities.select("s1_id"), "s1_id", "left_semi").join(true_pairs.hint("merge"), ["s1_id", "cand_id"], "left")
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    kept = labelled.select("*", grid).where(F.col("probability") >= F.col("threshold")).groupBy("threshold", "s1_id").agg(F.count("*").alias("n_pred"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_correct"))
    every = entities.select("*", grid).join(kept, ["threshold", "s1_id"], "left").na.fill(0, ["n_pred", "n_correct"])
    return every.withColumn("f", f05(F.col("n_true"), F.col("n_pred"), F.col("n_correct"))).groupBy("threshold").agg(F.round(F.avg("f"), 6).alias("macro_f05"), F.sum("n_pred").alias("n_pred"), F.sum("n_correct").alias("n_correct"))


def _resampled(resamples: int):
    """One row for each task: the sums of weighted differences and of weights for every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for h, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.random.Generator(np.random.Philox(key=h & (1 << 64) - 1)).poisson(1.0, resamples)
                total += w * d
                weight += w
        yield pa.record_batch([pa.array([total.tolist()]), pa.array([weight.tolist()])], ["total", "weight"])

    return run


def paired_bootstrap(a: DataFrame, b: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean difference of per-entity scores b - a with a 95 % interval, and entities better, worse, equal.

    Resampling is by Poisson weights from a hash of entity and round, so it needs no gathering and repeats exactly.
    """
    d = a.select("source1_entity_id", F.col("f05").alias("x")).join(b.select("source1_entity_id", F.col("f05").alias("y")), "source1_entity_id").withColumn("d", F.col("y") - F.col("x"))
    part = d.select(F.xxhash64("source1_entity_id", F.lit(seed)).alias("h"), "d").mapInArrow(_resampled(resamples), "total array<double>, weight array<double>")
    drawn = part.select(F.posexplode(F.arrays_zip("total", "weight")).alias("round", "x")).groupBy("round").agg(F.sum("x.total").alias("t"), F.sum("x.weight").alias("w"))
    means = drawn.select(F.try_divide("t", "w").alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.lit(1).alias("one"))
    n = d.agg(F.avg("d").alias("mean_difference"), F.sum((F.col("d") > 0).cast("int")).alias("better"), F.sum((F.col("d") < 0).cast("int")).alias("worse"), F.sum((F.col("d") == 0).cast("int")).alias("unchanged"), F.lit(1).alias("one"))
    return n.join(ci, "one").drop("one")


def split_entities(entities: DataFrame, key: str, share: float = 0.2, small: int = 20_000, seed: int = 42) -> DataFrame:
    """(key, split, small_validation): a validation share by hash order, and a small set within it."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key)))
    r = entities.select(key).distinct().withColumn("h", h).withColumn("validation", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") < int(share * 2**32))
    chosen = r.where("validation").orderBy("h", key).limit(small).select(key, F.lit(True).alias("small_validation"))
    return r.join(chosen, key, "left").select(key, F.when(F.col("validation"), "validation").otherwise("train").alias("split"), F.coalesce("small_validation", F.lit(False)).alias("small_validation"))
