"""Classifiers of pairs: Spark ML pipelines, out-of-fold scoring by entity, importance, saving and loading."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ligature.workspace import release


@dataclass(frozen=True)
class Experiment:
    """Settings of one training run; ``plans.linkage`` reads every one of them."""

    name: str = "boosting"
    learner: str = "boosting"  # logistic, forest or boosting
    rounds: int = 20
    depth: int = 5
    step: float = 0.1
    least_rows: int = 20  # rows of a leaf
    trees: int = 50
    translit: bool = True
    max_df: int = 1000
    top_k: int = 50
    train_share: float = 1.0  # of the training entities
    tfidf: bool = False
    extra: bool = False
    reverse: bool = False
    stage2: bool = False
    noise: bool = False


_FULL = {"learner": "boosting", "rounds": 400, "depth": 6, "least_rows": 50}
_MANY = {"learner": "boosting", "rounds": 800, "depth": 7, "step": 0.05, "least_rows": 2}
EXPERIMENTS = {
    "logistic": Experiment("logistic", "logistic", rounds=50), "forest": Experiment("forest", "forest", depth=10), "boosting": Experiment(),
    "quick": Experiment("quick", "logistic", extra=True, reverse=True, stage2=True, noise=True, max_df=50, top_k=10),
    "plain": Experiment("plain", **_FULL, translit=False, tfidf=True, train_share=0.25), "translit": Experiment("translit", **_FULL, tfidf=True, train_share=0.25), "more_entities": Experiment("more_entities", **_FULL, tfidf=True, train_share=0.75),
    "wide": Experiment("wide", **_FULL, tfidf=True, top_k=100, train_share=0.25), "fast": Experiment("fast", **_FULL, top_k=100, train_share=0.5), "stage2": Experiment("stage2", **_FULL, top_k=100, stage2=True),
    "reverse": Experiment("reverse", **_MANY, top_k=100, stage2=True, reverse=True), "extra": Experiment("extra", **_MANY, top_k=100, stage2=True, reverse=True, extra=True), "noise": Experiment("noise", **_MANY, top_k=100, stage2=True, reverse=True, extra=True, noise=True),
    "large_forest": Experiment("large_forest", "forest", trees=100, depth=18, tfidf=True),
}
#: The second stage learns slower and in smaller trees.
SECOND = {"boosting": {"rounds": 300, "step": 0.05, "depth": 5, "least_rows": 40}}


def second_stage(experiment: Experiment) -> Experiment:
    settings = SECOND.get(experiment.learner, {})
    if experiment.rounds < 100:
        settings = {k: v for k, v in settings.items() if k != "rounds"}
    return replace(experiment, name=f"{experiment.name}_second", **settings)


def prepare(pairs: DataFrame, features: list[str], missing: float | None = None) -> DataFrame:
    """Features as doubles; nulls stay for an imputer, or become ``missing``."""
    cols = [F.col(f).cast("double").alias(f) for f in features]
    if missing is not None:
        cols = [F.coalesce(c, F.lit(missing)).alias(f) for c, f in zip(cols, features, strict=True)]
    return pairs.select(*[c for c in pairs.columns if c not in features], *cols)


def pipeline(experiment: Experiment, features: list[str], seed: int = 42) -> Pipeline:
    """Logistic regression imputes medians and scales; trees see -1 for unknown values (set by ``prepare``)."""
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    if experiment.learner == "logistic":
        filled, missing = [f"{f}__filled" for f in features], [f"{f}__missing" for f in features]
        return Pipeline(stages=[
            Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=[*filled, *missing], outputCol="raw"),
            StandardScaler(withMean=True, inputCol="raw", outputCol="features"), LogisticRegression(maxIter=experiment.rounds, regParam=1e-4),
        ])
    if experiment.learner == "forest":
        return Pipeline(stages=[assemble, RandomForestClassifier(numTrees=experiment.trees, maxDepth=experiment.depth, minInstancesPerNode=20, subsamplingRate=0.3, seed=seed)])
    return Pipeline(stages=[assemble, GBTClassifier(maxIter=experiment.rounds, stepSize=experiment.step, maxDepth=experiment.depth, minInstancesPerNode=experiment.least_rows, seed=seed)])


def _ready(pairs: DataFrame, experiment: Experiment, features: list[str]) -> DataFrame:
    """Logistic regression gets a flag for each unknown value beside the median; trees get -1."""
    if experiment.learner != "logistic":
        return prepare(pairs, features, -1.0)
    out = prepare(pairs, features)
    # a column without any known value has no median
    return out.select("*", *[F.col(f).isNull().cast("double").alias(f"{f}__missing") for f in features])


def known_features(pairs: DataFrame, features: list[str]) -> list[str]:
    """Features of which at least one pair knows the value."""
    n = pairs.agg(*[F.count(f).alias(f) for f in features]).first()
    return [f for f in features if n[f]]


def weights(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Weights of a logistic regression, largest first; ``__missing`` marks those of unknown values."""
    names = [*features, *[f"{f}__missing" for f in features]]
    return sorted(zip(names, model.stages[-1].coefficients.toArray().tolist(), strict=True), key=lambda x: -abs(x[1]))


def fit(pairs: DataFrame, experiment: Experiment, features: list[str]) -> PipelineModel:
    model = pipeline(experiment, features).fit(_ready(pairs, experiment, features).withColumn("label", F.col("label").cast("double")))
    release(pairs.sparkSession)  # a fit is dozens of jobs
    return model


def predict(model: PipelineModel, pairs: DataFrame, experiment: Experiment, features: list[str], column: str = "probability") -> DataFrame:
    out = model.transform(_ready(pairs, experiment, features)).withColumn("p__", vector_to_array("probability")[1])
    keep = [c for c in pairs.columns if c != column]
    return out.select(*keep, F.col("p__").alias(column))


def out_of_fold(pairs: DataFrame, experiment: Experiment, features: list[str], folds: int = 3) -> DataFrame:
    """Probabilities of each entity's pairs from a model that has not seen the entity."""
    with_fold = pairs.withColumn("fold", F.pmod(F.xxhash64("s1_id"), F.lit(folds)))
    parts = None
    for k in range(folds):
        model = fit(with_fold.where(F.col("fold") != k), experiment, features)
        part = predict(model, with_fold.where(F.col("fold") == k), experiment, features)
        parts = part if parts is None else parts.unionByName(part)
    return parts.drop("fold")


def permutation_importance(model: PipelineModel, pairs: DataFrame, experiment: Experiment, features: list[str], seed: int = 7) -> DataFrame:
    """(feature, auc_drop): what is lost in AUC when a feature's values change places.

    Values change places along a hash order: each row takes the value of the row with the same place in another one.
    """
    from pyspark.sql import Window

    from ligature.operators.evaluation import rank_auc

    spark = pairs.sparkSession
    whole = rank_auc(predict(model, pairs, experiment, features), "probability", "label").first().auc
    rows = []
    blocks = 64  # places are counted within blocks of rows, so no single task sees all of them
    for f in features:
        block = F.pmod(F.xxhash64("s1_id"), F.lit(blocks))
        a = pairs.drop(f).withColumn("block", block).withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("s1_id", "cand_id"))))
        b = pairs.select(f, block.alias("block"), F.row_number().over(Window.partitionBy(block).orderBy(F.xxhash64("cand_id", "s1_id", F.lit(seed)))).alias("place"))
        auc = rank_auc(predict(model, a.join(b, ["block", "place"]).drop("block", "place"), experiment, features), "probability", "label").first().auc
        rows.append((f, float(whole - auc)))
    return spark.createDataFrame(rows, "feature string, auc_drop double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
