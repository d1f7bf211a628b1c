"""The whole job: normalise, key, candidates, features, first model, second model, threshold, one owner, lists."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ligature.functions import text as T
from ligature.operators import blocking, decision, evaluation, features, keys, learn, reverse, stage2
from ligature.operators.learn import Experiment
from ligature.plans.registry import _pool, _s1, _truth, query
from ligature.sources import sinks, tables
from ligature.workspace import materialize

#: Thresholds tried for either stage; pairs below the first cut never come back.
GRID = [round(0.5 + 0.025 * i, 3) for i in range(17)]
GRID_SECOND = [round(0.3 + 0.025 * i, 3) for i in range(25)]
EARLY_DROP = 0.01


def normalised(records: DataFrame, translit: bool) -> DataFrame:
    """(entity_id, country, name, addr, name_foreign): the chosen steps; the flag tells raw names in Indic scripts."""
    first = ("translit",) if translit else ()
    name, addr = T.normalize(F.col("business_name"), (*first, *T.NAME_STEPS)), T.normalize(F.col("business_address"), (*first, *T.ADDRESS_STEPS))
    return records.select("entity_id", "country", name.alias("name"), addr.alias("addr"), F.col("business_name").rlike(T.INDIC).cast("int").alias("name_foreign"))


@dataclass
class Tables:
    """Normalised records and the features of all candidate pairs."""

    reference: DataFrame
    pool: DataFrame
    pairs: DataFrame


def pair_tables(reference: DataFrame, pool: DataFrame, e: Experiment) -> Tables:
    s1, p = materialize(normalised(reference, e.translit), "reference"), materialize(normalised(pool, e.translit), "pool")
    k1, kp = keys.record_keys(s1, hashed=True), keys.record_keys(p, hashed=True)
    found = materialize(blocking.candidates(k1, kp, p.count(), e.max_df, e.top_k), "candidates")
    back = reverse.reverse_table(k1, kp, s1.count(), e.max_df) if e.reverse else None
    return Tables(s1, p, materialize(features.pair_vector(found, s1, p, back, e.tfidf), "features"))


@dataclass
class Model:
    """Both stages with what they read and their thresholds; without a second stage the first one decides."""

    experiment: Experiment
    first: PipelineModel
    first_features: list[str]
    threshold: float
    second: PipelineModel | None = None
    second_features: list[str] | None = None
    first_threshold: float | None = None

    def without_second(self) -> Model:
        """The first stage alone, as a training without a second stage gives it."""
        return replace(self, threshold=self.first_threshold, second=None, second_features=None)


def _second_pairs(scored: DataFrame, frequencies: DataFrame | None) -> DataFrame:
    """Pairs that may still match, with the features of the second stage."""
    context = stage2.context_features(scored.where(F.col("p1") >= EARLY_DROP))
    out = stage2.cross_features(materialize(context, "context"))
    if frequencies is not None:
        out = stage2.word_noise(stage2.number_noise(out), frequencies)
    return materialize(out, "second-stage")


def _best(truth: DataFrame, pairs: DataFrame, grid: list[float]) -> float:
    return evaluation.best_threshold(evaluation.threshold_sweep(truth, pairs, grid)).first().threshold


def train(t: Tables, matches: DataFrame, e: Experiment) -> Model:
    """Fits on the entities of ``matches``. Thresholds and the second stage see out-of-fold probabilities only."""
    ids = matches.select(F.col("source1_entity_id").alias("s1_id"))
    if e.train_share < 1:
        ids = ids.where(F.pmod(F.xxhash64("s1_id", F.lit(11)), F.lit(1000)) < int(1000 * e.train_share))
    matches = matches.join(ids.withColumnRenamed("s1_id", "source1_entity_id"), "source1_entity_id", "left_semi")
    true = tables.explode_matches(matches).select(F.col("source1_entity_id").alias("s1_id"), F.col("match_id").alias("cand_id"), F.lit(1).alias("label"))
    rows = materialize(t.pairs.join(ids.hint("merge"), "s1_id", "left_semi").join(true.hint("merge"), ["s1_id", "cand_id"], "left").na.fill(0, ["label"]), "training")
    names = learn.known_features(rows, features.feature_names(e.tfidf, e.extra, e.reverse))
    oof = materialize(learn.out_of_fold(rows, e, names).withColumnRenamed("probability", "p1"), "out-of-fold")
    model = Model(e, learn.fit(rows, e, names), names, _best(matches, oof.withColumn("probability", F.col("p1")), GRID))
    model.first_threshold = model.threshold
    if e.stage2:
        second, pairs = learn.second_stage(e), _second_pairs(oof, stage2.word_frequencies(t.reference) if e.noise else None)
        more = learn.known_features(pairs, stage2.feature_columns(pairs))
        p2 = materialize(learn.out_of_fold(pairs, second, more), "out-of-fold-second")
        model.second, model.second_features, model.threshold = learn.fit(pairs, second, more), more, _best(matches, p2, GRID_SECOND)
    return model


def predict(t: Tables, model: Model, ids: DataFrame | None = None) -> DataFrame:
    """(s1_id, cand_id, probability) of the chosen pairs: above the threshold, each record with one owner."""
    e = model.experiment
    pairs = t.pairs if ids is None else t.pairs.join(ids, "s1_id", "left_semi")
    scored = learn.predict(model.first, pairs, e, model.first_features, "p1")
    if model.second is None:
        scored = scored.withColumn("probability", F.col("p1"))
    else:
        scored = learn.predict(model.second, _second_pairs(scored, stage2.word_frequencies(t.reference) if e.noise else None), learn.second_stage(e), model.second_features)
    return decision.one_owner(decision.global_threshold(scored.select("s1_id", "cand_id", "probability"), model.threshold))


def run(spark: SparkSession, folder: str, e: Experiment) -> tuple[Tables, Model]:
    t = pair_tables(_s1(spark, folder), _pool(spark, folder), e)
    return t, train(t, tables.known_matches(spark, folder), e)


@query()
def er_predict(s, d):
    """The lists of all reference records, from models that are trained on the known matches."""
    t, model = run(s, d, learn.EXPERIMENTS["quick"])
    return sinks.assemble(_s1(s, d), decision.to_lists(predict(t, model)))


@query()
def er_train(s, d):
    """Scores on held-out entities: the rule-based baseline, the first stage alone, both stages."""
    e = learn.EXPERIMENTS["quick"]
    t, known = pair_tables(_s1(s, d), _pool(s, d), e), tables.known_matches(s, d)
    side = evaluation.split_entities(known.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", 0.3, 0)
    held = side.where("split = 'validation'").select(F.col("entity_id").alias("source1_entity_id"))
    truth, rest = known.join(held, "source1_entity_id", "left_semi"), known.join(held, "source1_entity_id", "left_anti")
    ids = held.select(F.col("source1_entity_id").alias("s1_id"))
    parts = []
    both = train(t, rest, e)
    for name, model in (("first_stage", both.without_second()), ("both_stages", both)):
        chosen = evaluation.report(evaluation.score_per_entity(truth, decision.to_lists(predict(t, model, ids))))
        parts.append(chosen.select(F.lit(name).alias("stage"), F.lit(model.threshold).alias("threshold"), "entities", "macro_f05", "micro_precision", "micro_recall"))
    rule = decision.one_owner(t.pairs.join(ids, "s1_id", "left_semi").select("s1_id", "cand_id", F.col("rule_score").alias("probability")).where("probability >= 0.6"))
    base = evaluation.report(evaluation.score_per_entity(truth, decision.to_lists(rule)))
    parts.append(base.select(F.lit("rule").alias("stage"), F.lit(0.6).alias("threshold"), "entities", "macro_f05", "micro_precision", "micro_recall"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def feat_vector(s, d):
    """All 46 features of every candidate pair, tf-idf of names and addresses among them."""
    e = learn.replace(learn.EXPERIMENTS["quick"], tfidf=True)
    return pair_tables(_s1(s, d), _pool(s, d), e).pairs.select("s1_id", "cand_id", *features.feature_names(True, True, True))
