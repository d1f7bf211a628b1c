import glob
import math
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ligature.operators import blocking, decision, evaluation, features, keys, learn, reverse, stage2
from ligature.plans import registry
from ligature.sources import sinks, tables

RECORD = "entity_id string, country string, name string, addr string"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_keys(spark):
    r = records(spark, [("1", "US", "maure williams colombier inc", "85 wayne avenue ticonderoga ny"), ("2", "US", "", ""), ("3", "US", "ab", "")])
    found = defaultdict(set)
    for x in keys.record_keys(r).collect():
        found[x.entity_id].add(x.key)
    assert {"US|nw|colombier", "US|nb|williams_colombier", "US|ab|85_wayne", "US|nj|maurewilliamscolombier"} <= found["1"]
    assert found["2"] == set() and found["3"] == {"US|nw|ab"}
    with pytest.raises(ValueError):
        keys.record_keys(r, ["xx"])


def test_candidates_against_brute_force(spark):
    q = [("q1", "US", "red fox foods", "1 high street"), ("q2", "US", "blue whale", ""), ("q3", "FR", "red fox", "")]
    p = [("p1", "US", "red fox food", "1 high street"), ("p2", "US", "whale blue", ""), ("p3", "US", "red", "high"), ("p4", "FR", "red", ""), ("p5", "US", "red fox food", "1 high street")]
    kq, kp = keys.record_keys(records(spark, q), ["nw", "aw"]), keys.record_keys(records(spark, p), ["nw", "aw"])
    got = {(r.s1_id, r.cand_id): (r.score_all, r.block_rank) for r in blocking.candidates(kq, kp, len(p), 3, 2).collect()}

    def words(r):
        return {f"{r[1]}|n|{w}" for w in r[2].split()} | {f"{r[1]}|a|{w}" for w in r[3].split()}

    df = defaultdict(int)
    for r in p:
        for k in words(r):
            df[k] += 1
    wanted = {}
    for a in q:
        scored = sorted((-round(sum(math.log(len(p) / df[k]) for k in words(a) & words(b) if df[k] <= 3), 9), b[0]) for b in p if any(df[k] <= 3 for k in words(a) & words(b)))
        wanted.update({(a[0], b): (-s, i + 1) for i, (s, b) in enumerate(scored[:2])})
    assert {k: (round(s, 6), r) for k, (s, r) in got.items()} == {k: (round(s, 6), r) for k, (s, r) in wanted.items()}
    hashed = blocking.candidates(keys.record_keys(records(spark, q), ["nw", "aw"], hashed=True), keys.record_keys(records(spark, p), ["nw", "aw"], hashed=True), len(p), 3, 2)
    assert {(r.s1_id, r.cand_id) for r in hashed.collect()} == set(wanted)
    back = reverse.reverse_table(kq, kp, len(q), 3)
    assert {(r.record_id, r.s1_id) for r in back.collect()} >= {("p1", "q1"), ("p2", "q2")}


def test_empty_tables(spark):
    none = records(spark, [])
    k = keys.record_keys(none)
    assert blocking.candidates(k, k, 0, 5, 5).count() == 0
    assert reverse.reverse_table(k, k, 0, 5).count() == 0


def test_f05_goldens(spark):
    rows = [(2, 3, 2, 0.714), (4, 4, 4, 1.0), (4, 5, 4, 0.8333), (4, 3, 3, 0.9375), (4, 2, 2, 0.8333), (4, 1, 1, 0.625), (4, 4, 2, 0.5), (4, 4, 1, 0.25), (4, 0, 0, 0.0), (0, 0, 0, 1.0), (0, 1, 0, 0.0)]
    df = spark.createDataFrame(rows, "t int, p int, c int, w double").withColumn("f", evaluation.f05(F.col("t"), F.col("p"), F.col("c")))
    for r in df.collect():
        assert r.f == pytest.approx(r.w, abs=5e-4)


def test_expected_f05(spark):
    rows = [("A", "a1", 0.99), ("A", "a2", 0.98), ("A", "a3", 0.65), ("A", "a4", 0.05), ("B", "b1", 0.65), ("B", "b2", 0.10), ("C", "c1", 0.30)]
    got = decision.expected_f05(spark.createDataFrame(rows, "s1_id string, cand_id string, probability double")).collect()
    assert {r.cand_id for r in got} == {"a1", "a2", "b1"}


def test_owner_and_lists(spark):
    p = spark.createDataFrame([("s1", "c", 0.9), ("s2", "c", 0.9), ("s2", "d", 0.2)], "s1_id string, cand_id string, probability double")
    assert {(r.s1_id, r.cand_id) for r in decision.one_owner(p).collect()} == {("s1", "c"), ("s2", "d")}
    out = sinks.assemble(spark.createDataFrame([("s1",), ("s3",)], "entity_id string"), decision.to_lists(decision.one_owner(p)))
    assert {r.source1_entity_id: r.matched_entity_ids for r in out.collect()} == {"s1": "c", "s3": ""}


def test_set_features(spark):
    p = spark.createDataFrame([("a", "S3-1", "red fox inc", "1 high st", "red fox incorporated", ""), ("a", "S2-1", "x", "12 a", "", "12 b")], "s1_id string, cand_id string, name_s string, addr_s string, name_c string, addr_c string")
    f = {r.cand_id: r for r in features.set_features(p).collect()}
    assert f["S3-1"].core_exact == 1 and f["S3-1"].legal_same == 1 and f["S3-1"].addr_jaccard is None and f["S3-1"].addr_c_empty == 1 and f["S3-1"].is_source3 == 1
    assert f["S2-1"].name_jaccard is None and f["S2-1"].num_exact_match == 1 and f["S2-1"].rule_score == pytest.approx(1 / 3)
    n = {r.cand_id: r for r in stage2.number_noise(p).collect()}
    assert n["S2-1"].num_close_shared == 1


def test_auc_and_bootstrap(spark):
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (None, 1)], "p double, label int")
    assert evaluation.rank_auc(s, "p", "label").first().auc == pytest.approx(0.875)
    a = spark.createDataFrame([(str(i), float(i % 2)) for i in range(50)], "source1_entity_id string, f05 double")
    b = a.withColumn("f05", F.lit(1.0))
    r = evaluation.paired_bootstrap(a, b, 50).first()
    assert r.better == 25 and r.unchanged == 25 and 0 < r.low <= 0.5 <= r.high < 1


def test_tsv_keeps_quotes_and_empty_fields(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta "b\t\tUS\nS1-2\tnull\tNA\tUS\n')
    rows = {r.entity_id: r for r in tables.read_tsv(spark, str(tmp_path / "x.tsv")).collect()}
    assert rows["S1-1"].business_name == 'a "b' and rows["S1-1"].business_address == "" and rows["S1-2"].business_name == "null"
    m = spark.createDataFrame([("S1-1", "S2-5,S3-9"), ("S1-2", "")], tables.MATCH_SCHEMA)
    assert {(r.source1_entity_id, r.match_id, r.match_source) for r in tables.explode_matches(m).collect()} == {("S1-1", "S2-5", "S2"), ("S1-1", "S3-9", "S3")}
    sinks.write_id_lists(m, str(tmp_path / "out"))
    text = "".join(sorted(open(f).read() for f in glob.glob(str(tmp_path / "out/*.csv"))))
    assert "S1-1\tS2-5,S3-9\n" in text and "\r" not in text and '"' not in text
    sinks.write_partitioned(spark.createDataFrame([("a", "US"), ("b", "FR")], "id string, country string"), str(tmp_path / "parts"))
    assert sinks.finished_partitions(spark, str(tmp_path / "parts")) == ["FR", "US"]


def test_model_learns_saves_and_loads(spark, tmp_path):
    rows = [(f"s{i % 60}", f"c{i}", int(i % 3 == 0), float(i % 3 == 0) + (i % 7) / 10, None if i % 5 == 0 else float(i % 4)) for i in range(600)]
    pairs = spark.createDataFrame(rows, "s1_id string, cand_id string, label int, x double, y double")
    e = learn.EXPERIMENTS["logistic"]
    oof = learn.out_of_fold(pairs, e, ["x", "y"])
    assert oof.count() == 600 and evaluation.rank_auc(oof, "probability", "label").first().auc > 0.9
    model = learn.fit(pairs, e, ["x", "y"])
    learn.save(model, str(tmp_path / "m"))
    key = lambda m: {(r.cand_id, round(r.probability, 9)) for r in learn.predict(m, pairs, e, ["x", "y"]).select("cand_id", "probability").collect()}
    assert key(model) == key(learn.load(str(tmp_path / "m")))


def test_stream_matches_like_a_batch(spark, tmp_path, sf_dir):
    from ligature.streaming import incremental as inc

    ref = inc.normalised(tables.reference_records(spark, sf_dir))
    k, n = keys.record_keys(ref), ref.count()
    src = tables.table(spark, sf_dir, "train_source2").select("entity_id", "business_name", "business_address", "country")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    inc.match_stream(stream, k, n, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("record_id", "s1_id", "rank")
    want = inc.match_batch(src, k, n, 50, 10).select("record_id", "s1_id", "rank")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def _same(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return x if isinstance(x, str | bool | int) else round(float(x), 5)


@pytest.mark.parametrize("name", ["src_matches_long", "norm_legal_canonical", "key_nb", "block_candidates_all", "rev_features", "feat_numbers", "dec_expected", "eval_report", "eda_evidence", "er_baseline"])
def test_sql_says_the_same(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = c.execute(registry.SQL[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    want = sorted(repr(tuple(_same(r[at.index(k)]) for k in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(_same(r[k]) for k in cols)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["block_candidates_wide", "block_sweep_wide"])
def test_wide_design_says_the_same(spark, sf_dir, name):
    test_sql_says_the_same(spark, sf_dir, name)


def test_wide_design_keeps_common_keys(spark, tmp_path):
    row = "entity_id string, business_name string, business_address string, country string"
    copies = [(f"S2-{i:03d}", "red fox", "", "US") for i in range(60)]
    for table, rows in (("train_source1", [("S1-1", "red fox", "", "US")]), ("train_source2", copies), ("train_source3", [("S3-1", "blue whale", "", "US")])):
        spark.createDataFrame(rows, row).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert registry.QUERIES["block_candidates_wide"](spark, str(tmp_path)).count() == 60


def test_every_setting_of_an_experiment_is_read():
    import inspect
    import re
    from dataclasses import replace

    from ligature.plans import linkage

    source = inspect.getsource(learn) + inspect.getsource(linkage)
    read = set(re.findall(r"\b(?:e|x|experiment)\.(\w+)", source))
    assert set(learn.Experiment.__dataclass_fields__) <= read
    assert len({replace(e, name="") for e in learn.EXPERIMENTS.values()}) == len(learn.EXPERIMENTS)


def test_bootstrap_query_draws_as_often_as_the_operator(spark, sf_dir, monkeypatch):
    drawn = []
    real = evaluation.paired_bootstrap
    monkeypatch.setattr(evaluation, "paired_bootstrap", lambda a, b, resamples=1000, seed=42: drawn.append(resamples) or real(a, b, resamples, seed))
    assert registry.QUERIES["eval_bootstrap"](spark, sf_dir).count() == 1 and drawn == [1000]
