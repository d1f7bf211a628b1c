import random

import pytest
from pyspark.sql import functions as F

from ligature.functions import similarity
from ligature.operators import evaluation, features, learn, stage2
from ligature.sources import sinks, tables
from ligature.workspace import cached


def test_partial_ratio_against_all_windows():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 7))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))] if short else []
        wanted = max((similarity.ratio(short, w) for w in windows), default=0.0) if short else float(not long)
        assert similarity.partial_ratio(a, b) == pytest.approx(wanted)


def test_auc_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xy"), rng.choice([round(rng.random(), 1), rng.random()]), rng.randint(0, 1)) for _ in range(300)] + [("x", None, 1), ("y", float("nan"), 0)]
    df = spark.createDataFrame(rows, "g string, s double, label int")
    for r in evaluation.rank_auc(df, "s", "label", ["g"], parts=7).collect():
        pos, neg = ([s for g, s, k in rows if g == r.g and k == want and s is not None and s == s] for want in (1, 0))
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert r.auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-6)
    assert evaluation.rank_auc(df.where("g = 'z'"), "s", "label").first().auc is None


def test_labels_buckets_and_thresholds(spark):
    pairs = spark.createDataFrame([("a", "1", 0.0), ("a", "2", 0.5), ("b", "1", 0.51), ("b", "3", 1.0), ("b", "4", 1.5)], "s1_id string, cand_id string, p double")
    truth = pairs.where("(s1_id = 'a' and cand_id in ('1', '2'))")
    got = {(r.s1_id, r.cand_id): (r.error, r.owner) for r in evaluation.error_labels(pairs, pairs.where("p >= 0.5"), truth).collect()}
    assert got == {("a", "1"): ("FN", "this"), ("a", "2"): ("ok", "this"), ("b", "1"): ("FP", "another"), ("b", "3"): ("FP", "nobody"), ("b", "4"): ("FP", "nobody")}
    assert [r.b for r in pairs.orderBy("p").select(evaluation.buckets(F.col("p"), [0.0, 0.5, 1.0]).alias("b")).collect()] == ["[0.0, 0.5]", "[0.0, 0.5]", "(0.5, 1.0]", "(0.5, 1.0]", None]
    sweep = spark.createDataFrame([(0.6, 0.7), (0.5, 0.7), (0.4, 0.2)], "threshold double, macro_f05 double")
    assert evaluation.best_threshold(sweep).first().threshold == 0.5


def test_word_noise(spark):
    pairs = spark.createDataFrame([("a", "1", "kelly cleaning ltd", "moeller cleaning"), ("a", "2", "fox foods", "foxx foods"), ("a", "3", "", "x")], "s1_id string, cand_id string, name_s string, name_c string")
    freq = spark.createDataFrame([("kelly", 9), ("moeller", 4)], "word string, n long")
    r = {x.cand_id: x for x in stage2.word_noise(pairs, freq).collect()}
    assert (r["1"].s1_unmatched, r["1"].rec_unmatched) == (1, 1) and r["1"].s1_unmatched_freq == pytest.approx(2.302585) and r["2"].s1_unmatched == 0 and r["2"].min_word_ratio == pytest.approx(6 / 7)
    assert r["3"].s1_unmatched is None and r["3"].min_word_ratio is None
    assert stage2.feature_columns(pairs.withColumn("r_rank", F.lit(1)))[-1] == "r_rank"


def test_feature_names():
    assert [len(features.feature_names(*x)) for x in ((True,), (False,), (False, True), (False, True, True), (True, True))] == [34, 32, 42, 46, 44]
    assert learn.second_stage(learn.EXPERIMENTS["noise"]).rounds == 300 and learn.EXPERIMENTS["wide"].top_k == 100


def test_parts_and_texts(spark, tmp_path):
    df = spark.createDataFrame([("1", "US"), ("2", "India")], "id string, country string")
    path, lines = f"{tmp_path}/parts", []
    assert sinks.resume(spark, ["US"], lambda v: df.where(F.col("country") == v), path, log=lines.append) == ["US"] and len(lines) == 1
    assert sinks.resume(spark, ["India", "US"], lambda v: df.where(F.col("country") == v), path) == ["India"]
    assert tables.read_parts(spark, path, "country", ["US", "India"]).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_parts(spark, path, "country", ["US", "France"])
    made = []
    for _ in range(2):
        assert cached(spark, lambda: made.append(1) or df, f"{tmp_path}/kept", "tag").count() == 2
    assert len(made) == 1
    sinks.write_empty(spark, "id string, n long", f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").columns == ["id", "n"]
    text = tmp_path / "t.tsv"
    text.write_bytes(b"a,b\tx\t\nc\ty\tz\r\n,\t\t\r\n")
    r = tables.raw_counts(spark, str(text)).first()
    assert (r.lines, r.commas, r.carriage_returns, r.open_ends) == (3, 2, 2, 2)
    sinks.package({"t.tsv": str(text)}, f"{tmp_path}/all.zip")
    with pytest.raises(FileNotFoundError):
        sinks.package({"u": f"{tmp_path}/u"}, f"{tmp_path}/all.zip")
