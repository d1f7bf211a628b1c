"""What a job leaves in the driver and on disk while it runs."""

import gc
import os
import random
import re
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ligature.llm import gazetteer, matching, names
from ligature.operators import blocking, features, keys, reverse, stage2
from ligature.plans import linkage
from ligature.workspace import materialize, release


def _full_collections(spark) -> int:
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_driver_lets_go_after_each_table(spark):
    before = _full_collections(spark)
    assert materialize(spark.range(3), "three").count() == 3
    assert _full_collections(spark) > before


def test_driver_gives_freed_memory_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    if not Path(f"/proc/{pid}/status").exists():
        pytest.skip("memory can't be read here")

    def resident() -> float:
        return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024

    # memory outside the heap, freed but for a piece here and there that keeps the C library from shrinking
    text = os.urandom(20_000)
    made = []
    for _ in range(600):
        made.append(jvm.java.util.zip.Deflater())
        made[-1].setInput(text)
        made[-1].finish()
        made[-1].deflate(bytearray(100))
    for k, x in enumerate(made):
        if k % 60 != 59:
            x.end()
    jvm.System.gc()
    before = resident()
    release(spark)
    assert resident() < before - 30


def test_driver_shrinks_its_heap(spark):
    jvm = spark.sparkContext._jvm
    bean = jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
    held = [jvm.java.nio.ByteBuffer.allocate(1_000_000) for _ in range(200)]
    del held
    time.sleep(3)  # objects are let go by a thread
    for _ in range(2):
        release(spark)
    heap = bean.getHeapMemoryUsage()
    assert heap.getCommitted() < 2.2 * heap.getUsed() + 20_000_000


def test_driver_lets_go_of_what_cycles_hold(spark):
    jvm = spark.sparkContext._jvm
    gc.disable()
    try:
        holder = SimpleNamespace(text=jvm.java.lang.StringBuilder("held by a cycle"))
        holder.self = holder
        seen = jvm.java.lang.ref.WeakReference(holder.text)
        del holder
        for _ in range(10):
            release(spark)
            if gone := seen.get() is None:
                break
            time.sleep(0.5)
    finally:
        gc.enable()
    assert gone


def test_er_train_fits_the_first_stage_once(spark, sf_dir, monkeypatch):
    calls = []

    def train(t, matches, e):
        calls.append(e.name)
        return linkage.Model(e, None, [], 0.4, "second", [], 0.7)

    pairs = spark.createDataFrame([], "s1_id string, cand_id string, rule_score double")
    monkeypatch.setattr(linkage, "pair_tables", lambda *a: SimpleNamespace(pairs=pairs))
    monkeypatch.setattr(linkage, "train", train)
    monkeypatch.setattr(linkage, "predict", lambda t, model, ids: pairs.select("s1_id", "cand_id", F.lit(float(model.second is None)).alias("probability")))
    rows = {r.stage: r.threshold for r in linkage.er_train(spark, sf_dir).collect()}
    assert rows == {"first_stage": 0.7, "both_stages": 0.4, "rule": 0.6}
    assert len(calls) == 1


def test_keys_and_texts_are_not_broadcast(spark):
    rows = [(str(i), "US", f"fox {i} foods", f"{i} high street", 0) for i in range(40)]
    a = materialize(spark.createDataFrame(rows, "entity_id string, country string, name string, addr string, name_foreign int"), "few")
    k = materialize(keys.record_keys(a, hashed=True), "few-keys")
    found = blocking.candidates(k, k, 40, 5, 3)
    vector = features.pair_vector(materialize(found, "few-candidates"), a, a, reverse.reverse_table(k, k, 40, 5))
    vector = vector.withColumn("p1", F.lit(0.95))
    # keys above max_df alone go to all tasks
    common = "BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint, true])"
    for df in (found, vector, stage2.cross_features(materialize(vector, "few-vectors"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastExchange") == plan.count(common)
    assert {(r.s1_id, r.cand_id) for r in vector.collect()} >= {(str(i), str(i)) for i in range(40)}


def test_tfidf_shuffles_no_pairs(spark):
    texts = ["12 main street", "12 main st", "9 oak road", "", "  ", "zzz qqq", "main main street", "\u0928\u092e\u0938\u094d\u0924\u0947 road", "a"]
    pairs = spark.createDataFrame([(a, b) for a in [*texts, None] for b in texts], "a string, b string")
    corpus = spark.createDataFrame([(t,) for t in texts[:4] + ["12 main road", "9 oak street"]], "text string")
    made = features.tfidf_cosine(pairs, "a", "b", corpus)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    joined = features.tfidf_cosine(pairs, "a", "b", corpus, most_grams=0)  # weights and pairs are joined
    x, y = [{(r.a, r.b): round(r.cosine, 9) for r in d.collect()} for d in (made, joined)]
    assert len(x) == len(texts) * (len(texts) + 1)
    known = {k for k in x if k[0] is not None}
    assert {k: x[k] for k in known} == {k: y[k] for k in known} and x[None, "a"] == 0
    assert 0.5 < x["12 main street", "12 main st"] < 1 and x["9 oak road", "9 oak road"] == 1


def test_sweep_in_slices_compares_every_pair(spark):
    def keys(side, n):
        return spark.range(n).select(F.concat(F.lit(side), F.col("id")).alias("entity_id"), F.explode(F.array(*[F.concat(F.lit(f"k{m}-"), F.col("id") % m) for m in (2, 5, 11, 23)])).alias("key"))

    a, b = keys("q", 60), keys("c", 90)
    truth = spark.range(60).select(F.concat(F.lit("q"), F.col("id")).alias("s1_id"), F.concat(F.lit("c"), F.col("id")).alias("cand_id"))
    dfs, ks = [4, 10, 20], [2, 5]
    parts = [blocking.shared_keys(a, blocking.build_index(a, b, 90, m)).select(F.lit(m).alias("max_df"), "s1_id", "cand_id", "score_all") for m in dfs]
    whole = blocking.sweep(parts[0].unionByName(parts[1]).unionByName(parts[2]), truth, dfs, ks)
    rows = lambda df: sorted(map(tuple, df.select("max_df", "top_k", "pairs", "entities", "found").collect()))
    expected = rows(whole)
    assert len(expected) == 6
    for most in (10**6, 100):
        assert rows(blocking.sweep_in_slices(a, b, 90, truth, dfs, ks, most)) == expected


def test_pairs_that_cannot_match_are_not_compared(spark, monkeypatch):
    schema = "entity_id string, n string, a string, country string"
    name = "Foxbrook Denham Foods"
    ref = spark.createDataFrame([("S1-1", name, "42 Wexley St, Dunmore", "US"), ("S1-2", name, "7 Wexley St, Dunmore", "US"), ("S1-3", "Tarrow Quill", None, "US")], schema)
    rows = [(f"S2-{i:02d}", name, f"{i} Wexley St, Dunmore", "US") for i in range(1, 31)] + [("S3-1", name, None, "US"), ("S3-2", "Foxbrok Denham", "42 Wexley Street, Dunmore, OH", "US"), ("S3-3", "Tarow Quill", "9 Elm St, Dunmore", "US")]
    pool = spark.createDataFrame(rows, schema)
    made, neighbours = [], matching.neighbours

    def counted(*a, **k):
        out = neighbours(*a, **k)
        made.append(out.count())
        return out

    monkeypatch.setattr(matching, "neighbours", counted)
    found = {(r.reference, r.pool) for r in matching.match(ref, pool, "entity_id", "n", "a", "country").collect()}
    best = {}
    for r in matching.scored_pairs(ref, pool, "entity_id", "n", "a", "country").collect():  # compares all of them
        best.setdefault(r.pool, []).append((-round(r.confidence, 9), r.reference))
    assert found == {(min(x)[1], pool) for pool, x in best.items() if -min(x)[0] >= 0.35}
    assert {("S1-2", "S2-07"), ("S1-1", "S3-2"), ("S1-3", "S3-3")} <= found
    assert made[0] < made[1] / 2  # other house numbers are left out of the pairs
    assert matching.most_at_other_doors(matching.WEIGHTS) < 0.35 < matching.most_at_other_doors((*matching.WEIGHTS[:8], 6.0, 0.0))


def test_other_doors_over_partitions(spark):
    rng = random.Random(5)
    door = lambda: rng.choice([None, *[(rng.randrange(-5, 5) << 32) + n for n in (1, 2, 3)]])
    rows = [(f"{rng.random():.9f}", i % 2, i, -1, door()) for i in range(3000)]
    order, wanted = sorted(rows, key=lambda x: x[0]), set()
    for i, a in enumerate(order):
        for b in order[i + 1 : i + 4]:
            if a[1] != b[1] and (not a[4] or not b[4] or (a[4] ^ b[4]) & (2**32 - 1) == 0):
                wanted.add((a[2], b[2]) if a[1] == 0 else (b[2], a[2]))
    df = spark.createDataFrame(rows, "key string, source int, row long, bits long, door long")
    got = [(r.reference, r.pool) for r in matching.neighbours(df, 3, part_rows=200, other_doors=False, total=len(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_sort_keys_are_counted_without_being_made(spark):
    schema = "row long, country string, source int, words array<string>, first string, line string, town string, street string, direction string, number string, type string, bits long"
    rows = [(0, "US", 0, ["books", "aeio", "waxks"], "j", "", "dunmore", "elm", "", "4", "street", 1), (1, "US", 1, ["fox", "den"], "", "", "", "", "", "", "", 3), (2, "US", 1, [], "", "", "dunmore", "elm", "", "4", "", 0), (3, "US", 0, ["fox"], "", "", "", "", "", "", "", 3)]
    r = spark.createDataFrame(rows, schema)
    keys = matching.sort_keys(r)
    got = sorted((k.row, k["head"] >> 56, k["key"]) for k in keys.collect())
    assert matching.key_count(r) == keys.count() == len(got) == 6 + 4 + 1 + 4
    assert [k for _, n, k in got if n == 5] == ["US| bx vxx|dunmore|elm|4|", "US|dn fx||||", "US|fx||||"]
    assert matching.key_count(r.where("false")) == 0
    doors = {k.row: k.door for k in keys.collect()}
    assert doors[0] == doors[2] and doors[0] and doors[1] is None


def test_spellings_are_shuffled_once(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))) for _ in range(250)} | {"abc5"})
    rows = [(s, w, rng.randrange(1, 4)) for s in ("x", "y") for w in words]
    df = materialize(spark.createDataFrame(rows, "scope string, word string, uses long"), "spellings")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")  # spellings of one key in several batches
    try:
        near = gazetteer.near_spellings(df, ["scope"], "word", "uses")
        got = [tuple(r) for r in near.collect()]
    finally:
        spark.conf.set(size, before)
    assert near._jdf.queryExecution().executedPlan().toString().count("Generate") <= 2  # the plan shows first and final form
    wanted = {(s, a, b) for s, a, m in rows for t, b, n in rows if s == t and a != b and (n > m or n == m and b < a) and min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 4 and "5" not in a + b and names.damerau(a, b) <= 1}
    assert len(got) == len(set(got)) and set(got) == wanted
