"""Candidate generation over an inverted index of rare keys.

The index side of the join is bounded by ``max_df`` postings per key. Keys above that are few and are dropped on both
sides by a broadcast before anything is shuffled by key; should there be more than ``MOST_COMMON`` of them, the join
drops them. Skewed query keys are left to adaptive skew joins. Keys and texts take many times more of the driver's memory
than of the files by whose size Spark would choose to broadcast them, so their joins are merge joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ligature.workspace import discard, materialize, scatter

#: Keys that are broadcast at most, some dozen bytes each.
MOST_COMMON = 200_000


def build_index(query_keys: DataFrame, pool_keys: DataFrame, n_pool: int, max_df: int) -> DataFrame:
    """Postings (key, entity_id, idf) of pool keys that occur among the queries and in at most ``max_df`` records.

    df counts distinct records; idf is ln(records of the whole pool / df).
    """
    asked = query_keys.select("key").distinct()
    # counts come first and are combined before they move; postings of keys that are too common never do
    df = materialize(pool_keys.groupBy("key").agg(F.count("*").alias("df")), "key-counts")
    common = df.where(F.col("df") > max_df).select("key")
    postings = pool_keys.select("key", "entity_id")
    if common.limit(MOST_COMMON + 1).count() <= MOST_COMMON:
        postings = postings.join(F.broadcast(common), "key", "left_anti")
        asked = asked.join(F.broadcast(common), "key", "left_anti")
    kept = df.where(F.col("df") <= max_df).join(asked.hint("merge"), "key", "left_semi")
    return postings.join(kept.select("key", F.log(F.lit(float(n_pool)) / F.col("df")).alias("idf")).hint("merge"), "key")


def shared_keys(query_keys: DataFrame, index: DataFrame) -> DataFrame:
    """(s1_id, cand_id, score_all, score_name, score_addr, shared): idf sums over shared keys, rounded to 9 digits."""
    q = query_keys.select("key", F.col("entity_id").alias("s1_id"), *(["is_name"] if "is_name" in query_keys.columns else [F.lit(1).alias("is_name")]))
    pairs = q.join(index.select("key", F.col("entity_id").alias("cand_id"), "idf").hint("merge"), "key")
    sums = pairs.groupBy("s1_id", "cand_id").agg(F.round(F.sum("idf"), 9).alias("score_all"), F.round(F.sum(F.when(F.col("is_name") == 1, F.col("idf")).otherwise(0.0)), 9).alias("score_name"), F.count("*").alias("shared"))
    return sums.withColumn("score_addr", F.round(F.col("score_all") - F.col("score_name"), 9))


def rank_candidates(scores: DataFrame, top_k: int, ranking: str = "all") -> DataFrame:
    """The ``top_k`` candidates of each query by total score, or half by name and half by address score.

    Ties go to the smaller candidate id.
    """
    def place(score: str):
        return F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "cand_id"))

    if ranking == "all":
        return scores.withColumn("block_rank", place("score_all")).where(F.col("block_rank") <= top_k)
    if ranking != "split":
        raise ValueError("ranking is all or split")
    half = top_k // 2
    return scores.withColumn("by_name", place("score_name")).withColumn("by_addr", place("score_addr")).where((F.col("by_name") <= half) | (F.col("by_addr") <= half)).drop("by_name", "by_addr")


def candidates(query_keys: DataFrame, pool_keys: DataFrame, n_pool: int, max_df: int, top_k: int, ranking: str = "all") -> DataFrame:
    return rank_candidates(shared_keys(query_keys, build_index(query_keys, pool_keys, n_pool, max_df)), top_k, ranking)


def key_reach(truth: DataFrame, query_keys: DataFrame, pool_keys: DataFrame) -> DataFrame:
    """(s1_id, cand_id, key_type, min_df): for each true pair and key type the smallest df of a shared key."""
    df = pool_keys.groupBy("key").agg(F.count("*").alias("df"))
    q, p = query_keys.select(F.col("entity_id").alias("s1_id"), "key"), pool_keys.select(F.col("entity_id").alias("cand_id"), "key")
    shared = truth.join(q, "s1_id").join(p, ["cand_id", "key"]).join(df, "key")
    return shared.groupBy("s1_id", "cand_id", F.split("key", r"\|")[1].alias("key_type")).agg(F.min("df").alias("min_df"))


def sweep(scores_by_df: DataFrame, truth: DataFrame, max_dfs: list[int], top_ks: list[int]) -> DataFrame:
    """Recall and mean candidates for designs (max_df, top_k).

    ``scores_by_df`` has (s1_id, cand_id, max_df, score_all), one block of rows for each max_df; it is ranked
    once and filtered for each top_k.
    """
    w = Window.partitionBy("max_df", "s1_id").orderBy(F.desc("score_all"), "cand_id")
    ranked = scores_by_df.where(F.col("max_df").isin(max_dfs)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(top_ks))
    designs = ranked.select("*", F.explode(F.array(*[F.lit(k) for k in top_ks])).alias("top_k")).where(F.col("place") <= F.col("top_k"))
    hit = designs.join(truth.select("s1_id", "cand_id", F.lit(1).alias("hit")), ["s1_id", "cand_id"], "left")
    return hit.groupBy("max_df", "top_k").agg(F.count("*").alias("pairs"), F.countDistinct("s1_id").alias("entities"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


#: Pairs of a shared key that a slice of ``sweep_in_slices`` holds at most; as rows of a shuffle they take about a GB.
SLICE_PAIRS = 30_000_000


def sweep_in_slices(query_keys: DataFrame, pool_keys: DataFrame, n_pool: int, truth: DataFrame, max_dfs: list[int], top_ks: list[int], slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """``sweep`` of the scores at each max_df, as ``shared_keys`` gives them, with one pass over the pairs for all of them.

    Pairs with a shared key are many times the input. Both lists of a key are written once, in the space of the
    keys themselves; queries then go through in slices by hash, and the shuffles of a slice are gone before the
    next one begins. All pairs are compared.
    """
    index = build_index(query_keys, pool_keys, n_pool, max(max_dfs))
    held = materialize(index.groupBy("key").agg(F.collect_list("entity_id").alias("cands"), F.first("idf").alias("idf"), F.count("*").alias("df")), "postings")
    asked = query_keys.join(held.select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list("entity_id").alias("asked"))
    lists = materialize(scatter(asked.join(held, "key").select("key", "asked", "cands", "idf", "df"), "key").drop("key"), "lists")
    discard(held)
    pairs = lists.agg(F.sum(F.size("asked").cast("long") * F.size("cands"))).first()[0] or 0
    slices = max(1, -(-pairs // slice_pairs))
    parts = []
    for k in range(slices):
        mine = F.filter("asked", lambda x: F.pmod(F.xxhash64(x), F.lit(slices)) == k) if slices > 1 else F.col("asked")
        met = lists.select("idf", "df", "cands", F.explode(mine).alias("s1_id")).select("s1_id", "idf", "df", F.explode("cands").alias("cand_id"))
        sums = met.groupBy("s1_id", "cand_id").agg(*[F.round(F.sum(F.when(F.col("df") <= m, F.col("idf"))), 9).alias(f"under_{m}") for m in max_dfs])
        each = F.array(*[F.struct(F.lit(m).alias("max_df"), F.col(f"under_{m}").alias("score_all")) for m in max_dfs])
        scored = sums.select("s1_id", "cand_id", F.explode(F.filter(each, lambda x: x["score_all"].isNotNull())).alias("x")).select("s1_id", "cand_id", "x.max_df", "x.score_all")
        parts.append(materialize(sweep(scored, truth, max_dfs, top_ks), "slice"))
    out = reduce(DataFrame.unionByName, parts)
    # no query is in two slices
    return out.groupBy("max_df", "top_k").agg(*[F.sum(c).alias(c) for c in ("pairs", "entities", "found")])


def reduction(reference: DataFrame, pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: pairs kept, pairs of equal country, and 1 less their quotient."""
    a = reference.groupBy("country").agg(F.count("*").alias("n_s1"))
    b = pool.groupBy("country").agg(F.count("*").alias("n_pool"))
    brute = a.join(b, "country").agg(F.sum(F.col("n_s1") * F.col("n_pool")).alias("brute_force"), F.lit(1).alias("one"))
    return pairs.agg(F.count("*").alias("pairs"), F.lit(1).alias("one")).join(brute, "one").select("pairs", "brute_force", F.round(1 - F.col("pairs") / F.col("brute_force"), 9).alias("reduction"))
