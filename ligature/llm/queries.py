"""The queries of the training-data problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ligature.llm import encoding, gazetteer, leaks, lookalike, matching, quality, terms, topn, variants
from ligature.workspace import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = gazetteer.same_place(_table(spark, sf_dir, "train_source1"), "entity_id", "business_address", "country")
    return pairs.select(F.col("key_a").alias("entity_id_a"), F.col("key_b").alias("entity_id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terms.marked_terms(_table(spark, sf_dir, "train_source1"), "entity_id", ["business_name", "business_address"])
    return found.where("mark is not null").select("field", "term", "mark")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "train_matches")
    owned = known.select(F.explode(F.split("matched_entity_ids", ",")).alias("entity_id")).where("entity_id <> ''").distinct()
    pool = _table(spark, sf_dir, "train_source2").unionByName(_table(spark, sf_dir, "train_source3")).join(owned, "entity_id", "left_anti")
    found = matching.match(_table(spark, sf_dir, "train_source1"), pool, "entity_id", "business_name", "business_address", "country")
    listed = known.select(F.col("source1_entity_id").alias("reference")).distinct()
    return found.join(listed, "reference", "left_anti").select(F.col("reference").alias("source1_entity_id"), F.col("pool").alias("matched_entity_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = variants.name_pairs(_table(spark, sf_dir, "train_source1"), "entity_id", "business_name", "country")
    return pairs.select(F.col("key_a").alias("entity_id_a"), F.col("key_b").alias("entity_id_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.lookalike_pairs(_table(spark, sf_dir, "train_source1"), "entity_id", "business_name")
    return pairs.select(F.col("key_a").alias("entity_id_a"), F.col("key_b").alias("entity_id_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(_table(spark, sf_dir, "candidate_pairs"), "s1_row", "pool_row", "score_all", 10).select("s1_row", "pool_row")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.no_prose(_table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
}

SQL: dict[str, str] = {
    "p2_found": r"""
        with r as (select entity_id, min(business_name) as business_name, min(business_address) as business_address from train_source1 group by entity_id),
        v as (select entity_id, 'business_name' as field, business_name as t from r union all select entity_id, 'business_address', business_address from r),
        w as (select entity_id, field, unnest(regexp_extract_all(lower(t), '[\p{L}\p{M}\p{N}]+')) as term from v),
        c as (select field, term, count(*) as n, count(distinct entity_id) as k from w group by field, term)
        select field, term, case when n <= 2 then 'rare' else 'common' end as mark from c
        where n <= 2 or k > 0.02 * (select count(*) from r)""",
    "p6_found": """
        with s as (select s1_row, pool_row, max(score_all) as score from candidate_pairs where score_all is not null and not isnan(score_all) group by s1_row, pool_row)
        select s1_row, pool_row from (select *, row_number() over (partition by s1_row order by score desc, pool_row) as k from s) where k <= 10""",
}
