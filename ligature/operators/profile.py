"""Questions that a profile of record tables answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ligature.functions.text import tokens


def file_profile(df: DataFrame) -> DataFrame:
    """One row: rows, distinct ids, rows of repeated ids, empty names and addresses, distinct names, mean lengths."""
    blank = lambda c: F.sum((F.coalesce(F.col(c), F.lit("")) == "").cast("int"))
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("ids"), (F.count("*") - F.countDistinct("entity_id")).alias("repeated"),
        blank("business_name").alias("empty_names"), blank("business_address").alias("empty_addresses"), F.countDistinct("business_name").alias("names"),
        F.round(F.avg(F.length("business_name")), 6).alias("name_length"), F.round(F.avg(F.length("business_address")), 6).alias("address_length"),
    )


def share_true(df: DataFrame, predicate: Column, by: list[str]) -> DataFrame:
    """Percentage of rows for which the predicate holds, per group and over all (group columns null)."""
    return df.withColumn("hit", predicate.cast("int")).rollup(*by).agg(F.count("*").alias("n"), F.round(100 * F.avg("hit"), 6).alias("percent"))


def top_words(df: DataFrame, text: str, by: str, n: int, position: str = "any") -> DataFrame:
    """The ``n`` most frequent words per group: any, first or last words; ties in string order."""
    from pyspark.sql import Window

    words = tokens(F.col(text))
    picked = {"any": F.explode(words), "first": F.explode(F.slice(words, 1, 1)), "last": F.explode(F.when(F.size(words) > 0, F.slice(words, -1, 1)).otherwise(words))}[position]
    counted = df.select(by, picked.alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def match_counts(matches: DataFrame) -> DataFrame:
    """(n_matches, n_s2, n_s3, entities): how many entities have so many matches, none included."""
    from ligature.sources.tables import id_list

    ids = id_list("matched_entity_ids")
    per = matches.select(F.size(ids).alias("n_matches"), F.size(F.filter(ids, lambda x: x.startswith("S2"))).alias("n_s2"), F.size(F.filter(ids, lambda x: x.startswith("S3"))).alias("n_s3"))
    return per.groupBy("n_matches", "n_s2", "n_s3").agg(F.count("*").alias("entities"))
