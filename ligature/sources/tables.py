"""Sources: record tables in Parquet or tab-separated text, known matches, and their long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
RECORD_SCHEMA = StructType([StructField(c, StringType()) for c in RECORD_COLUMNS])
MATCH_SCHEMA = StructType([StructField("source1_entity_id", StringType()), StructField("matched_entity_ids", StringType())])


def read_tsv(spark: SparkSession, path: str, schema: StructType = RECORD_SCHEMA) -> DataFrame:
    """Tab-separated text with a header. Quotes are ordinary characters; empty fields are "", never null."""
    df = spark.read.schema(schema).option("sep", "\t").option("quote", "\u0000").option("header", True).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) if isinstance(schema[c].dataType, StringType) else c for c in df.columns])


def source_path(folder: str, split: str, number: int, suffix: str = "parquet") -> str:
    return f"{folder}/{split}_source{number}.{suffix}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def delivered_once(df: DataFrame) -> DataFrame:
    """One row per entity_id of records that may have been delivered twice; missing texts are ""."""
    one = df.where("entity_id is not null").groupBy("entity_id").agg(F.min(F.struct(*RECORD_COLUMNS[1:])).alias("x"))
    return one.select("entity_id", *[F.coalesce(f"x.{c}", F.lit("")).alias(c) for c in RECORD_COLUMNS[1:]])


def reference_records(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    return delivered_once(table(spark, folder, f"{split}_source1"))


def pool_records(spark: SparkSession, folder: str, split: str = "train", where: Column | None = None) -> DataFrame:
    """Both pool tables; ``where`` is a condition on what copies of a record agree in, and reaches the scan."""
    both = table(spark, folder, f"{split}_source2").unionByName(table(spark, folder, f"{split}_source3"))
    return delivered_once(both if where is None else both.where(where))


def known_matches(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """(source1_entity_id, matched_entity_ids), one row per reference record, "" for none."""
    rows = table(spark, folder, f"{split}_matches").groupBy("source1_entity_id").agg(F.max(F.coalesce("matched_entity_ids", F.lit(""))).alias("matched_entity_ids"))
    return rows


def read_parts(spark: SparkSession, folder: str, by: str, expected: list[str]) -> DataFrame:
    """A table written in folders ``by``=value; raises if one of the expected parts isn't there."""
    from ligature.sources.sinks import finished_partitions

    missing = sorted(set(expected) - set(finished_partitions(spark, folder, by)))
    if missing:
        raise FileNotFoundError(f"{folder} has no part {by} = {', '.join(missing)}")
    return spark.read.parquet(folder).where(F.col(by).isin(*expected))


def raw_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, commas, carriage returns and lines whose last field is empty, from the bytes as they are."""
    lines = spark.read.option("lineSep", "\n").text(path)
    n = lambda x: F.sum(F.length("value") - F.length(F.replace(F.col("value"), F.lit(x), F.lit(""))))
    return lines.agg(F.count("*").alias("lines"), n(",").alias("commas"), n("\r").alias("carriage_returns"), F.sum(F.col("value").rlike("\t\r?$").cast("int")).alias("open_ends"))


def id_list(column: str):
    """A comma list as an array of distinct ids; null and "" are empty."""
    return F.array_distinct(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: x != ""))


def explode_matches(matches: DataFrame) -> DataFrame:
    """(source1_entity_id, match_id, match_source): one row per known pair."""
    long = matches.select("source1_entity_id", F.explode(id_list("matched_entity_ids")).alias("match_id"))
    return long.withColumn("match_source", F.substring("match_id", 1, 2))
