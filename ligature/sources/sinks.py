"""Sinks: id lists as tab-separated text, Parquet in partitions, append logs, a validator of what was written."""

from __future__ import annotations

import os
import time
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_id_lists(df: DataFrame, path: str, columns: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> None:
    """A two-column list with header and line feeds; the lists of all partitions end in one folder."""
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").option("emptyValue", "").option("lineSep", "\n").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str = "country", rows_per_file: int = 5_000_000) -> None:
    """Parquet, one folder per value; a re-run replaces only the folders it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def finished_partitions(spark: SparkSession, path: str, by: str = "country") -> list[str]:
    """Values whose folder is there, for a run that goes on where it stopped; few by construction."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{by}="))


def append_log(spark: SparkSession, path: str, row: dict[str, str]) -> None:
    spark.createDataFrame([row]).coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def write_candidate_lists(pairs: DataFrame, path: str) -> None:
    """Every entity's candidates as a comma list in order of rank, tab-separated, without gathering them anywhere."""
    write_id_lists(candidate_lists(pairs), path, ("source1_entity_id", "candidate_entity_ids"))


def candidate_lists(pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids), best first; the list of an entity is bounded by the top K of the blocking."""
    ranked = pairs.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.sort_array(F.collect_list(F.struct("block_rank", "cand_id"))).alias("x"))
    return ranked.select("source1_entity_id", F.array_join(F.transform("x", lambda r: r["cand_id"]), ",").alias("candidate_entity_ids"))


def write_empty(spark: SparkSession, schema, path: str) -> None:
    """A table without rows that keeps its columns."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Written beside its place and moved there when whole, so that readers never see half a table."""
    sc = df.sparkSession.sparkContext
    fs_path = sc._jvm.org.apache.hadoop.fs.Path
    target, draft = fs_path(path), fs_path(f"{path}.{uuid.uuid4().hex}.draft")
    df.write.parquet(draft.toString())
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(draft, target):
        raise OSError(f"{draft} could not be moved to {path}")


def resume(spark: SparkSession, values: list[str], make: Callable[[str], DataFrame], path: str, by: str = "country", log: Callable[[str], None] = lambda line: None) -> list[str]:
    """Makes and publishes the parts that aren't there yet, one folder per value; gives those it made."""
    done, made, began = set(finished_partitions(spark, path, by)), [], time.time()
    todo = [v for v in values if v not in done]
    for v in todo:
        publish(make(v).drop(by), f"{path}/{by}={v}")
        made.append(v)
        spent = time.time() - began
        log(f"{len(made)} of {len(todo)} parts, {spent:.0f} s, about {spent / len(made) * (len(todo) - len(made)):.0f} s left")
    return made


def package(files: dict[str, str], path: str) -> None:
    """A zip of finished small files under their names in it; raises if one is missing."""
    missing = [f for f in files.values() if not os.path.isfile(f)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, f in files.items():
            z.write(f, name)


def assemble(reference: DataFrame, lists: DataFrame, key: str = "source1_entity_id", column: str = "matched_entity_ids") -> DataFrame:
    """Every reference record with its list, "" if it has none."""
    return reference.select(F.col("entity_id").alias(key)).join(lists, key, "left").withColumn(column, F.coalesce(column, F.lit("")))


def validate(output: DataFrame, reference: DataFrame, key: str = "source1_entity_id", column: str = "matched_entity_ids") -> DataFrame:
    """One row of counts: rows, ids, empty lists, missing and unknown reference records, pool ids with two owners, carriage returns."""
    ids = output.select(key, F.explode(F.filter(F.split(column, ","), lambda x: x != "")).alias("id"))
    double = ids.groupBy("id").agg(F.countDistinct(key).alias("owners")).agg(F.sum(F.when(F.col("owners") > 1, 1).otherwise(0)).alias("double_owned"), F.count("*").alias("distinct_ids"))
    rows = output.agg(F.count("*").alias("n_rows"), F.sum((F.col(column) == "").cast("int")).alias("empty_lists"), F.sum((F.instr(column, "\r") > 0).cast("int")).alias("carriage_returns"))
    missing = reference.select(F.col("entity_id").alias(key)).join(output, key, "left_anti").agg(F.count("*").alias("missing"))
    unknown = output.join(reference.select(F.col("entity_id").alias(key)), key, "left_anti").agg(F.count("*").alias("unknown"))
    one = F.lit(1).alias("one")
    out = rows.select("*", one)
    for part in (double, missing, unknown):  # single rows
        out = out.join(part.select("*", one), "one")
    return out.drop("one").select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in out.columns if c != "one"])
