"""Matching of newly arriving records against a standing index of reference records.

The reference postings are static; each micro-batch of records is keyed, joined and ranked like a batch, and
written under its batch id, so that a batch run again after a failure replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ligature.functions.text import normalize
from ligature.operators.blocking import build_index, rank_candidates, shared_keys
from ligature.operators.keys import record_keys


def normalised(records: DataFrame) -> DataFrame:
    return records.select("entity_id", "country", normalize(F.coalesce("business_name", F.lit(""))).alias("name"), normalize(F.coalesce("business_address", F.lit(""))).alias("addr"))


def match_batch(batch: DataFrame, reference_keys: DataFrame, n_reference: int, max_df: int, top_k: int) -> DataFrame:
    """(record_id, s1_id, score, rank) of the records of one batch."""
    keys = record_keys(normalised(batch.dropDuplicates(["entity_id"])))
    best = rank_candidates(shared_keys(keys, build_index(keys, reference_keys, n_reference, max_df)), top_k)
    return best.select(F.col("s1_id").alias("record_id"), F.col("cand_id").alias("s1_id"), F.col("score_all").alias("score"), F.col("block_rank").alias("rank"))


def match_stream(stream: DataFrame, reference_keys: DataFrame, n_reference: int, out: str, checkpoint: str, max_df: int = 50, top_k: int = 10) -> StreamingQuery:
    """Starts a query that matches a stream of records and appends to Parquet, once per batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        match_batch(batch, reference_keys, n_reference, max_df, top_k).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    sink: Callable[[DataFrame, int], None] = write
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, time: str, late: str = "30 days", width: str = "1 day") -> DataFrame:
    """Records per day of recording and country, with a watermark for records that come late."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("day"), "country").agg(F.count("*").alias("n"))
