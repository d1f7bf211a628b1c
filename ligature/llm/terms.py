"""Problem 2: frequency of every distinct term (or n-gram of terms).

Method: suffix-sorted n-gram counting. Every position of a record emits the suffix that starts there, cut
to ``max_len`` terms. Suffixes are routed by their first term, so all n-grams that start with a term meet in
one partition, and sorted in reverse lexicographic order. Then every n-gram is a prefix of a run of
neighbouring rows: one pass with a stack of at most ``max_len`` levels adds up counts and record sets and
emits an n-gram as soon as the sort order leaves it.

A first term that holds more than ``hot`` suffixes is split, by the record, into buckets of about ``hot``
suffixes; a record's suffixes stay together, so the partial results of the buckets have disjoint record sets
and are added up. No task therefore holds a record set larger than a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ligature.workspace import spread

TERM = r"[\p{L}\p{M}\p{N}]+"
SCHEMA = "field string, terms array<string>, occurrences long, records long"


def tokens(text: Column) -> Column:
    """Maximal runs of letters, marks and digits of the lower-cased text; null and "" have none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0), F.array().cast("array<string>"))


def _stack(max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        field, path, counts, sets = None, [], [], []

        def close(depth: int) -> None:
            while len(path) > depth:
                n, records = counts.pop(), sets.pop()
                out.append((field, list(path), n, len(records)))
                path.pop()
                if path:  # what a longer n-gram counted, its prefix counts as well
                    counts[-1] += n
                    sets[-1] |= records

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["field", "terms", "occurrences", "records"])

        for b in batches:
            for f, suffix, record in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                same = 0
                if f == field:
                    while same < len(path) and same < len(suffix) and path[same] == suffix[same]:
                        same += 1
                close(same)
                field = f
                for t in suffix[same:]:
                    path.append(t)
                    counts.append(0)
                    sets.append(set())
                counts[-1] += 1
                sets[-1].add(record)
            if len(out) >= 20_000:
                yield flush()
        close(0)
        if out:
            yield flush()

    return run


def ngram_frequencies(df: DataFrame, key: str, fields: list[str], max_len: int = 1, hot: int = 200_000) -> DataFrame:
    """Every n-gram of up to ``max_len`` terms, each field for itself: (field, terms, occurrences, records).

    A record is a key; of a key delivered several times one row counts (the smallest in string order). Rows with
    a null key are no records. Null and empty values have no terms. Equal terms of one record count each time in
    ``occurrences`` and once in ``records``. Other columns are not read, whatever they are called.
    """
    if max_len < 1:
        raise ValueError("max_len must be at least 1")
    rows = df.select(F.col(key).cast("string").alias("id"), *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)]).where("id is not null")
    rows = rows.groupBy("id").agg(F.min(F.struct(*[f"v{i}" for i in range(len(fields))])).alias("v"))
    values = rows.select(F.xxhash64("id").alias("record"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f"v.v{i}")).alias("w")) for i, f in enumerate(fields)])).alias("x"))
    suffixes = values.where(F.size("x.w") > 0).select(
        "record", F.col("x.field").alias("field"),
        F.explode(F.expr(f"transform(sequence(1, size(x.w)), i -> slice(x.w, i, {max_len}))")).alias("suffix"),
    ).withColumn("head", F.col("suffix")[0])
    heads = suffixes.groupBy("field", "head").agg(F.count("*").alias("m")).where(F.col("m") > hot)
    heads = heads.select("field", "head", F.ceil(F.col("m") / hot).alias("split"))
    routed = suffixes.join(heads, ["field", "head"], "left")
    bucket = F.coalesce(F.pmod(F.col("record"), F.col("split")), F.lit(0)).alias("bucket")
    ordered = routed.select("field", "suffix", "record", "head", bucket).repartition(spread(df.sparkSession), "field", "head", "bucket").sortWithinPartitions("field", "bucket", F.col("suffix").desc())
    counted = ordered.select("field", "suffix", "record").mapInArrow(_stack(max_len), SCHEMA)
    return counted.groupBy("field", "terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, key: str, fields: list[str], rare_at_most: int = 2, common_share: float = 0.02, **options) -> DataFrame:
    """Terms with their counts and mark: (field, term, occurrences, records, mark), mark null if neither.

    ``rare``: at most ``rare_at_most`` occurrences in all records. ``common``: held by more than
    ``common_share`` of all records. In tables so small that a term is both it is rare.
    """
    total = df.agg(F.countDistinct(F.col(key).cast("string"))).first()[0]
    mark = F.when(F.col("occurrences") <= rare_at_most, "rare").when(F.col("records") > total * common_share, "common")
    counted = ngram_frequencies(df, key, fields, 1, **options)
    return counted.select("field", F.col("terms")[0].alias("term"), "occurrences", "records", mark.alias("mark"))
