"""Bitmaps of documents for filters: what a search may return, tested in each leg without a join with documents.

Documents have numbers from 0. For each value of a filter's column there is a bitmap of the documents that have it, in buckets of 32,768 (Spark's
bitmap functions). A filter with several values is the union of theirs, and several filters are the intersection of those, bucket
by bucket. Only buckets with a document that may be returned are kept; they go to the legs as one small table, or are an error above a bound.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a bucket's bitmap.
BUCKET_BYTES = 4096


def numbered(documents: DataFrame, id_col: str = "document_id") -> DataFrame:
    """documents with number, from 0 without gaps in the order of their ids. The order is found by ranges: only how many rows each range has is added up in
    one task. Null ids come first, equal ids in any order."""
    from pyspark.sql import Window as W

    from .stage import keep

    ranged = keep(documents.select(F.col(id_col).alias("_id")).distinct().repartitionByRange("_id").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = ranged.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy("_id")) - 1).join(F.broadcast(before), "_part")
    numbers = at.select("_id", (F.col("_before") + F.col("_at")).alias("number"))
    return documents.join(numbers, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")


def build(values: DataFrame) -> DataFrame:
    """(field, value, bucket, bits) of values (field, value, number): one row for each value and bucket that has a document. Nulls take no part; repeats count
    once. Map-side aggregation: a bitmap is all that leaves a task."""
    own = values.where("field is not null and value is not null and number is not null")
    bucket, place = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    return own.groupBy("field", "value", bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def matching(bitmaps: DataFrame, filters: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(bucket, bits) of the documents that have, for each field, one of its values. Fields without values hold for all; with none at all, filters are an error."""
    asked = {f: v for f, v in filters.items() if v}
    if not asked:
        raise ValueError("there is no filter")
    any_ = None
    for field, options in asked.items():
        one = (F.col("field") == field) & F.col("value").isin(*options)
        any_ = one if any_ is None else any_ | one
    each = bitmaps.where(any_).groupBy("field", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = each.groupBy("bucket").agg(F.count("*").alias("fields"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where((F.col("fields") == len(asked)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def held(bits: Column, number: Column) -> Column:
    """Whether a bucket's bitmap has a document."""
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1


def kept(rows: DataFrame, allowed: DataFrame, most_bytes: int = 1 << 28) -> DataFrame:
    """rows (with number) of documents that allowed (bucket, bits) has. Bitmaps of up to most_bytes are sent to where rows are; more are joined by bucket."""
    few = allowed.count() * BUCKET_BYTES <= most_bytes
    other = allowed.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    met = rows.join(F.broadcast(other) if few else other, F.bitmap_bucket_number("number") == F.col("_bucket"))
    return met.where(held(F.col("_bits"), F.col("number"))).drop("_bucket", "_bits")
