"""Carrying values along an ordered key whose rows may not fit one task.

Spark evaluates a window partition in one task. Where one entity may hold a third of all rows that
task becomes the job. These helpers split an entity's axis into buckets, run the window inside each
bucket, and pass only one summary row per bucket along the whole axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry_last(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Add ``name``: ``value`` of the previous row of the same ``keys``, across buckets.

    ``bucket`` must not decrease along ``order``. The first row of each entity gets null. Rows whose
    ``bucket`` is null form a bucket of their own before all others.
    """
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    boxed = F.struct(value.alias("v"))
    marked = df.withColumn("_boxed", boxed).withColumn("_before", F.lag("_boxed").over(inside))
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ends = (
        df.select(*keys, bucket, ranked.alias("_o"), boxed.alias("_boxed"))
        .groupBy(*keys, bucket)
        .agg(F.max_by("_boxed", "_o").alias("_end"))
        .withColumn("_carried", F.lag("_end").over(W.partitionBy(*keys).orderBy(bucket)))
        .select(*keys, bucket, "_carried")
    )
    joined = marked.join(ends, [*keys, bucket], "left")
    return joined.withColumn(name, F.coalesce("_before", "_carried")["v"]).drop("_boxed", "_before", "_carried")


def running_count(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], flag: Column, name: str
) -> DataFrame:
    """Add ``name``: how many rows up to and including this one have ``flag``, across buckets."""
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    one = F.when(flag, 1).otherwise(0).cast("long")
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = (
        df.groupBy(*keys, bucket)
        .agg(F.sum(one).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*keys, bucket, "_offset")
    )
    local = df.withColumn("_local", F.sum(one).over(inside))
    return local.join(sums, [*keys, bucket], "left").withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset")


def running_max(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Add ``name``: the greatest ``value`` of all earlier rows of the same ``keys``, across buckets."""
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    tops = df.groupBy(*keys, bucket).agg(F.max(value).alias("_top")).withColumn("_reach", F.max("_top").over(before)).select(*keys, bucket, "_reach")
    local = df.withColumn("_local", F.max(value).over(inside))
    return local.join(tops, [*keys, bucket], "left").withColumn(name, F.greatest("_local", "_reach")).drop("_local", "_reach")


def islands(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Add ``name``: the number of the run of equal neighbouring ``value`` that a row is in, from 1 per ``keys``.

    Null equals null. Nothing but one row per bucket is ordered over a whole entity.
    """
    linked = carry_last(df.withColumn("_value", value), keys, bucket, order, F.struct(F.col("_value").alias("v")), "_prior")
    opens = F.col("_prior").isNull() | ~F.col("_prior")["v"].eqNullSafe(F.col("_value"))
    return running_count(linked, keys, bucket, order, opens, name).drop("_value", "_prior")
