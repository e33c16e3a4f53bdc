"""Pairing records of two tables by nearest time within a tolerance.

Both tables are united and sorted per entity and time; the last right record that began and the next
one to begin are carried onto each left row, and the nearer within the tolerance is kept. An entity
may hold any share of the rows, so its axis is cut into buckets and each right interval stands in the
buckets that it or its tolerance touches. Intervals that are long against the bucket go to a level
with longer buckets, and left rows visit only the levels that their entity has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bucket length of the lowest level in milliseconds, and how much longer each further level's is.
BUCKET_MS = 64_000
STEP = 16
LEVELS = 11
SALTS = 8


def nearest(
    left: DataFrame, right: DataFrame, entity: str, left_key: Sequence[str], at_ms: Column,
    right_key: str, start_ms: Column, end_ms: Column, tolerance_ms: int,
) -> DataFrame:
    """``entity, *left_key, right_key, gap_ms``: each left record with the nearest right interval.

    The gap is 0 inside the interval, else the time to its nearer end; pairs further apart than
    ``tolerance_ms`` are no pairs, and left records without one give no row. Times are whole
    milliseconds. Rows lacking their entity, key or a time take no part, nor do intervals that end
    before they start. Repeated rows change nothing. Of several right records around the instant the
    one that ends last counts; of those, and of others at the same gap, the one with the lowest key.
    Other columns of the inputs do not matter.
    """
    names = [f"k{i}" for i in range(len(left_key))]
    points = left.select(F.col(entity).alias("entity"), *[F.col(k).alias(n) for k, n in zip(left_key, names, strict=True)], at_ms.cast("long").alias("t"))
    points = points.dropna()
    spans = right.select(F.col(entity).alias("entity"), F.col(right_key).alias("r"), start_ms.cast("long").alias("s"), end_ms.cast("long").alias("e")).dropna().filter("s <= e")

    # a level's bucket is at least as long as its intervals with their tolerance, so each stands in two buckets at most
    length = F.col("e") - F.col("s") + 2 * tolerance_ms
    level = F.lit(LEVELS)
    for n in reversed(range(LEVELS)):
        level = F.when(length <= BUCKET_MS * STEP**n, n).otherwise(level)
    size = F.element_at(F.array(*[F.lit(BUCKET_MS * STEP**n) for n in range(LEVELS + 1)]), F.col("level") + 1)
    leveled = spans.withColumn("level", level).withColumn("size", size)
    first, last = F.floor((F.col("s") - tolerance_ms) / F.col("size")), F.floor((F.col("e") + tolerance_ms) / F.col("size"))
    placed = leveled.select("entity", "level", "r", "s", "e", F.explode(F.sequence(first, last)).alias("bucket"))

    there = leveled.select("entity", "level").distinct()
    # an entity may hold a third of all left records: its few levels are repeated over salts of the key
    salted = points.withColumn("salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int"))
    spread = there.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    visits = salted.join(spread, ["entity", "salt"]).withColumn("size", size).withColumn("bucket", F.floor(F.col("t") / F.col("size")))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(points.dtypes)
    both = placed.select("entity", "level", "bucket", F.col("s").alias("time"), F.lit(0).alias("side"), "e", "r", *[none(kinds[n]).alias(n) for n in names]).unionByName(
        visits.select("entity", "level", "bucket", F.col("t").alias("time"), F.lit(1).alias("side"), none("bigint").alias("e"), none(dict(spans.dtypes)["r"]).alias("r"), *names)
    )

    # The record that reaches furthest among those begun covers the point or ends nearest to it;
    # of equals the lowest key. Backwards, the next to begin is the last one seen.
    by = W.partitionBy("entity", "level", "bucket")
    begun = by.orderBy("time", "side").rowsBetween(W.unboundedPreceding, 0)
    ahead = by.orderBy(F.desc("time"), F.desc("side"), F.desc("r")).rowsBetween(W.unboundedPreceding, 0)
    mine = F.col("side") == 0
    carried = both.select(
        "*",
        F.max(F.when(mine, F.struct("e", (-F.col("r")).alias("minus_r")))).over(begun).alias("before"),
        F.last(F.when(mine, F.struct(F.col("time").alias("s"), "r")), ignorenulls=True).over(ahead).alias("after"),
    ).filter("side = 1")
    gap_before = F.greatest(F.lit(0), F.col("time") - F.col("before.e"))
    options = F.array_compact(F.array(
        F.when(F.col("before").isNotNull(), F.struct(gap_before.cast("long").alias("gap_ms"), F.when(gap_before == 0, -F.col("before.e")).otherwise(0).alias("ends"), (-F.col("before.minus_r")).alias("r"))),
        F.when(F.col("after").isNotNull(), F.struct((F.col("after.s") - F.col("time")).cast("long").alias("gap_ms"), F.lit(0).cast("long").alias("ends"), F.col("after.r").alias("r"))),
    ))
    chosen = carried.select("entity", *names, F.array_min(options).alias("best")).filter(F.col("best.gap_ms") <= tolerance_ms)
    won = chosen.groupBy("entity", *names).agg(F.min("best").alias("best"))
    return won.select(F.col("entity").alias(entity), *[F.col(n).alias(k) for n, k in zip(names, left_key, strict=True)], F.col("best.r").alias(right_key), F.col("best.gap_ms").alias("gap_ms"))
