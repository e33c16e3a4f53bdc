"""Overlapping and gapped intervals: continuous periods and the gaps between them.

The aggregate is a sorted list of disjoint intervals. ``merge_lists`` is its linear merge. Partial lists
are made per Arrow batch on the map side, joined per salted key, then merged per key in a tree. The axis of an
entity is cut into buckets, so the state of a key is bounded by the bucket's length, whatever
number of rows it holds, and only the furthest end travels from bucket to bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Length of a bucket in milliseconds.
BUCKET_MS = 600_000
#: Salts of the first level of the reduction tree.
SALTS = 8
#: Rows of partial lists a task holds before it hands them on.
HELD = 200_000


def disjoint(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals within each group, as sorted disjoint intervals; touching ones join."""
    if not len(start):
        return group, start, end
    order = np.lexsort((end, start, group))
    group, start, end = group[order], start[order], end[order]
    low, high = int(start.min()), int(end.max())
    width = high - low + 2
    # the running maximum restarts with each group: groups lie one after another on one axis
    shift = group.astype(object) * width if int(group[-1] + 1) > (2**62) // width else group * width
    reach = np.maximum.accumulate(end - low + shift)
    opens = np.ones(len(start), bool)
    opens[1:] = (start[1:] - low + shift[1:] > reach[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start)) - 1
    ends = (reach - shift + low)[last].astype(np.int64)
    return group[first], start[first], ends


Lists = tuple[np.ndarray, np.ndarray]


def merge_lists(a: Lists, b: Lists) -> Lists:
    """Linear merge of two sorted disjoint lists (starts, ends) into one; touching intervals join."""
    if not len(a[0]) or not len(b[0]):
        return b if len(b[0]) else a
    start, end = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(start, kind="stable")  # two sorted runs: a stable sort of them is one merging pass
    start, reach = start[order], np.maximum.accumulate(end[order])
    opens = np.append(True, start[1:] > reach[:-1])
    return start[opens], reach[np.append(np.flatnonzero(opens)[1:], len(start)) - 1]


class Tree:
    """Lists of one key merged as they come, two of like size at a time, so that each is merged log times."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Lists]] = []

    def add(self, item: Lists) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            item = merge_lists(self.held.pop()[1], item)
            level += 1
        self.held.append((level, item))

    def root(self) -> Lists:
        out = self.held[-1][1]
        for _, item in reversed(self.held[:-1]):
            out = merge_lists(item, out)
        return out


def _lists(keys: Sequence[str], nested: bool) -> object:
    """A mapInArrow function: rows with a start and an end (or lists of them) to merged lists by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            keyed = t.select(list(keys))
            if nested:
                starts, ends = t["starts"].combine_chunks(), t["ends"].combine_chunks()
                parent = np.repeat(np.arange(len(t)), np.diff(starts.offsets.to_numpy()))
                s, e = starts.flatten().to_numpy(), ends.flatten().to_numpy()
            else:
                parent = np.arange(len(t))
                s, e = t["start_ms"].to_numpy(), t["end_ms"].to_numpy()
            frame = keyed.to_pandas(types_mapper=None)
            code = frame.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
            g, s, e = disjoint(code[parent].astype(np.int64), s.astype(np.int64), e.astype(np.int64))
            there, first = np.unique(g, return_index=True)
            offsets = pa.array(np.append(first, len(g)).astype(np.int32))
            origin = np.unique(code, return_index=True)[1][there] if len(there) else np.array([], np.int64)
            taken = keyed.take(pa.array(origin))
            columns = [taken[k].combine_chunks() for k in keys]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (s, e)]
            return pa.RecordBatch.from_arrays([*columns, *lists], names=[*keys, "starts", "ends"])

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
            if rows >= HELD:
                out = flush()
                yield out
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def covered_lists(df: DataFrame, keys: Sequence[str], start: Column, end: Column, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``keys, bucket, starts, ends``: per entity and bucket the merged list of the intervals that start in it.

    ``start`` and ``end`` are whole milliseconds. Rows lacking either, or whose end is not after the
    start, do not count; repeated rows change nothing; a null key is a key like others.
    """
    named = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))
    rows = rows.filter(F.col("end_ms") > F.col("start_ms")).withColumn("bucket", F.floor(F.col("start_ms") / bucket_ms).cast("long"))
    by = [*named, "bucket"]
    kinds = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in by] + ["starts array<bigint>", "ends array<bigint>"])
    partial = rows.mapInArrow(_lists(by, nested=False), kinds)
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    first = partial.withColumn("salt", salt).repartition(*by, "salt").drop("salt").mapInArrow(_lists(by, nested=True), kinds)
    # _lists may hand on one key twice where it flushed; a window-free second level merges those too
    whole = first.repartition(*by).sortWithinPartitions(*by).mapInArrow(_ordered(by), kinds)
    return whole.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], "bucket", "starts", "ends")


def _ordered(keys: Sequence[str]) -> object:
    """The last level: lists come ordered by key and are merged in a tree; each key leaves once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, done = None, Tree(), []

        def emit() -> pa.RecordBatch:
            cols = [pa.array([d[0][i] for d in done], kinds[i]) for i in range(len(keys))]
            lists = [pa.array([d[1][j] for d in done], pa.list_(pa.int64())) for j in (0, 1)]
            return pa.RecordBatch.from_arrays([*cols, *lists], names=[*keys, "starts", "ends"])

        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            columns = [batch.column(k).to_pylist() for k in keys]
            starts, ends = batch.column("starts"), batch.column("ends")
            so, sv, ev = starts.offsets.to_numpy(), starts.values.to_numpy(), ends.values.to_numpy()
            eo = ends.offsets.to_numpy()
            for i, k in enumerate(zip(*columns, strict=True)):
                if k != key:
                    if key is not None:
                        done.append((key, tree.root()))
                    key, tree = k, Tree()
                tree.add((sv[so[i] : so[i + 1]], ev[eo[i] : eo[i + 1]]))
            if len(done) > 5000:
                yield emit()
                done = []
        if key is not None:
            done.append((key, tree.root()))
            yield emit()

    return run


def with_reach(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``reach``: the furthest end of all earlier buckets of the entity (null in the first)."""
    furthest = lists.select(*keys, "bucket", F.element_at("ends", -1).alias("_far"))
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # one row per bucket: the window carries summaries, never the intervals
    reach = furthest.withColumn("reach", F.max("_far").over(before)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_b"), "reach")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("bucket") == F.col("_b")]
    return lists.join(reach, on, "left").drop("_b", *[f"_{k}" for k in keys])


def _gap_array() -> Column:
    """Gaps before each interval of a bucket's list, given the reach of earlier buckets."""
    ends_before = F.concat(F.array(F.col("reach")), F.slice("ends", 1, F.size("ends") - 1))
    pairs = F.arrays_zip(F.transform(ends_before, lambda x: F.greatest(x, F.col("reach"))).alias("gap_start_ms"), F.col("starts").alias("gap_end_ms"))
    return F.filter(pairs, lambda x: x["gap_start_ms"] < x["gap_end_ms"])


def gaps(df: DataFrame, keys: Sequence[str], start: Column, end: Column, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``keys, gap_start_ms, gap_end_ms``: every uncovered gap between two periods of an entity.

    Empty input, or entities with one period, give no row. Other columns of ``df`` do not matter.
    """
    lists = with_reach(covered_lists(df, keys, start, end, bucket_ms), keys)
    return lists.select(*keys, F.explode(_gap_array()).alias("g")).select(*keys, "g.gap_start_ms", "g.gap_end_ms")


def periods(df: DataFrame, keys: Sequence[str], start: Column, end: Column, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``keys, start_ms, end_ms``: the continuous periods of each entity; touching intervals join.

    A period ends where the next gap begins. Within a bucket that is the next mark of its list; between
    buckets one summary row per bucket travels, with the first gap in it and the furthest end.
    """
    lists = with_reach(covered_lists(df, keys, start, end, bucket_ms), keys)
    opened = F.transform(_gap_array(), lambda g: F.struct(g["gap_end_ms"].alias("s"), g["gap_start_ms"].alias("before")))
    first = F.when(F.col("reach").isNull(), F.array(F.struct(F.col("starts")[0].alias("s"), F.lit(None).cast("long").alias("before"))))
    # the first list of an entity has no reach, so the gaps inside it are taken against its own ends
    marks = lists.select(*keys, "bucket", F.concat(F.coalesce(first, F.array().cast("array<struct<s:bigint,before:bigint>>")), opened).alias("m"), F.greatest(F.element_at("ends", -1), F.col("reach")).alias("far"))
    after = W.partitionBy(*keys).orderBy("bucket").rowsBetween(1, W.unboundedFollowing)
    whole = W.partitionBy(*keys)
    summary = marks.select(*keys, "bucket", F.get("m.before", F.lit(0)).alias("_opens"), "far")
    ahead = summary.withColumn("_next", F.first("_opens", ignorenulls=True).over(after)).withColumn("_last", F.max("far").over(whole))
    ahead = ahead.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_b"), F.coalesce("_next", "_last").alias("_end"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("bucket") == F.col("_b")]
    ended = F.transform("m", lambda x, i: F.struct(x["s"].alias("start_ms"), F.coalesce(F.get("m", i + 1)["before"], F.col("_end")).alias("end_ms")))
    return marks.filter(F.size("m") > 0).join(ahead, on).select(*keys, F.explode(ended).alias("x")).select(*keys, "x.*")
