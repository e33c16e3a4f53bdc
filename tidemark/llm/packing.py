"""Filling containers of fixed capacity with items of varying length.

Best fit, largest items first, in supersteps. Items are range-sorted by size over the cluster; a
superstep takes the items of one size, sweeps the gaps from the smallest that can hold them upwards,
hands each gap a run of consecutive ranks, and moves the gaps to their new sizes. Items of one size
are interchangeable, and so are containers with one gap, so the sweep works on runs of ranks and of
container numbers: its state is bounded by the capacity, not by the data, and the plan it makes is a
table that every task reads to place its own items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


@dataclass
class Plan:
    """Runs of ranks to runs of containers: rank ``r`` of ``size`` in a run goes to ``container + (r - first) // each``."""

    capacity: int
    containers: int = 0
    size: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)

    def note(self, size: int, first: int, each: int, container: int) -> None:
        self.size.append(size)
        self.first.append(first)
        self.each.append(each)
        self.container.append(container)


def best_fit(counts: Mapping[int, int], capacity: int) -> Plan:
    """The plan for ``counts`` items of each size from 1 to ``capacity``."""
    plan = Plan(capacity)
    order: list[int] = []  # the sizes of gaps there are, ascending
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to runs of container numbers

    def put(gap: int, start: int, stop: int) -> None:
        if gap and start < stop:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((start, stop))

    for size in sorted((s for s in counts if counts[s] > 0), reverse=True):
        left, rank = counts[size], 0
        moved: list[tuple[int, int, int]] = []
        at = bisect_left(order, size)
        while left:
            if at < len(order):
                gap = order[at]
                start, stop = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, start = capacity, plan.containers
                stop = start + -(-left // (capacity // size))
                plan.containers = stop
            each = gap // size
            full = min(stop - start, left // each)
            if full:
                plan.note(size, rank, each, start)
                moved.append((gap - each * size, start, start + full))
                rank, left, start = rank + full * each, left - full * each, start + full
            if left and start < stop:  # fewer are left than one more container takes
                plan.note(size, rank, left, start)
                moved.append((gap - left * size, start, start + 1))
                rank, left, start = rank + left, 0, start + 1
            moved.append((gap, start, stop))
        for gap, start, stop in moved:
            put(gap, start, stop)
    return plan


def pack(items: DataFrame, key: str, size: str, capacity: int, partitions: int | None = None) -> DataFrame:
    """``key, part, size, container``: every item placed, ``size`` being the length of the part.

    Only an item longer than ``capacity`` is split: into parts of the full capacity, which fill one
    container each, and a rest. A null or negative size counts as 0; items of size 0 need no room and
    are dealt out over the containers. Repeated keys are placed once each time they occur. Empty
    input gives no row. Runs three jobs: it writes the sizes, writes the sorted parts, counts them.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    length = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    sized = cut(items.select(F.col(key).alias("item"), length.alias("length")))
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / capacity) - 1, F.lit(0)))).alias("part")
    pieces = sized.select("item", parts, "length").select("item", "part", F.least(F.col("length") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("size"))
    wide = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.desc("size"), F.col("item"), F.col("part")]
    ranged = cut(pieces.repartitionByRange(wide, *sort).sortWithinPartitions(*sort))

    # ranges meet in one size at most, so this has as many rows as there are partitions and sizes
    seen = ranged.groupBy(F.spark_partition_id().alias("p"), "size").agg(F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    offsets: dict[tuple[int, int], int] = {}
    for row in sorted(seen, key=lambda r: (r["p"], -r["size"])):
        offsets[row["p"], row["size"]] = counts.get(row["size"], 0)
        counts[row["size"]] = counts.get(row["size"], 0) + row["n"]
    plan = best_fit({s: n for s, n in counts.items() if s}, capacity)
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    table = pd.DataFrame({"size": plan.size, "first": plan.first, "each": plan.each, "container": plan.container})
    for s, t in table.groupby("size"):
        by_size[int(s)] = (t["first"].to_numpy(), t["each"].to_numpy(), t["container"].to_numpy())
    shared = spark.sparkContext.broadcast((offsets, by_size, max(1, plan.containers)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offset, runs, containers = shared.value
        p = TaskContext.get().partitionId()
        done: dict[int, int] = {}
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            sizes = pdf["size"].to_numpy()
            for s in np.unique(sizes):
                s, where = int(s), np.flatnonzero(sizes == s)
                rank = offset[p, s] + done.get(s, 0) + np.arange(len(where))
                done[s] = done.get(s, 0) + len(where)
                if s == 0:
                    out[where] = rank % containers
                    continue
                first, each, container = runs[s]
                run = np.searchsorted(first, rank, side="right") - 1
                out[where] = container[run] + (rank - first[run]) // each[run]
            yield pdf.assign(container=out)

    kind = ranged.schema["item"].dataType.simpleString()
    placed = ranged.mapInPandas(place, f"item {kind}, part int, size int, container bigint")
    return placed.select(F.col("item").alias(key), "part", "size", "container")
