"""Voice activity: spans of speech from a detector, brought into shape and cut into batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.carry import running_count, running_max

#: Milliseconds: the longest span, the gap that merging bridges, the shortest span kept.
LONGEST, BRIDGE, SHORTEST = 600_000, 800, 250
#: Milliseconds of speech in a batch, of silence between spliced spans, of audio kept around a span.
BATCH, JOIN, PAD = 480_000, 200, 150
#: Milliseconds of a run's axis that one window task orders.
BUCKET = 3_600_000
#: Noise floor without a measurement, and its limits, in decibels.
FLOOR_DEFAULT, FLOOR_LOW, FLOOR_HIGH = -32.0, -55.0, -22.0


def merge_spans(spans: DataFrame, bridge: int = BRIDGE, shortest: int = SHORTEST) -> DataFrame:
    """``run_id, s, e``: spans clamped to 0 and ``duration``, merged over gaps up to ``bridge``, scraps dropped.

    ``spans`` has ``run_id, span_idx, s, e, duration`` in milliseconds; rows lacking a time or not
    ending after they start do not count. A null duration does not clamp. Equal starts go by index.
    """
    ok = spans.filter("run_id is not null and e > s")
    held = ok.select("run_id", "span_idx", F.col("s").alias("raw"), F.greatest(F.col("s"), F.lit(0)).alias("s"), F.least("e", "duration").alias("e"))
    held = held.withColumn("bucket", F.floor(F.col("raw") / BUCKET).cast("long"))
    order = [F.col("raw"), F.col("span_idx")]
    reach = running_max(held, ["run_id"], "bucket", order, F.col("e"), "reach")
    opens = F.col("reach").isNull() | (F.col("s") - F.col("reach") > bridge)
    numbered = running_count(reach, ["run_id"], "bucket", order, opens, "island")
    merged = numbered.groupBy("run_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.filter(F.col("e") - F.col("s") >= shortest).select("run_id", "s", "e")


def split_long(spans: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Spans longer than ``longest`` cut into pieces of that length and a rest."""
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil((F.col("e") - F.col("s")) / longest) - 1, F.lit(0)))
    cut = spans.withColumn("k", F.explode(pieces))
    start = F.col("s") + F.col("k") * longest
    return cut.select(*[c for c in spans.columns if c not in ("s", "e")], start.alias("s"), F.least(F.col("e"), start + longest).alias("e"))


def invert(silences: DataFrame, pad: int) -> DataFrame:
    """``run_id, s, e``: the speech between silences ``run_id, silence_idx, s, e, duration``.

    A silence without an end lasts to the end of the run; speech is padded at a silence, but not
    before 0 nor after the end of the run's last stretch.
    """
    w = W.partitionBy("run_id").orderBy("silence_idx")
    ended = F.coalesce(F.col("e"), F.col("duration"))
    rows = silences.select("run_id", "silence_idx", "s", "duration", F.lag(ended, 1, 0).over(w).alias("cursor"), ended.alias("_ended"))
    inner = rows.filter("s > cursor").select("run_id", F.greatest(F.col("cursor") - pad, F.lit(0)).alias("s"), (F.col("s") + pad).alias("e"))
    last = rows.groupBy("run_id").agg(F.max_by("_ended", "silence_idx").alias("cursor"), F.max("duration").alias("duration"))
    tail = last.filter("cursor < duration").select("run_id", F.greatest(F.col("cursor") - pad, F.lit(0)).alias("s"), F.col("duration").alias("e"))
    return inner.unionByName(tail)


def noise_floor(mean: Column, peak: Column) -> Column:
    """The silence threshold for a run's mean and peak level in decibels."""
    found = F.least(F.greatest(F.least(mean - 8, peak - 25), F.lit(FLOOR_LOW)), F.lit(FLOOR_HIGH))
    return F.when(mean.isNull() | peak.isNull(), F.lit(FLOOR_DEFAULT)).otherwise(found)


def fold(df: DataFrame, key: str, order: list[str], size: str, name: str, step: Callable[[tuple | None, float], tuple[tuple, int]]) -> DataFrame:
    """Add ``name``: what a sequential ``step`` gives for each row of a key in order.

    ``step`` takes the state (None at the start of a key) and the row's size, and returns the new
    state and the row's number. Greedy budgets restart at places that depend on all rows before, so
    a key is read in order; rows stream by and only the state is held.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = object()
        state: tuple | None = None
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf[size], strict=True):
                if k != now:
                    now, state = k, None
                state, n = step(state, v)
                out.append(n)
            yield pdf.assign(**{name: out})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, kinds)


def budget(limit: float, most: int | None = None, extra: int = 0) -> Callable[[tuple | None, float], tuple[tuple, int]]:
    """A step that opens a new batch when the row would take it over ``limit`` (or over ``most`` rows)."""

    def step(state: tuple | None, size: float) -> tuple[tuple, int]:
        size += extra
        if state is None:
            return (1, size, 1), 1
        batch, total, rows = state
        if total + size > limit or (most is not None and rows >= most):
            return (batch + 1, size, 1), batch + 1
        return (batch, total + size, rows + 1), batch

    return step


def batches(spans: DataFrame, limit: int = BATCH) -> DataFrame:
    """Adds ``batch`` (from 1): consecutive spans of a run with at most ``limit`` of speech; one longer span is a batch."""
    sized = spans.withColumn("_size", F.greatest(F.col("e") - F.col("s"), F.lit(0)))
    return fold(sized, "run_id", ["s", "e"], "_size", "batch", budget(limit)).drop("_size")


def pieces(batched: DataFrame) -> DataFrame:
    """``run_id, batch, piece, chunk_s, chunk_e, source_s``: where each span lies in its spliced batch.

    A batch holds a bounded amount of speech, so its window does too.
    """
    w = W.partitionBy("run_id", "batch").orderBy("s", "e")
    start = F.greatest(F.col("s") - PAD, F.lit(0))
    length = F.col("e") + PAD - start
    before = F.coalesce(F.sum(length + JOIN).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return batched.select("run_id", "batch", F.row_number().over(w).alias("piece"), before.alias("chunk_s"), (before + length).alias("chunk_e"), start.alias("source_s"))


def speech_share(covered: Column, total: Column) -> Column:
    """Share of ``total`` that is speech; 1 where there is no total."""
    return F.when(total > 0, covered / total).otherwise(F.lit(1.0))


def describe(spans: Column, covered_ms: Column, total_ms: Column) -> Column:
    """One line on a run's speech: spans, minutes and share."""
    return F.format_string("%d speech span(s), %.1f of %.1f min (%.0f%% speech)", spans, covered_ms / 60_000, total_ms / 60_000, speech_share(covered_ms, total_ms) * 100)
