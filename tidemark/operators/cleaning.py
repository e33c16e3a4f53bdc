"""Taking out what a decoder invented, and keeping a record of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import phrases, text
from tidemark.operators import confidence
from tidemark.operators.carry import islands

#: Copies of a phrase beyond which it is a loop; neighbours that make an echo and their longest text.
REPEATS, ECHO_RUN, ECHO_CHARS = 3, 3, 60
#: Share of a segment over silence that counts against it.
SILENT = 0.6
#: Segments of a run that one window task orders.
BUCKET = 2048


def always(value: Column, extra: str | None = None) -> Column:
    """Holds a phrase that is never speech; ``extra`` is a user's pattern for the same."""
    found = value.rlike(phrases.SPARK_ALWAYS)
    return found | value.rlike(f"(?iu){extra}") if extra else found


def contextual(value: Column) -> Column:
    return value.rlike(phrases.SPARK_CONTEXTUAL)


def flags(value: Column, conf: Column, silence: Column, strict: bool = False, floor: float = confidence.FLOOR) -> Column:
    """The flags of a segment as an array: ``empty`` alone, or low-confidence, silence and hallucination in this order.

    A missing confidence is not low. An ordinary phrase needs a low confidence or silence against it,
    unless ``strict``.
    """
    t = text.trimmed(value)
    low, over = F.coalesce(conf < floor, F.lit(False)), silence > SILENT
    invented = always(t) | (contextual(t) & (F.lit(strict) | low | over))
    found = F.array_compact(F.array(F.when(low, F.lit("low-confidence")), F.when(over, F.lit("silence")), F.when(invented, F.lit("hallucination"))))
    return F.when(t == "", F.array(F.lit("empty"))).otherwise(found)


def drop_reason(marks: Column) -> Column:
    """Why a segment is dropped: hallucination, empty or loop-echo, the first that it has; null keeps it."""
    has = lambda x: F.array_contains(marks, x)
    return F.when(has("hallucination"), "hallucination").when(has("empty"), "empty").when(has("loop-echo"), "loop-echo")


def echoes(segments: DataFrame) -> DataFrame:
    """Adds ``echo``: one of a run of three or more neighbours with one short text, but not its first.

    Neighbours follow by ``seg_idx``. Texts are compared without case and punctuation; texts of
    nothing but punctuation make no echo; the length of the first decides.
    """
    rows = segments.withColumn("_norm", text.norm(F.coalesce("text", F.lit("")))).withColumn("_bucket", F.floor(F.col("seg_idx") / BUCKET))
    numbered = islands(rows, ["run_id"], "_bucket", [F.col("seg_idx")], F.col("_norm"), "_island")
    first = numbered.groupBy("run_id", "_island").agg(F.count("*").alias("_n"), F.min("seg_idx").alias("_first"), F.min_by(F.length("text"), "seg_idx").alias("_chars"))
    marked = numbered.join(first, ["run_id", "_island"])
    echo = (F.col("_n") >= ECHO_RUN) & (F.col("_norm") != "") & (F.col("_chars") <= ECHO_CHARS) & (F.col("seg_idx") > F.col("_first"))
    return marked.withColumn("echo", echo).drop("_norm", "_bucket", "_island", "_n", "_first", "_chars")


def collapse(value: str | None, repeats: int = REPEATS) -> str | None:
    """A text with a looping phrase of one to eight words written once; other texts as they are.

    The shortest phrase that loops counts. A scan goes from group to group, so a loop that starts
    out of step with its length is not seen.
    """
    if repeats < 1:
        raise ValueError("repeats must be at least 1")
    words = value.split() if value else []
    if len(words) < 2 * repeats:
        return value
    for size in range(1, min(8, len(words) // repeats) + 1):
        out, at, looped = [], 0, False
        while at + size <= len(words):
            group, stop = words[at : at + size], at + size
            while words[stop : stop + size] == group:
                stop += size
            many = (stop - at) // size > repeats
            out += group if many else words[at:stop]
            looped |= many
            at = stop
        if looped:
            return " ".join(out + words[at:])
    return value


def collapsed(value: Column, repeats: int = REPEATS) -> Column:
    """``collapse`` over a column; the scan goes on from where the last group ended, which no pattern can say."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: collapse(t, repeats) if isinstance(t, str) else None)

    return run.asNondeterministic()(value)


def clean(segments: DataFrame, strict: bool = False, floor: float = confidence.FLOOR) -> DataFrame:
    """The whole pass over ``run_id, seg_idx, text, confidence, silence``: loops, flags, echoes, the reason to drop.

    Adds ``clean_text``, ``flags`` and ``reason``; nothing is removed, so the caller may keep all.
    Echoes are looked for in every segment, before any is dropped.
    """
    rows = segments.withColumn("_raw", F.col("text")).withColumn("text", collapsed(F.col("text")))
    rows = echoes(rows)
    marks = F.concat(
        F.when(~F.col("text").eqNullSafe(F.col("_raw")), F.array(F.lit("loop"))).otherwise(F.array().cast("array<string>")),
        flags(F.coalesce("text", F.lit("")), F.col("confidence"), F.col("silence"), strict, floor),
        F.when(F.col("echo"), F.array(F.lit("loop-echo"))).otherwise(F.array().cast("array<string>")),
    )
    out = rows.withColumn("flags", marks).withColumn("reason", drop_reason(F.col("flags")))
    return out.withColumnRenamed("text", "clean_text").withColumnRenamed("_raw", "text").drop("echo")
