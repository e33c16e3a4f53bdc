"""Joins of intervals that overlap in time.

Without an equal key Spark would compare all pairs of a run. Both sides are placed in the buckets of
the time axis that they touch and meet there; a pair that shares several buckets is kept in the first
of them only. An interval costs one row for each bucket it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import confidence

BUCKET = 60_000
#: Milliseconds that an interval counts for at least, and shares of an interval.
LEAST, MAJORITY, SPILL = 200, 0.5, 0.4


def _placed(df: DataFrame, bucket: int) -> DataFrame:
    return df.filter("run_id is not null and e > s").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))))


def overlapping(left: DataFrame, right: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows (columns ``run_id, s, e`` and others) that overlap by more than nothing.

    Right columns come back with the prefix ``r_``, the overlap in milliseconds as ``overlap``. Rows
    lacking run or time, or of no length, meet nothing.
    """
    r = right.select(*[F.col(c).alias(c if c == "run_id" else f"r_{c}") for c in right.columns])
    r = r.filter("r_e > r_s and run_id is not null").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("r_s") / bucket), F.floor((F.col("r_e") - 1) / bucket))))
    pairs = _placed(left, bucket).join(r, ["run_id", "_bucket"]).filter("r_s < e and s < r_e")
    first = F.floor(F.greatest("s", "r_s") / bucket) == F.col("_bucket")
    return pairs.filter(first).withColumn("overlap", F.least("e", "r_e") - F.greatest("s", "r_s")).drop("_bucket")


def outside_share(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``silence``: the share of each segment outside the spans of its run; 0 for runs without spans and segments of no length."""
    covered = overlapping(segments.select("run_id", "seg_idx", "s", "e"), spans.select("run_id", "s", "e")).groupBy("run_id", "seg_idx").agg(F.sum("overlap").alias("_covered"))
    there = spans.filter("run_id is not null").select("run_id").distinct().withColumn("_spans", F.lit(True))
    rows = segments.join(covered, ["run_id", "seg_idx"], "left").join(there, "run_id", "left")
    share = F.greatest(F.lit(0.0), 1 - F.coalesce("_covered", F.lit(0)) / (F.col("e") - F.col("s")))
    return rows.withColumn("silence", F.when(F.col("_spans") & (F.col("e") > F.col("s")), share).otherwise(F.lit(0.0))).drop("_covered", "_spans")


def attach(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds ``speaker``: that of the single turn with the largest overlap; the earlier turn among equals, null for none."""
    pairs = overlapping(segments.select("run_id", "seg_idx", "s", "e"), turns.select("run_id", "turn_idx", "s", "e", "speaker"))
    best = pairs.groupBy("run_id", "seg_idx").agg(F.max_by("r_speaker", F.struct("overlap", -F.col("r_turn_idx"))).alias("speaker"))
    return segments.drop("speaker").join(best, ["run_id", "seg_idx"], "left")


def assign(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """``run_id, alt_idx, seg_idx``: each alternate segment with the primary one whose reading it is.

    It lies in it by more than half and covers no other primary by more than the spill; the lower
    index wins among equals.
    """
    pairs = overlapping(alternate.select("run_id", F.col("seg_idx").alias("alt_idx"), "s", "e"), primary.select("run_id", "seg_idx", "s", "e"))
    room = F.greatest(F.col("r_e") - F.col("r_s"), F.lit(LEAST))
    heavy = F.col("overlap") > room * SPILL
    best = F.max(F.struct("overlap", (-F.col("r_seg_idx")).alias("minus"), heavy.alias("heavy")))
    chosen = pairs.groupBy("run_id", "alt_idx").agg(best.alias("b"), F.count_if(heavy).alias("heavies"), F.first(F.col("e") - F.col("s")).alias("length"))
    enough = F.col("b.overlap") > F.greatest(F.col("length"), F.lit(LEAST)) * MAJORITY
    alone = F.col("heavies") - F.col("b.heavy").cast("int") == 0
    return chosen.filter(enough & alone).select("run_id", "alt_idx", (-F.col("b.minus")).alias("seg_idx"))


def second_readings(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """``run_id, seg_idx, reading, confidence``: what a second pass says where it differs in words."""
    said = F.trim(F.col("text"))
    parts = assign(primary, alternate).join(alternate.withColumnRenamed("seg_idx", "alt_idx"), ["run_id", "alt_idx"]).filter(said != "")
    length = F.col("e") - F.col("s")
    ordered = F.array_sort(F.collect_list(F.struct("alt_idx", said.alias("t"))))
    joined = parts.groupBy("run_id", "seg_idx").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("reading"), confidence.weighted_mean(length, F.col("confidence")).alias("confidence"))
    return joined


def to_source(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds ``source_ms`` to ``run_id, batch, t``: a time in a spliced batch as a time of the recording.

    In a join it snaps to the next piece, past the end to the end of the last. Both sides meet on run
    and batch, and a batch holds few pieces.
    """
    lists = pieces.groupBy("run_id", "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_e", "chunk_s", "source_s"))).alias("_p"))
    rows = points.join(lists, ["run_id", "batch"], "left")
    hit = F.filter("_p", lambda p: p["chunk_e"] >= F.col("t"))
    at = F.get(hit, F.lit(0))
    last = F.element_at("_p", -1)
    inside = at["source_s"] + F.greatest(F.col("t") - at["chunk_s"], F.lit(0))
    end = last["source_s"] + last["chunk_e"] - last["chunk_s"]
    return rows.withColumn("source_ms", F.when(F.col("_p").isNull(), F.col("t")).when(F.size(hit) > 0, inside).otherwise(end)).drop("_p")


def within(segments: DataFrame, ranges: DataFrame, bucket: int = 600_000) -> DataFrame:
    """Segments with the range ``run_id, batch, from_ms, to_ms`` in which they start (the end excluded)."""
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("from_ms") / bucket), F.floor(F.col("to_ms") / bucket))))
    rows = segments.withColumn("_bucket", F.floor(F.col("s") / bucket))
    return rows.join(r, ["run_id", "_bucket"]).filter("from_ms <= s and s < to_ms").drop("_bucket")


def suspects(rows: DataFrame, floor: float = confidence.FLOOR) -> DataFrame:
    """``run_id, batch``: batches whose first segment opens in lower case or of which a fifth, at least one, is shaky.

    A missing confidence counts as sure here.
    """
    shaky = F.coalesce("confidence", F.lit(1.0)) < floor
    head = F.trim(F.min_by("text", F.struct("s", "seg_idx")))
    groups = rows.groupBy("run_id", "batch").agg(head.alias("head"), F.count_if(shaky).alias("bad"), F.count("*").alias("n"))
    lower = F.col("head").rlike(r"^\p{Ll}")
    return groups.filter(lower | (F.col("bad") >= F.greatest(F.lit(1), F.floor(F.col("n") / 5)))).select("run_id", "batch")
