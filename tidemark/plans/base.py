"""Inputs that many queries share: segments of a run, its spans and turns, in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import confidence
from tidemark.session import table


def ms(column: str) -> Column:
    return F.round(F.col(column) * 1000).cast("long")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, seg_idx, s, e, text, confidence, words``: the words of a turn as one segment.

    Repeated deliveries of a word count once. One shuffle, by run and turn.
    """
    words = table(spark, sf, "words").filter("turn_idx is not null")
    item = F.struct("word_idx", "text", ms("start_s").alias("s"), ms("end_s").alias("e"), "p")
    grouped = words.groupBy("run_id", F.col("turn_idx").alias("seg_idx")).agg(F.array_sort(F.collect_set(item)).alias("words"))
    return grouped.select(
        "run_id", "seg_idx", F.array_min("words.s").alias("s"), F.array_max("words.e").alias("e"),
        F.array_join("words.text", " ").alias("text"), confidence.geometric_mean(F.col("words.p")).alias("confidence"), "words",
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, turn_idx, s, e, speaker``: each turn once."""
    rows = table(spark, sf, "turns").groupBy("run_id", "turn_idx").agg(F.min(ms("start_s")).alias("s"), F.min(ms("end_s")).alias("e"), F.min("speaker").alias("speaker"))
    return rows


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, span_idx, s, e``: each voice span once."""
    return table(spark, sf, "spans").groupBy("run_id", "span_idx").agg(F.min(ms("start_s")).alias("s"), F.min(ms("end_s")).alias("e"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The run index with each run once: enrichments of any delivery count, of other values the least."""
    rows = table(spark, sf, "runs")
    keep = [c for c in rows.columns if c not in ("run_id", "has_summary", "has_speakers")]
    return rows.groupBy("run_id").agg(*[F.min(c).alias(c) for c in keep], *[F.max(c).alias(c) for c in ("has_summary", "has_speakers")])


#: The same inputs for the oracle.
SEGMENTS = """w AS (SELECT DISTINCT run_id, turn_idx, word_idx, text, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e, p FROM words WHERE turn_idx IS NOT NULL),
segments AS (SELECT run_id, turn_idx AS seg_idx, min(s) AS s, max(e) AS e, string_agg(text, ' ' ORDER BY word_idx) AS text,
  CASE WHEN count(*) FILTER (p > 0) > 0 THEN least(1.0, greatest(0.0, exp(avg(ln(CASE WHEN p > 0 THEN p END))))) END AS confidence FROM w GROUP BY run_id, turn_idx)"""
TURNS = "t AS (SELECT run_id, turn_idx, min(CAST(round(start_s * 1000) AS BIGINT)) AS s, min(CAST(round(end_s * 1000) AS BIGINT)) AS e, min(speaker) AS speaker FROM turns GROUP BY run_id, turn_idx)"
SPANS = "sp AS (SELECT run_id, span_idx, min(CAST(round(start_s * 1000) AS BIGINT)) AS s, min(CAST(round(end_s * 1000) AS BIGINT)) AS e FROM spans GROUP BY run_id, span_idx)"
RUNS = "r AS (SELECT run_id, min(media_sha) AS media_sha, min(fingerprint) AS fingerprint, min(source_path) AS source_path, min(source_name) AS source_name, min(created_at) AS created_at, min(recorded_at) AS recorded_at, min(duration) AS duration, min(backend) AS backend, min(model) AS model, min(lang) AS lang, min(segments) AS segments, min(words) AS words, max(has_summary) AS has_summary, max(has_speakers) AS has_speakers FROM runs GROUP BY run_id)"


def oracle(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
