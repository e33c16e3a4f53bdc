"""Queries of the general data problems: timestamps (4) and intervals (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import periods, stamps
from tidemark.session import table

#: A gap from this length on is a break between sessions, not a gap.
BREAK_MS = 1_800_000


def _stamps(spark: SparkSession, sf: str) -> DataFrame:
    return stamps.instants(table(spark, sf, "media"), table(spark, sf, "runs"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _stamps(spark, sf).filter("stamp_status = 'ok'").select("origin", "rec_key", "epoch_us").distinct()


def p4_status(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps by origin, source and outcome, unresolved ones included, and how many of them several formats fit."""
    by = _stamps(spark, sf).groupBy("origin", "habit", "stamp_status")
    return by.agg(F.count("*").alias("n"), F.count_if(F.col("stamp_readings") > 1).alias("with_several_readings"))


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(c)
    pick = lambda t: table(spark, sf, t).filter(F.col("end_s") > F.col("start_s")).select(F.lit(t).alias("origin"), "run_id", ms("start_s"), ms("end_s"))
    return pick("spans").unionByName(pick("turns"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = periods.gaps(_intervals(spark, sf), ["origin", "run_id"], F.col("start_s"), F.col("end_s"))
    return found.filter(F.col("gap_end_ms") - F.col("gap_start_ms") < BREAK_MS)


def p5_periods(spark: SparkSession, sf: str) -> DataFrame:
    return periods.periods(_intervals(spark, sf), ["origin", "run_id"], F.col("start_s"), F.col("end_s"))


_ISLANDS = """
WITH x AS (
  SELECT DISTINCT 'spans' AS origin, run_id, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM spans WHERE end_s > start_s
  UNION SELECT DISTINCT 'turns', run_id, CAST(round(start_s * 1000) AS BIGINT), CAST(round(end_s * 1000) AS BIGINT) FROM turns WHERE end_s > start_s),
m AS (SELECT *, max(e) OVER (PARTITION BY origin, run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x)"""

QUERIES = {"p4_found": p4_found, "p4_status": p4_status, "p5_found": p5_found, "p5_periods": p5_periods}
ORACLES = {
    "p5_found": _ISLANDS + " SELECT origin, run_id, p AS gap_start_ms, s AS gap_end_ms FROM m WHERE s > p AND s - p < 1800000",
    "p5_periods": _ISLANDS + """, i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY origin, run_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT origin, run_id, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY origin, run_id, k""",
}
