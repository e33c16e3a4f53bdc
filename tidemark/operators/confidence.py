"""Confidence of words, segments and readings, and the choice of what is worth a second look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A segment below this confidence is shaky; an absorbed reading below it is flagged.
FLOOR = 0.55
#: Segments of a run that are decoded again at most: the feature is a worst-60 report.
WORST = 60


def clamp(value: Column) -> Column:
    """``value`` held in 0 to 1; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def geometric_mean(probabilities: Column) -> Column:
    """Of an array: the geometric mean of what is above 0, held in 0 to 1; null for none."""
    good = F.filter(probabilities, lambda p: p > 0)
    total = F.aggregate(good, F.lit(0.0), lambda a, p: a + F.ln(p))
    return F.when(F.size(good) > 0, clamp(F.exp(total / F.size(good))))


def from_log(avg_logprob: Column) -> Column:
    """Confidence from a mean log probability; null stays null."""
    return clamp(F.exp(avg_logprob))


def weighted_mean(duration: Column, confidence: Column) -> Column:
    """Aggregate: mean confidence weighted by duration; null where nothing has weight."""
    weight = F.when(confidence.isNotNull(), F.greatest(duration, F.lit(0)).cast("double"))
    total = F.sum(weight)
    return F.when(total > 0, F.sum(weight * confidence) / total)


def shaky(text: Column, confidence: Column, floor: float = FLOOR) -> Column:
    """Has words, and no confidence or one below the floor."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & (confidence.isNull() | (confidence < floor))


def worst(segments: DataFrame, floor: float = FLOOR, most: int = WORST) -> DataFrame:
    """Adds ``worst_rank`` to the shaky segments of each run, least confident first, at most ``most``.

    A missing confidence ranks as 0, equals go by ``seg_idx``. The limit is pushed below the shuffle,
    so a run with a third of all rows sends ``most`` of each task's.
    """
    w = W.partitionBy("run_id").orderBy(F.coalesce("confidence", F.lit(0.0)), "seg_idx")
    return segments.filter(shaky(F.col("text"), F.col("confidence"), floor)).withColumn("worst_rank", F.row_number().over(w)).filter(F.col("worst_rank") <= most)


def absorb(current: Column, stated: Column) -> Column:
    """A second opinion may lower a confidence, never raise it; nothing stated changes nothing."""
    return F.when(stated.isNull(), current).when(current.isNull(), clamp(stated)).otherwise(F.least(current, clamp(stated)))


def by_confidence(variants: Column) -> Column:
    """An array of readings ordered by falling confidence, those without one last; stable."""
    numbered = F.transform(variants, lambda v, i: F.struct(v["confidence"].isNull().cast("int").alias("none"), (-F.coalesce(v["confidence"], F.lit(0.0))).alias("minus"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(numbered), lambda x: x["v"])
