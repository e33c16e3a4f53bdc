"""Queries of the training-data problems and their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import abuse, bpe, canonical, nearest, packing, transcripts
from tidemark.session import table

#: Tokens that a container of problem 7 holds.
CAPACITY = 2048


def _ms(column: str) -> Column:
    return F.round(F.col(column) * 1000).cast("long")


def _hit_matches(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "hits").select("hit_id", "phrase")
    return canonical.map_to_entries(hits, "phrase", canonical.spellings_of(table(spark, sf, "terms")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    matched = _hit_matches(spark, sf).filter("match is not null and hit_id is not null")
    return matched.groupBy("hit_id").agg(F.min("match.entry").cast("int").alias("priority"))


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases that stand for no entry, with the number of hits that carry them."""
    left = _hit_matches(spark, sf).filter("match is null").select("hit_id", "phrase").distinct()
    return left.groupBy("phrase").agg(F.count("*").alias("hits"))


def _nearest_words(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "turns").select("run_id", "turn_idx", "start_s")
    words = table(spark, sf, "words").select("run_id", "word_idx", "start_s", "end_s")
    return nearest.nearest(turns, words, "run_id", ["turn_idx"], _ms("start_s"), "word_idx", _ms("start_s"), _ms("end_s"), 500)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest_words(spark, sf).select("run_id", "turn_idx", "word_idx")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    turns, words = table(spark, sf, "turns"), table(spark, sf, "words")
    return transcripts.clean_turns(turns, words, with_text=False).select("run_id", "first_idx", "last_idx", "speaker_no")


def p3_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Clean turns with their times and text."""
    return transcripts.clean_turns(table(spark, sf, "turns"), table(spark, sf, "words"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    sized = documents.select("doc_id", bpe.token_count(spark, F.col("text")).alias("tokens"))
    return packing.pack(sized, "doc_id", "tokens", CAPACITY).withColumnRenamed("size", "tokens")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used, tokens held and the share of room left over."""
    used = p7_packed(spark, sf).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = used.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6))


def _abuse(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return abuse.classify(documents, abuse.fit(documents, table(spark, sf, "review_labels")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _abuse(spark, sf).filter("abusive and doc_id is not null").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _abuse(spark, sf).select("doc_id", F.round("abuse_score", 6).alias("score"), "abusive")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the share of abusive ones by source."""
    counts = _abuse(spark, sf).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive"))
    return counts.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p3_found": p3_found, "p3_turns": p3_turns, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
ORACLES = {
    "p2_found": """
WITH t AS (SELECT DISTINCT run_id, turn_idx, CAST(round(start_s * 1000) AS BIGINT) AS t FROM turns WHERE start_s IS NOT NULL),
w AS (SELECT DISTINCT run_id, word_idx, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM words WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND start_s <= end_s),
p AS (SELECT t.run_id, turn_idx, word_idx, CASE WHEN t.t < s THEN s - t.t WHEN t.t > e THEN t.t - e ELSE 0 END AS d FROM t JOIN w ON t.run_id = w.run_id AND s <= t.t + 500 AND e >= t.t - 500),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, turn_idx ORDER BY d, word_idx) AS k FROM p)
SELECT run_id, turn_idx, word_idx FROM r WHERE k = 1""",
}
