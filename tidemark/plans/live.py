"""Queries over levels as streams: utterances, sessions, the meter; and calls of outside engines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import confidence, plugins, readings
from tidemark.plans import base
from tidemark.plans.base import SEGMENTS, oracle
from tidemark.session import kept, shared_folder, table
from tidemark.sources import logs
from tidemark.streaming import gate, live

QUERIES: dict = {}
ORACLES: dict = {}
#: Levels of a stream made of events: for so many frames of each stretch loud, then quiet.
GAIN, STRETCH, LOUD = 40, 400, 150


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _levels(events: DataFrame) -> DataFrame:
    loud = F.col("event_id") % STRETCH < LOUD
    level = F.col("value") * F.when(loud, GAIN).otherwise(0.01)
    return events.select((F.col("event_id") % 4).alias("stream_id"), F.floor(F.col("event_id") / 4).alias("frame_no"), level.alias("level"))


@query()
def x01_utterances(spark: SparkSession, sf: str) -> DataFrame:
    return gate.utterances(_levels(table(spark, sf, "events"))).filter("kind <> 'draft'")


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return gate.utterance_stream(_levels(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/event[s].parquet")))


@query()
def x01_utterance_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same over a stream of the event files, written to a table of the shared folder and read back, the end included."""
    found = _streamed(spark, sf).filter("kind <> 'draft'")
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = found.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    ended = spark.read.schema(found.schema).parquet(f"{at}/out").unionByName(gate.unfinished(spark, f"{at}/log"))
    return kept(ended, at)


@query()
def x05_session(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader sees once every draft was settled or taken back."""
    return gate.current(gate.utterances(_levels(table(spark, sf, "events"))))


@query()
def x06_settling_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as the stream's sink has it, before the last utterances end."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sink = gate.Settling(spark, f"{at}/shown")
    _streamed(spark, sf).writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return kept(sink.shown(), at)


@query("""WITH r AS (SELECT user_id AS stream_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT stream_id, max(n) AS n, max(value) AS peak, round(CASE WHEN max(n) < 10 THEN 1.0 ELSE max(value) FILTER (i = n * 9 // 10) / greatest(max(value) FILTER (i = n // 10), 1.0) END, 6) AS swing FROM r GROUP BY stream_id""")
def a12_a13_meter(spark: SparkSession, sf: str) -> DataFrame:
    levels = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("value").alias("level"))
    return live.readings(levels).withColumn("swing", F.round("swing", 6))


@query()
def x11_verdict(spark: SparkSession, sf: str) -> DataFrame:
    levels = _levels(table(spark, sf, "events"))
    heard = gate.utterances(levels).filter("kind = 'final'").select("stream_id")
    return live.verdict(levels, heard)


@query("SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY user_id")
def a10_rms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))


@query()
def x09_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.segments(spark, sf).select("run_id", "seg_idx", "text")
    return live.sentences(rows, table(spark, sf, "terms")).select("run_id", "seg_idx", "sentence")


@query()
def x12_edits(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.concat(F.substring_index("text", " ", 3), F.lit(" indeed"))
    rows = base.segments(spark, sf).select("run_id", "seg_idx", live.edits(F.col("text"), wanted).alias("e"))
    return rows.select("run_id", "seg_idx", "e.backspaces", "e.text")


@query()
def c25_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return base.segments(spark, sf).select("run_id", "seg_idx", F.posexplode(live.in_pieces(F.col("text"))).alias("n", "piece"))


@query()
def f16_cut(spark: SparkSession, sf: str) -> DataFrame:
    return base.segments(spark, sf).select("run_id", "seg_idx", live.cut_to(F.col("text"), 40).alias("shown"))


@query(oracle(SEGMENTS, select=r"SELECT run_id, seg_idx, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS parts FROM segments"))
def u01_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Each segment's text through a decoder that says it word by word."""
    rows = base.segments(spark, sf).select("run_id", "seg_idx", "text")
    found = plugins.decode(rows, plugins.fake_decoder, plugins.Request("base"), ("run_id", "seg_idx"))
    return found.groupBy("run_id", "seg_idx").agg(F.count("*").alias("parts"))


@query()
def u08_second_passes(spark: SparkSession, sf: str) -> DataFrame:
    """Shaky segments decoded once more hot, where that says something new."""
    rows = confidence.worst(base.segments(spark, sf).drop("words")).select("run_id", "seg_idx", "text")
    planned = plugins.plan_passes(rows, 1)
    hot = plugins.pooled(plugins.decode(planned, plugins.fake_decoder, plugins.Request("base", temperature=0.4), ("run_id", "seg_idx")))
    return readings.novel(rows, hot.withColumn("n", F.lit(0)).select("run_id", "seg_idx", "n", F.concat("text", F.lit(" again")).alias("text")))


@query(oracle("x AS (SELECT run_id, turn_idx, min(speaker) AS speaker FROM turns WHERE start_s IS NOT NULL GROUP BY run_id, turn_idx)", select="SELECT run_id, count(*) AS turns, count(speaker) AS labelled FROM x GROUP BY run_id"))
def u07_diarizer_json(spark: SparkSession, sf: str) -> DataFrame:
    """Turns written as a diarizer's JSON and read back."""
    rows = base.turns(spark, sf).filter("s is not null")
    item = F.struct((F.col("s") / 1000).alias("start"), (F.col("e") / 1000).alias("end"), "speaker")
    made = rows.groupBy("run_id").agg(F.to_json(F.struct(F.collect_list(item).alias("turns"))).alias("reply"))
    return plugins.diarized(made).groupBy("run_id").agg(F.count("*").alias("turns"), F.count("speaker").alias("labelled"))


@query(oracle(SEGMENTS, select="SELECT run_id, count(*) AS fixed FROM segments WHERE text <> trim(text) GROUP BY run_id"))
def c13_correction(spark: SparkSession, sf: str) -> DataFrame:
    """Windows through a language model that trims, and its answers taken over."""
    rows = base.segments(spark, sf).select("run_id", "seg_idx", "text", "confidence")
    asked = plugins.ask(readings.prompt_items(readings.windows(rows)), F.col("items"), plugins.fake_model)
    kind = "struct<segments:array<struct<i:int,text:string,confidence:double>>>"
    answers = asked.select("run_id", F.explode(F.from_json(logs.reply_object(F.col("reply")), kind)["segments"]).alias("x"))
    fixes = answers.select("run_id", F.col("x.i").alias("seg_idx"), F.lit(0).alias("n"), F.col("x.text").alias("text"), F.lit(None).cast("double").alias("confidence"))
    return readings.patch(rows, fixes).filter("changed").groupBy("run_id").agg(F.count("*").alias("fixed"))
