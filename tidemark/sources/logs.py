"""Tool output as text, read into rows: detector logs, decoder JSON, device lists, chat replies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import confidence


def _numbers(log: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(log, F.lit(pattern), group), lambda x: x.try_cast("double"))


def silences(log: Column) -> Column:
    """``silence_start: x`` and ``silence_end: y`` of a log as an array of s and e in seconds; a last end may lack."""
    return F.arrays_zip(_numbers(log, r"silence_start:\s*(-?[\d.]+)").alias("s"), _numbers(log, r"silence_end:\s*(-?[\d.]+)").alias("e"))


def volume(log: Column, which: str) -> Column:
    """``mean_volume`` or ``max_volume`` in decibels, null where the log has none."""
    return F.get(_numbers(log, rf"{which}_volume:\s*(-?[\d.]+) dB"), F.lit(0))


def centisecond_spans(log: Column) -> Column:
    """``start = x, end = y`` in hundredths of a second as an array of s and e in seconds."""
    pattern = r"start\s*=\s*([\d.]+),\s*end\s*=\s*([\d.]+)"
    both = F.arrays_zip(_numbers(log, pattern, 1).alias("s"), _numbers(log, pattern, 2).alias("e"))
    return F.transform(both, lambda x: F.struct((x["s"] / 100).alias("s"), (x["e"] / 100).alias("e")))


_OFFSETS = "offsets struct<`from`:double,`to`:double>"
TOKEN_JSON = f"transcription array<struct<text:string,{_OFFSETS.replace(' ', ':', 1)},tokens:array<struct<text:string,p:double,{_OFFSETS.replace(' ', ':', 1)}>>>>"


def _special(token: Column) -> Column:
    return F.coalesce(token["text"], F.lit("")).rlike(r"^(\[_|<\|)")


def token_segments(raw: Column) -> Column:
    """A decoder's token JSON as an array of segments: ms to seconds, special tokens left out."""
    items = F.from_json(raw, TOKEN_JSON)["transcription"]

    def segment(x: Column) -> Column:
        plain = F.filter(x["tokens"], lambda t: ~_special(t))
        words = F.transform(F.filter(plain, lambda t: t["offsets"].isNotNull()), lambda t: F.struct((t["offsets"]["from"] / 1000).alias("start"), (t["offsets"]["to"] / 1000).alias("end"), t["text"].alias("text"), F.when(t["p"] != 0, t["p"]).alias("p")))
        return F.struct((x["offsets"]["from"] / 1000).alias("start"), (x["offsets"]["to"] / 1000).alias("end"), text.trimmed(x["text"]).alias("text"), confidence.geometric_mean(F.transform(plain, lambda t: F.coalesce(t["p"], F.lit(0.0)))).alias("confidence"), words.alias("words"))

    return F.transform(items, segment)


WORD_JSON = "segments array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,words:array<struct<start:double,end:double,word:string,probability:double>>>>"


def word_segments(raw: Column) -> Column:
    """A decoder's word JSON as an array of segments; words lacking a time are left out."""
    items = F.from_json(raw, WORD_JSON)["segments"]

    def segment(x: Column) -> Column:
        timed = F.filter(x["words"], lambda w: w["start"].isNotNull() & w["end"].isNotNull())
        words = F.transform(timed, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["word"].alias("text"), w["probability"].alias("p")))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), text.trimmed(x["text"]).alias("text"), confidence.from_log(x["avg_logprob"]).alias("confidence"), x["no_speech_prob"].alias("no_speech"), words.alias("words"))

    return F.transform(items, segment)


def devices(lines: DataFrame) -> DataFrame:
    """``report, index, name`` of the audio section of a device list ``report, line_no, line``.

    A line belongs to the last heading before it; a report is one tool's output, which one window orders.
    """
    w = W.partitionBy("report").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    heading = F.when(F.contains("line", F.lit("audio devices")), "audio").when(F.contains("line", F.lit("video devices")), "video")
    rows = lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))
    pattern = r"\[(\d+)\]\s+(.+?)\s*$"
    found = rows.filter((F.col("section") == "audio") & F.col("line").rlike(pattern))
    return found.select("report", F.regexp_extract("line", pattern, 1).cast("int").alias("index"), F.regexp_extract("line", pattern, 2).alias("name"))


def pick_device(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``report, wish``) with the ``index`` and ``name`` it names, null where none or several do.

    A number is an index and nothing else; other text is part of a name, whatever its case; null takes the first.
    """
    number = F.col("wish").rlike(r"^\d+$")
    hit = F.when(F.col("wish").isNull(), F.lit(True)).when(number, F.col("index") == F.col("wish").try_cast("int")).otherwise(F.contains(text.casefold(F.col("name")), text.casefold(F.col("wish"))))
    pairs = wanted.join(found, "report", "left").groupBy("report", "wish").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.struct("index", "name"))).alias("d"))
    one = (F.col("n") == 1) | F.col("wish").isNull()
    return pairs.select("report", "wish", F.when(one, F.col("d.index")).alias("index"), F.when(one, F.col("d.name")).alias("name"))


def json_object(reply: str | None) -> str | None:
    """The JSON object in a chatty reply: that of a fenced block, else the first one that ends; None for none."""
    if not reply:
        return None
    places = []
    fence = reply.find("```")
    while fence >= 0:
        body = reply[fence + 3 :].removeprefix("json").lstrip()
        if body.startswith("{"):
            places.append(body)
            break
        fence = reply.find("```", fence + 3)
    if "{" in reply:
        places.append(reply[reply.index("{") :])
    decoder = json.JSONDecoder()
    for place in places:
        try:
            value, _ = decoder.raw_decode(place)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


def last_object(output: str | None) -> str | None:
    """The last line of a tool's output that is a JSON object."""
    for line in reversed((output or "").splitlines()):
        try:
            value = json.loads(line)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


def reply_object(reply: Column, last: bool = False) -> Column:
    """``json_object`` (or ``last_object``) over a column; finding where an object ends takes a scanner."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = last_object if last else json_object
        for s in batches:
            yield s.map(lambda t: read(t) if isinstance(t, str) else None)

    return run(reply)


_SLIM = "struct<language:string,segments:array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double,words:array<struct<start:double,end:double,word:string,probability:double>>>>>"


def slim(raw: Column) -> Column:
    """A decoder's raw result without what nobody reads, as token arrays; missing text is empty, missing words none.

    Null where the text is no JSON object.
    """
    read = F.from_json(raw, _SLIM)
    word = lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.coalesce(w["word"], F.lit("")).alias("word"), w["probability"].alias("probability"))
    kept = ("start", "end")
    segment = lambda s: F.struct(*[s[c].alias(c) for c in kept], F.coalesce(s["text"], F.lit("")).alias("text"), *[s[c].alias(c) for c in ("avg_logprob", "no_speech_prob", "compression_ratio")], F.transform(F.coalesce(s["words"], F.array().cast("array<struct<start:double,end:double,word:string,probability:double>>")), word).alias("words"))
    segments = F.transform(F.coalesce(read["segments"], F.expr(f"cast(array() as {_SLIM[len('struct<language:string,segments:') : -1]})")), segment)
    return F.when(F.get_json_object(raw, "$").startswith("{"), F.struct(read["language"].alias("language"), segments.alias("segments")))


_PROBE = "struct<format:struct<duration:string,format_name:string,size:string,tags:map<string,string>>,streams:array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,duration:string>>>"


def probed(raw: Column) -> Column:
    """A media probe's JSON as duration, container, codec, sample rate, channels, video and tag; null without an audio stream.

    Numbers that cannot be read are 0, as is a duration that neither the file nor the stream states.
    """
    read = F.from_json(raw, _PROBE)
    audio = F.get(F.filter(read["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    number = lambda c, kind: F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))
    has_video = F.exists(read["streams"], lambda s: s["codec_type"] == "video")
    return F.when(
        audio.isNotNull(),
        F.struct(
            number(F.coalesce(read["format"]["duration"], audio["duration"]), "double").alias("duration"), F.coalesce(read["format"]["format_name"], F.lit("")).alias("container"),
            F.coalesce(audio["codec_name"], F.lit("")).alias("codec"), number(audio["sample_rate"], "int").alias("sample_rate"), F.coalesce(audio["channels"], F.lit(0)).alias("channels"),
            F.coalesce(has_video, F.lit(False)).alias("has_video"), read["format"]["tags"]["creation_time"].alias("tag"),
        ),
    )
