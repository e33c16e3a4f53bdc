"""Queries that render, parse tool output, window text for a language model and compare readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import overlap, readings, render, stamps
from tidemark.plans import base
from tidemark.plans.base import RUNS, SEGMENTS, SPANS, TURNS, oracle
from tidemark.plans.speech import _ATTACHED
from tidemark.sources import files, logs
from tidemark.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with their speaker; those whose words all lack a time have none and are kept."""
    return overlap.attach(base.segments(spark, sf), base.turns(spark, sf))


def _cues(spark: SparkSession, sf: str) -> DataFrame:
    """Those that can be a cue, which needs a start and an end."""
    return _spoken(spark, sf).filter("s is not null and e is not null")


def _clock(ms: str) -> str:
    t = f"greatest({ms}, 0)"
    return f"printf('%d:%02d:%02d', {t} // 3600000, ({t} // 60000) % 60, ({t} // 1000) % 60)"


def _cue(ms: str, mark: str) -> str:
    t = f"greatest({ms}, 0)"
    return f"printf('%02d:%02d:%02d{mark}%03d', {t} // 3600000, ({t} // 60000) % 60, ({t} // 1000) % 60, {t} % 1000)"


_NUMBERED = "tm AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seg_idx) AS n FROM att)"
_TIMED = "tm AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seg_idx) AS n FROM att WHERE s IS NOT NULL AND e IS NOT NULL)"


@query(oracle(SEGMENTS, TURNS, _ATTACHED, _NUMBERED, select=f"SELECT run_id, n * 1000 AS line_no, concat_ws(' ', CASE WHEN s IS NOT NULL THEN '[' || {_clock('s')} || ']' END, CASE WHEN speaker <> '' THEN speaker || ':' END, printf('(%.2f)', round(confidence, 2)), text) AS line FROM tm"))
def k01_txt(spark: SparkSession, sf: str) -> DataFrame:
    return render.txt(_spoken(spark, sf), render.Options(confidence=True))


@query()
def k02_md_head(spark: SparkSession, sf: str) -> DataFrame:
    return render.markdown_head(base.runs(spark, sf), table(spark, sf, "media"))


@query()
def k03_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each run with its columns, speech spans and segments: speaker, words, times in seconds."""
    times = lambda x: ((x["s"] / 1000).alias("start"), (x["e"] / 1000).alias("end"))
    words = F.transform("words", lambda w: F.struct(w["text"].alias("text"), *times(w), w["p"].alias("confidence")))
    said = overlap.attach(base.segments(spark, sf), base.turns(spark, sf))
    said = said.select("run_id", "seg_idx", *times({"s": F.col("s"), "e": F.col("e")}), "text", "confidence", "speaker", words.alias("words"))
    spans = base.spans(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*times({"s": F.col("s"), "e": F.col("e")})))).alias("speech"))
    return render.document(base.runs(spark, sf).join(spans, "run_id", "left"), said)


@query(oracle(SEGMENTS, TURNS, _ATTACHED, _TIMED, select=f"SELECT run_id, n AS line_no, n || chr(10) || {_cue('s', ',')} || ' --> ' || {_cue('e', ',')} || chr(10) || CASE WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' ELSE '' END || text AS line FROM tm"))
def k04_srt(spark: SparkSession, sf: str) -> DataFrame:
    return render.srt(_cues(spark, sf))


@query(oracle(SEGMENTS, TURNS, _ATTACHED, _TIMED, select=f"SELECT run_id, n AS line_no, {_cue('s', '.')} || ' --> ' || {_cue('e', '.')} || chr(10) || CASE WHEN coalesce(speaker, '') <> '' THEN '<v ' || speaker || '>' ELSE '' END || text AS line FROM tm"))
def k05_vtt(spark: SparkSession, sf: str) -> DataFrame:
    return render.srt(_cues(spark, sf), web=True)


@query(oracle(SEGMENTS, TURNS, _ATTACHED, select=f"""SELECT run_id, seg_idx, coalesce(printf('%.3f', s / 1000.0), '') AS start, coalesce(printf('%.3f', e / 1000.0), '') AS "end", CASE WHEN s IS NULL THEN '' ELSE {_clock('s')} END AS at, coalesce(speaker, '') AS speaker, coalesce(printf('%.4f', confidence), '') AS confidence, '' AS flags, '' AS suspected,
CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS text FROM att"""))
def k06_csv(spark: SparkSession, sf: str) -> DataFrame:
    return render.table(_spoken(spark, sf))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS cell FROM documents WHERE text IS NOT NULL")
def k07_inert(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", text.inert(F.col("text")).alias("cell"))


_DIALOGUE = """dw AS (SELECT *, coalesce(nullif(speaker, ''), 'SPEAKER') AS who FROM tm),
dx AS (SELECT *, CASE WHEN who IS DISTINCT FROM lag(who) OVER (PARTITION BY run_id ORDER BY seg_idx) THEN 1 ELSE 0 END AS b FROM dw),
dy AS (SELECT *, sum(b) OVER (PARTITION BY run_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS k FROM dx)"""


@query(oracle(SEGMENTS, TURNS, _ATTACHED, _NUMBERED, _DIALOGUE, select=f"""SELECT run_id, CAST(k AS BIGINT) AS line_no, CASE WHEN arg_min_null(s, seg_idx) IS NULL THEN '' ELSE '[' || {_clock('arg_min_null(s, seg_idx)')} || '] ' END || min(who) || ': ' || trim(string_agg(nullif(trim(text), ''), ' ' ORDER BY seg_idx)) AS line FROM dy GROUP BY run_id, k"""))
def k08_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    return render.dialogue(_spoken(spark, sf))


@query()
def k09_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A summary reply made from each run's first words, read and rendered line by line."""
    payload = F.to_json(F.struct(F.col("head").alias("headline"), F.array(F.struct(F.col("head").alias("title"), F.array(F.lit(" a "), F.lit("")).alias("bullets"))).alias("sections"), F.array(F.lit("b")).alias("decisions")))
    first = base.segments(spark, sf).groupBy("run_id").agg(F.min_by("text", "seg_idx").alias("head"))
    rows = first.withColumn("summary", readings.summary(payload))
    return rows.select("run_id", F.posexplode(render.summary_lines(F.col("summary"))).alias("line_no", "line"))


def _with_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with an original reading for every third one and two other readings."""
    rows = base.segments(spark, sf).drop("words")
    make = lambda said, kind, c: F.struct(said.alias("text"), F.lit("pass").alias("source"), F.lit(kind).alias("kind"), F.lit(c).cast("double").alias("confidence"))
    primary = F.when(F.col("seg_idx") % 3 == 0, F.array(make(F.lower("text"), "primary", 0.5))).otherwise(F.array().cast("array<struct<text:string,source:string,kind:string,confidence:double>>"))
    others = F.array(make(F.concat("text", F.lit("!")), "context", 0.25), make(F.concat("text", F.lit(" more")), "model", None))
    return rows.withColumn("variants", F.concat(primary, others))


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, CASE WHEN seg_idx % 3 = 0 AND lower(text) <> text THEN text || '   |raw| ' || lower(text) ELSE text END AS reading FROM segments"))
def k10_chosen(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_variants(spark, sf)
    return rows.select("run_id", "seg_idx", render.chosen(rows, render.Options(reading="both")).alias("reading"))


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN 'low-confidence,term: a~b;c~d' ELSE 'loop' END AS labels FROM segments"))
def k11_flag_labels(spark: SparkSession, sf: str) -> DataFrame:
    flags = F.when(F.col("seg_idx") % 2 == 0, F.array(F.lit("low-confidence"), F.lit("term"))).otherwise(F.array(F.lit("loop")))
    pair = lambda a, b: F.struct(F.lit(a).alias("heard"), F.lit(b).alias("term"))
    return base.segments(spark, sf).select("run_id", "seg_idx", F.array_join(render.flag_labels(flags, F.array(pair("a", "b"), pair("c", "d"))), ",").alias("labels"))


@query("SELECT * FROM (VALUES ('srt,txt,srt', 'srt,txt'), ('all', 'txt,md,json,srt,vtt,csv,tsv,speakers,summary'), (' CSV , all', 'csv,txt,md,json,srt,vtt,tsv,speakers,summary')) v(asked, formats)")
def k12_formats(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([("srt,txt,srt",), ("all",), (" CSV , all",)], "asked string")
    return asked.select("asked", F.array_join(render.expand(F.col("asked")), ",").alias("formats"))


@query(f"SELECT run_id, span_idx, {_clock('s')} AS clock, {_clock('s')} || printf('.%03d', greatest(s, 0) % 1000) AS fine, {_cue('s', ',')} AS cue FROM (SELECT run_id, span_idx, min(CAST(round(start_s * 1000) AS BIGINT)) AS s FROM spans GROUP BY ALL) WHERE s IS NOT NULL")
def f07_f08_clock(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.spans(spark, sf).filter("s is not null")
    return rows.select("run_id", "span_idx", text.clock(F.col("s")).alias("clock"), text.clock(F.col("s"), True).alias("fine"), text.cue_time(F.col("s")).alias("cue"))


@query()
def f09_absolute(spark: SparkSession, sf: str) -> DataFrame:
    """When each span began by the clock of the recording's home zone."""
    media = stamps.instants(table(spark, sf, "media"), table(spark, sf, "runs").limit(0)).filter("stamp_status = 'ok'").groupBy("rec_key").agg(F.min("epoch_us").alias("us"))
    zones = table(spark, sf, "media").groupBy(F.col("sha256").alias("rec_key")).agg(F.coalesce(F.min("home_zone"), F.lit("UTC")).alias("zone"))
    runs = base.runs(spark, sf).select("run_id", F.col("media_sha").alias("rec_key")).join(media, "rec_key").join(zones, "rec_key")
    at = F.from_utc_timestamp(F.timestamp_micros(F.col("us") + F.greatest(F.col("s"), F.lit(0)) * 1000), F.col("zone"))
    return base.spans(spark, sf).filter("s is not null").join(runs, "run_id").select("run_id", "span_idx", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(r"SELECT sha256, strftime(TRY_CAST(recorded_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT DISTINCT sha256, recorded_at FROM media WHERE regexp_full_match(recorded_at, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}')) WHERE TRY_CAST(recorded_at AS TIMESTAMP) IS NOT NULL")
def f11_plain_iso(spark: SparkSession, sf: str) -> DataFrame:
    plain = table(spark, sf, "media").select("sha256", "recorded_at").filter(F.col("recorded_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$")).distinct()
    read = stamps.resolve(plain, "recorded_at", F.lit(""), F.lit(None).cast("string"), F.lit(True)).filter("epoch_us is not null")
    return read.select("sha256", F.date_format(F.timestamp_micros("epoch_us"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query()
def f11_iso_and_name(spark: SparkSession, sf: str) -> DataFrame:
    """Every file with the instant of its tag in any ISO notation and the date in its name, null where there is none."""
    rows = table(spark, sf, "media").select("path", "sha256", "recorded_at").distinct()
    return rows.select("path", "sha256", "recorded_at", stamps.each(F.col("recorded_at"), stamps.tag_micros, "bigint").alias("epoch_us"), stamps.each(F.col("path"), stamps.name_date, "string").alias("name_date"))


@query("SELECT DISTINCT sha256, CASE WHEN size_bytes >= 1048576 THEN (size_bytes // 1048576) || ' MiB' ELSE (size_bytes // 1024) || ' KiB' END AS size FROM media")
def f18_in_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "media").select("sha256", text.in_units(F.col("size_bytes")).alias("size")).distinct()


@query("SELECT event_id, CASE WHEN f <= 16 THEN repeat('#', f) || repeat('-', 16 - f) || '|' || repeat('-', 15) ELSE repeat('#', f) || repeat('-', 32 - f) END AS bar FROM (SELECT event_id, CAST(least(32, floor(value / 100 * 16)) AS INTEGER) AS f FROM events)")
def f17_bar(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.bar(F.col("value"), F.lit(100.0)).alias("bar"))


# --- tool output -----------------------------------------------------------------------------


@query(oracle(SPANS, select="SELECT run_id, span_idx, round(s / 1000.0, 3) AS s, round(e / 1000.0, 3) AS e FROM sp WHERE s >= 0 AND e IS NOT NULL"))
def s10_silence_log(spark: SparkSession, sf: str) -> DataFrame:
    """Each span written as a detector's log and read back."""
    rows = base.spans(spark, sf).filter("s >= 0 and e is not null")
    log = F.format_string("[x] silence_start: %.3f\n[x] silence_end: %.3f | silence_duration: 1", F.col("s") / 1000, F.col("e") / 1000)
    return rows.select("run_id", "span_idx", F.explode(logs.silences(log)).alias("x")).select("run_id", "span_idx", "x.s", "x.e")


@query(oracle(SPANS, select="SELECT run_id, span_idx, round(s / 1000.0, 2) AS s, round(e / 1000.0, 2) AS e FROM (SELECT run_id, span_idx, floor(s / 10) * 10 AS s, floor(e / 10) * 10 AS e FROM sp WHERE s >= 0 AND e IS NOT NULL)"))
def s11_centisecond_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.spans(spark, sf).filter("s >= 0 and e is not null")
    line = F.format_string("seg: start = %d.00, end = %d.00", F.floor(F.col("s") / 10).cast("long"), F.floor(F.col("e") / 10).cast("long"))
    return rows.select("run_id", "span_idx", F.explode(logs.centisecond_spans(line)).alias("x")).select("run_id", "span_idx", F.round("x.s", 2).alias("s"), F.round("x.e", 2).alias("e"))


@query(oracle(SEGMENTS, select="""SELECT run_id, turn_idx AS seg_idx, count(*) FILTER (s IS NOT NULL AND e IS NOT NULL) AS words,
CASE WHEN count(*) FILTER (p > 0) > 0 THEN round(least(1.0, exp(avg(ln(CASE WHEN p > 0 THEN p END)))), 6) END AS confidence FROM w WHERE NOT (starts_with(text, '[_') OR starts_with(text, '<|')) GROUP BY run_id, turn_idx"""))
def s12_token_json(spark: SparkSession, sf: str) -> DataFrame:
    """The words of a segment written as a decoder's token JSON and read back."""
    token = lambda w: F.struct(w["text"].alias("text"), w["p"].alias("p"), F.when(w["s"].isNotNull() & w["e"].isNotNull(), F.struct(w["s"].alias("from"), w["e"].alias("to"))).alias("offsets"))
    raw = F.to_json(F.struct(F.array(F.struct("text", F.struct(F.col("s").alias("from"), F.col("e").alias("to")).alias("offsets"), F.transform("words", token).alias("tokens"))).alias("transcription")))
    parsed = base.segments(spark, sf).select("run_id", "seg_idx", "words", F.explode(logs.token_segments(raw)).alias("x"))
    special = F.filter("words", lambda w: ~w["text"].rlike(r"^(\[_|<\|)"))
    return parsed.filter(F.size(special) > 0).select("run_id", "seg_idx", F.size("x.words").alias("words"), F.round("x.confidence", 6).alias("confidence"))


@query(oracle(SEGMENTS, select="SELECT run_id, turn_idx AS seg_idx, count(*) FILTER (s IS NOT NULL AND e IS NOT NULL) AS words, round(exp(-0.5), 6) AS confidence FROM w GROUP BY run_id, turn_idx"))
def s13_word_json(spark: SparkSession, sf: str) -> DataFrame:
    word = lambda w: F.struct((w["s"] / 1000).alias("start"), (w["e"] / 1000).alias("end"), w["text"].alias("word"), w["p"].alias("probability"))
    raw = F.to_json(F.struct(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), "text", F.lit(-0.5).alias("avg_logprob"), F.transform("words", word).alias("words"))).alias("segments")))
    parsed = base.segments(spark, sf).select("run_id", "seg_idx", F.explode(logs.word_segments(raw)).alias("x"))
    return parsed.select("run_id", "seg_idx", F.size("x.words").alias("words"), F.round("x.confidence", 6).alias("confidence"))


@query(oracle(SEGMENTS, select="SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seg_idx) - 1 AS INTEGER) AS seg_idx, text FROM segments"))
def s05_transcript_json(spark: SparkSession, sf: str) -> DataFrame:
    made = render.document(base.runs(spark, sf).select("run_id", "lang", "segments"), base.segments(spark, sf).select("run_id", "seg_idx", "text", "confidence"))
    return files.flat_segments(files.parse_transcripts(made)).select("run_id", "seg_idx", "text")


@query(r"""SELECT DISTINCT value FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS value FROM documents WHERE text IS NOT NULL) WHERE value <> '' AND NOT starts_with(value, '#')""")
def s07_pattern_lines(spark: SparkSession, sf: str) -> DataFrame:
    return files.patterns(table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))).distinct()


_REPORT = ("[x] AVFoundation video devices:", "[x] [0] Front Camera", "[x] [1] Screen", "[x] AVFoundation audio devices:", "[x] [0] Desk Microphone", "[x] [1] Headset Microphone", "done")


def _devices(spark: SparkSession) -> DataFrame:
    rows = [("a", i, line) for i, line in enumerate(_REPORT)]
    return logs.devices(spark.createDataFrame(rows, "report string, line_no int, line string"))


@query("SELECT * FROM (VALUES ('a', 0, 'Desk Microphone'), ('a', 1, 'Headset Microphone')) v(report, index, name)")
def s15_devices(spark: SparkSession, sf: str) -> DataFrame:
    return _devices(spark)


@query("SELECT * FROM (VALUES ('a', NULL, 0, 'Desk Microphone'), ('a', '1', 1, 'Headset Microphone'), ('a', '5', NULL, NULL), ('a', 'DESK', 0, 'Desk Microphone'), ('a', 'micro', NULL, NULL)) v(report, wish, index, name)")
def s16_pick_device(spark: SparkSession, sf: str) -> DataFrame:
    wishes = spark.createDataFrame([("a", w) for w in (None, "1", "5", "DESK", "micro")], "report string, wish string")
    return logs.pick_device(_devices(spark), wishes)


@query()
def s17_reply_object(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON object in what documents hold."""
    return table(spark, sf, "documents").select("doc_id", logs.reply_object(F.col("text")).alias("object")).filter("object is not null")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s18_last_object(spark: SparkSession, sf: str) -> DataFrame:
    output = F.concat(F.lit("loading\n{not json\n"), "props", F.lit("\n[1]\nbye"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(logs.reply_object(output, last=True), "$.k").cast("int").alias("k"))


# --- readings and windows --------------------------------------------------------------------


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, 2 AS n, text || ' more' AS text FROM segments"))
def t01_novel(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.segments(spark, sf).select("run_id", "seg_idx", "text")
    said = F.array(F.concat("text", F.lit("!")), F.lower("text"), F.concat("text", F.lit(" more")), F.concat("text", F.lit(" MORE!")))
    return readings.novel(rows, rows.select("run_id", "seg_idx", F.posexplode(said).alias("n", "text")))


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, CASE WHEN seg_idx % 3 = 0 THEN 'primary,model' ELSE 'model' END AS kinds FROM segments"))
def t02_still_differing(spark: SparkSession, sf: str) -> DataFrame:
    kept = readings.still_differing(F.col("variants"), F.col("text"), ("context", "model"))
    return _with_variants(spark, sf).select("run_id", "seg_idx", F.array_join(F.transform(kept, lambda v: v["kind"]), ",").alias("kinds"))


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, text || ' x|y' AS added FROM segments"))
def t03_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    offered = F.array(F.concat("text", F.lit(" x ")), F.lower("text"), F.lit(" "), F.lit("y"), F.lit("Y"))
    return base.segments(spark, sf).select("run_id", "seg_idx", F.array_join(readings.absorb_alternatives(F.col("text"), F.array().cast("array<string>"), offered), "|").alias("added"))


@query(oracle(SEGMENTS, select="SELECT run_id, pass, count(*) AS n, sum(s) AS s FROM (SELECT run_id, 1 AS pass, s FROM segments UNION ALL SELECT run_id, 2, s FROM segments WHERE seg_idx % 5 <> 4) GROUP BY ALL"))
def t07_passes(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.segments(spark, sf).select("run_id", "seg_idx", "s")
    both = rows.withColumn("pass", F.lit(1)).unionByName(rows.filter("seg_idx % 5 <> 4").withColumn("pass", F.lit(2)))
    return both.groupBy("run_id", "pass").agg(F.count("*").alias("n"), F.sum("s").alias("s"))


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, CAST(row_number() OVER (PARTITION BY run_id ORDER BY s, seg_idx) AS INTEGER) AS place FROM segments WHERE s IS NOT NULL"))
def o06_by_start(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("run_id").orderBy("s", "seg_idx"))
    return base.segments(spark, sf).filter("s is not null").select("run_id", "seg_idx", place.alias("place"))


@query("WITH RECURSIVE " + SEGMENTS + """, o AS (SELECT run_id, seg_idx, length(text) AS l, row_number() OVER (PARTITION BY run_id ORDER BY seg_idx) AS i FROM segments),
f AS (SELECT run_id, seg_idx, i, CAST(1 AS BIGINT) AS window_no, l AS total, 1 AS n FROM o WHERE i = 1
UNION ALL SELECT o.run_id, o.seg_idx, o.i, CASE WHEN f.n >= 40 OR f.total + o.l > 6000 THEN window_no + 1 ELSE window_no END, CASE WHEN f.n >= 40 OR f.total + o.l > 6000 THEN o.l ELSE f.total + o.l END, CASE WHEN f.n >= 40 OR f.total + o.l > 6000 THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.run_id = f.run_id AND o.i = f.i + 1)
SELECT run_id, seg_idx, window_no AS "window" FROM f""")
def w09_windows(spark: SparkSession, sf: str) -> DataFrame:
    return readings.windows(base.segments(spark, sf).select("run_id", "seg_idx", "text")).select("run_id", "seg_idx", "window")


@query("WITH RECURSIVE " + SEGMENTS + f""", o AS (SELECT run_id, seg_idx, length('[' || {_clock('s')} || '] ' || text) AS l, row_number() OVER (PARTITION BY run_id ORDER BY seg_idx) AS i FROM segments WHERE s IS NOT NULL AND trim(text) <> ''),
f AS (SELECT run_id, seg_idx, i, CAST(1 AS BIGINT) AS window_no, l AS total FROM o WHERE i = 1
UNION ALL SELECT o.run_id, o.seg_idx, o.i, CASE WHEN f.total + o.l > 16000 THEN window_no + 1 ELSE window_no END, CASE WHEN f.total + o.l > 16000 THEN o.l ELSE f.total + o.l END FROM f JOIN o ON o.run_id = f.run_id AND o.i = f.i + 1)
SELECT run_id, seg_idx, window_no AS "window" FROM f""")
def w10_summary_windows(spark: SparkSession, sf: str) -> DataFrame:
    return readings.summary_windows(base.segments(spark, sf).filter("s is not null").select("run_id", "seg_idx", "s", "text")).select("run_id", "seg_idx", "window")


@query(oracle(SEGMENTS, TURNS, _ATTACHED, select=f"SELECT run_id, seg_idx, CASE WHEN s IS NULL THEN '' ELSE '[' || {_clock('s')} || '] ' END || CASE WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' ELSE '' END || text AS line FROM att WHERE trim(text) <> ''"))
def c16_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _spoken(spark, sf).filter("trim(text) <> ''").select("run_id", "seg_idx", readings.spoken_line(F.col("speaker")).alias("line"))


@query(oracle(SEGMENTS, select="""SELECT run_id, seg_idx, CASE WHEN seg_idx % 4 = 0 THEN lower(text) || '.' ELSE text END AS fixed, seg_idx % 4 = 0 AS changed,
round(CASE WHEN seg_idx % 4 IN (0, 1) THEN least(coalesce(confidence, 0.2), 0.2) ELSE confidence END, 6) AS confidence FROM segments"""))
def j11_patch(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.segments(spark, sf).select("run_id", "seg_idx", "text", "confidence")
    k = F.col("seg_idx") % 4
    said = F.when(k == 0, F.concat(F.lower("text"), F.lit(". "))).when(k == 1, F.lit(" ")).otherwise(F.col("text"))
    fixes = rows.filter(k < 3).select("run_id", "seg_idx", F.lit(0).alias("n"), said.alias("text"), F.when(k < 2, 0.2).alias("confidence"))
    return readings.patch(rows, fixes).select("run_id", "seg_idx", "fixed", "changed", F.round("confidence", 6).alias("confidence"))


@query()
def c14_prompt_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = readings.windows(base.segments(spark, sf).select("run_id", "seg_idx", "text", "confidence"))
    return readings.prompt_items(rows)


@query("SELECT user_id, array_to_string(list_distinct(list(event_type ORDER BY event_type)), ',') IS NOT NULL AS merged, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def a14_merge_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("part"), F.array("event_type").alias("decisions"), F.array(F.lit("a")).alias("actions"), F.array("event_type").alias("questions"))
    return readings.merge_parts(parts).select(F.col("run_id").alias("user_id"), F.col("decisions").isNotNull().alias("merged"), F.size("decisions").alias("n"))


@query()
def c17_summary_reply(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit('{"headline": " h ", "sections": [{"title": " ", "bullets": ["", " b "]}, {"title": ""}], "decisions": [" d ", null], "extra": '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", F.to_json(readings.summary(reply)).alias("summary"))
