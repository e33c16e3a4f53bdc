"""Queries of the rules over settings, of whole documents and of passes that are composed of several operators.

No table holds settings, so each run's are made of its columns, in the queries and in their SQL alike.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import overlap, plugins, readings, render, settings, store
from tidemark.plans import base
from tidemark.plans.base import RUNS, SEGMENTS, oracle
from tidemark.plans.speech import _in_batches
from tidemark.session import table
from tidemark.sources import logs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_MODES, _COMPARE = ("off", "short", "full"), ("off", "auto", "always")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), F.col(by) % 3 + 1)
    return base.runs(spark, sf).select(
        "run_id", "backend", "model", "lang", pick(_MODES, "words").alias("context"), pick(_COMPARE, "segments").alias("compare"), (F.col("has_summary") == 1).alias("fix"),
        (F.col("has_speakers") == 1).alias("chosen"), (F.col("words") % 2 == 0).alias("dictionary"), (F.col("segments") % 2 == 0).alias("bias"), (F.col("segments") % 3).alias("extra"),
    )


_ASKED = """st AS (SELECT run_id, backend, model, lang, ['off', 'short', 'full'][words % 3 + 1] AS context, ['off', 'auto', 'always'][segments % 3 + 1] AS compare, has_summary = 1 AS fix,
has_speakers = 1 AS chosen, words % 2 = 0 AS dictionary, segments % 2 = 0 AS bias, segments % 3 AS extra FROM r)"""


@query(oracle(RUNS, _ASKED, select="SELECT run_id, CASE context WHEN 'off' THEN 0 WHEN 'short' THEN 64 ELSE 224 END AS tokens FROM st"))
def f20_context_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("run_id", settings.context_tokens(F.col("context")).alias("tokens"))


@query(oracle(RUNS, _ASKED, select="SELECT run_id, CASE WHEN compare = 'off' AND fix AND NOT chosen THEN 'auto' ELSE compare END AS mode FROM st"))
def c08_compare_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("run_id", settings.compare_mode(F.col("compare"), F.col("fix"), F.col("chosen")).alias("mode"))


@query(oracle(RUNS, _ASKED, select="SELECT run_id, CASE WHEN extra = 0 AND fix AND NOT chosen THEN 1 ELSE extra END AS decodes FROM st"))
def c09_extra_decodes(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("run_id", settings.extra_decodes(F.col("extra"), F.col("chosen").cast("int"), F.col("fix")).alias("decodes"))


_ENGINES = [("mlx", False, True, False), ("whispercpp", True, True, True)]


@query(oracle(RUNS, "n AS (SELECT DISTINCT backend || ':' || model AS name FROM r)", "u AS (SELECT backend || ':' || model AS name FROM r GROUP BY ALL HAVING count(*) > 1)", select="""SELECT n.name, u.name IS NULL AS skipped,
CASE WHEN u.name IS NULL THEN 'cross-check ' || n.name || ' skipped: unavailable' END AS warning FROM n LEFT JOIN u ON n.name = u.name"""))
def c12_cross_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Engines and models that runs name, checked against those that more than one run used."""
    named = base.runs(spark, sf).select(F.concat_ws(":", "backend", "model").alias("name"))
    return settings.cross_checks(named.distinct(), named.groupBy("name").count().filter("count > 1"))


@query(oracle(RUNS, _ASKED, select="""SELECT run_id, CASE WHEN backend = 'mlx' AND context = 'short' THEN 'full' WHEN backend = 'whispercpp' AND context = 'off' AND compare = 'off' AND dictionary AND bias THEN 'short' ELSE context END AS context,
CASE WHEN lang IS NULL THEN 'x was unavailable' ELSE '' END AS limits FROM st"""))
def c10_settled(spark: SparkSession, sf: str) -> DataFrame:
    """The settings that each run is stored under; runs without a language asked for a cross check that nobody has."""
    engines = spark.createDataFrame(_ENGINES, "backend string, has_budget boolean, can_pin boolean, pin_costs boolean")
    rows = _asked(spark, sf).withColumn("prompt", settings.gated(F.lit("Glossary: a."), F.col("dictionary"), F.col("bias")))
    rows = rows.withColumn("skipped", F.when(F.col("lang").isNull(), F.array(F.lit("x"), F.lit("x"))))
    return settings.settled(rows, engines).select("run_id", "context", F.array_join("limits", ", ").alias("limits"))


@query(oracle(RUNS, _ASKED, select="SELECT run_id, CASE WHEN backend = 'mlx' AND dictionary AND bias THEN 'noise; mlx cannot pin the glossary' ELSE 'noise' END AS warnings FROM st"))
def c11_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings with what an engine that cannot pin left undone."""
    engines = spark.createDataFrame([("mlx", True, False, False), ("whispercpp", True, True, True)], "backend string, has_budget boolean, can_pin boolean, pin_costs boolean")
    rows = _asked(spark, sf).withColumn("prompt", settings.gated(F.lit("Glossary: a."), F.col("dictionary"), F.col("bias"))).withColumn("skipped", F.lit(None).cast("array<string>"))
    found = settings.settled(rows, engines)
    return found.select("run_id", F.array_join(settings.warned(F.array(F.lit("noise")), F.col("limits")), "; ").alias("warnings"))


@query(oracle(RUNS, _ASKED, select="SELECT run_id, CASE WHEN dictionary AND bias THEN 'Glossary: a.' ELSE '' END AS prompt FROM st"))
def c19_glossary_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("run_id", settings.gated(F.lit("Glossary: a."), F.col("dictionary"), F.col("bias")).alias("prompt"))


@query(oracle(RUNS, select="SELECT run_id, CASE WHEN words % 3 = 0 THEN 'flag' WHEN lang IS NOT NULL THEN lang ELSE 'auto' END AS language FROM r"))
def p09_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """The language that counts: a flag in every third run, else the configured one, else the default."""
    flag = F.when(F.col("words") % 3 == 0, "flag")
    return base.runs(spark, sf).select("run_id", settings.precedence(flag, F.col("lang"), F.lit("auto")).alias("language"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'mdoel' ELSE '' END AS unknown FROM events")
def t06_unknown_keys(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("mdoel"), F.lit("model"), F.lit("mdoel"))).otherwise(F.array(F.lit("backend")))
    return table(spark, sf, "events").select("event_id", F.array_join(settings.unknown_keys(given, store.KEYS), ",").alias("unknown"))


@query("SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS int_ok, false AS bool_ok, json_extract(props, '$.k') IS NOT NULL AS float_ok FROM events")
def c23_stored_types(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the stored number passes as a whole number, a truth value and a number."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", *[settings.valid_setting(k, kind).alias(f"{kind}_ok") for kind in ("int", "bool", "float")])


@query(oracle(RUNS, select="SELECT run_id, array_to_string(list_filter([CASE WHEN has_summary = 0 THEN 'summary' END, CASE WHEN has_speakers = 0 OR segments % 2 = 1 THEN 'speakers' END], lambda x: x IS NOT NULL), ',') AS missing FROM r"))
def j13_missing_enrichments(spark: SparkSession, sf: str) -> DataFrame:
    """What each run lacks of a summary and of two speakers; odd runs have three."""
    stored = F.when(F.col("has_speakers") == 1, F.when(F.col("segments") % 2 == 1, "speakers=3").otherwise("speakers=2"))
    found = settings.missing_enrichments(F.lit(True), F.col("has_summary") == 1, F.lit(True), F.lit("speakers=2"), stored)
    return base.runs(spark, sf).select("run_id", F.array_join(found, ",").alias("missing"))


@query(oracle(RUNS, _ASKED, select="SELECT run_id, chosen AND bias AS show_speakers, fix AND bias AS show_summary FROM st"))
def k15_render_gate(spark: SparkSession, sf: str) -> DataFrame:
    """What is rendered where every other call asks for it."""
    return _asked(spark, sf).select("run_id", settings.shown(F.col("bias"), F.col("chosen")).alias("show_speakers"), settings.shown(F.col("bias"), F.col("fix")).alias("show_summary"))


_SET = {"_decode_revision": f"'{store.REVISION}'", "backend": "'\"' || backend || '\"'", "model": "'\"' || model || '\"'", "language": "coalesce('\"' || lang || '\"', 'null')"}
#: A pair of the key in JSON, with the comma before it; ``context`` is there only where it is not the default.
_PAIRS = {k: f"', \"{k}\": ' || " + _SET.get(k, "'null'") for k in (*store.KEYS, "_decode_revision")}
_PAIRS["context"] = "CASE WHEN context = 'off' THEN '' ELSE ', \"context\": \"' || context || '\"' END"
_JSON = " || ".join(_PAIRS[k] for k in sorted(_PAIRS))


@query(oracle(RUNS, _ASKED, select=f"SELECT run_id, substr(sha256('{{' || substr({_JSON}, 3) || '}}'), 1, 16) AS fingerprint FROM st"))
def f12_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """The key of each run's settings: what is not set counts as null, a context only where it is not the default."""
    rows = _asked(spark, sf).withColumnRenamed("lang", "language")
    return rows.select("run_id", store.fingerprints(rows, ("backend", "model", "language", "context")).alias("fingerprint"))


@query("SELECT DISTINCT sha256, duration, container, codec, sample_rate, channels, has_video FROM media WHERE codec IS NOT NULL")
def s01_probe_json(spark: SparkSession, sf: str) -> DataFrame:
    """A probe's JSON made of each file's columns and read back."""
    streams = F.array(
        F.struct(F.when(F.col("has_video"), "video").otherwise("data").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("int").alias("channels")),
        F.struct(F.lit("audio").alias("codec_type"), F.col("codec").alias("codec_name"), F.col("sample_rate").cast("string").alias("sample_rate"), "channels"),
    )
    made = F.to_json(F.struct(F.struct(F.col("duration").cast("string").alias("duration"), F.col("container").alias("format_name")).alias("format"), streams.alias("streams")))
    rows = table(spark, sf, "media").filter("codec is not null").select("sha256", logs.probed(made).alias("p"))
    return rows.select("sha256", "p.duration", "p.container", "p.codec", "p.sample_rate", "p.channels", "p.has_video").distinct()


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, text, len(string_split(text, ' ')) AS words, 0 AS tokens FROM segments WHERE text <> ''"))
def c20_slim(spark: SparkSession, sf: str) -> DataFrame:
    """A raw decoder result with token arrays made of each segment, and what is left of it."""
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"), F.lit(0.5).alias("probability"), F.array(F.lit(1), F.lit(2)).alias("tokens")))
    raw = F.to_json(F.struct(F.lit("en").alias("language"), F.array(F.struct("text", words.alias("words"), F.array(F.lit(1), F.lit(2)).alias("tokens"))).alias("segments")))
    rows = base.segments(spark, sf).filter("text <> ''").select("run_id", "seg_idx", logs.slim(raw).alias("x"))
    return rows.select("run_id", "seg_idx", F.col("x.segments")[0]["text"].alias("text"), F.size(F.col("x.segments")[0]["words"]).alias("words"), F.when(F.contains(F.to_json("x"), F.lit('"tokens":')), 1).otherwise(0).alias("tokens"))


# --- composed passes -------------------------------------------------------------------------


@query()
def c06_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with their own words as a second reading, spellings recorded in the glossary put right: what still differs."""
    make = lambda said, kind: F.struct(said.alias("text"), F.lit("pass").alias("source"), F.lit(kind).alias("kind"), F.lit(0.5).alias("confidence"))
    rows = base.segments(spark, sf).select("run_id", "seg_idx", "text", F.array(make(F.col("text"), "primary"), make(F.upper("text"), "context"), make(F.concat("text", F.lit(" more")), "model")).alias("variants"))
    found = readings.reconcile(rows, table(spark, sf, "terms"))
    return found.select("run_id", "seg_idx", F.array_join(F.transform("variants", lambda v: v["kind"]), ",").alias("kinds"))


def _louder(row: dict, request: plugins.Request) -> list[dict]:
    """A second pass for the query: the chunk's segments again, every other one with a word more."""
    return [{"start": s["start"], "end": s["end"], "text": s["text"] + " again" * (i % 2), "confidence": 0.5} for i, s in enumerate(json.loads(row["said"] or "[]"))]


@query()
def c07_context_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged batches decoded again with the other context: where the second pass says something else."""
    placed = _in_batches(spark, sf)
    batched = placed.select("run_id", "batch", "seg_idx", "s", "e", "text", "confidence")
    item = F.struct((F.col("s") / 1000).alias("start"), (F.col("e") / 1000).alias("end"), "text")
    chunks = batched.filter("e > s").groupBy("run_id", "batch").agg(F.lit(0).alias("from_ms"), F.to_json(F.sort_array(F.collect_list(item))).alias("said"))
    found = readings.compare_context(base.segments(spark, sf).drop("words"), chunks, _louder, "auto", batched=batched)
    return found.select("run_id", "seg_idx", "text", "source", "confidence")


def _summary_model(prompt: str) -> str:
    """A language model for the query: counts the lines of a transcript, and the parts that it merges."""
    head, _, body = prompt.strip("\n").partition("\n")
    return json.dumps({"headline": f"{head} {body.count(chr(10))}", "decisions": [head[:7]]})


@query(oracle(SEGMENTS, "ln AS (SELECT run_id, seg_idx, length('[' || printf('%d:%02d:%02d', greatest(s, 0) // 3600000, (greatest(s, 0) // 60000) % 60, (greatest(s, 0) // 1000) % 60) || '] ' || text) AS l FROM segments WHERE s IS NOT NULL AND trim(text) <> '')",
    select="SELECT run_id, sum(l + 1) - 1 <= 24000 AS direct, CASE WHEN sum(l + 1) - 1 <= 24000 THEN 'Transcript: ' || (count(*) - 1) ELSE 'Partial summaries, in order, to merge into one: 0' END AS headline FROM ln GROUP BY run_id"))
def c15_summaries(spark: SparkSession, sf: str) -> DataFrame:
    found = readings.summarise(base.segments(spark, sf).filter("s is not null").select("run_id", "seg_idx", "s", "text"), _summary_model)
    return found.select("run_id", (F.col("parts") == 1).alias("direct"), F.trim("summary.headline").alias("headline"))


def _told(spark: SparkSession, sf: str) -> DataFrame:
    return base.runs(spark, sf).select("run_id", F.lit(0).alias("n"), F.when(F.col("lang").isNull(), "language unknown").alias("warning"))


@query()
def k02_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every run's document: head, warnings, a summary of the runs that have one, and all segments with their speakers."""
    runs = base.runs(spark, sf)
    reply = F.to_json(F.struct(F.col("source_name").alias("headline"), F.array(F.lit("ship it")).alias("decisions")))
    summaries = runs.filter("has_summary = 1").select("run_id", readings.summary(reply).alias("summary"))
    said = overlap.attach(base.segments(spark, sf), base.turns(spark, sf))
    return render.markdown(runs, table(spark, sf, "media"), said, render.Options(confidence=True), _told(spark, sf), summaries)


@query()
def k13_routed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of text, subtitles and dialogue in one table, by format, as a writer takes them apart."""
    said = overlap.attach(base.segments(spark, sf), base.turns(spark, sf))
    return render.routed({"txt": render.txt(said), "srt": render.srt(said.filter("s is not null and e is not null")), "speakers": render.dialogue(said)})


@query(oracle(SEGMENTS, RUNS, r"x AS (SELECT run_id, count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda t: t <> ''))) AS w FROM segments GROUP BY run_id)",
    select="SELECT r.run_id, source_path AS source, duration, lang AS language, backend || ':' || model AS engine, coalesce(n, 0) AS segments, CAST(coalesce(w, 0) AS BIGINT) AS words, has_summary = 1 AS has_summary, CASE WHEN lang IS NULL THEN 'language unknown' ELSE '' END AS warnings FROM r LEFT JOIN x ON r.run_id = x.run_id"))
def k13_run_report(spark: SparkSession, sf: str) -> DataFrame:
    found = render.run_report(base.runs(spark, sf), base.segments(spark, sf), _told(spark, sf))
    return found.withColumn("warnings", F.array_join("warnings", "; "))
