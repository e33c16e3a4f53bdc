"""Queries over spans, turns and segments: intervals, islands, joins by time, cleaning, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import phrases, text
from tidemark.operators import cleaning, confidence, overlap, voice
from tidemark.operators.carry import islands
from tidemark.plans import base
from tidemark.plans.base import SEGMENTS, SPANS, TURNS, oracle
from tidemark.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its oracle if SQL can say it."""

    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- islands ---------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM x)
SELECT user_id, CAST(turn_no AS BIGINT) AS turn_no, min(event_type) AS event_type, epoch_us(min(ts)) AS start_us, count(*) AS n FROM y GROUP BY user_id, turn_no""")
def w03_event_turns(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", us.alias("us"))
    rows = events.withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    numbered = islands(rows, ["user_id"], "day", [F.col("us"), F.col("event_id")], F.col("event_type"), "turn_no")
    return numbered.groupBy("user_id", "turn_no").agg(F.min("event_type").alias("event_type"), F.min("us").alias("start_us"), F.count("*").alias("n"))


@query(oracle(TURNS, "o AS (SELECT *, coalesce(speaker, 'SPEAKER') AS who FROM t WHERE s IS NOT NULL)", """x AS (SELECT *, CASE WHEN who IS DISTINCT FROM lag(who) OVER (PARTITION BY run_id ORDER BY s, turn_idx) THEN 1 ELSE 0 END AS b FROM o)""",
    "y AS (SELECT *, sum(b) OVER (PARTITION BY run_id ORDER BY s, turn_idx ROWS UNBOUNDED PRECEDING) AS k FROM x)",
    select="SELECT run_id, CAST(k AS BIGINT) AS turn_no, min(who) AS speaker, min(s) AS s, count(*) AS n FROM y GROUP BY run_id, k"))
def w03_speaker_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.turns(spark, sf).filter("s is not null").withColumn("who", F.coalesce("speaker", F.lit("SPEAKER"))).withColumn("bucket", F.floor(F.col("s") / voice.BUCKET))
    numbered = islands(rows, ["run_id"], "bucket", [F.col("s"), F.col("turn_idx")], F.col("who"), "turn_no")
    return numbered.groupBy("run_id", "turn_no").agg(F.min("who").alias("speaker"), F.min("s").alias("s"), F.count("*").alias("n"))


@query(oracle(TURNS, "f AS (SELECT run_id, speaker, min(s) AS s, min(turn_idx) AS i FROM t WHERE speaker IS NOT NULL AND s IS NOT NULL GROUP BY run_id, speaker)",
    select="SELECT run_id, speaker, 'S' || row_number() OVER (PARTITION BY run_id ORDER BY s, i) AS name FROM f"))
def w04_friendly_names(spark: SparkSession, sf: str) -> DataFrame:
    first = base.turns(spark, sf).filter("speaker is not null and s is not null").groupBy("run_id", "speaker").agg(F.min("s").alias("s"), F.min("turn_idx").alias("i"))
    rank = F.row_number().over(W.partitionBy("run_id").orderBy("s", "i"))
    return first.select("run_id", "speaker", F.concat(F.lit("S"), rank.cast("string")).alias("name"))


@query("""WITH y AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS b FROM events),
z AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM y),
g AS (SELECT *, count(*) OVER (PARTITION BY user_id, k) AS c, min(event_id) OVER (PARTITION BY user_id, k) AS f FROM z)
SELECT user_id, event_id, event_type FROM g WHERE c >= 3 AND event_id > f""")
def w05_echoes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seg_idx"), F.col("event_type").alias("text"))
    return cleaning.echoes(rows).filter("echo").select(F.col("run_id").alias("user_id"), F.col("seg_idx").alias("event_id"), F.col("text").alias("event_type"))


@query()
def w05_document_echoes(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"))
    return cleaning.echoes(lines).filter("echo").select(F.col("run_id").alias("doc_id"), F.col("seg_idx").alias("line_no"), "text")


@query("""WITH x AS (SELECT *, value > 100 AS loud, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
y AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, loud ORDER BY i) AS g FROM x)
SELECT user_id, coalesce(max(c), 0) * 100 AS sustained_ms FROM (SELECT user_id, CASE WHEN loud THEN count(*) ELSE 0 END AS c FROM y GROUP BY user_id, loud, g) GROUP BY user_id""")
def w06_sustained(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("user_id", "event_id", us.alias("us"), (F.col("value") > 100).alias("loud")).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    numbered = islands(rows, ["user_id"], "day", [F.col("us"), F.col("event_id")], F.col("loud"), "island")
    runs = numbered.groupBy("user_id", "island").agg(F.count_if("loud").alias("n"))
    return runs.groupBy("user_id").agg((F.max("n") * 100).alias("sustained_ms"))


# --- voice activity --------------------------------------------------------------------------

_MERGED = """d AS (SELECT run_id, CAST(round(min(duration) * 1000) AS BIGINT) AS duration FROM runs GROUP BY run_id),
c AS (SELECT sp.run_id, span_idx, s AS raw, greatest(s, 0) AS s, least(e, duration) AS e FROM sp LEFT JOIN d ON sp.run_id = d.run_id WHERE e > s),
m AS (SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY raw, span_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 800 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY raw, span_idx ROWS UNBOUNDED PRECEDING) AS k FROM m),
mg AS (SELECT run_id, min(s) AS s, max(e) AS e FROM n GROUP BY run_id, k HAVING max(e) - min(s) >= 250)"""
_SPLIT = "ct AS (SELECT run_id, s + k * 600000 AS s, least(e, s + (k + 1) * 600000) AS e FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((e - s) / 600000.0) AS BIGINT), 1))) AS k FROM mg))"


def _duration(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "runs").groupBy("run_id").agg(F.round(F.min("duration") * 1000).cast("long").alias("duration"))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return voice.merge_spans(base.spans(spark, sf).join(_duration(spark, sf), "run_id", "left"))


@query(oracle(SPANS, _MERGED, select="SELECT * FROM mg"))
def w01_merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


@query(oracle(SPANS, _MERGED, _SPLIT, select="SELECT * FROM ct"))
def w02_split_long(spark: SparkSession, sf: str) -> DataFrame:
    return voice.split_long(_merged(spark, sf))


@query(oracle(SPANS, _MERGED, select="""SELECT run_id, sum(e - s) AS covered_ms, round(CASE WHEN min(d.duration) > 0 THEN sum(e - s) / min(d.duration) ELSE 1 END, 6) AS share
FROM mg JOIN d USING (run_id) GROUP BY run_id"""))
def a01_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _merged(spark, sf).groupBy("run_id").agg(F.sum(F.col("e") - F.col("s")).alias("covered_ms")).join(_duration(spark, sf), "run_id")
    return rows.select("run_id", "covered_ms", F.round(voice.speech_share(F.col("covered_ms"), F.col("duration")), 6).alias("share"))


@query()
def c28_vad_line(spark: SparkSession, sf: str) -> DataFrame:
    rows = _merged(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("c")).join(_duration(spark, sf), "run_id")
    return rows.select("run_id", voice.describe(F.col("n"), F.col("c"), F.col("duration")).alias("line"))


_SILENCES = """si AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY s, span_idx) AS i, s, CASE WHEN span_idx % 7 = 6 THEN NULL ELSE e END AS e FROM sp WHERE e > s),
d AS (SELECT run_id, CAST(round(min(duration) * 1000) AS BIGINT) AS duration FROM runs GROUP BY run_id)"""


@query(oracle(SPANS, _SILENCES, """y AS (SELECT si.run_id, i, s, duration, coalesce(e, duration) AS en, lag(coalesce(e, duration), 1, 0) OVER (PARTITION BY si.run_id ORDER BY i) AS cur FROM si JOIN d ON si.run_id = d.run_id)""",
    select="""SELECT run_id, greatest(cur - 150, 0) AS s, s + 150 AS e FROM y WHERE s > cur
UNION ALL SELECT run_id, greatest(c - 150, 0), du FROM (SELECT run_id, arg_max(en, i) AS c, max(duration) AS du FROM y GROUP BY run_id) WHERE c < du"""))
def w07_invert_silence(spark: SparkSession, sf: str) -> DataFrame:
    spans = base.spans(spark, sf).filter("e > s")
    i = F.row_number().over(W.partitionBy("run_id").orderBy("s", "span_idx"))
    silences = spans.select("run_id", i.alias("silence_idx"), "s", F.when(F.col("span_idx") % 7 != 6, F.col("e")).alias("e"))
    return voice.invert(silences.join(_duration(spark, sf), "run_id"), 150)


_BATCHED = """o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s, e) AS i FROM ct),
b AS (SELECT run_id, i, s, e, 1 AS batch, e - s AS total FROM o WHERE i = 1
 UNION ALL SELECT o.run_id, o.i, o.s, o.e, CASE WHEN b.total + (o.e - o.s) > 480000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.total + (o.e - o.s) > 480000 THEN o.e - o.s ELSE b.total + (o.e - o.s) END
 FROM b JOIN o ON b.run_id = o.run_id AND o.i = b.i + 1)"""


@query("WITH RECURSIVE " + ",\n".join([SPANS, _MERGED, _SPLIT, _BATCHED]) + " SELECT run_id, s, e, CAST(batch AS BIGINT) AS batch FROM b")
def w08_batches(spark: SparkSession, sf: str) -> DataFrame:
    return voice.batches(voice.split_long(_merged(spark, sf)))


_PIECES = """pc AS (SELECT run_id, batch, row_number() OVER (PARTITION BY run_id, batch ORDER BY s, e) AS piece, greatest(s - 150, 0) AS src, e + 150 - greatest(s - 150, 0) AS len FROM b),
pieces AS (SELECT run_id, CAST(batch AS BIGINT) AS batch, CAST(piece AS INTEGER) AS piece, CAST(coalesce(sum(len + 200) OVER (PARTITION BY run_id, batch ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_s, len, src AS source_s FROM pc)"""


@query("WITH RECURSIVE " + ",\n".join([SPANS, _MERGED, _SPLIT, _BATCHED, _PIECES]) + " SELECT run_id, batch, piece, chunk_s, chunk_s + len AS chunk_e, source_s FROM pieces")
def w13_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return voice.pieces(voice.batches(voice.split_long(_merged(spark, sf))))


@query("WITH RECURSIVE " + ",\n".join([SPANS, _MERGED, _SPLIT, _BATCHED, _PIECES]) + """,
p2 AS (SELECT *, chunk_s + len AS chunk_e FROM pieces),
q AS (SELECT run_id, batch, unnest(range(0, 600000, 7777)) AS t FROM (SELECT DISTINCT run_id, batch FROM p2)),
l AS (SELECT run_id, batch, max(source_s + len) FILTER (piece = mp) AS fin FROM (SELECT *, max(piece) OVER (PARTITION BY run_id, batch) AS mp FROM p2) GROUP BY run_id, batch),
h AS (SELECT q.run_id, q.batch, q.t, arg_min(source_s + greatest(q.t - chunk_s, 0), piece) AS a FROM q JOIN p2 ON q.run_id = p2.run_id AND q.batch = p2.batch AND q.t <= chunk_e GROUP BY ALL)
SELECT q.run_id, q.batch, q.t, coalesce(a, fin) AS source_ms FROM q JOIN l USING (run_id, batch) LEFT JOIN h USING (run_id, batch, t)""")
def j06_to_source(spark: SparkSession, sf: str) -> DataFrame:
    pieces = voice.pieces(voice.batches(voice.split_long(_merged(spark, sf))))
    points = pieces.select("run_id", "batch").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(599_999), F.lit(7777)).cast("array<bigint>")))
    return overlap.to_source(points, pieces)


_RANGES = "rg AS (SELECT run_id, CAST(batch AS BIGINT) AS batch, min(greatest(s - 150, 0)) AS f, max(e + 150) AS u FROM b GROUP BY run_id, batch)"


def _in_batches(spark: SparkSession, sf: str) -> DataFrame:
    pieces = voice.pieces(voice.batches(voice.split_long(_merged(spark, sf))))
    end = F.col("source_s") + F.col("chunk_e") - F.col("chunk_s")
    ranges = pieces.groupBy("run_id", "batch").agg(F.min("source_s").alias("from_ms"), F.max(end).alias("to_ms"))
    return overlap.within(base.segments(spark, sf), ranges)


@query("WITH RECURSIVE " + ",\n".join([SPANS, _MERGED, _SPLIT, _BATCHED, _RANGES, SEGMENTS]) + " SELECT g.run_id, g.seg_idx, batch FROM segments g JOIN rg ON g.run_id = rg.run_id AND f <= g.s AND g.s < u")
def j07_segment_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _in_batches(spark, sf).select("run_id", "seg_idx", "batch")


@query("WITH RECURSIVE " + ",\n".join([SPANS, _MERGED, _SPLIT, _BATCHED, _RANGES, SEGMENTS]) + r""", k AS (SELECT g.*, batch FROM segments g JOIN rg ON g.run_id = rg.run_id AND f <= g.s AND g.s < u)
SELECT run_id, batch FROM k GROUP BY run_id, batch HAVING regexp_matches(trim(arg_min(text, (s, seg_idx))), '^\p{Ll}') OR count(*) FILTER (coalesce(confidence, 1.0) < 0.3) >= greatest(1, count(*) // 5)""")
def p06_suspect_batches(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.suspects(_in_batches(spark, sf), 0.3)


# --- joins by overlap ------------------------------------------------------------------------

_SILENCE = """cv AS (SELECT g.run_id, g.seg_idx, sum(least(g.e, sp.e) - greatest(g.s, sp.s)) AS c FROM segments g JOIN sp ON g.run_id = sp.run_id AND sp.s < g.e AND g.s < sp.e AND sp.e > sp.s AND g.e > g.s GROUP BY g.run_id, g.seg_idx),
sil AS (SELECT g.*, CASE WHEN g.run_id IN (SELECT run_id FROM sp) AND g.e > g.s THEN greatest(0.0, 1 - coalesce(c, 0) / (g.e - g.s)) ELSE 0.0 END AS silence FROM segments g LEFT JOIN cv USING (run_id, seg_idx))"""


def _silent(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.outside_share(base.segments(spark, sf).drop("words"), base.spans(spark, sf))


@query(oracle(SEGMENTS, SPANS, _SILENCE, select="SELECT run_id, seg_idx, round(silence, 6) AS silence FROM sil"))
def j01_silence_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _silent(spark, sf).select("run_id", "seg_idx", F.round("silence", 6).alias("silence"))


_ATTACHED = """pr AS (SELECT g.run_id, g.seg_idx, t.turn_idx, t.speaker, least(g.e, t.e) - greatest(g.s, t.s) AS o FROM segments g JOIN t ON g.run_id = t.run_id AND t.s < g.e AND g.s < t.e AND t.e > t.s AND g.e > g.s),
bs AS (SELECT *, row_number() OVER (PARTITION BY run_id, seg_idx ORDER BY o DESC, turn_idx) AS k FROM pr),
att AS (SELECT g.*, bs.speaker FROM segments g LEFT JOIN bs ON g.run_id = bs.run_id AND g.seg_idx = bs.seg_idx AND k = 1)"""


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.attach(base.segments(spark, sf), base.turns(spark, sf))


@query(oracle(SEGMENTS, TURNS, _ATTACHED, select="SELECT run_id, seg_idx, speaker FROM att"))
def j02_attach_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return _spoken(spark, sf).select("run_id", "seg_idx", "speaker")


_SECOND = """alt AS (SELECT run_id, seg_idx, s + (seg_idx % 4) * 400 AS s, e + (seg_idx % 3) * 300 AS e, CASE WHEN seg_idx % 2 = 0 THEN lower(text) ELSE text || ' again' END AS text, confidence FROM segments WHERE seg_idx % 5 <> 4),
ov AS (SELECT a.run_id, a.seg_idx AS alt_idx, g.seg_idx, a.e - a.s AS len, g.e - g.s AS plen, least(a.e, g.e) - greatest(a.s, g.s) AS o FROM alt a JOIN segments g ON a.run_id = g.run_id AND a.s < g.e AND g.s < a.e AND a.e > a.s AND g.e > g.s),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, alt_idx ORDER BY o DESC, seg_idx) AS k FROM ov),
asg AS (SELECT run_id, alt_idx, max(seg_idx) FILTER (k = 1) AS seg_idx FROM rk GROUP BY run_id, alt_idx
 HAVING max(o) > 0.5 * greatest(200, max(len)) AND count(*) FILTER (k > 1 AND o > 0.4 * greatest(200, plen)) = 0)"""


def _second(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    primary = base.segments(spark, sf).drop("words")
    i = F.col("seg_idx")
    shifted = primary.filter(i % 5 != 4).select("run_id", "seg_idx", (F.col("s") + i % 4 * 400).alias("s"), (F.col("e") + i % 3 * 300).alias("e"), F.when(i % 2 == 0, F.lower("text")).otherwise(F.concat("text", F.lit(" again"))).alias("text"), "confidence")
    return primary, shifted


@query(oracle(SEGMENTS, _SECOND, select="SELECT * FROM asg"))
def j03_assign_passes(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.assign(*_second(spark, sf))


@query(oracle(SEGMENTS, _SECOND, select="""SELECT asg.run_id, asg.seg_idx, string_agg(trim(alt.text), ' ' ORDER BY alt_idx) AS reading,
round(sum(CASE WHEN confidence IS NOT NULL THEN greatest(e - s, 0) * confidence END) / nullif(sum(CASE WHEN confidence IS NOT NULL THEN greatest(e - s, 0) END), 0), 6) AS confidence
FROM asg JOIN alt ON asg.run_id = alt.run_id AND asg.alt_idx = alt.seg_idx WHERE trim(alt.text) <> '' GROUP BY asg.run_id, asg.seg_idx"""))
def a04_second_readings(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.second_readings(*_second(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(oracle(SEGMENTS, _SECOND, """rd AS (SELECT asg.run_id, asg.seg_idx, string_agg(trim(alt.text), ' ' ORDER BY alt_idx) AS reading FROM asg JOIN alt ON asg.run_id = alt.run_id AND asg.alt_idx = alt.seg_idx GROUP BY ALL)""",
    select=r"""SELECT run_id, seg_idx, reading FROM rd JOIN segments USING (run_id, seg_idx)
WHERE regexp_extract_all(replace(lower(reading), 'ß', 'ss'), '[\p{L}\p{N}_]+') <> regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')"""))
def j03_merge_parallel(spark: SparkSession, sf: str) -> DataFrame:
    primary, second = _second(spark, sf)
    found = overlap.second_readings(primary, second).drop("confidence").join(primary, ["run_id", "seg_idx"])
    return found.filter(~text.same_words(F.col("reading"), F.col("text"))).select("run_id", "seg_idx", "reading")


# --- cleaning --------------------------------------------------------------------------------


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(rf"WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT line FROM l WHERE regexp_matches(line, '{_sql(phrases.SQL_ALWAYS)}')")
def p01_always(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.filter(cleaning.always(F.col("line")))


_FLAGGED = rf"""tr AS (SELECT *, regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS x, coalesce(confidence < 0.55, false) AS low, silence > 0.6 AS sil FROM sil),
fl AS (SELECT *, CASE WHEN x = '' THEN 'empty' ELSE concat_ws(',', CASE WHEN low THEN 'low-confidence' END, CASE WHEN sil THEN 'silence' END,
 CASE WHEN regexp_matches(x, '{_sql(phrases.SQL_ALWAYS)}') OR (regexp_matches(x, '{_sql(phrases.SQL_CONTEXTUAL)}') AND (low OR sil)) THEN 'hallucination' END) END AS flags FROM tr)"""


@query(oracle(SEGMENTS, SPANS, _SILENCE, _FLAGGED, select="SELECT run_id, seg_idx, flags FROM fl"))
def p03_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _silent(spark, sf)
    return rows.select("run_id", "seg_idx", F.array_join(cleaning.flags(F.col("text"), F.col("confidence"), F.col("silence")), ",").alias("flags"))


@query(oracle(SEGMENTS, SPANS, _SILENCE, _FLAGGED, select=rf"SELECT run_id, seg_idx FROM fl WHERE regexp_matches(x, '{_sql(phrases.SQL_CONTEXTUAL)}')"))
def p02_contextual_strict(spark: SparkSession, sf: str) -> DataFrame:
    return base.segments(spark, sf).filter(cleaning.contextual(text.trimmed(F.col("text")))).select("run_id", "seg_idx")


@query(oracle(SEGMENTS, SPANS, _SILENCE, _FLAGGED, select="SELECT run_id, seg_idx, CASE WHEN contains(flags, 'hallucination') THEN 'hallucination' WHEN flags = 'empty' THEN 'empty' END AS reason FROM fl WHERE contains(flags, 'hallucination') OR flags = 'empty'"))
def p04_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that the whole pass drops, echoes of a loop among them (the SQL has no echoes)."""
    return cleaning.clean(_silent(spark, sf)).select("run_id", "seg_idx", "reason").filter("reason is not null")


@query(oracle(SEGMENTS, SPANS, _SILENCE, _FLAGGED, select="SELECT run_id, count(*) FILTER (contains(flags, 'hallucination') OR flags = 'empty') AS dropped, count(*) FILTER (NOT (contains(flags, 'hallucination') OR flags = 'empty') AND low) AS flagged_low FROM fl GROUP BY run_id"))
def a08_clean_report(spark: SparkSession, sf: str) -> DataFrame:
    """Segments dropped by the whole pass, and kept ones of low confidence, by run (the SQL has no echoes)."""
    return _reported(spark, sf).drop("collapsed")


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    counts = F.count_if(F.col("reason").isNotNull()).alias("dropped"), F.count_if(F.col("reason").isNull() & F.array_contains("flags", "low-confidence")).alias("flagged_low")
    return cleaning.clean(_silent(spark, sf)).groupBy("run_id").agg(*counts, F.count_if(F.array_contains("flags", "loop")).alias("collapsed"))


@query()
def a08_clean_report_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """The report with the segments whose loop was written once, which SQL cannot find."""
    return _reported(spark, sf)


@query()
def c18_clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(_silent(spark, sf)).select("run_id", "seg_idx", "clean_text", F.array_join("flags", ",").alias("flags"), "reason")


@query()
def w15_collapse_loops(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.segments(spark, sf).select("run_id", "seg_idx", "text", cleaning.collapsed(F.col("text")).alias("collapsed"))
    return rows.filter("collapsed <> text").drop("text")


@query()
def w16_collapse_only(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.segments(spark, sf).select("run_id", "text", cleaning.collapsed(F.col("text")).alias("collapsed"))
    return rows.groupBy("run_id").agg(F.count_if(F.expr("collapsed <> text")).alias("collapsed"))


# --- confidence ------------------------------------------------------------------------------


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, round(confidence, 6) AS confidence FROM segments"))
def a02_geometric_mean(spark: SparkSession, sf: str) -> DataFrame:
    return base.segments(spark, sf).select("run_id", "seg_idx", F.round("confidence", 6).alias("confidence"))


@query("SELECT event_id, round(least(1.0, greatest(0.0, exp(value / 100 - 2))), 6) AS confidence FROM events")
def a03_from_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(confidence.from_log(F.col("value") / 100 - 2), 6).alias("confidence"))


@query(oracle(SEGMENTS, select="SELECT run_id, round(avg(confidence), 6) AS confidence FROM segments GROUP BY run_id"))
def a05_plain_mean(spark: SparkSession, sf: str) -> DataFrame:
    return base.segments(spark, sf).groupBy("run_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"))


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx FROM segments WHERE trim(text) <> '' AND (confidence IS NULL OR confidence < 0.55)"))
def p05_shaky(spark: SparkSession, sf: str) -> DataFrame:
    return base.segments(spark, sf).filter(confidence.shaky(F.col("text"), F.col("confidence"))).select("run_id", "seg_idx")


@query(oracle(SEGMENTS, select="SELECT run_id, seg_idx, worst_rank FROM (SELECT run_id, seg_idx, CAST(row_number() OVER (PARTITION BY run_id ORDER BY coalesce(confidence, 0), seg_idx) AS INTEGER) AS worst_rank FROM segments WHERE trim(text) <> '' AND (confidence IS NULL OR confidence < 0.55)) WHERE worst_rank <= 60"))
def o01_worst(spark: SparkSession, sf: str) -> DataFrame:
    return confidence.worst(base.segments(spark, sf).drop("words")).select("run_id", "seg_idx", "worst_rank")


@query("""SELECT run_id, turn_idx AS seg_idx, string_agg(text, '|' ORDER BY p IS NULL, -coalesce(p, 0), word_idx) AS ranked
FROM (SELECT DISTINCT run_id, turn_idx, word_idx, text, p FROM words WHERE turn_idx IS NOT NULL) GROUP BY run_id, turn_idx""")
def o03_by_confidence(spark: SparkSession, sf: str) -> DataFrame:
    readings = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["p"].alias("confidence")))
    return base.segments(spark, sf).select("run_id", "seg_idx", F.array_join(confidence.by_confidence(readings)["text"], "|").alias("ranked"))


@query(oracle(SEGMENTS, select="""SELECT run_id, seg_idx, round(c, 6) AS confidence, coalesce(c < 0.55, false) AS low FROM (
SELECT *, CASE WHEN seg_idx % 3 = 0 THEN confidence ELSE least(confidence, (seg_idx % 11) / 10.0) END AS c FROM segments)"""))
def f19_absorb(spark: SparkSession, sf: str) -> DataFrame:
    stated = F.when(F.col("seg_idx") % 3 != 0, F.col("seg_idx") % 11 / 10.0)
    rows = base.segments(spark, sf).withColumn("c", confidence.absorb(F.col("confidence"), stated))
    return rows.select("run_id", "seg_idx", F.round("c", 6).alias("confidence"), F.coalesce(F.col("c") < confidence.FLOOR, F.lit(False)).alias("low"))


@query("""SELECT user_id, least(greatest(least(m - 8, p - 25), -55.0), -22.0) AS floor_db FROM (SELECT user_id, round(-avg(value) / 10, 3) AS m, round(-min(value) / 10, 3) AS p FROM events GROUP BY user_id)""")
def a11_noise_floor(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.round(-F.avg("value") / 10, 3).alias("m"), F.round(-F.min("value") / 10, 3).alias("p"))
    return rows.select("user_id", voice.noise_floor(F.col("m"), F.col("p")).alias("floor_db"))


