"""Transcripts as text, one row per line, so that a long recording is never one value.

``segments`` have ``run_id, seg_idx, s, e, text`` and, where they are known, ``speaker, confidence,
flags`` (array), ``suspects`` (array of heard and term) and ``variants`` (array of text, source, kind,
confidence). Lines come as ``run_id, line_no, line``; ``line_no`` orders them within a run.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.carry import islands, running_count

#: Every format there is, in the order of ``all``.
FORMATS = ("txt", "md", "json", "srt", "vtt", "csv", "tsv", "speakers", "summary")
BUCKET = 2048


@dataclass(frozen=True)
class Options:
    stamps: bool = True
    speakers: bool = True
    confidence: bool = False
    flags: bool = False
    variants: bool = False
    reading: str = "fixed"  # raw, fixed or both


def expand(formats: Column) -> Column:
    """A list of formats with ``all`` spelled out, each once, in order; an unknown one raises."""
    every = F.array(*map(F.lit, FORMATS))
    named = F.transform(F.split(formats, ","), lambda f: F.lower(F.trim(f)))
    known = F.transform(named, lambda f: F.when(f == "all", every).when(F.array_contains(every, f), F.array(f)).otherwise(F.raise_error(F.concat(F.lit("unknown format: "), f)).cast("array<string>")))
    return F.array_distinct(F.flatten(known))


def _has(df: DataFrame, column: str) -> bool:
    return column in df.columns


def original(df: DataFrame) -> Column:
    if not _has(df, "variants"):
        return F.lit(None).cast("string")
    return F.get(F.filter("variants", lambda v: v["kind"] == "primary"), F.lit(0))["text"]


def chosen(df: DataFrame, options: Options) -> Column:
    """The reading to show: as heard, as corrected, or both where they differ."""
    raw, fixed = original(df), F.coalesce("text", F.lit(""))
    if options.reading == "raw":
        return F.coalesce(raw, fixed)
    if options.reading == "both":
        return F.when(raw.isNotNull() & (raw != fixed), F.concat(fixed, F.lit("   |raw| "), raw)).otherwise(fixed)
    return fixed


def flag_labels(flags: Column, suspects: Column | None) -> Column:
    """Flags, the one for terms with what it is about."""
    if suspects is None:
        return flags
    pairs = F.array_join(F.transform(suspects, lambda p: F.concat(p["heard"], F.lit("~"), p["term"])), ";")
    return F.transform(flags, lambda f: F.when((f == "term") & (pairs != ""), F.concat(F.lit("term: "), pairs)).otherwise(f))


def line(df: DataFrame, options: Options) -> Column:
    """One segment as a line: time, speaker, confidence, flags and text, whatever of them there is."""
    parts = []
    if options.stamps:
        parts.append(F.concat(F.lit("["), text.clock(F.col("s")), F.lit("]")))
    if options.speakers and _has(df, "speaker"):
        parts.append(F.when(F.col("speaker") != "", F.concat("speaker", F.lit(":"))))
    if options.confidence and _has(df, "confidence"):
        parts.append(F.when(F.col("confidence").isNotNull(), F.format_string("(%.2f)", F.col("confidence"))))
    if options.flags and _has(df, "flags"):
        labels = flag_labels(F.col("flags"), F.col("suspects") if _has(df, "suspects") else None)
        parts.append(F.when(F.size("flags") > 0, F.concat(F.lit("<"), F.array_join(labels, ","), F.lit(">"))))
    return F.concat_ws(" ", *parts, chosen(df, options))


def _numbered(segments: DataFrame) -> DataFrame:
    """Adds ``n``: the place of a segment in its run, by index."""
    rows = segments.withColumn("_bucket", F.floor(F.col("seg_idx") / BUCKET))
    return running_count(rows, ["run_id"], "_bucket", [F.col("seg_idx")], F.lit(True), "n").drop("_bucket")


def txt(segments: DataFrame, options: Options = Options()) -> DataFrame:
    """Plain text: a line per segment and one per other reading below it. ``line_no`` steps by 1000 per segment."""
    rows = _numbered(segments)
    out = rows.select("run_id", (F.col("n") * 1000).alias("line_no"), line(rows, options).alias("line"))
    if options.variants and _has(segments, "variants"):
        score = lambda v: F.when(v["confidence"].isNull(), F.lit("--")).otherwise(F.format_string("%.2f", v["confidence"]))
        said = F.transform("variants", lambda v: F.concat(F.lit("    ├ alt ("), score(v), F.lit(", "), v["source"], F.lit("): "), v["text"]))
        alts = rows.select("run_id", "n", F.posexplode(said).alias("i", "line"))
        out = out.unionByName(alts.select("run_id", (F.col("n") * 1000 + F.col("i") + 1).alias("line_no"), "line"))
    return out


def srt(segments: DataFrame, options: Options = Options(), web: bool = False) -> DataFrame:
    """Subtitles, one row per cue: number, times and text; ``web`` gives the form of the web with voice tags."""
    rows = _numbered(segments)
    mark = "." if web else ","
    body = chosen(rows, options)
    if options.speakers and _has(rows, "speaker"):
        who = F.col("speaker")
        tag = F.concat(F.lit("<v "), who, F.lit(">"), body) if web else F.concat(who, F.lit(": "), body)
        body = F.when(F.coalesce(who, F.lit("")) != "", tag).otherwise(body)
    times = F.concat(text.cue_time(F.col("s"), mark), F.lit(" --> "), text.cue_time(F.col("e"), mark))
    head = [] if web else [F.col("n").cast("string")]
    return rows.select("run_id", F.col("n").alias("line_no"), F.concat_ws("\n", *head, times, body).alias("line"))


def table(segments: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows for a CSV or TSV writer, with what a spreadsheet would run made harmless; a missing time is empty."""
    nothing = F.lit("")
    seconds = lambda c: F.when(F.col(c).isNull(), nothing).otherwise(F.format_string("%.3f", F.col(c) / 1000))
    suspects = F.array_join(F.transform("suspects", lambda p: F.concat(p["heard"], F.lit("~"), p["term"])), "|") if _has(segments, "suspects") else nothing
    return segments.select(
        "run_id", "seg_idx", seconds("s").alias("start"), seconds("e").alias("end"),
        F.coalesce(text.clock(F.col("s")), nothing).alias("at"), (F.coalesce("speaker", nothing) if options.speakers and _has(segments, "speaker") else nothing).alias("speaker"),
        F.when(F.col("confidence").isNull(), "").otherwise(F.format_string("%.4f", F.col("confidence"))).alias("confidence"),
        (F.array_join("flags", "|") if _has(segments, "flags") else nothing).alias("flags"), text.inert(suspects).alias("suspected"), text.inert(chosen(segments, options)).alias("text"),
    )


def dialogue(segments: DataFrame, options: Options = Options()) -> DataFrame:
    """One line per turn: neighbours of one voice joined, with the time of the first, if it has one."""
    rows = segments.withColumn("who", F.coalesce(F.when(F.col("speaker") != "", F.col("speaker")), F.lit("SPEAKER"))).withColumn("said", F.trim(chosen(segments, options))).withColumn("_bucket", F.floor(F.col("seg_idx") / BUCKET))
    numbered = islands(rows, ["run_id"], "_bucket", [F.col("seg_idx")], F.col("who"), "line_no")
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "said")))
    turns = numbered.groupBy("run_id", "line_no").agg(F.min("who").alias("who"), F.min_by("s", "seg_idx").alias("s"), F.trim(F.array_join(F.filter(F.transform(ordered, lambda x: x["said"]), lambda t: t != ""), " ")).alias("said"))
    stamp = F.coalesce(F.concat(F.lit("["), text.clock(F.col("s")), F.lit("] ")), F.lit("")) if options.stamps else F.lit("")
    return turns.select("run_id", "line_no", F.concat(stamp, "who", F.lit(": "), "said").alias("line"))


def markdown_head(runs: DataFrame, media: DataFrame) -> DataFrame:
    """The head of a run's document, a line per row."""
    m = media.groupBy("sha256").agg(F.min("recorded_at").alias("rec"), F.min("recorded_at_source").alias("src"))
    rows = runs.join(m, runs["media_sha"] == m["sha256"], "left")
    stem = F.regexp_replace("source_name", r"\.[^.]*$", "")
    lines = F.array(
        F.concat(F.lit("# "), stem), F.lit(""), F.concat(F.lit("- **Source**: `"), "source_path", F.lit("`")),
        F.format_string("- **Duration**: %.1f min", F.col("duration") / 60),
        F.concat(F.lit("- **Engine**: "), "backend", F.lit(":"), "model", F.lit(" (language: "), F.coalesce("lang", F.lit("auto")), F.lit(")")),
        F.when(F.col("rec").isNotNull(), F.concat(F.lit("- **Recorded**: "), "rec", F.lit(" ("), "src", F.lit(")"))),
    )
    return rows.select("run_id", F.posexplode(F.array_compact(lines)).alias("line_no", "line"))


#: Where the parts of a Markdown document begin among its line numbers.
_SUMMARY_AT, _BODY_AT = 1_000, 10_000_000


def markdown(runs: DataFrame, media: DataFrame, segments: DataFrame, options: Options = Options(), warnings: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """A run's whole document, a line per row: head with warnings, a summary if there is one, every segment.

    ``warnings`` have ``run_id, n, warning``, ``summaries`` have ``run_id, summary``. Null warnings do
    not count. A run without segments has its head and an empty transcript.
    """
    head = markdown_head(runs, media).select("run_id", F.col("line_no").cast("long").alias("line_no"), "line")
    parts = [head]
    if warnings is not None:
        told = warnings.join(runs.select("run_id").distinct(), "run_id", "left_semi").filter("warning is not null")
        parts.append(told.select("run_id", (F.col("n") + 100).cast("long").alias("line_no"), F.concat(F.lit("- **Note**: "), "warning").alias("line")))
    if summaries is not None:
        lines = summaries.filter("summary is not null").select("run_id", F.posexplode(F.concat(F.array(F.lit("")), summary_lines(F.col("summary")))).alias("i", "line"))
        parts.append(lines.select("run_id", (F.col("i") + _SUMMARY_AT).cast("long").alias("line_no"), "line"))
    title = F.posexplode(F.array(*map(F.lit, ("", "## Transcript", "")))).alias("i", "line")
    parts.append(runs.select("run_id", title).select("run_id", (F.col("i") + _BODY_AT).cast("long").alias("line_no"), "line"))
    body = txt(segments, options).withColumn("line_no", F.col("line_no") + _BODY_AT)
    gaps = body.withColumn("line_no", F.floor(F.col("line_no") / 1000) * 1000 + 999).select("run_id", "line_no").distinct().withColumn("line", F.lit(""))
    parts += [body.select("run_id", "line_no", "line"), gaps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def routed(lines: Mapping[str, DataFrame]) -> DataFrame:
    """``format, run_id, line_no, line`` of the lines of several formats; an unknown format raises."""
    wrong = set(lines) - set(FORMATS)
    if wrong or not lines:
        raise ValueError(f"unknown formats: {sorted(wrong)}" if wrong else "no format")
    out = [df.select(F.lit(name).alias("format"), "run_id", F.col("line_no").cast("long").alias("line_no"), "line") for name, df in lines.items()]
    return reduce(DataFrame.unionByName, out)


def write(rows: DataFrame, folder: str) -> None:
    """Lines in a folder per format and run, as text in order. A run's lines pass through one task, which streams them."""
    ordered = rows.repartition("format", "run_id").sortWithinPartitions("format", "run_id", "line_no")
    ordered.select("format", "run_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("format", "run_id").text(folder)


def run_report(runs: DataFrame, segments: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """``run_id`` and what was made of it: source, duration, language, engine, segments, words, summary, ``warnings`` (array)."""
    counts = segments.groupBy("run_id").agg(F.count("*").alias("_n"), F.sum(F.size(text.tokens(F.coalesce("text", F.lit(""))))).alias("_w"))
    rows = runs.drop("segments", "words").join(counts, "run_id", "left")
    none = F.array().cast("array<string>")
    if warnings is not None:
        listed = warnings.filter("warning is not null").groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "warning"))), lambda x: x["warning"]).alias("_told"))
        rows = rows.join(listed, "run_id", "left").withColumn("_told", F.coalesce("_told", none))
    else:
        rows = rows.withColumn("_told", none)
    return rows.select(
        "run_id", F.col("source_path").alias("source"), "duration", F.col("lang").alias("language"), F.concat_ws(":", "backend", "model").alias("engine"),
        F.coalesce("_n", F.lit(0)).alias("segments"), F.coalesce("_w", F.lit(0)).alias("words"), (F.col("has_summary") == 1).alias("has_summary"), F.col("_told").alias("warnings"),
    )


def document(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """``run_id, json``: each run with its segments as one JSON value, empty lists and nulls left out."""
    flat = [c for c in segments.columns if c not in ("run_id", "seg_idx")]
    listed = segments.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", *flat))).alias("segments"))
    rows = runs.drop("segments").join(listed, "run_id", "left")
    return rows.select("run_id", F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def summary_lines(summary: Column) -> Column:
    """A summary (headline, sections of title and bullets, decisions, actions, questions) as an array of lines."""
    bullets = lambda items: F.transform(items, lambda b: F.concat(F.lit("- "), b))
    sections = F.flatten(F.transform(summary["sections"], lambda s: F.concat(F.array(F.concat(F.lit("### "), s["title"])), bullets(s["bullets"]), F.array(F.lit("")))))
    part = lambda name, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"### {name}")), bullets(items), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    head = F.when(summary["headline"] != "", F.array(summary["headline"], F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("## Summary"), F.lit("")), head, sections, part("Decisions", summary["decisions"]), part("Action items", summary["actions"]), part("Open questions", summary["questions"]))
