"""Other readings of a segment: which are new, which still differ, what a correction pass changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import cleaning, confidence, glossary, overlap, plugins, settings
from tidemark.operators.voice import budget, fold
from tidemark.sources import logs

#: Segments and characters of a correction window; characters of a summary window and of a text summarised at once.
WINDOW_SEGMENTS, WINDOW_CHARS, SUMMARY_CHARS, DIRECT_CHARS = 40, 6000, 16_000, 24_000


def novel(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Of ``found`` (``run_id, seg_idx, n, text``) what neither the segment nor an earlier reading says."""
    keyed = found.withColumn("_key", text.norm(F.col("text")))
    known = segments.select("run_id", "seg_idx", text.norm(F.col("text")).alias("_key"))
    fresh = keyed.join(known, ["run_id", "seg_idx", "_key"], "left_anti")
    return fresh.groupBy("run_id", "seg_idx", "_key").agg(F.min("n").alias("n"), F.min_by("text", "n").alias("text")).drop("_key")


def still_differing(variants: Column, current: Column, kinds: tuple[str, ...]) -> Column:
    """``variants`` without those of ``kinds`` that say the same words as ``current``; ``primary`` always stays."""
    return F.filter(variants, lambda v: (v["kind"] == "primary") | ~v["kind"].isin(*kinds) | ~text.same_words(v["text"], current))


def absorb_alternatives(current: Column, known: Column, offered: Column) -> Column:
    """What of ``offered`` is new by trimmed lower case, each once, in order."""
    key = lambda c: F.lower(text.trimmed(c))
    have = F.concat(F.array(key(current)), F.transform(known, key))
    clean = F.filter(F.transform(offered, text.trimmed), lambda t: (t != "") & ~F.array_contains(have, F.lower(t)))
    # the first of those that differ in case only stays
    return F.transform(F.filter(F.transform(clean, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.array_position(F.transform(clean, F.lower), F.lower(x["t"])) == x["i"] + 1), lambda x: x["t"])


def reconcile(segments: DataFrame, terms: DataFrame, kinds: tuple[str, ...] = ("context", "temperature", "model")) -> DataFrame:
    """``run_id, seg_idx, text, variants``: recorded spellings put right in readings of ``kinds``, those that then agree dropped.

    ``primary`` is never touched: it holds what was heard. A segment without readings keeps none.
    """
    each = segments.select("run_id", "seg_idx", "text", F.posexplode_outer("variants").alias("_n", "_v")).withColumn("_said", F.col("_v.text"))
    right = glossary.substitute(each, "_said", terms, "_right")
    fixed = right.withColumn("_v", F.when(F.col("_v.kind").isin(*kinds) & (F.col("_v.kind") != "primary"), F.col("_v").withField("text", F.col("_right"))).otherwise(F.col("_v")))
    grouped = fixed.groupBy("run_id", "seg_idx").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_n", "_v")))).alias("_a"))
    listed = grouped.withColumn("variants", F.transform("_a", lambda x: x["_v"]))
    return listed.select("run_id", "seg_idx", "text", still_differing(F.col("variants"), F.col("text"), kinds).alias("variants"))


def compare_context(segments: DataFrame, chunks: DataFrame, decoder: plugins.Decoder, mode: str, carried: int = 0, batched: DataFrame | None = None, request: plugins.Request = plugins.Request("base")) -> DataFrame:
    """``run_id, seg_idx, text, kind, source, confidence``: what a pass with the opposite context reads differently.

    ``chunks`` have ``run_id, batch, from_ms`` and what ``decoder`` needs; ``segments`` have ``s, e,
    text, confidence``. ``always`` decodes every chunk, ``auto`` those whose segments in ``batched``
    look damaged, ``off`` none. Loops in the second pass are collapsed before it is compared.
    """
    if mode not in settings.COMPARE_MODES:
        raise ValueError(f"unknown compare mode: {mode}")
    tokens = settings.CONTEXT_TOKENS["full" if carried == 0 else "off"]
    wanted = chunks if mode == "always" else chunks.limit(0)
    if mode == "auto" and batched is not None:
        wanted = chunks.join(overlap.suspects(batched).select("run_id", "batch"), ["run_id", "batch"], "left_semi")
    decoded = plugins.decode(wanted, decoder, replace(request, max_context=tokens))
    at = lambda c: F.round(F.col("from_ms") + F.col(c) * 1000).cast("long")
    placed = decoded.join(wanted.select("run_id", "batch", "from_ms"), ["run_id", "batch"])
    second = placed.select("run_id", (F.col("batch") * 1_000_000 + F.col("seg_no")).alias("seg_idx"), at("start").alias("s"), at("end").alias("e"), cleaning.collapsed(F.col("text")).alias("text"), "confidence")
    found = overlap.second_readings(segments.select("run_id", "seg_idx", "s", "e", "text", "confidence"), second)
    both = found.join(segments.select("run_id", "seg_idx", "text"), ["run_id", "seg_idx"]).filter(~text.same_words(F.col("reading"), F.col("text")))
    return both.select("run_id", "seg_idx", F.col("reading").alias("text"), F.lit("context").alias("kind"), F.lit(f"asr:context={tokens}").alias("source"), "confidence")


def windows(segments: DataFrame) -> DataFrame:
    """Adds ``window``: consecutive segments of a run within the budget of segments and characters."""
    sized = segments.withColumn("_size", F.length(F.coalesce("text", F.lit(""))))
    return fold(sized, "run_id", ["seg_idx"], "_size", "window", budget(WINDOW_CHARS, WINDOW_SEGMENTS)).drop("_size")


def spoken_line(speaker: Column | None) -> Column:
    """``[clock] speaker: text`` as a language model reads it; without a time there is no clock."""
    who = F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit(": "))).otherwise("") if speaker is not None else F.lit("")
    stamp = F.coalesce(F.concat(F.lit("["), text.clock(F.col("s")), F.lit("] ")), F.lit(""))
    return F.concat(stamp, who, F.col("text"))


def summary_windows(segments: DataFrame) -> DataFrame:
    """``run_id, seg_idx, line, window``: lines of spoken text in windows of characters, line ends not counted."""
    speaker = F.col("speaker") if "speaker" in segments.columns else None
    rows = segments.filter(text.trimmed(F.col("text")) != "").select("run_id", "seg_idx", spoken_line(speaker).alias("line"))
    return fold(rows.withColumn("_size", F.length("line")), "run_id", ["seg_idx"], "_size", "window", budget(SUMMARY_CHARS)).drop("_size")


def patch(segments: DataFrame, fixes: DataFrame) -> DataFrame:
    """``segments`` with ``fixed`` and ``changed``: corrections ``run_id, seg_idx, text, confidence`` taken over.

    Blank or equal text changes nothing, but a lower confidence is taken anyway. Of several fixes for
    one segment the last by ``n`` with text counts, and the lowest confidence.
    """
    said = F.when(text.trimmed(F.col("text")) != "", text.trimmed(F.col("text")))
    last = fixes.groupBy("run_id", "seg_idx").agg(F.max_by(said, F.when(said.isNotNull(), F.col("n"))).alias("_fix"), F.min("confidence").alias("_stated"))
    rows = segments.join(last, ["run_id", "seg_idx"], "left")
    changed = F.coalesce(F.col("_fix").isNotNull() & (F.col("_fix") != F.col("text")), F.lit(False))
    out = rows.withColumn("changed", changed).withColumn("fixed", F.when(changed, F.col("_fix")).otherwise(F.col("text")))
    return out.withColumn("confidence", confidence.absorb(F.col("confidence"), F.col("_stated"))).drop("_fix", "_stated")


def prompt_items(rows: DataFrame) -> DataFrame:
    """``run_id, window, items``: the segments of a window as JSON data; readings of kind ``primary`` stay out."""
    alts = F.transform(F.filter("variants", lambda v: v["kind"] != "primary"), lambda v: v["text"]) if "variants" in rows.columns else F.array().cast("array<string>")
    item = F.struct(F.col("seg_idx").alias("i"), "text", F.round("confidence", 3).alias("confidence"), alts.alias("alts"))
    grouped = rows.groupBy("run_id", "window").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("run_id", "window", F.to_json("items").alias("items"))


SUMMARY = "struct<headline:string,sections:array<struct<title:string,bullets:array<string>,start:double>>,decisions:array<string>,actions:array<string>,questions:array<string>>"


def summary(payload: Column) -> Column:
    """A reply as a summary: trimmed, blanks and empty sections dropped, missing lists empty."""
    raw = F.from_json(payload, SUMMARY)
    none = F.array().cast("array<string>")
    tidy = lambda a: F.filter(F.transform(F.coalesce(a, none), text.trimmed), lambda t: t != "")
    sections = F.transform(F.coalesce(raw["sections"], F.array().cast("array<struct<title:string,bullets:array<string>,start:double>>")), lambda s: F.struct(text.trimmed(F.coalesce(s["title"], F.lit(""))).alias("title"), tidy(s["bullets"]).alias("bullets"), s["start"].alias("start")))
    kept = F.filter(sections, lambda s: (s["title"] != "") | (F.size(s["bullets"]) > 0))
    return F.struct(text.trimmed(F.coalesce(raw["headline"], F.lit(""))).alias("headline"), kept.alias("sections"), *[tidy(raw[n]).alias(n) for n in ("decisions", "actions", "questions")])


def merge_parts(parts: DataFrame, lists: tuple[str, ...] = ("decisions", "actions", "questions")) -> DataFrame:
    """``run_id`` and lists: the lists of partial summaries ``run_id, part`` joined in order, each item once."""
    ordered = F.array_sort(F.collect_list(F.struct("part", *lists)))
    grouped = parts.groupBy("run_id").agg(ordered.alias("_p"))
    return grouped.select("run_id", *[F.array_distinct(F.flatten(F.transform("_p", lambda x: x[n]))).alias(n) for n in lists])


def _joined(parts: Column) -> Column:
    """Partial summaries as one, where no model merges them: the first headline, all sections, each item once."""
    listed = lambda n: F.array_distinct(F.flatten(F.transform(parts, lambda p: p[n]))).alias(n)
    lists = [listed(n) for n in ("decisions", "actions", "questions")]
    return F.struct(parts[0]["headline"].alias("headline"), F.flatten(F.transform(parts, lambda p: p["sections"])).alias("sections"), *lists)


def summarise(segments: DataFrame, model: Callable[[str], str | None], instructions: str = "", most: int = DIRECT_CHARS) -> DataFrame:
    """``run_id, summary, parts``: each run summarised at once up to ``most`` characters, else in windows that are merged.

    ``segments`` have ``run_id, seg_idx, s, text`` and perhaps ``speaker``. A window whose reply holds
    no object is passed over; where the reply that merges the windows fails, their parts are joined. A
    run of which no window was summarised has no summary; one without text does not come out.
    """
    lines = summary_windows(segments)
    whole = lines.groupBy("run_id").agg((F.sum(F.length("line") + 1) - 1).alias("_chars"))
    placed = lines.join(whole, "run_id").withColumn("window", F.when(F.col("_chars") <= most, F.lit(1)).otherwise(F.col("window")))
    texts = placed.groupBy("run_id", "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "line"))), lambda x: x["line"]), "\n").alias("_text"))
    asked = plugins.ask(texts, F.concat(F.lit(instructions + "\nTranscript:\n"), "_text"), model, "_reply")
    parts = asked.withColumn("_object", logs.reply_object(F.col("_reply"))).select("run_id", F.when(F.col("_object").isNotNull(), F.struct("window", summary(F.col("_object")).alias("s"))).alias("_p"))
    grouped = parts.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["s"]).alias("_parts"))
    merged = F.when(F.size("_parts") > 1, F.concat(F.lit(instructions + "\nPartial summaries, in order, to merge into one:\n"), F.to_json("_parts")))
    final = plugins.ask(grouped, merged, model, "_final").withColumn("_object", logs.reply_object(F.col("_final")))
    made = F.when(F.size("_parts") == 1, F.col("_parts")[0]).when(F.size("_parts") > 1, F.when(F.col("_object").isNotNull(), summary(F.col("_object"))).otherwise(_joined(F.col("_parts"))))
    return final.select("run_id", made.alias("summary"), F.size("_parts").alias("parts"))
