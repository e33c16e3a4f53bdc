"""Passes composed of several operators, with planted rows."""

import json
import random

from pyspark.sql import functions as F

from tidemark.operators import cleaning, glossary, readings, render
from tidemark.plans import live as live_queries
from tidemark.plans import speech
from tidemark.plans import terms as term_queries
from tidemark.sources import logs

TERM = "priority int, term string, aka array<string>, note string"
VARIANT = "array<struct<text:string,source:string,kind:string,confidence:double>>"


def test_reconcile(spark):
    terms = spark.createDataFrame([(1, "Figma", ["Vigma"], None)], TERM)
    rows = [
        ("r", 1, "Figma it is", [("Vigma it is", "a", "primary", 0.5), ("Vigma, it is", "b", "context", 0.5), ("Vigma it was", "c", "model", None), ("vigma it is", "d", "temperature", 0.1)]),
        ("r", 2, "plain", []), ("r", 3, "null", None),
    ]
    df = spark.createDataFrame(rows, f"run_id string, seg_idx int, text string, variants {VARIANT}")
    got = {r["seg_idx"]: [(v["kind"], v["text"]) for v in r["variants"]] for r in readings.reconcile(df, terms).collect()}
    assert got == {1: [("primary", "Vigma it is"), ("model", "Figma it was")], 2: [], 3: []}
    assert readings.reconcile(df.limit(0), terms).collect() == []


def chunk_decoder(row, request):
    assert request.max_context in (0, 224)
    return [{"start": s, "end": s + 1.0, "text": t, "confidence": 0.4} for s, t in json.loads(row["said"])]


def test_compare_context(spark):
    segments = spark.createDataFrame([("r", 0, 0, 1000, "the same words", 0.9), ("r", 1, 1000, 2000, "heard one way", 0.9), ("r", 2, 60_000, 61_000, "lower start", 0.1)], "run_id string, seg_idx int, s long, e long, text string, confidence double")
    said = [("r", 1, 0, json.dumps([[0.0, "The same, words!"], [1.0, "heard another way"]])), ("r", 2, 60_000, json.dumps([[0.0, "no no no no no no no no"]]))]
    chunks = spark.createDataFrame(said, "run_id string, batch int, from_ms long, said string")
    batched = segments.withColumn("batch", F.when(F.col("seg_idx") < 2, 1).otherwise(2)).withColumn("text", F.when(F.col("seg_idx") < 2, F.concat(F.lit("X"), "text")).otherwise(F.col("text")))
    run = lambda mode, **kw: {r["seg_idx"]: (r["text"], r["source"]) for r in readings.compare_context(segments, chunks, chunk_decoder, mode, batched=batched, **kw).collect()}
    always = run("always")
    assert always[1] == ("heard another way", "asr:context=224") and 0 not in always and always[2][0].count("no") < 8
    assert set(run("auto")) == {2} and run("off") == {}
    assert run("always", carried=64)[1][1] == "asr:context=0"


def model(prompt):
    if "Partial" in prompt:
        return None if "bad" in prompt else json.dumps({"headline": "merged"})
    if "skip" in prompt:
        raise ValueError
    return "ok ```json\n" + json.dumps({"headline": "part", "decisions": ["d", "bad" if "bad" in prompt else "e"]}) + "\n```"


def test_summarise(spark):
    rows = [("short", 1, 0, "hello"), ("blank", 1, 0, " "), ("none", 1, 0, "skip")]
    rows += [(run, i, i * 1000, f"{word} " + "x" * 9000) for run, word in (("long", "a"), ("fail", "bad")) for i in range(4)]
    df = spark.createDataFrame(rows, "run_id string, seg_idx int, s long, text string")
    got = {r["run_id"]: r for r in readings.summarise(df, model).collect()}
    assert set(got) == {"short", "none", "long", "fail"} and got["none"]["summary"] is None
    assert got["short"]["parts"] == 1 and got["short"]["summary"]["decisions"] == ["d", "e"]
    assert got["long"]["summary"]["headline"] == "merged" and got["long"]["parts"] == 4
    assert got["fail"]["summary"]["headline"] == "part" and got["fail"]["summary"]["decisions"] == ["d", "bad"]


RUN = "run_id string, media_sha string, source_path string, source_name string, duration double, backend string, model string, lang string, has_summary int"


def test_markdown_and_files(spark, tmp_path):
    runs = spark.createDataFrame([("r", "m", "/a/x.wav", "x.wav", 90.0, "w", "base", None, 1), ("q", "n", "/b.wav", "b.wav", 0.0, "w", "base", "en", 0)], RUN)
    media = spark.createDataFrame([("m", "2024-01-01", "filename")], "sha256 string, recorded_at string, recorded_at_source string")
    segments = spark.createDataFrame([("r", 1, 1000, 2000, "hello", 0.5), ("r", 3, 3000, 4000, "world", None)], "run_id string, seg_idx int, s long, e long, text string, confidence double")
    warnings = spark.createDataFrame([("r", 0, "first"), ("r", 1, "second"), ("q", 0, None)], "run_id string, n int, warning string")
    summaries = runs.filter("has_summary = 1").select("run_id", readings.summary(F.lit('{"headline": "h"}')).alias("summary"))
    out = render.markdown(runs, media, segments, warnings=warnings, summaries=summaries)
    text = {run: [r["line"] for r in out.filter(F.col("run_id") == run).orderBy("line_no").collect()] for run in "rq"}
    assert text["r"] == ["# x", "", "- **Source**: `/a/x.wav`", "- **Duration**: 1.5 min", "- **Engine**: w:base (language: auto)", "- **Recorded**: 2024-01-01 (filename)", "- **Note**: first", "- **Note**: second",
                         "", "## Summary", "", "h", "", "", "## Transcript", "", "[0:00:01] hello", "", "[0:00:03] world", ""]
    assert text["q"][-3:] == ["", "## Transcript", ""] and not any("Note" in line for line in text["q"])
    report = {r["run_id"]: r for r in render.run_report(runs, segments, warnings).collect()}
    assert (report["r"]["words"], report["r"]["warnings"], report["q"]["segments"]) == (2, ["first", "second"], 0)
    render.write(render.routed({"md": out, "txt": render.txt(segments)}), str(tmp_path / "out"))
    files = list((tmp_path / "out" / "format=md" / "run_id=r").glob("*.txt"))
    assert len(files) == 1 and files[0].read_text().splitlines() == text["r"]


def test_slim_and_probe(spark):
    raw = '{"language": "en", "text": "x", "segments": [{"start": 0, "end": 1, "tokens": [1, 2], "words": [{"word": "a", "start": 0.5, "tokens": [3]}]}, {"text": "b"}]}'
    got = json.loads(spark.range(1).select(F.to_json(logs.slim(F.lit(raw)))).collect()[0][0])
    assert got == {"language": "en", "segments": [{"start": 0.0, "end": 1.0, "text": "", "words": [{"start": 0.5, "word": "a"}]}, {"text": "b", "words": []}]}
    probe = '{"format": {"duration": "1.5", "format_name": "mp4", "tags": {"creation_time": "2024"}}, "streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}]}'
    df = spark.createDataFrame([(probe,), ('{"streams": [{"codec_type": "video"}]}',), ("{}",), (None,), ('{"streams": [{"codec_type": "audio", "sample_rate": "x"}]}',)], "j string")
    rows = [r["p"] for r in df.select(logs.probed(F.col("j")).alias("p")).collect()]
    assert tuple(rows[0]) == (1.5, "mp4", "aac", 48000, 2, True, "2024") and rows[1:4] == [None] * 3 and tuple(rows[4])[:4] == (0.0, "", "", 0)


def test_near_misses_are_the_best_of_all(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abdegiklmnorstu") for _ in range(r.randint(5, 9))) for _ in range(300)]
    terms = spark.createDataFrame([(i, w.capitalize(), None, None) for i, w in enumerate(words[:40], 1)], TERM)
    bent = [w[:2] + r.choice("xyz") + w[3:] for w in words[:60]] + words[40:]
    grams = spark.createDataFrame([(w,) for w in bent], "phrase string")
    low = glossary.lookalikes(grams, terms, like=0.5, heard=True).filter("not caught").orderBy(F.desc("score"), "phrase").limit(20).select("phrase", "term", "score").collect()
    assert [tuple(x) for x in glossary.near_misses(grams, terms).collect()] == [tuple(x) for x in low] and len(low) == 20
    few = glossary.near_misses(grams.limit(5), terms).collect()
    assert len(few) <= 5


def folder(spark, tmp_path, **tables):
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


WORDS = "run_id string, turn_idx int, word_idx int, text string, start_s double, end_s double, p double"


def words_of(texts):
    return [("r", i, i * 100 + k, w, float(k), k + 0.5, 0.9) for i, t in enumerate(texts) for k, w in enumerate(t.split(" "))]


def test_queries_without_rows_in_the_tables(spark, tmp_path):
    """Queries that the given tables leave empty, over planted rows."""
    texts = [" padded ", "plain", "so so so so so so so so so so so so"]
    terms = [(1, "Figma", ["Vigma", "sketch"], None), (2, "Sketch", ["vigma"], None)]
    docs = [(1, "glossary", "Newone = a, b\nFigma = x\n# c"), (2, "chat", "Thanks.\nthanks\nTHANKS!\nelse"), (3, "chat", None)]
    sf = folder(spark, tmp_path, words=(words_of(texts), WORDS), terms=(terms, TERM), documents=(docs, "doc_id long, kind string, text string"))
    assert [(r["run_id"], r["fixed"]) for r in live_queries.c13_correction(spark, sf).collect()] == [("r", 1)]
    assert {(r["alias"], r["terms"]) for r in term_queries.j12_ambiguous(spark, sf).collect()} == {("vigma", 2), ("sketch", 2)}
    assert {r["name"] for r in term_queries.t05_new_terms(spark, sf).collect()} >= {"newone"}
    assert [r["doc_id"] for r in speech.w05_document_echoes(spark, sf).select("doc_id").distinct().collect()] == [2]
    assert speech.w15_collapse_loops(spark, sf).count() == 1 and cleaning.collapse(texts[2]) != texts[2]
