import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import glossary, plugins, readings, render, store
from tidemark.operators.carry import islands, running_count
from tidemark.plans import output
from tidemark.plans import terms as term_queries
from tidemark.sources import files, logs

BASE = dict(backend="b", model="m", language="en", vad=True, variants=0)


@pytest.mark.parametrize("change", [{"backend": "x"}, {"model": "x"}, {"language": None}, {"vad": False}, {"variants": 2}, {"context": "full"}, {"dict_digest": "1"}, {"dict_similarity": 0.9}, {"engine_limits": "x"}])
def test_key_changes(change):
    assert store.fingerprint(BASE | change) != store.fingerprint(BASE)


@pytest.mark.parametrize("change", [{"formats": "srt"}, {"timestamps": "none"}, {"summary": True}, {"context": "off"}, {"dict_similarity": 0.8}])
def test_key_stays(change):
    assert store.fingerprint(BASE | change) == store.fingerprint(BASE) and len(store.fingerprint(BASE)) == 16


def test_resolve(spark):
    runs = spark.createDataFrame([("abc",), ("abcd",), ("xyz",)], "run_id string")
    assert store.resolve(runs, "abc") == "abc" and store.resolve(runs, "x") == "xyz"
    for bad in ("ab", "q"):
        with pytest.raises(LookupError):
            store.resolve(runs, bad)


def test_expired(spark):
    row = spark.range(1).select(store.expired(F.lit(0.0), 1e9, 1).alias("a"), store.expired(F.lit(0.0), 1e9, 0).alias("b"), store.expired(F.lit(None).cast("double"), 1e9, 1).alias("c")).collect()[0]
    assert tuple(row) == (True, False, True)


def test_similar_sounds():
    same = lambda a, b: glossary.skeleton(a) == glossary.skeleton(b)
    assert same("Vigma", "Figma") and same("Конлока", "ConLoca") and not same("replace", "ConLoca")
    assert glossary.skeleton("") == "" and glossary.skeleton("123") == ""


TERMS = [(1, "ConLoca", ["ConLog", "Con Loca"], None), (2, "ACME Corp", ["ACME", "akme corp"], "note"), (3, "Sketch", ["Figma"], None), (4, "Figma", None, None), (5, "Other", ["twice"], None), (6, "More", ["Twice"], None)]
TERM = "priority int, term string, aka array<string>, note string"


def test_substitute(spark):
    terms = spark.createDataFrame(TERMS, TERM)
    rows = [("we use conlog and Con Loca",), ("akme corp shipped, ACME too",), ("Figma stays",), ("twice is left",), ("myConLogs",), (None,), ("",)]
    got = [r["corrected"] for r in glossary.substitute(spark.createDataFrame(rows, "t string"), "t", terms).collect()]
    assert got == ["we use ConLoca and ConLoca", "ACME Corp shipped, ACME Corp too", "Figma stays", "twice is left", "myConLogs", None, ""]


def test_lookalikes(spark):
    terms = spark.createDataFrame([(1, "HyperIDE", None, None), (2, "ConLoca", None, None)], TERM)
    grams = spark.createDataFrame([(p,) for p in ("hyper ide", "Conloca", "Coloca", "Colocka", "customer", "the ConLoca")], "phrase string")
    written = {r["phrase"]: r["term"] for r in glossary.lookalikes(grams, terms).collect()}
    assert written == {"Coloca": "ConLoca"}
    heard = {r["phrase"]: r["term"] for r in glossary.lookalikes(grams, terms, heard=True).collect()}
    assert heard == {"Coloca": "ConLoca", "Colocka": "ConLoca", "hyper ide": "HyperIDE"}


def test_merge_aliases(spark):
    rows = [(1, "Vigma ", ["A", "b"]), (2, "vigma", ["a", "C, d"]), (3, "", ["x"]), (4, "Lone", None)]
    got = {r["key"]: (r["term"], r["aka"]) for r in glossary.merge_aliases(spark.createDataFrame(rows, "n int, term string, aka array<string>")).collect()}
    assert got == {"vigma": ("Vigma", ["A", "b", "C d"]), "lone": ("Lone", [])}


@pytest.mark.parametrize(("reply", "want"), [
    ('{"a": 1}', '{"a": 1}'), ('sure:\n```json\n{"a": 1}\n```\nbye', '{"a": 1}'), ('x {"a": "}{"} y', '{"a": "}{"}'),
    ("[1]", None), ("{nope", None), ("", None), (None, None), ("nothing", None),
])
def test_reply(reply, want):
    assert logs.json_object(reply) == want


def test_last_object():
    assert logs.last_object('log\n{"a": 1}\nbye') == '{"a": 1}' and logs.last_object(None) is None


def test_bad_files(tmp_path, spark):
    with pytest.raises(files.BadFile):
        files.check(str(tmp_path / "none"), 10)
    (tmp_path / "latin").write_bytes("é".encode("latin-1"))
    with pytest.raises(files.BadFile):
        files.check(str(tmp_path / "latin"), 10)
    (tmp_path / "p").write_text("  a \n# c\n\nb\n", "utf-8")
    with pytest.raises(files.BadFile):
        files.check(str(tmp_path / "p"), 3)
    assert [r["value"] for r in files.read_patterns(spark, str(tmp_path / "p")).collect()] == ["a", "b"]
    hashed = files.media_files(spark, str(tmp_path)).collect()
    assert len(hashed) == 2 and all(len(r["sha256"]) == 64 for r in hashed)


def test_transcripts(tmp_path, spark):
    (tmp_path / "t.json").write_text('{"run_id": "r", "extra": 1, "segments": [{"start": 0, "end": 1.5, "text": "a", "suspected_terms": [["x", "y"]]}]}\n', "utf-8")
    row = files.read_transcripts(spark, str(tmp_path)).collect()[0]
    assert row["segments"][0]["text"] == "a" and row["segments"][0]["confidence"] is None


def test_times(spark):
    row = spark.range(1).select(text.clock(F.lit(3_725_400)).alias("a"), text.cue_time(F.lit(1001)).alias("b"), text.clock(F.lit(-5), True).alias("c"), text.in_units(F.lit(204_800)).alias("d")).collect()[0]
    assert tuple(row) == ("1:02:05", "00:00:01,001", "0:00:00.000", "200 KiB")


def test_unknown_format(spark):
    with pytest.raises(Exception, match="unknown format"):
        spark.createDataFrame([("pdf",)], "f string").select(render.expand(F.col("f"))).collect()


def test_patch_repeated_and_null(spark):
    seg = spark.createDataFrame([("r", 0, "a", None), ("r", 1, "b", 0.9)], "run_id string, seg_idx int, text string, confidence double")
    fix = spark.createDataFrame([("r", 0, 0, "x", 0.5), ("r", 0, 1, "y", 0.7), ("r", 1, 0, " ", 0.95), ("r", 7, 0, "z", 0.1)], "run_id string, seg_idx int, n int, text string, confidence double")
    got = {r["seg_idx"]: (r["fixed"], r["changed"], r["confidence"]) for r in readings.patch(seg, fix).collect()}
    assert got == {0: ("y", True, 0.5), 1: ("b", False, 0.9)}


def test_failed_reply_is_null(spark):
    def model(p):
        if p == "bad":
            raise RuntimeError
        return p.upper()

    rows = spark.createDataFrame([("ok",), ("bad",), (None,)], "p string")
    assert [r["reply"] for r in plugins.ask(rows, F.col("p"), model).collect()] == ["OK", None, None]


def test_islands_across_buckets(spark):
    rows = [("a", i, v) for i, v in enumerate([1, 1, None, None, 2, 2, 2, 1] * 3)]
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumn("b", F.floor(F.col("i") / 5))
    got = [r["n"] for r in islands(df, ["k"], "b", [F.col("i")], F.col("v"), "n").orderBy("i").collect()]
    want, n, last = [], 0, object()
    for _, _, v in rows:
        n, last = (n, v) if v == last else (n + 1, v)
        want.append(n)
    assert got == want
    counted = running_count(df, ["k"], "b", [F.col("i")], F.col("v") == 2, "c").orderBy("i").collect()
    assert counted[-1]["c"] == 9


def test_heard_is_the_better_reading(spark):
    """Each phrase against each term, scored in full."""
    terms = spark.createDataFrame([(1, "HyperIDE", None, None), (2, "ConLoca", None, None), (3, "Straße", None, None), (4, "数据平台", None, None)], TERM)
    grams = spark.createDataFrame([(p,) for p in ("hyper ide", "Coloca", "Конлока", "колока нет", "strasse", "шрасе", "数据平合", "语音识别", "customer", "ConLoca is")], "phrase string")
    t = terms.withColumn("b", glossary.skeletons(F.col("term")))
    pairs = grams.withColumn("a", glossary.skeletons(F.col("phrase"))).crossJoin(t)
    pairs = pairs.withColumn("score", glossary.likeness(F.col("phrase"), F.col("term"), F.col("a"), F.col("b"))).collect()
    for like in (0.8, 0.5):
        best = {}
        for r in sorted(pairs, key=lambda r: (-r["score"], r["priority"])):
            wide = len(r["phrase"].split()) > len(r["term"].split())
            near = abs(len(r["phrase"].replace(" ", "")) - len(r["term"].replace(" ", ""))) <= glossary.SLACK
            held = r["term"].casefold() in r["phrase"].casefold()
            if not held and (near or not wide) and r["score"] >= like + (glossary.WIDE if wide else 0):
                best.setdefault(r["phrase"], (r["term"], round(r["score"], 9)))
        got = {r["phrase"]: (r["term"], round(r["score"], 9)) for r in glossary.lookalikes(grams, terms, like=like, heard=True).collect()}
        assert got == best and best["Конлока"] == ("ConLoca", 1.0)


def tables_of(spark, folder, texts, terms):
    """Words of one run, a turn each, and a glossary."""
    words = [("r", i, k, w, float(k), k + 0.5, 0.9) for i, t in enumerate(texts) for k, w in enumerate(t.split())]
    spark.createDataFrame(words, "run_id string, turn_idx int, word_idx int, text string, start_s double, end_s double, p double").write.parquet(f"{folder}/words.parquet")
    spark.createDataFrame(terms, TERM).write.parquet(f"{folder}/terms.parquet")
    return str(folder)


def test_screen_hears(spark, tmp_path):
    sf = tables_of(spark, tmp_path, ["we use Конлока", "and Colocka here"], [(1, "ConLoca", None, None)])
    got = {(r["seg_idx"], r["heard"], r["term"]) for r in term_queries.c03_apply_glossary(spark, sf).collect()}
    assert got == {(0, "Конлока", "ConLoca"), (1, "Colocka", "ConLoca")}
    near = {r["phrase"] for r in term_queries.o04_near_misses(spark, sf).collect()}
    assert not near & {"Конлока", "Colocka"}


def test_dictionary_report(spark, tmp_path):
    sf = tables_of(spark, tmp_path, ["ConLog and conlog", "and Colocka here", "plain"], [(1, "ConLoca", ["ConLog"], None)])
    got = [r.asDict(recursive=True) for r in term_queries.a09_dictionary_report(spark, sf).collect()]
    pair = lambda heard: {"heard": heard, "term": "ConLoca"}
    assert got == [{"run_id": "r", "rewritten": 1, "replacements": 2, "flags": 1, "replaced": [pair("ConLog"), pair("conlog")], "flagged": [pair("Colocka")]}]


def test_document_is_whole(spark):
    rows = [json.loads(r["json"]) for r in output.k03_json(spark, "/root/testdata/sf0.001").collect()]
    said = [s for r in rows for s in r.get("segments", ())]
    assert any("speech" in r and "media_sha" in r for r in rows) and any("speaker" in s for s in said)
    assert said and all(" ".join(w.get("text", "") for w in s["words"]) == s["text"] for s in said if all("text" in w for w in s["words"]))
    assert any("start" in s and "end" in s and "start" in s["words"][0] for s in said)
