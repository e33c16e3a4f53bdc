import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import gate, live


def levels(*parts):
    """Frames of (milliseconds, level)."""
    return [level for ms, level in parts for _ in range(ms // gate.FRAME_MS)]


def run(frames, minimum=gate.THRESHOLD_LEAST):
    g = gate.Gate(minimum=minimum)
    rows = [r for i, level in enumerate(frames) for r in g.step(i, level)] + g.close(len(frames) - 1)
    return [r for r in rows if r[2] != "draft"], [r for r in rows if r[2] == "draft"]


def test_room_alone():
    assert run(levels((5000, 15.0))) == ([], [])


def test_one_utterance():
    ends, drafts = run(levels((1000, 15.0), (1200, 6000.0), (1100, 15.0)))
    assert [e[2] for e in ends] == ["final"] and len(drafts) >= 2
    first, last = ends[0][3], ends[0][4]
    assert (last - first + 1) * gate.FRAME_MS > 1200 and first < 50


def test_end_of_stream_finishes():
    assert [e[2] for e in run(levels((500, 15.0), (1000, 6000.0)))[0]] == ["final"]


def test_clicks_are_dropped():
    frames = levels((1000, 15.0)) + levels((40, 900.0), (400, 15.0)) * 6
    assert run(frames)[0] == []
    assert [e[2] for e in run(levels((500, 15.0), (120, 900.0), (900, 15.0)))[0]] == ["dropped"]


def test_minimum():
    assert run(levels((500, 15.0), (1000, 800.0), (900, 15.0)), 1500)[0] == []
    assert run(levels((500, 15.0), (1000, 800.0), (900, 15.0)))[0]


def test_longest():
    assert len(run(levels((500, 15.0), (60_000, 6000.0)))[0]) == 3


def streamed(spark, tmp_path, batches, sink=None):
    """A stream of so many files, one a micro-batch; what it wrote and its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, "stream_id int, frame_no bigint, level double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id int, frame_no bigint, level double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log = str(tmp_path / "log")
    writer = gate.utterance_stream(stream).writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", str(tmp_path / "out"))
    writer.start().awaitTermination()
    return (None if sink else spark.read.parquet(str(tmp_path / "out"))), log


def planted():
    """Three streams in three parts, with frames that come twice, in another order, or late; the frames that count."""
    parts, true = [[], [], []], []
    for s in range(3):
        frames = levels((800, 15.0), (1000, 5000.0 + s), (1500, 15.0), (60, 900.0), (1500, 15.0)) * 3 + levels((400, 15.0), (900, 5000.0))
        n = len(frames)
        for i, v in enumerate(frames):
            true.append((s, i, v))
            parts[3 * i // n].append((s, i, v))
            if i % 7 == 0:
                parts[3 * i // n].append((s, i, v))
        parts[2].append((s, 5, 9000.0))  # long over
    return [p[::-1] for p in parts], true


def test_stored_and_streamed_agree(spark, tmp_path):
    parts, true = planted()
    out, log = streamed(spark, tmp_path, parts)
    stored = spark.createDataFrame(true + true[:40], "stream_id int, frame_no bigint, level double")
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(map(tuple, gate.utterances(stored, close=False).collect())) and len(got) >= 9
    ends = sorted(map(tuple, gate.unfinished(spark, log).collect()))
    assert sorted(got + ends) == sorted(map(tuple, gate.utterances(stored).collect())) and len(ends) == 3


def test_sink_shows_what_the_log_says(spark, tmp_path):
    parts, true = planted()
    sink = gate.Settling(spark, str(tmp_path / "shown"))
    streamed(spark, tmp_path, parts, sink)
    stored = spark.createDataFrame(true, "stream_id int, frame_no bigint, level double")
    want = sorted(map(tuple, gate.current(gate.utterances(stored, close=False)).collect()))
    assert sorted(map(tuple, sink.shown().collect())) == want and {r[3] for r in want} == {"draft", "final"}
    assert sorted(int(p.name) for p in (tmp_path / "shown").iterdir()) == [1, 2]


def test_stale_answers_are_refused(spark):
    kind = "stream_id string, " + gate.CHANGES
    seen = spark.createDataFrame([("s", 1, 3, "final", 0, 40, 700), ("s", 2, 2, "dropped", 50, 60, 80), ("s", 3, 1, "draft", 70, 80, 90)], kind)
    late = spark.createDataFrame([("s", 1, 2, "draft", 0, 30, 500), ("s", 2, 1, "draft", 50, 55, 80), ("s", 3, 2, "final", 70, 99, 400), ("t", 1, 1, "draft", 0, 9, 80)], kind)
    got = {(r["stream_id"], r["utterance"]): (r["version"], r["kind"]) for r in gate.settle(seen, late).collect()}
    assert got == {("s", 1): (3, "final"), ("s", 2): (2, "dropped"), ("s", 3): (2, "final"), ("t", 1): (1, "draft")}


class Idle:
    """A group's state as Spark hands it over."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.after = None, False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutDuration(self, ms):
        self.after = ms


def test_a_stream_that_was_idle_goes_on(monkeypatch):
    """A timeout ends what was being said and forgets neither the count nor the last frame."""
    kept = {}

    class Group:
        def applyInPandasWithState(self, run, *rest):  # noqa: N802
            kept["run"] = run

    class Levels:
        schema = {"stream_id": type("F", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "int")})})}

        def groupBy(self, _):  # noqa: N802
            return Group()

    gate.utterance_stream(Levels(), idle_ms=1000)
    step = lambda frames, at: [tuple(r) for p in kept["run"]((1,), iter([pd.DataFrame({"frame_no": range(at, at + len(frames)), "level": frames})]), state) for r in p.itertuples(index=False)]
    state = Idle()
    first = step(levels((500, 15.0), (1000, 6000.0)), 0)
    assert {r[3] for r in first} == {"draft"} and state.after == 1000
    state.hasTimedOut = True
    ended = [tuple(r) for p in kept["run"]((1,), iter([]), state) for r in p.itertuples(index=False)]
    assert [(r[1], r[3]) for r in ended] == [(1, "final")]
    state.hasTimedOut = False
    assert step(levels((1000, 6000.0)), 0) == []  # frames from before are late
    again = step(levels((500, 15.0), (1000, 6000.0), (900, 15.0)), 75)
    assert [(r[1], r[3]) for r in again if r[3] != "draft"] == [(2, "final")]


def test_dropped_drafts_are_taken_back(spark):
    rows = [("s", 1, 1, "draft", 0, 9, 80), ("s", 1, 2, "dropped", 0, 12, 80), ("s", 2, 2, "final", 20, 90, 900), ("s", 2, 1, "draft", 20, 50, 400)]
    got = gate.current(spark.createDataFrame(rows, "stream_id string, " + gate.CHANGES)).collect()
    assert [(r["utterance"], r["kind"]) for r in got] == [(2, "final")]


def test_frames_over_block_borders(spark):
    pcm = (np.ones(1000) * 100).astype("<i2").tobytes()
    df = spark.createDataFrame([("s", i, bytearray(pcm[i * 333 : (i + 1) * 333])) for i in range(7)], "stream_id string, block_no int, pcm binary")
    got = gate.frame_levels(df).orderBy("frame_no").collect()
    assert [(r["frame_no"], r["level"]) for r in got] == [(0, 100.0), (1, 100.0), (2, 100.0)]


@pytest.mark.parametrize(("shown", "wanted", "edit"), [
    ("hello wor", "hello word", (0, "d")), ("abc", "xyz", (3, "xyz")), ("café", "cafés", (0, "s")), ("cafe", "café", (1, "é")),
    ("👨‍👩‍👧‍👦", "", (1, "")), ("🇺🇸🇨🇦", "🇺🇸", (1, "")), ("", "", (0, "")),
])
def test_edit(shown, wanted, edit):
    assert live.plan_edit(shown, wanted) == edit


def test_pieces_and_width():
    assert live.pieces("a" * 30) == ["a" * 12, "a" * 12, "a" * 6]
    assert live.pieces("x" + "e" + "́" * 20) == ["x", "e" + "́" * 20]
    assert live.within("日本語です", 6) == "日本…" and live.within("abc", 3) == "abc"


def test_verdicts(spark):
    voice = [0, 0, 900, 900, 900, 900, 0, 0, 800, 900] * 6
    rows = [("silent", i, 0.0) for i in range(60)] + [("room", i, 150.0 + i % 3) for i in range(60)] + [("voice", i, 20.0 + v / 4) for i, v in enumerate(voice)]
    df = spark.createDataFrame(rows, "stream_id string, frame_no bigint, level double")
    heard = spark.createDataFrame([], "stream_id string")
    got = {r["stream_id"]: r["verdict"] for r in live.verdict(df, heard).collect()}
    assert got == {"silent": "pure silence", "room": "nothing but the room", "voice": "a voice, too quiet"}
