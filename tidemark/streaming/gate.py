"""Detecting utterances in a stream of levels: an adaptive threshold with onset, hang-over and pre-roll.

``Gate`` is the state machine, one frame at a time. ``utterances`` runs it over stored levels and
``utterance_stream`` over a stream, with the same rows for the same frames. ``unfinished`` ends what a
stream that will not go on was still saying, and ``Settling`` is the sink that keeps what a reader sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds of a frame; samples a second; bytes of a sample.
FRAME_MS, RATE, SAMPLE = 20, 16_000, 2
# How loud against the room, the least threshold and floor, and how fast the floor rises.
RATIO, THRESHOLD_LEAST, FLOOR_LEAST, RISE = 6.0, 250.0, 20.0, 1.0008
# Fixed values, milliseconds: onset, least speech, hang-over, pre-roll, longest utterance, time between drafts.
ONSET, SPEECH, HANGOVER, PREROLL, LONGEST, DRAFT = 80, 300, 700, 300, 25_000, 600

CHANGES = "utterance bigint, version bigint, kind string, first_frame bigint, last_frame bigint, spoken_ms bigint"


@dataclass
class Gate:
    """One stream's state between frames."""

    floor: float = FLOOR_LEAST
    minimum: float = THRESHOLD_LEAST
    speaking: bool = False
    held: int = 0  # frames kept from before the onset
    frames: int = 0  # frames of the utterance
    first: int = 0
    loud_ms: int = 0
    quiet_ms: int = 0
    spoken_ms: int = 0
    drafted_ms: int = 0
    utterance: int = 0
    version: int = 0

    @property
    def threshold(self) -> float:
        return max(self.floor * RATIO, self.minimum)

    def step(self, frame: int, level: float) -> list[tuple]:
        """Take one frame; rows of the change log that it causes: draft, final or dropped."""
        if not self.speaking:  # the room is learnt only while nobody speaks: down at once, up slowly
            self.floor = max(FLOOR_LEAST, level if level < self.floor else self.floor * RISE)
        loud = level > self.threshold
        if not self.speaking:
            self.held = min(self.held + 1, PREROLL // FRAME_MS)
            self.loud_ms = self.loud_ms + FRAME_MS if loud else 0
            if self.loud_ms >= ONSET:
                self.speaking, self.spoken_ms, self.quiet_ms = True, self.loud_ms, 0
                self.frames, self.first, self.held = self.held, frame - self.held + 1, 0
                self.drafted_ms, self.version = self.frames * FRAME_MS, 0
                self.utterance += 1
            return []
        self.frames += 1
        if loud:
            self.quiet_ms, self.spoken_ms = 0, self.spoken_ms + FRAME_MS
            over = self.frames * FRAME_MS >= LONGEST
        else:
            self.loud_ms, self.quiet_ms = 0, self.quiet_ms + FRAME_MS
            over = self.quiet_ms >= HANGOVER
        if over:
            return [self.finish(frame)]
        if self.frames * FRAME_MS - self.drafted_ms >= DRAFT:
            self.drafted_ms = self.frames * FRAME_MS
            return [self._row("draft", frame)]
        return []

    def finish(self, frame: int) -> tuple:
        """End the utterance: final, or dropped where too little of it was loud."""
        row = self._row("final" if self.spoken_ms >= SPEECH else "dropped", frame)
        self.speaking, self.frames, self.loud_ms, self.quiet_ms, self.spoken_ms = False, 0, 0, 0, 0
        return row

    def close(self, frame: int) -> list[tuple]:
        """What is still being said when the stream ends."""
        return [self.finish(frame)] if self.speaking else []

    def _row(self, kind: str, frame: int) -> tuple:
        self.version += 1
        return (self.utterance, self.version, kind, self.first, frame, self.spoken_ms)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


_NAMES = [part.split()[0] for part in CHANGES.split(", ")]


def utterances(levels: DataFrame, minimum: float = THRESHOLD_LEAST, close: bool = True) -> DataFrame:
    """The change log of stored levels ``stream_id, frame_no, level``: drafts, then final or dropped.

    Frames of a stream are read in order while they stream by; only the state is held. Null levels
    count as silence; of repeated frames the loudest counts, as in a micro-batch of a stream.
    """
    kind = levels.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, gate, at = None, None, -1
        for pdf in batches:
            rows = []
            for s, n, level in zip(pdf["stream_id"], pdf["frame_no"], pdf["level"].fillna(0.0), strict=True):
                if gate is None or s != stream:
                    if gate is not None and close:
                        rows += [(stream, *r) for r in gate.close(at)]
                    stream, gate, at = s, Gate(minimum=minimum), -1
                if n > at:
                    at = int(n)
                    rows += [(s, *r) for r in gate.step(at, float(level))]
            yield _frame(rows, ["stream_id", *_NAMES])
        if gate is not None and close:
            yield _frame([(stream, *r) for r in gate.close(at)], ["stream_id", *_NAMES])

    ordered = levels.select("stream_id", "frame_no", "level").filter("stream_id is not null").repartition("stream_id").sortWithinPartitions("stream_id", "frame_no", F.desc("level"))
    return ordered.mapInPandas(run, f"stream_id {kind}, {CHANGES}")


_STATE = "floor double, minimum double, speaking boolean, held int, frames int, first bigint, loud_ms int, quiet_ms int, spoken_ms int, drafted_ms int, utterance bigint, version bigint, last bigint"


def utterance_stream(levels: DataFrame, minimum: float = THRESHOLD_LEAST, idle_ms: int | None = None) -> DataFrame:
    """The same log from a streaming ``levels``; frames at or before the last one seen are late and dropped.

    Frames of one micro-batch are put in order. With ``idle_ms`` a stream from which nothing comes for
    so long (processing time) is closed, which ends what it was saying. Its count of utterances, its
    last frame and what it learnt of the room stay, so that one which comes back goes on from there.
    """
    kind = levels.schema["stream_id"].dataType.simpleString()

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in _STATE.split(", ")]
        old = dict(zip(names, state.get, strict=True)) if state.exists else None
        last = old.pop("last") if old else -1
        gate = Gate(**old) if old else Gate(minimum=minimum)
        rows: list[tuple] = []
        if state.hasTimedOut:
            rows = gate.close(last)
            state.update((*asdict(gate).values(), last))
        else:
            pdf = pd.concat(list(pdfs)).sort_values(["frame_no", "level"], ascending=[True, False], kind="stable")
            for n, level in zip(pdf["frame_no"], pdf["level"].fillna(0.0), strict=True):
                if n > last:
                    last = int(n)
                    rows += gate.step(last, float(level))
            state.update((*asdict(gate).values(), last))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield _frame([(key[0], *r) for r in rows], ["stream_id", *_NAMES])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return levels.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, {CHANGES}", _STATE, "append", timeout)


def unfinished(spark: SparkSession, log: str) -> DataFrame:
    """What each stream was still saying when its query ended, closed: ``utterance_stream``'s rows for the end.

    ``log`` is the query's checkpoint location. The states are read where the query left them, so
    this is for streams that will not go on.
    """
    stored = spark.read.format("statestore").load(log)
    kind = stored.schema["key"].dataType[0]
    names = [part.split()[0] for part in _STATE.split(", ")]
    values = stored.select(F.col(f"key.{kind.name}").alias("stream_id"), F.col("value.groupState.*")).toDF("stream_id", *names)
    ending = F.when(F.col("spoken_ms") >= SPEECH, "final").otherwise("dropped")
    return values.filter("speaking").select("stream_id", "utterance", (F.col("version") + 1).alias("version"), ending.alias("kind"), F.col("first").alias("first_frame"), F.col("last").alias("last_frame"), F.col("spoken_ms").cast("long").alias("spoken_ms"))


def accept(seen: Column, arriving: Column) -> Column:
    """Whether an answer of version ``arriving`` may replace one of version ``seen``: stale ones may not."""
    return seen.isNull() | (arriving > seen)


_SHOWN = ("kind", "first_frame", "last_frame", "spoken_ms")


def settle(seen: DataFrame, arriving: DataFrame) -> DataFrame:
    """``seen`` after ``arriving`` rows of a change log: the newest version of each utterance, stale ones refused.

    Dropped utterances stay as rows of kind ``dropped``, so that a late draft cannot bring them back.
    """
    newest = arriving.groupBy("stream_id", "utterance").agg(F.max_by(F.struct(*_SHOWN), "version").alias("x"), F.max("version").alias("v"))
    old = seen.select(F.col("stream_id").alias("s"), F.col("utterance").alias("u"), F.col("version").alias("w"), F.struct(*_SHOWN).alias("y"))
    both = newest.join(old, F.col("stream_id").eqNullSafe(F.col("s")) & (F.col("utterance") == F.col("u")), "full")
    fresh = F.col("v").isNotNull() & accept(F.col("w"), F.col("v"))
    pick = lambda a, b: F.when(fresh, a).otherwise(b)
    return both.select(F.coalesce("stream_id", "s").alias("stream_id"), F.coalesce("utterance", "u").alias("utterance"), pick(F.col("v"), F.col("w")).alias("version"), pick(F.col("x"), F.col("y")).alias("x")).select("stream_id", "utterance", "version", "x.*")


class Settling:
    """Sink of a change log for ``foreachBatch``: drafts show at once, a later version replaces or takes them back.

    Each micro-batch writes the table anew beside the last one, under its own number, so a batch that
    is run again gives the same table and readers never see half of one. The last two are kept.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self) -> list[int]:
        """Numbers of the tables that were written whole."""
        there = self.files.globStatus(self.path(f"{self.folder}/*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName()) for f in there)

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = [n for n in self._done() if n < number]
        seen = self.spark.read.parquet(f"{self.folder}/{before[-1]}") if before else batch.limit(0)
        settle(seen, batch).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        for n in before[:-1]:
            self.files.delete(self.path(f"{self.folder}/{n}"), True)

    def shown(self) -> DataFrame:
        """What a reader sees now: the newest version of each utterance, dropped ones taken back."""
        return self.spark.read.parquet(f"{self.folder}/{self._done()[-1]}").filter("kind <> 'dropped'")


def current(changes: DataFrame) -> DataFrame:
    """What a reader sees of a whole change log."""
    return settle(changes.limit(0), changes).filter("kind <> 'dropped'")


def frame_levels(blocks: DataFrame) -> DataFrame:
    """``stream_id, frame_no, level`` of blocks ``stream_id, block_no, pcm`` of 16-bit samples.

    Blocks of any length follow one another; what does not fill a frame is carried to the next
    block, and what is left at the end of a stream is not heard. The level is the root mean square.
    """
    size = RATE * FRAME_MS // 1000 * SAMPLE
    kind = blocks.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, spare, n = None, b"", 0
        for pdf in batches:
            out = []
            for s, pcm in zip(pdf["stream_id"], pdf["pcm"], strict=True):
                if s != stream:
                    stream, spare, n = s, b"", 0
                spare += pcm or b""
                whole = len(spare) // size
                if whole:
                    samples = np.frombuffer(spare[: whole * size], "<i2").astype(float).reshape(whole, -1)
                    for level in np.sqrt((samples**2).mean(1)):
                        out.append((s, n, float(level)))
                        n += 1
                    spare = spare[whole * size :]
            yield pd.DataFrame(out, columns=["stream_id", "frame_no", "level"])

    ordered = blocks.select("stream_id", "block_no", "pcm").repartition("stream_id").sortWithinPartitions("stream_id", "block_no")
    return ordered.mapInPandas(run, f"stream_id {kind}, frame_no bigint, level double")
