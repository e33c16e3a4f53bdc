"""Places where an outside engine is called: decoders, diarizers and language models as functions over rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import confidence

SEGMENT = "start double, end double, text string, confidence double"
TEMPERATURES = (0.4, 0.8, 1.0)


@dataclass(frozen=True)
class Request:
    """How a chunk is to be decoded."""

    model: str
    language: str | None = None
    temperature: float = 0.0
    max_context: int = 0
    prompt: str | None = None
    extra: Mapping[str, object] = field(default_factory=dict)


#: A decoder takes a chunk's row and a request and gives its segments.
Decoder = Callable[[Mapping[str, object], Request], Sequence[Mapping[str, object]]]


def decode(chunks: DataFrame, decoder: Decoder, request: Request, keys: Sequence[str] = ("run_id", "batch")) -> DataFrame:
    """``keys, seg_no`` and the segments that ``decoder`` finds in each chunk; a batch of rows per call of Python."""
    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "seg_no", "start", "end", "text", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                found = sorted(decoder(row, request), key=lambda s: s["start"])
                rows += [(*[row[k] for k in keys], i, s["start"], s["end"], s["text"], s.get("confidence")) for i, s in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    return chunks.mapInPandas(run, f"{kinds}, seg_no int, {SEGMENT}")


def ask(df: DataFrame, prompt: Column, model: Callable[[str], str | None], name: str = "reply") -> DataFrame:
    """Add ``name``: the reply of ``model`` to a prompt, null where it fails; one failure never ends the run."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(p: object) -> str | None:
            try:
                return model(p) if isinstance(p, str) else None
            except Exception:  # noqa: BLE001
                return None

        for s in batches:
            yield s.map(one)

    return df.withColumn(name, run(prompt))


TURNS_JSON = "turns array<struct<start:double,end:double,speaker:string>>"


def diarized(rows: DataFrame, column: str = "reply") -> DataFrame:
    """``run_id, turn_idx, start, end, speaker`` from a diarizer's JSON."""
    turns = F.from_json(column, TURNS_JSON)["turns"]
    return rows.select("run_id", F.posexplode(turns).alias("turn_idx", "t")).select("run_id", "turn_idx", "t.*")


def plan_passes(targets: DataFrame, extra: int, models: Sequence[str] = (), fix: bool = False) -> DataFrame:
    """Every target with each extra pass it gets: temperatures first, then other models.

    A correction pass without either gets one temperature. Passes are a handful, so each target row
    is repeated that often.
    """
    n = 1 if fix and not extra and not models else extra
    passes = [("temperature", f"t{t}", t) for t in TEMPERATURES[:n]] + [("model", m, 0.0) for m in models]
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("source"), F.lit(float(t)).alias("temperature")) for k, s, t in passes]) if passes else F.array().cast("array<struct<kind:string,source:string,temperature:double>>")
    return targets.withColumn("_p", F.explode(made)).select("*", "_p.*").drop("_p")


def fake_decoder(row: Mapping[str, object], request: Request) -> list[dict]:
    """A decoder for tests: says a chunk's text, word by word of a second each, or in capitals when it is hot."""
    said = str(row.get("text") or "")
    said = said.upper() if request.temperature else said
    return [{"start": float(i), "end": i + 1.0, "text": w, "confidence": 1 / (i + 1)} for i, w in enumerate(said.split())]


def fake_model(prompt: str) -> str:
    """A language model for tests: gives every segment of the data back, trimmed, as a reply with chatter around it."""
    return "Here you are:\n```json\n" + json.dumps({"segments": json.loads(prompt)}) + "\n```"


def pooled(rows: DataFrame) -> DataFrame:
    """One reading per ``run_id, seg_idx`` from decoded parts: texts in order, the plain mean of confidences."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", F.trim("text").alias("t"))))
    return rows.groupBy("run_id", "seg_idx").agg(F.array_join(F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t != ""), " ").alias("text"), confidence.clamp(F.avg("confidence")).alias("confidence"))
