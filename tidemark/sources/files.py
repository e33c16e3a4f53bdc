"""Files read into tables: line lists, transcripts as JSON, media as binary files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text

TRANSCRIPT = (
    "run_id string, `schema` int, language string, warnings array<string>, speech_spans array<array<double>>, "
    "segments array<struct<start:double,end:double,text:string,confidence:double,no_speech:double,speaker:string,"
    "words:array<struct<start:double,end:double,text:string,p:double>>,variants:array<struct<text:string,source:string,kind:string,confidence:double>>,"
    "flags:array<string>,suspected_terms:array<array<string>>>>"
)


class BadFile(ValueError):
    """A file that is not what it should be; the message names it and says why."""


def check(path: str, most: int) -> None:
    """Refuse what is no regular UTF-8 file of at most ``most`` bytes (driver side, before Spark reads it)."""
    p = Path(path)
    if not p.is_file():
        raise BadFile(f"{path}: no regular file")
    if p.stat().st_size > most:
        raise BadFile(f"{path}: larger than {most} bytes")
    try:
        p.read_text("utf-8")
    except UnicodeDecodeError as e:
        raise BadFile(f"{path}: not UTF-8 ({e.reason} at {e.start})") from e


def patterns(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines trimmed, without blank ones and ``#`` comments."""
    return lines.withColumn(column, text.trimmed(F.col(column))).filter((F.col(column) != "") & ~F.startswith(column, F.lit("#")))


def read_patterns(spark: SparkSession, path: str, most: int = 256 * 1024) -> DataFrame:
    check(path, most)
    return patterns(spark.read.text(path))


def read_transcripts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Transcripts as JSON, one object per file or line; a malformed one raises unless not ``strict``."""
    return spark.read.schema(TRANSCRIPT).json(path, mode="FAILFAST" if strict else "PERMISSIVE", multiLine=False)


def parse_transcripts(df: DataFrame, column: str = "json") -> DataFrame:
    """``df`` with ``doc``: the transcript in a column of JSON; unknown keys are ignored."""
    return df.withColumn("doc", F.from_json(column, TRANSCRIPT))


def flat_segments(parsed: DataFrame) -> DataFrame:
    """``run_id, seg_idx`` and the fields of each segment of parsed transcripts."""
    return parsed.select("run_id", F.posexplode("doc.segments").alias("seg_idx", "x")).select("run_id", "seg_idx", "x.*")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, size_bytes, sha256`` of the files under ``path``; content is hashed where it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
