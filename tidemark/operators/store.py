"""A result store: runs by content and settings, found again, updated, cleaned up.

Plain Parquet tables have no MERGE, so changes are written as joins that yield the new table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import join_small

# Settings that change the words of a result, always part of its key; those that came later,
# part of the key only where they differ from the default; the revision of the key.
KEYS = (
    "backend", "model", "language", "vad", "vad_threshold", "vad_min_silence_ms", "vad_speech_pad_ms", "vad_min_speech_ms",
    "clean", "strict_clean", "max_repeats", "confidence_floor", "variants", "variant_models", "fix", "fix_with",
)
DEFAULTS: Mapping[str, object] = {"context": "off", "context_compare": "off", "dict_digest": "", "dict_bias": True, "dict_similarity": 0.80, "engine_limits": ""}
REVISION = 2
#: What an update may change; the rest of a stored run stays.
UPDATED = ("created_at", "segments", "words", "has_summary", "has_speakers", "source_path")
#: Keys up to which a side is broadcast.
BROADCAST = 100_000


def fingerprint(settings: Mapping[str, object]) -> str:
    """The key of a set of settings: 16 hex digits of a hash that does not depend on their order."""
    chosen = {k: settings.get(k) for k in KEYS} | {k: settings[k] for k, v in DEFAULTS.items() if settings.get(k, v) != v}
    text = json.dumps(chosen | {"_decode_revision": REVISION}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def fingerprints(settings: DataFrame, columns: Sequence[str]) -> Column:
    """``fingerprint`` of each row's settings, given by the columns of these names; null means not set."""
    chosen = F.struct(*[F.col(c) for c in columns])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        memo: dict[tuple, str] = {}
        for pdf in batches:
            out = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                key = tuple(row)
                if key not in memo:
                    memo[key] = fingerprint({k: v for k, v in zip(columns, key, strict=True) if v is not None})
                out.append(memo[key])
            yield pd.Series(out, dtype=object)

    return run(chosen)


def run_id(media_sha: Column, key: Column) -> Column:
    """The name of a run: ten digits of the content and the whole key."""
    return F.concat(F.substring(media_sha, 1, 10), F.lit("-"), key)


def find(wanted: DataFrame, runs: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """``wanted`` (``media_sha, fingerprint``) with ``run_id`` of the stored result, null for a miss.

    A run whose payload (``run_id``) is gone is a miss.
    """
    there = runs.select("media_sha", "fingerprint", "run_id")
    if payloads is not None:
        there = there.join(payloads.select("run_id"), "run_id", "left_semi")
    return wanted.join(there.groupBy("media_sha", "fingerprint").agg(F.min("run_id").alias("run_id")), ["media_sha", "fingerprint"], "left")


def missing(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """What of ``wanted`` has to be computed."""
    return wanted.join(runs.select("media_sha", "fingerprint"), ["media_sha", "fingerprint"], "left_anti")


def latest_media(runs: DataFrame) -> DataFrame:
    """``source_path, media_sha``: the content that was last stored for each path."""
    return runs.groupBy("source_path").agg(F.max_by("media_sha", F.struct("created_at", "run_id")).alias("media_sha"))


def _like(column: str, query: str) -> Column:
    escaped = query.replace("\\", "\\\\").replace("'", "''")
    return F.expr(f"lower(`{column}`) like lower('{escaped}')")


def recent(runs: DataFrame, limit: int = 30, query: str | None = None) -> DataFrame:
    """The last runs, newest first, whose name or path holds ``query`` or whose id starts with it; ``%`` and ``_`` are wild."""
    rows = runs
    if query:
        rows = runs.filter(_like("source_name", f"%{query}%") | _like("source_path", f"%{query}%") | _like("run_id", f"{query}%"))
    return rows.orderBy(F.desc("created_at"), "run_id").limit(limit)


def resolve(runs: DataFrame, wanted: str) -> str:
    """The id that ``wanted`` names: itself, or the only one that starts with it. Runs one bounded job."""
    rows = [r["run_id"] for r in runs.filter(F.col("run_id").startswith(wanted)).select("run_id").orderBy(F.col("run_id") != wanted, "run_id").limit(3).collect()]
    if rows and rows[0] == wanted:
        return wanted
    if len(rows) != 1:
        raise LookupError(f"{wanted!r} names " + ("no run" if not rows else "several runs"))
    return rows[0]


def upsert(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """``runs`` after ``changes`` of the same columns: new ids are added, of known ones only ``UPDATED`` changes."""
    new = changes.select("run_id", F.struct(*[F.col(c) for c in runs.columns]).alias("_new"))
    both = runs.select("run_id", F.struct(*runs.columns).alias("_old")).join(new, "run_id", "full")
    known = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    out = [F.when(known, F.col(f"_new.{c}") if c in UPDATED else F.col(f"_old.{c}")).otherwise(F.coalesce(f"_old.{c}", f"_new.{c}")).alias(c) for c in runs.columns]
    return both.select(*out)


def keep_created(runs: DataFrame, enriched: DataFrame) -> DataFrame:
    """``enriched`` with the time of the first result, where there is one."""
    first = runs.select("run_id", F.col("created_at").alias("_first"))
    return enriched.join(first, "run_id", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")


def forget(runs: DataFrame, ids: DataFrame) -> DataFrame:
    return join_small(runs, ids.select("run_id").distinct(), ["run_id"], "left_anti", BROADCAST)


def expired(epoch: Column, now: float, days: int | None) -> Column:
    """Older than so many days; without a number, or with 0, nothing is. A time that cannot be read is old."""
    return F.coalesce(epoch, F.lit(0)) < now - days * 86_400 if days else F.lit(False)


def unused_media(media: DataFrame, kept: DataFrame) -> DataFrame:
    """``sha256`` of stored media that no kept run refers to."""
    return media.select("sha256").distinct().join(kept.select(F.col("media_sha").alias("sha256")), "sha256", "left_anti")


def usage(media: DataFrame, runs: DataFrame) -> DataFrame:
    """``kind, n, bytes``: what the store holds, each item once."""
    m = media.groupBy("sha256").agg(F.max("size_bytes").alias("b")).agg(F.lit("media").alias("kind"), F.count("*").alias("n"), F.sum("b").alias("bytes"))
    r = runs.select("run_id").distinct().agg(F.lit("runs").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("bigint").alias("bytes"))
    return m.unionByName(r)


def first_available(engines: DataFrame) -> DataFrame:
    """``kind, name``: of each kind the usable engine with the best rank."""
    return engines.filter("ok").groupBy("kind").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))
