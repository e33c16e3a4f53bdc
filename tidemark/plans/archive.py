"""Queries over the result store: lookup, listing, update, clean-up, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import stamps, store
from tidemark.plans import base
from tidemark.plans.base import RUNS, SEGMENTS, oracle
from tidemark.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(oracle(RUNS, select="SELECT run_id, media_sha, fingerprint, source_name, duration, backend, model, lang, has_summary, has_speakers FROM r"))
def s19_runs(spark: SparkSession, sf: str) -> DataFrame:
    return base.runs(spark, sf).select("run_id", "media_sha", "fingerprint", "source_name", "duration", "backend", "model", "lang", "has_summary", "has_speakers")


@query("SELECT DISTINCT sha256(path) AS path_sha, path FROM media")
def s02_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "media").select(F.sha2("path", 256).alias("path_sha"), "path").distinct()


@query("""WITH k AS (SELECT sha256, recorded_at, trim(regexp_replace(lower(coalesce(recorded_at_source, 'unknown')), '[\\s_]+', ' ', 'g')) AS src FROM media WHERE recorded_at IS NOT NULL),
o AS (SELECT *, CASE src WHEN 'explicit' THEN 1 WHEN 'container tag' THEN 2 WHEN 'filename' THEN 3 WHEN 'file creation time' THEN 4 WHEN 'file modification time' THEN 5 ELSE 6 END AS rk FROM k)
SELECT sha256, arg_min(recorded_at, (rk, recorded_at)) AS recorded_at, arg_min(src, (rk, recorded_at)) AS source FROM o GROUP BY sha256""")
def s03_precedence(spark: SparkSession, sf: str) -> DataFrame:
    source = stamps.source_name(F.col("recorded_at_source"))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ("explicit", "container tag", "filename", "file creation time", "file modification time"))), source), F.lit(0))
    rows = table(spark, sf, "media").filter("recorded_at is not null").select("sha256", "recorded_at", source.alias("source"), F.when(order == 0, 6).otherwise(order).alias("rank"))
    by = F.struct("rank", "recorded_at")
    return rows.groupBy("sha256").agg(F.min_by("recorded_at", by).alias("recorded_at"), F.min_by("source", by).alias("source"))


@query(oracle(RUNS, select="SELECT run_id, media_sha[1:10] || '-' || fingerprint AS made, run_id = media_sha[1:10] || '-' || fingerprint AS same FROM r"))
def f13_run_id(spark: SparkSession, sf: str) -> DataFrame:
    made = store.run_id(F.col("media_sha"), F.col("fingerprint"))
    return base.runs(spark, sf).select("run_id", made.alias("made"), (F.col("run_id") == made).alias("same"))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    """Every run's media with its own key, and once more with a key that nobody has."""
    runs = base.runs(spark, sf).select("media_sha", "fingerprint")
    return runs.unionByName(runs.withColumn("fingerprint", F.reverse("fingerprint"))).distinct()


_WANTED = "wd AS (SELECT media_sha, fingerprint FROM r UNION SELECT media_sha, reverse(fingerprint) FROM r)"


@query(oracle(RUNS, _WANTED, select="SELECT wd.media_sha, wd.fingerprint, min(r.run_id) AS run_id FROM wd LEFT JOIN r ON wd.media_sha = r.media_sha AND wd.fingerprint = r.fingerprint AND r.run_id IN (SELECT run_id FROM words) GROUP BY wd.media_sha, wd.fingerprint"))
def j08_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return store.find(_wanted(spark, sf), base.runs(spark, sf), table(spark, sf, "words").select("run_id").distinct())


@query(oracle(RUNS, _WANTED, select="SELECT media_sha, fingerprint FROM wd WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.media_sha = wd.media_sha AND r.fingerprint = wd.fingerprint)"))
def j08_to_do(spark: SparkSession, sf: str) -> DataFrame:
    return store.missing(_wanted(spark, sf), base.runs(spark, sf))


@query(oracle(RUNS, select="SELECT source_path, arg_max(media_sha, (created_at, run_id)) AS media_sha FROM r GROUP BY source_path"))
def j09_latest_media(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest_media(base.runs(spark, sf))


@query(oracle(RUNS, select="SELECT DISTINCT sha256 FROM media WHERE sha256 NOT IN (SELECT media_sha FROM r WHERE has_speakers = 1)"))
def j10_unused_media(spark: SparkSession, sf: str) -> DataFrame:
    return store.unused_media(table(spark, sf, "media"), base.runs(spark, sf).filter("has_speakers = 1"))


_MODELS = (("base", {"whispercpp": "ggml-base", "mlx": "base-mlx"}), ("large-v3", {"whispercpp": "ggml-large-v3", "mlx": "large-v3-mlx"}), ("large-v3-turbo", {"whispercpp": "ggml-large-v3-turbo"}))


@query(oracle(RUNS, select="""SELECT run_id, CASE model || '@' || backend WHEN 'base@whispercpp' THEN 'ggml-base' WHEN 'base@mlx' THEN 'base-mlx' WHEN 'large-v3@whispercpp' THEN 'ggml-large-v3' WHEN 'large-v3@mlx' THEN 'large-v3-mlx' WHEN 'large-v3-turbo@whispercpp' THEN 'ggml-large-v3-turbo' END AS engine_id FROM r"""))
def j14_model_lookup(spark: SparkSession, sf: str) -> DataFrame:
    models = spark.createDataFrame(list(_MODELS), "model string, engine_ids map<string,string>")
    return base.runs(spark, sf).join(F.broadcast(models), "model", "left").select("run_id", F.col("engine_ids")[F.col("backend")].alias("engine_id"))


@query(oracle(SEGMENTS, RUNS, "x AS (SELECT run_id, count(*) AS segments, sum(len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda t: t <> ''))) AS words FROM segments GROUP BY run_id)", select="SELECT r.run_id, coalesce(x.segments, 0) AS segments, CAST(coalesce(x.words, 0) AS BIGINT) AS words, r.has_summary = 1 AS has_summary, r.has_speakers = 1 AS has_speakers FROM r LEFT JOIN x ON r.run_id = x.run_id"))
def a06_index_row(spark: SparkSession, sf: str) -> DataFrame:
    counts = base.segments(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.size(text.tokens(F.col("text")))).alias("w"))
    rows = base.runs(spark, sf).select("run_id", "has_summary", "has_speakers").join(counts, "run_id", "left")
    return rows.select("run_id", F.coalesce("n", F.lit(0)).alias("segments"), F.coalesce("w", F.lit(0)).alias("words"), (F.col("has_summary") == 1).alias("has_summary"), (F.col("has_speakers") == 1).alias("has_speakers"))


@query("SELECT 'media' AS kind, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT max(size_bytes) AS b FROM media GROUP BY sha256) UNION ALL SELECT 'runs', count(DISTINCT run_id), NULL FROM runs")
def a07_usage(spark: SparkSession, sf: str) -> DataFrame:
    return store.usage(table(spark, sf, "media"), table(spark, sf, "runs"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS shortfalls FROM events GROUP BY user_id")
def a16_shortfalls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("shortfalls"))


@query(oracle(RUNS, select="SELECT run_id, created_at FROM r WHERE lower(source_name) LIKE '%memo%' OR lower(source_path) LIKE '%memo%' OR lower(run_id) LIKE 'memo%' ORDER BY created_at DESC, run_id LIMIT 30"))
def o02_recent(spark: SparkSession, sf: str) -> DataFrame:
    return store.recent(base.runs(spark, sf), 30, "MEMO").select("run_id", "created_at")


@query("WITH ids AS (SELECT DISTINCT run_id FROM runs) SELECT run_id[1:4] AS prefix, count(*) AS n, CASE WHEN count(*) = 1 THEN min(run_id) END AS run_id FROM ids GROUP BY run_id[1:4]")
def o05_resolve_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Four-digit prefixes with the run that they name, null where they are ambiguous."""
    ids = table(spark, sf, "runs").select("run_id").distinct()
    return ids.groupBy(F.substring("run_id", 1, 4).alias("prefix")).agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("run_id")).alias("run_id"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Enrichments of half of the runs, and a new run for each of the others."""
    runs = base.runs(spark, sf)
    odd = F.pmod(F.length("source_path"), F.lit(2)) == 1
    return runs.withColumn("run_id", F.when(odd, F.col("run_id")).otherwise(F.concat("run_id", F.lit("x")))).withColumn("model", F.lit("new")).withColumn("has_summary", F.lit(1)).withColumn("words", F.col("words") + 1)


_CHANGES = "ch AS (SELECT * REPLACE (CASE WHEN length(source_path) % 2 = 1 THEN run_id ELSE run_id || 'x' END AS run_id, 'new' AS model, 1 AS has_summary, words + 1 AS words) FROM r)"


@query(oracle(RUNS, _CHANGES, select="""SELECT coalesce(r.run_id, ch.run_id) AS run_id, CASE WHEN r.run_id IS NULL THEN ch.model ELSE r.model END AS model,
coalesce(ch.has_summary, r.has_summary) AS has_summary, coalesce(ch.words, r.words) AS words FROM r FULL JOIN ch ON r.run_id = ch.run_id"""))
def d01_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return store.upsert(base.runs(spark, sf), _changes(spark, sf)).select("run_id", "model", "has_summary", "words")


@query(oracle(RUNS, _CHANGES, select="SELECT ch.run_id, coalesce(r.created_at, '2030') AS created_at FROM ch LEFT JOIN r ON ch.run_id = r.run_id"))
def d02_keep_created(spark: SparkSession, sf: str) -> DataFrame:
    late = _changes(spark, sf).withColumn("created_at", F.lit("2030"))
    return store.keep_created(base.runs(spark, sf), late).select("run_id", "created_at")


@query(oracle(RUNS, select="SELECT run_id FROM r WHERE has_summary <> 0"))
def d03_forget(spark: SparkSession, sf: str) -> DataFrame:
    runs = base.runs(spark, sf).select("run_id", "has_summary")
    return store.forget(runs, runs.filter("has_summary = 0")).select("run_id")


@query()
def d04_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Runs older than two years on 2026-01-01; a time that cannot be read counts as old."""
    runs = base.runs(spark, sf).select("run_id", "created_at")
    read = stamps.resolve(runs, "created_at", F.lit("created_at"), F.lit(None).cast("string"), F.lit(True))
    return read.filter(store.expired(F.col("epoch_us") / 1e6, 1_767_225_600.0, 730)).select("run_id")


@query(oracle(RUNS, select="SELECT run_id, coalesce(epoch(TRY_CAST(created_at AS TIMESTAMP)), 0) AS epoch FROM r WHERE regexp_full_match(created_at, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}')").replace("epoch(TRY_CAST(created_at AS TIMESTAMP))", "CAST(floor(epoch(TRY_CAST(created_at AS TIMESTAMP))) AS BIGINT)"))
def c22_iso_epoch(spark: SparkSession, sf: str) -> DataFrame:
    plain = base.runs(spark, sf).filter(F.col("created_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"))
    return plain.select("run_id", F.coalesce(F.unix_timestamp(F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd'T'HH:mm:ss"))), F.lit(0)).alias("epoch"))


@query()
def c22_iso_epoch_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every run's seconds since 1970, from any ISO notation; 0 where its text is none."""
    return base.runs(spark, sf).select("run_id", F.coalesce(stamps.each(F.col("created_at"), stamps.iso_micros, "bigint") / 1e6, F.lit(0.0)).alias("epoch"))


@query("SELECT engine AS kind, arg_min(model, (n, model)) AS name FROM (SELECT backend AS engine, model, count(*) AS n FROM runs GROUP BY backend, model) WHERE n > 1 GROUP BY engine")
def c24_first_available(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "runs").groupBy(F.col("backend").alias("kind"), F.col("model").alias("name")).agg(F.count("*").alias("rank"))
    return store.first_available(counts.withColumn("ok", F.col("rank") > 1))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(CAST(trunc(TRY_CAST(substr(CAST(round(value, 2) AS VARCHAR), 1, 3) AS DOUBLE)) AS BIGINT), 0) AS part,
CASE lower(event_type) WHEN 'click' THEN true WHEN 'error' THEN false END AS flag FROM events""")
def s09_p10_coercers(spark: SparkSession, sf: str) -> DataFrame:
    word = F.lower("event_type")
    return table(spark, sf, "events").select(
        "event_id", text.as_int(F.get_json_object("props", "$.k"), -1).alias("k"),
        text.as_int(F.substring(F.round("value", 2).cast("string"), 1, 3)).alias("part"), F.when(word == "click", True).when(word == "error", False).alias("flag"),
    )
