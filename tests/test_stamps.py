import hashlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stamps
from tidemark.plans import archive, output, terms


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-02-29T10:00:00Z", None, us(2024, 2, 29, 10)),
    ("2023-02-29T10:00:00Z", None, None),
    ("2024-01-14T03:03:08.719+01:00", None, us(2024, 1, 14, 2, 3, 8, micro=719_000)),
    ("2024-01-14T03:03:08.123456789Z", None, us(2024, 1, 14, 3, 3, 8, micro=123_456)),
    ("2024-01-14T03:03:08,5Z", None, us(2024, 1, 14, 3, 3, 8, micro=500_000)),
    ("2024-01-14T03:03", "UTC", us(2024, 1, 14, 3, 3)),
    ("2024-01-14T22:54:60Z", None, None),
    ("2024-01-14", "UTC", None),
    ("18:42:07", "UTC", None),
    ("03/04/2024 05:06:07 PM", "UTC", us(2024, 3, 4, 17, 6, 7)),
    ("03/04/2024 12:00:00 AM", "UTC", us(2024, 3, 4)),
    ("13/04/2024 12:00:00 AM", "UTC", None),
    ("03.04.2024 05:06:07", "UTC", us(2024, 4, 3, 5, 6, 7)),
    ("2024:03:04 05:06:07", "Asia/Kathmandu", us(2024, 3, 3, 23, 21, 7)),
    ("20240304-050607", "UTC", us(2024, 3, 4, 5, 6, 7)),
    ("20240304T050607Z", None, us(2024, 3, 4, 5, 6, 7)),
    ("2024-064T05:06:07Z", None, us(2024, 3, 4, 5, 6, 7)),
    ("2023-366T05:06:07Z", None, None),
    ("1700000000", None, 1_700_000_000_000_000),
    ("1700000000.25", None, 1_700_000_000_250_000),
    ("1700000000123", None, 1_700_000_000_123_000),
    ("Tue, 31 Jan 2023 12:09:44 +0530", None, us(2023, 1, 31, 6, 39, 44)),
    ("Jan 31, 2023 4:37:47 PM UTC", None, us(2023, 1, 31, 16, 37, 47)),
    ("31 Jan 2023 12:09:44", "Asia/Tokyo", us(2023, 1, 31, 3, 9, 44)),
    ("2023-01-31 12:09:44 EST", None, us(2023, 1, 31, 17, 9, 44)),
    ("2023-01-31 12:09:44 QQQ", None, None),
    ("VN_2023-11-03_23.55.16", "UTC", us(2023, 11, 3, 23, 55, 16)),
    (" \tmemo 20230709_213030\n", "UTC", us(2023, 7, 9, 21, 30, 30)),
    ("2023-11-09T16:58:29-05:00[America/New_York]", None, us(2023, 11, 9, 21, 58, 29)),
    # a clock that occurs twice means the first time; one that is skipped moves on
    ("2023-10-29 02:30:00", "Europe/Berlin", us(2023, 10, 29, 0, 30)),
    ("2023-03-26 02:30:00", "Europe/Berlin", us(2023, 3, 26, 1, 30)),
    ("2023-10-29 02:30:00", None, None),
    ("2023-10-29 02:30:00", "Mars/Base", None),
    ("", "UTC", None), (None, "UTC", None), ("n/a", "UTC", None), ("x" * 100_000, "UTC", None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(i, *c, "clash") for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, stamp string, zone string, want bigint, epoch_us string")
    got = stamps.resolve(df, "stamp", F.lit("one"), F.col("zone"), F.lit(False))
    return {r["n"]: r for r in got.collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(read, n):
    assert read[n]["epoch_us"] == CASES[n][2]
    assert read[n]["stamp_status"] == ("unusable" if CASES[n][2] is None else "ok")


def test_rows_stay(read):
    assert len(read) == len(CASES)


def test_empty(spark):
    df = spark.createDataFrame([], "stamp string, zone string")
    assert stamps.resolve(df, "stamp", F.lit("x"), F.col("zone"), F.lit(True)).collect() == []


def test_mixture_decides_by_source(spark):
    # one source writes days first, as its days above 12 show; another leaves it open
    rows = [("a", f"{d:02d}/03/2024 10:00:00") for d in range(13, 29)] + [("a", "04/05/2024 10:00:00")]
    rows += [("b", "04/05/2024 10:00:00"), ("b", "06/05/2024 10:00:00"), (None, "05/05/2024 10:00:00")]
    df = spark.createDataFrame(rows, "src string, stamp string")
    got = stamps.resolve(df, "stamp", F.col("src"), F.lit("UTC"), F.lit(True), conventions={}).collect()
    found = {(r["src"], r["stamp"]): (r["stamp_status"], r["epoch_us"]) for r in got}
    assert found["a", "04/05/2024 10:00:00"] == ("ok", us(2024, 5, 4, 10))
    assert found["b", "04/05/2024 10:00:00"] == ("ambiguous", None)
    assert found[None, "05/05/2024 10:00:00"] == ("ok", us(2024, 5, 5, 10))


def test_iso_notations(spark, tmp_path):
    at = 1_711_929_600_000_000
    for value, want in (("2024-04-01T00:00:00Z", at), ("2024-04-01 02:00:00+02:00", at), ("2024-04-01T00:00:00.5", at + 500_000), ("20240401", at), ("2024-02-30", None), ("soon", None), ("", None), (None, None)):
        assert stamps.iso_micros(value) == want
    assert stamps.tag_micros(" 2024-04-01T00:00:00Z ") == at and stamps.iso_micros(" 2024-04-01") is None
    assert stamps.name_date("/a/take 2026-03-31 13.32.57.wav") == stamps.name_date("x_20260331_133257.m4a") == "2026-03-31 13:32:57"
    assert stamps.name_date("x_20260331-133257.m4a") is None
    assert stamps.name_date("/2026-03-31 13.32.57/memo.wav") is None
    spark.createDataFrame([("a.wav", "1", "2024-04-01T00:00:00Z"), ("20260331_133257.wav", "2", None)], "path string, sha256 string, recorded_at string").write.parquet(f"{tmp_path}/media.parquet")
    got = {r["sha256"]: (r["epoch_us"], r["name_date"]) for r in output.f11_iso_and_name(spark, str(tmp_path)).collect()}
    assert got == {"1": (at, None), "2": (None, "2026-03-31 13:32:57")}
    runs = spark.createDataFrame([("a", "2024-04-01T02:00:00+02:00", 0, 0), ("b", "soon", 0, 0), ("c", None, 0, 0)], "run_id string, created_at string, has_summary int, has_speakers int")
    runs.write.parquet(f"{tmp_path}/runs.parquet")
    assert {r["run_id"]: r["epoch"] for r in archive.c22_iso_epoch_all(spark, str(tmp_path)).collect()} == {"a": at / 1e6, "b": 0.0, "c": 0.0}


def test_norm_of_every_kind(spark, tmp_path):
    spark.createDataFrame([(1, "note", "A, b"), (2, "chat", "Да — нет!"), (3, "log", None)], "doc_id int, kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["sha"] for r in terms.f01_norm_all(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256("да нет".encode()).hexdigest(), 3: None}


def test_conventions_are_priors(spark):
    """By the convention months come first with slashes, whatever else a source writes; what only breaks it is no stamp."""
    rows = [("a", f"{d:02d}/03/2024 10:00:00") for d in range(13, 29)] + [("a", "04/05/2024 10:00:00"), ("a", "05.04.2024 10:00:00"), ("a", "soon"), ("b", "2024-04-05T10:00:00Z")]
    rows += [("b", f"2024-01-01T00:00:{n % 60:02d}Z") for n in range(500)]
    df = spark.createDataFrame(rows, "src string, stamp string")
    got = {(r["src"], r["stamp"]): r for r in stamps.resolve(df, "stamp", F.col("src"), F.lit("UTC"), F.lit(True)).collect()}
    assert (got["a", "04/05/2024 10:00:00"]["epoch_us"], got["a", "04/05/2024 10:00:00"]["stamp_readings"]) == (us(2024, 4, 5, 10), 2)
    assert got["a", "05.04.2024 10:00:00"]["epoch_us"] == us(2024, 4, 5, 10)
    assert got["a", "20/03/2024 10:00:00"]["stamp_status"] == "unusable" and got["a", "20/03/2024 10:00:00"]["stamp_readings"] == 1
    assert got["a", "soon"]["stamp_readings"] == 0


def test_a_rare_format_survives(spark):
    counts = spark.createDataFrame([("s", ["iso"], 10**11), ("s", [], 10**10), ("s", ["compact"], 1)], "source string, readings array<string>, n bigint")
    got = {r["fmt"]: r["weight"] for r in stamps.fit_weights(counts).collect()}
    assert got["compact"] > 100 * got[stamps.JUNK]
