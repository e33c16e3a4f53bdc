import random

import pytest

from tidemark.operators import overlap

SEG = "run_id string, seg_idx int, s bigint, e bigint, text string, confidence double"


def segs(spark, rows):
    return spark.createDataFrame([("r", i, *r) if len(r) == 4 else ("r", i, *r, "word", 0.5) for i, r in enumerate(rows)], SEG)


@pytest.mark.parametrize(("primary", "alternate", "want"), [
    ([(0, 5000)], [(200, 5400)], [(0, 0)]), ([(0, 2000), (2000, 4000)], [(1900, 4100)], [(0, 1)]),
    ([(0, 2000)], [(90_000, 92_000)], []), ([(0, 4000), (4000, 8000)], [(2000, 6000)], []),
    ([(0, 4000), (4000, 8000)], [(0, 6000)], []), ([(0, 4000), (4000, 8000)], [(0, 5000), (5000, 8000)], [(0, 0), (1, 1)]),
    ([], [(0, 1)], []),
])
def test_assign(spark, primary, alternate, want):
    got = overlap.assign(segs(spark, primary), segs(spark, alternate)).collect()
    assert sorted((r["alt_idx"], r["seg_idx"]) for r in got) == want


def test_reassembled(spark):
    alternate = segs(spark, [(0, 3000, "a", 0.9), (3000, 6000, "b", 0.8)])
    row = overlap.second_readings(segs(spark, [(0, 6000)]), alternate).collect()[0]
    assert row["reading"] == "a b" and abs(row["confidence"] - 0.85) < 1e-9


def test_pairs_like_all_pairs(spark):
    r = random.Random(2)
    make = lambda n: [(s := r.randint(-90_000, 400_000), s + r.choice([0, -5, 1, 700, 60_000, 250_000])) for _ in range(n)]
    a, b = make(80), make(80)
    got = sorted((x["seg_idx"], x["r_seg_idx"], x["overlap"]) for x in overlap.overlapping(segs(spark, a), segs(spark, b)).collect())
    want = sorted((i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] > x[0] and y[1] > y[0] and x[0] < y[1] and y[0] < x[1])
    assert got == want


def test_attach_ties_and_nothing(spark):
    turns = spark.createDataFrame([("r", 0, 0, 1000, "A"), ("r", 1, 1000, 2000, "B"), ("r", 2, None, 5, "C")], "run_id string, turn_idx int, s bigint, e bigint, speaker string")
    got = overlap.attach(segs(spark, [(500, 1500), (5000, 6000), (None, None)]), turns).orderBy("seg_idx").collect()
    assert [r["speaker"] for r in got] == ["A", None, None]


def test_to_source(spark):
    pieces = spark.createDataFrame([("r", 1, 1, 0, 10_000, 100_000), ("r", 1, 2, 10_200, 15_200, 300_000)], "run_id string, batch int, piece int, chunk_s bigint, chunk_e bigint, source_s bigint")
    points = spark.createDataFrame([("r", 1, t) for t in (5000, 12_000, 10_100, 99_000)] + [("q", 1, 7)], "run_id string, batch int, t bigint")
    got = {r["t"]: r["source_ms"] for r in overlap.to_source(points, pieces).collect()}
    assert got == {5000: 105_000, 12_000: 301_800, 10_100: 300_000, 99_000: 305_000, 7: 7}


def test_silence(spark):
    spans = spark.createDataFrame([("r", 0, 1000)], "run_id string, s bigint, e bigint")
    got = overlap.outside_share(segs(spark, [(0, 2000), (5000, 6000), (7, 7)]), spans).orderBy("seg_idx").collect()
    assert [r["silence"] for r in got] == [0.5, 1.0, 0.0]
    none = overlap.outside_share(segs(spark, [(0, 2000)]), spans.limit(0)).collect()
    assert none[0]["silence"] == 0.0
