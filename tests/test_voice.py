import random

import pytest

from tidemark.operators import voice


def spans(spark, rows, duration=None):
    data = [("r", i, s, e, duration) for i, (s, e) in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, span_idx int, s bigint, e bigint, duration bigint")


def out(df):
    return sorted((r["s"], r["e"]) for r in df.collect())


@pytest.mark.parametrize(("rows", "duration", "want"), [
    ([(0, 5000), (5300, 9000)], None, [(0, 9000)]),
    ([(0, 5000), (20_000, 25_000)], None, [(0, 5000), (20_000, 25_000)]),
    ([(0, 100), (10_000, 15_000)], None, [(10_000, 15_000)]),
    ([(-2000, 70_000)], 60_000, [(0, 60_000)]),
    ([(5, 5), (9, 3), (None, 4), (1, None)], None, []),
    ([], None, []),
])
def test_merge(spark, rows, duration, want):
    assert out(voice.merge_spans(spans(spark, rows, duration))) == want


def test_split(spark):
    assert out(voice.split_long(spans(spark, [(0, 1_500_000)]))) == [(0, 600_000), (600_000, 1_200_000), (1_200_000, 1_500_000)]


def test_merge_like_one_after_another(spark):
    r = random.Random(1)
    rows = [(s := r.randint(-5, 20_000_000), s + r.randint(1, 60_000)) for _ in range(400)]
    want = []
    for s, e in sorted(rows, key=lambda x: x[0]):
        s = max(s, 0)
        if want and s - want[-1][1] <= 800:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert out(voice.merge_spans(spans(spark, rows))) == [tuple(w) for w in want if w[1] - w[0] >= 250]


def test_invert(spark):
    rows = [("r", 1, 10_000, 20_000, 60_000), ("r", 2, 30_000, 40_000, 60_000), ("open", 1, 10_000, None, 60_000)]
    df = spark.createDataFrame(rows, "run_id string, silence_idx int, s bigint, e bigint, duration bigint")
    got = sorted(tuple(r) for r in voice.invert(df, 0).collect())
    assert got == [("open", 0, 10_000), ("r", 0, 10_000), ("r", 20_000, 30_000), ("r", 40_000, 60_000)]


def test_batches(spark):
    rows = [(i * 70_000, i * 70_000 + 60_000) for i in range(20)]
    got = voice.batches(spans(spark, rows), 300_000).collect()
    totals = {}
    for r in got:
        totals[r["batch"]] = totals.get(r["batch"], 0) + r["e"] - r["s"]
    assert len(got) == 20 and max(totals.values()) <= 300_000 and sorted(totals) == [1, 2, 3, 4]
    many = voice.batches(spans(spark, [(i * 6000, i * 6000 + 5000) for i in range(430)])).collect()
    assert max(r["batch"] for r in many) <= 8
    assert [r["batch"] for r in voice.batches(spans(spark, [(0, 5_000_000)]), 300_000).collect()] == [1]
