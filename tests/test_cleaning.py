import random

import pytest

from tidemark.operators import cleaning
from tidemark.plans import speech


@pytest.mark.parametrize(("value", "want"), [
    ("no no no no no no no no", "no"), ("and so on and so on and so on and so on and so on and so on", "and so on"),
    ("no no no", "no no no"), ("well and so on and so on and so on and so on", "well and so on and so on and so on and so on"),
    ("", ""), (None, None), ("one", "one"),
])
def test_collapse(value, want):
    assert cleaning.collapse(value) == want


def slow(words, size, most):
    """The scan written out: the group at each place, how often it follows itself, and on from there."""
    out, i, hit = [], 0, False
    while i < len(words):
        g = words[i : i + size]
        if len(g) < size:
            return out + words[i:], hit
        n = 1
        while words[i + n * size : i + (n + 1) * size] == g:
            n += 1
        out += g if n > most else words[i : i + n * size]
        hit |= n > most
        i += n * size
    return out, hit


def test_collapse_like_the_scan():
    r = random.Random(5)
    for _ in range(3000):
        words = [r.choice("ab") for _ in range(r.randint(0, 24))]
        want = " ".join(words)
        if len(words) >= 6:
            for size in range(1, min(8, len(words) // 3) + 1):
                got, hit = slow(words, size, 3)
                if hit:
                    want = " ".join(got)
                    break
        assert cleaning.collapse(" ".join(words)) == want


def test_no_repeats_is_an_error():
    with pytest.raises(ValueError):
        cleaning.collapse("a a a", 0)


def flagged(spark, rows, **options):
    df = spark.createDataFrame([("r", i, t, c, s) for i, (t, c, s) in enumerate(rows)], "run_id string, seg_idx int, text string, confidence double, silence double")
    return [r["reason"] for r in cleaning.clean(df, **options).orderBy("seg_idx").collect()]


def test_reasons(spark):
    rows = [("Субтитры сделал кто-то", 0.99, 0.0), ("Thank you", 0.95, 0.0), ("thank you.", 0.95, 0.9), ("Thank you", 0.2, 0.0), ("", 0.9, 0.0), ("...", 0.9, 0.0), ("ерунда", 0.1, 0.9), ("да", None, 0.0), (None, None, 0.0)]
    h = "hallucination"
    assert flagged(spark, rows) == [h, None, h, h, "empty", h, None, None, "empty"]
    assert flagged(spark, [("Thank you", 0.95, 0.0)], strict=True) == [h]


def test_echoes(spark):
    rows = [("same line", 0.9, 0.0)] * 4 + [("other", 0.9, 0.0)] + [("Same, line!", 0.9, 0.0)] * 2
    assert flagged(spark, rows) == [None, "loop-echo", "loop-echo", "loop-echo", None, None, None]
    assert flagged(spark, [("x" * 61, 0.9, 0.0)] * 3) == [None] * 3


def test_reports_count_echoes(spark, tmp_path):
    texts = ["same line"] * 4 + ["no no no no no no no no"]
    words = [("r", i, k, w, 10.0 * i + k, 10.0 * i + k + 1, 0.2) for i, t in enumerate(texts) for k, w in enumerate(t.split())]
    spark.createDataFrame(words, "run_id string, turn_idx int, word_idx int, text string, start_s double, end_s double, p double").write.parquet(f"{tmp_path}/words.parquet")
    spark.createDataFrame([("r", 0, 0.0, 90.0)], "run_id string, span_idx int, start_s double, end_s double").write.parquet(f"{tmp_path}/spans.parquet")
    dropped = {(r["seg_idx"], r["reason"]) for r in speech.p04_dropped(spark, str(tmp_path)).collect()}
    assert dropped == {(i, "loop-echo") for i in (1, 2, 3)}
    assert [r.asDict() for r in speech.a08_clean_report(spark, str(tmp_path)).collect()] == [{"run_id": "r", "dropped": 3, "flagged_low": 2}]
    assert [r["collapsed"] for r in speech.a08_clean_report_collapsed(spark, str(tmp_path)).collect()] == [1]
