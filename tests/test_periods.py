import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import periods

KIND = "k string, s double, e double, bucket int, starts string"


def brute(rows):
    """Periods and gaps of each key, one interval after another."""
    out, gaps = [], []
    for key in {r[0] for r in rows}:
        cur = None
        for s, e in sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e > s):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                if cur:
                    out.append((key, *cur))
                    gaps.append((key, cur[1], s))
                cur = [s, e]
        if cur:
            out.append((key, *cur))
    return sorted(out, key=repr), sorted(gaps, key=repr)


def run(spark, rows, bucket):
    df = spark.createDataFrame([(k, None if s is None else float(s), None if e is None else float(e), 1, "x") for k, s, e in rows], KIND)
    args = (df, ["k"], F.col("s"), F.col("e"), bucket)
    p = sorted(map(tuple, periods.periods(*args).collect()), key=repr)
    g = sorted(map(tuple, periods.gaps(*args).collect()), key=repr)
    return p, g


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c"]), s := r.randint(-50, 4000), s + r.choice([0, -3, 1, 5, 40, 900])) for _ in range(300)]
    rows += [("a", None, 5), ("b", 5, None), (None, 1, 9), (None, 4, 12), (None, 20, 21)] + rows[:40]
    assert run(spark, rows, 100) == brute(rows)
    assert run(spark, rows, 1_000_000) == brute(rows)


def test_one_entity_holds_most_rows(spark):
    rows = [("hot", i, i + 3) for i in range(0, 6000, 5)] + [("cold", 0, 1)]
    assert run(spark, rows, 700) == brute(rows)


def test_interval_over_many_buckets(spark):
    rows = [("a", 0, 5000), ("a", 10, 20), ("a", 4000, 4010), ("a", 5001, 5002)]
    assert run(spark, rows, 100)[1] == [("a", 5000, 5001)]


def test_empty(spark):
    assert run(spark, [], 100) == ([], [])


def test_merge_is_a_union():
    a = (np.array([0, 10]), np.array([5, 20]))
    b = (np.array([5, 30]), np.array([11, 31]))
    s, e = periods.merge_lists(a, b)
    assert (s.tolist(), e.tolist()) == ([0, 30], [20, 31])
