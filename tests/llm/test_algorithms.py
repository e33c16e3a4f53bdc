import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import canonical, nearest, packing, spelling
from tidemark.llm.canonical import BKTree, Forest, distance


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def some_words(n, seed, letters="abcd", longest=9):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_distance_is_levenshtein():
    for a, b in zip(some_words(1500, 1), some_words(1500, 2), strict=True):
        assert distance(a, b) == slow_distance(a, b) == distance(b, a)
    assert distance("x" * 5000, "x" * 4990) == 10


def test_forest_finds_what_one_tree_does():
    r = random.Random(4)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(0, 9))) for _ in range(400)]
    forest = Forest((w, (i,)) for i, w in enumerate(words))
    for _ in range(60):
        probe, radius = "".join(r.choice("abcd") for _ in range(r.randint(0, 9))), r.randint(0, 3)
        got = {k: d for d, k, _ in forest.within(probe, radius)}
        assert got == {w: distance(w, probe) for w in words if distance(w, probe) <= radius}


def test_tree_returns_every_key_within():
    words = sorted(set(some_words(300, 3)) - {""})
    tree = BKTree((w, (i, w)) for i, w in enumerate(words))
    for q in some_words(60, 4):
        for radius in (0, 1, 2, 3):
            assert sorted(k for _, k, _ in tree.within(q, radius)) == sorted(w for w in words if slow_distance(q, w) <= radius)


@pytest.mark.parametrize(("value", "entry"), [
    ("Vexre Signal", 1), ("  vexre_signal? ", 1), ("the VEXRE signal’s", 1), ("ВЕКСРЕ СИГНАЛ", 1), ("Vехre Signal", 1), ("Ｖｅｘｒｅ Ｓｉｇｎａｌ", 1),
    ("vexre sgnal", 1), ("in wexre signals' then", 1), ("Krövo", 2), ("Krovo 4", 3), ("krovo 7", None), ("second name", 2), ("kitchen", None),
    ("the small signal", None), (None, None), ("", None), ("???", None), ("[inaudible]", None), ("n/a", None), ("x" * 100_000, None),
])
def test_match(index, value, entry):
    got = index.best(value)
    assert (got[3] if got else None) == entry


LIST = [(1, "Vexre Signal"), (2, "Krovo"), (2, " second  NAME "), (3, "Krovo 4"), (4, "Gegiana"), (4, "Gegiana"), (5, ""), (6, None)]


@pytest.fixture(scope="module")
def index():
    return canonical.Index.of(LIST)


def test_sharded_agrees_with_broadcast(spark):
    r = random.Random(9)
    names = sorted({w for w in some_words(120, 5, "bdeiklmnorstu", 12) if len(w) > 5})
    listed = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + LIST, "entry bigint, spelling string")
    values = [n[: k] + r.choice("aoz") + n[k + 1 :] for n in names for k in (r.randrange(len(n)),)] + ["krovo", None, "", "zzz"] + ["krovo"] * 20
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(values)], "id int, value string, match string, _block string")
    one = {r["id"]: r["match"] for r in canonical.map_to_entries(df, "value", listed).collect()}
    many = {r["id"]: r["match"] for r in canonical.map_to_entries(df.drop("match"), "value", listed, shard=25, block=30).collect()}
    assert one == many and len(one) == len(values) and sum(m is not None for m in one.values()) > 80


def test_no_list_and_no_values(spark):
    none = spark.createDataFrame([], "entry bigint, spelling string")
    df = spark.createDataFrame([("a",), (None,)], "value string")
    assert [r["match"] for r in canonical.map_to_entries(df, "value", none).collect()] == [None, None]
    assert canonical.map_to_entries(df.limit(0), "value", none).collect() == []


def test_keys():
    assert spelling.bare_keys("with Krovo's") == ["withkrovo", "krovo"]
    assert spelling.key("Й й ё") == "jje" and spelling.sound("phooks") == spelling.sound("fux")


def slow_nearest(points, spans, tolerance):
    out = {}
    for e, k, t in points:
        if None in (e, k, t):
            continue
        best = None
        for e2, r, s, f in spans:
            if e2 != e or None in (r, s, f) or s > f:
                continue
            d = max(s - t, t - f, 0)
            rank = (d, 0 if d else -f, r)
            if d <= tolerance and (best is None or rank < best):
                best = rank
        if best:
            out[e, k] = best[0], best[2]
    return out


def run_nearest(spark, points, spans, tolerance):
    left = spark.createDataFrame([(*p, 1, "x") for p in points], "run string, k int, t bigint, r int, bucket string")
    right = spark.createDataFrame([(*s, "y", 7) for s in spans], "run string, r int, s bigint, f bigint, k string, t int")
    got = nearest.nearest(left, right, "run", ["k"], F.col("t"), "r", F.col("s"), F.col("f"), tolerance).collect()
    assert len({(g["run"], g["k"]) for g in got}) == len(got)
    return {(g["run"], g["k"]): (g["gap_ms"], g["r"]) for g in got}


def test_nearest_like_all_pairs(spark):
    r = random.Random(8)
    points = [(r.choice(["a", "b"]), i, r.randint(-2000, 300_000)) for i in range(200)]
    spans, at = [], {"a": -2000, "b": -2000}
    for i in range(400):
        e = r.choice(["a", "b"])
        at[e] += r.randint(1, 1500)
        spans.append((e, i, at[e], at[e] + r.choice([0, 1, 300, 900])))
    spans += [("a", 900, 5_000, 290_000), ("b", 901, -10**9, -10**9 + 5), ("b", 902, 7, 6), (None, 1, 1, 2), ("a", 903, None, 5), ("a", None, 1, 2)]
    points += [("c", 1, 5), (None, 3, 5), ("a", None, 5), ("a", 999, None)]
    assert run_nearest(spark, points + points[:30], spans + spans[:50], 500) == slow_nearest(points, spans, 500)


def test_nearest_ties_edges_and_empty(spark):
    spans = [("a", 5, 100, 200), ("a", 3, 300, 400), ("a", 9, 300, 300)]
    points = [("a", 1, 250), ("a", 2, 900), ("a", 3, 901), ("a", 4, 300)]
    assert run_nearest(spark, points, spans, 500) == slow_nearest(points, spans, 500)
    assert run_nearest(spark, [], spans, 500) == {} and run_nearest(spark, points, [], 500) == {}


def sequential(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, b in enumerate(bins) if capacity - b >= s]
        if fit:
            bins[max(fit, key=lambda i: bins[i])] += s
        else:
            bins.append(s)
    return sorted(bins)


@pytest.mark.parametrize("capacity", [7, 50, 2048])
def test_plan_is_best_fit_decreasing(capacity):
    r = random.Random(capacity)
    for _ in range(25):
        counts = Counter(r.randint(1, capacity) for _ in range(r.randint(0, 300)))
        plan = packing.best_fit(counts, capacity)
        load = Counter()
        for size, n in counts.items():
            runs = sorted((f, e, c) for s, f, e, c in zip(plan.size, plan.first, plan.each, plan.container, strict=True) if s == size)
            for rank in range(n):
                f, e, c = [x for x in runs if x[0] <= rank][-1]
                load[c + (rank - f) // e] += size
        assert sorted(load.values()) == sequential(counts.elements(), capacity) and set(load) == set(range(plan.containers))


def test_pack(spark):
    r = random.Random(4)
    sizes = [r.choice([1, 3, 40, 99, 100, 100, 101, 250, 1000]) for _ in range(500)] + [0, None, -5] + [7] * 400
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(sizes)], "id int, n int, container string, part int")
    got = packing.pack(df, "id", "n", 100, partitions=5).collect()
    load, placed = Counter(), Counter()
    for row in got:
        load[row["container"]] += row["size"]
        placed[row["id"]] += row["size"]
    assert max(load.values()) <= 100 and len({(g["id"], g["part"]) for g in got}) == len(got)
    assert all(placed[i] == max(s or 0, 0) for i, s in enumerate(sizes)) and len(placed) == len(sizes)
    pieces = [p for s in sizes if s and s > 0 for p in [100] * (s // 100) + ([s % 100] if s % 100 else [])]
    assert sorted(v for v in load.values() if v) == sequential(pieces, 100)


def test_pack_nothing(spark):
    empty = spark.createDataFrame([], "id int, n int")
    assert packing.pack(empty, "id", "n", 10).collect() == []
    only = spark.createDataFrame([(1, 0), (2, None)], "id int, n int")
    assert sorted(r["size"] for r in packing.pack(only, "id", "n", 10).collect()) == [0, 0]
    with pytest.raises(ValueError):
        packing.pack(only, "id", "n", 0)
