"""Rules over settings, each with its edges."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import settings, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def fails(spark, column):
    with pytest.raises(Exception, match="unknown|must lie"):
        one(spark, column)


def test_context(spark):
    assert [one(spark, settings.context_tokens(F.lit(m))) for m in ("off", "short", "full", None)] == [0, 64, 224, None]
    fails(spark, settings.context_tokens(F.lit("long")))


@pytest.mark.parametrize(("mode", "fix", "chosen", "want"), [("off", True, False, "auto"), ("off", True, True, "off"), ("off", False, False, "off"), ("always", True, False, "always"), ("off", None, None, "off"), (None, True, False, None)])
def test_compare_mode(spark, mode, fix, chosen, want):
    flag = lambda v: F.lit(v).cast("boolean")
    assert one(spark, settings.compare_mode(F.lit(mode).cast("string"), flag(fix), flag(chosen))) == want


def test_unknown_compare_mode(spark):
    fails(spark, settings.compare_mode(F.lit("sometimes"), F.lit(True), F.lit(False)))


@pytest.mark.parametrize(("asked", "models", "fix", "want"), [(0, 0, True, 1), (0, 1, True, 0), (2, 0, True, 2), (0, 0, False, 0), (None, None, None, 0)])
def test_extra_decodes(spark, asked, models, fix, want):
    assert one(spark, settings.extra_decodes(F.lit(asked).cast("int"), F.lit(models).cast("int"), F.lit(fix).cast("boolean"))) == want


def test_ranges(spark):
    assert one(spark, settings.in_range(F.lit(0.8), 0, 1, "likeness")) == 0.8
    for wrong in (1.1, -0.1, float("nan")):
        fails(spark, settings.in_range(F.lit(wrong), 0, 1, "likeness"))


@pytest.mark.parametrize(("value", "kinds"), [("1", {"int", "float"}), ("true", {"bool"}), ("0.5", {"float"}), ("1e999", set()), ("NaN", set()), ('"a"', {"str"}), ("null", set()), (None, set()), ("-3", {"int", "float"})])
def test_types(spark, value, kinds):
    assert {k for k in ("int", "float", "bool", "str") if one(spark, settings.valid_setting(F.lit(value).cast("string"), k))} == kinds


def test_zone(spark):
    assert one(spark, settings.zone(F.lit("Asia/Kathmandu"))) == "Asia/Kathmandu"
    fails(spark, settings.zone(F.lit("Mars/Base")))


def test_settled(spark):
    engines = spark.createDataFrame([("w", True, True, True), ("m", False, True, False), ("p", True, False, False)], "backend string, has_budget boolean, can_pin boolean, pin_costs boolean")
    rows = [(1, "w", "off", "off", "g", None), (2, "w", "off", "auto", "g", None), (3, "w", "off", "off", "", None), (4, "m", "short", "off", "", None), (5, "p", "off", "off", "g", ["b", "a", "b"]), (6, "?", "full", "off", None, None)]
    df = spark.createDataFrame(rows, "n int, backend string, context string, compare string, prompt string, skipped array<string>")
    got = {r["n"]: (r["context"], r["limits"]) for r in settings.settled(df, engines).collect()}
    assert got == {1: ("short", []), 2: ("off", []), 3: ("off", []), 4: ("full", []), 5: ("off", ["a was unavailable", "b was unavailable", "p cannot pin the glossary"]), 6: ("full", [])}


def test_missing_enrichments(spark):
    lit = lambda v: F.lit(v)
    found = lambda *a: one(spark, settings.missing_enrichments(*map(lit, a)))
    assert found(True, False, True, "speakers=2", "speakers=3") == ["summary", "speakers"]
    assert found(True, True, True, "speakers=2", "speakers=2") == [] and found(False, False, False, "a", "b") == []


def test_fingerprints(spark):
    rows = [("w", "base", None), ("w", "base", "short"), ("m", None, "off")]
    df = spark.createDataFrame(rows, "backend string, model string, context string")
    got = [r["f"] for r in df.select(store.fingerprints(df, df.columns).alias("f")).collect()]
    assert got == [store.fingerprint({k: v for k, v in zip(df.columns, r, strict=True) if v is not None}) for r in rows] and len(set(got)) == 3
