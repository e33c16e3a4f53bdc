"""Rules over settings as columns: which value counts, what an engine makes of it, what was asked for in vain.

Null settings stay null unless a rule says otherwise; a name that nobody knows is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import join_small

# Tokens of context by mode, and modes of comparison.
CONTEXT_TOKENS = {"off": 0, "short": 64, "full": 224}
COMPARE_MODES = ("off", "auto", "always")
#: Engines up to which their table is broadcast.
ENGINES = 10_000


def _refuse(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown {what}: "), value.cast("string")))


def context_tokens(mode: Column) -> Column:
    """Tokens of a context mode."""
    known = F.create_map(*[F.lit(x) for pair in CONTEXT_TOKENS.items() for x in pair])
    return F.when(mode.isNull(), F.lit(None).cast("int")).when(mode.isin(*CONTEXT_TOKENS), known[mode]).otherwise(_refuse("context mode", mode).cast("int"))


def compare_mode(mode: Column, fix: Column, chosen: Column) -> Column:
    """``auto`` where a correction pass runs and nobody chose ``off``; else the mode itself."""
    implied = (mode == "off") & F.coalesce(fix, F.lit(False)) & ~F.coalesce(chosen, F.lit(False))
    return F.when(mode.isNull() | mode.isin(*COMPARE_MODES), F.when(implied, "auto").otherwise(mode)).otherwise(_refuse("compare mode", mode).cast("string"))


def extra_decodes(asked: Column, models: Column, fix: Column) -> Column:
    """Extra readings to make: one for a correction pass that has none and no other model."""
    asked, models = F.coalesce(asked, F.lit(0)), F.coalesce(models, F.lit(0))
    return F.when((asked == 0) & (models == 0) & F.coalesce(fix, F.lit(False)), 1).otherwise(asked)


def precedence(flag: Column, config: Column, default: Column) -> Column:
    """What counts: the flag, else the configuration, else the default; null means not mentioned."""
    return F.coalesce(flag, config, default)


def unknown_keys(keys: Column, allowed: Sequence[str]) -> Column:
    """The keys that nobody knows, sorted, each once; a misspelt one must not pass unheard."""
    return F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed))))


def in_range(value: Column, low: float, high: float, name: str) -> Column:
    """``value``, or an error where it is no number between ``low`` and ``high``."""
    wrong = F.isnan(value.cast("double")) | (value < low) | (value > high)
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"{name} must lie between {low} and {high}, not "), value.cast("string"))).cast("double")).otherwise(value.cast("double"))


_VALID = {"bool": r"^(true|false)$", "int": r"^-?(0|[1-9]\d*)$", "float": r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$", "str": r'^"(?s:.*)"$'}


def valid_setting(value: Column, kind: str) -> Column:
    """Whether a JSON value is of the declared type: a truth value is no number, a number must be finite."""
    text = F.trim(value)
    fits = text.rlike(_VALID[kind])
    if kind == "float":
        fits = fits & (F.abs(text.try_cast("double")) < float("inf"))
    return F.coalesce(fits, F.lit(False))


def zone(name: Column) -> Column:
    """``name``, or an error where no time zone is called so."""
    return F.when(name.isNull() | name.isin(sorted(available_timezones())), name).otherwise(_refuse("time zone", name).cast("string"))


def shown(asked: Column, there: Column) -> Column:
    """Whether an extra is rendered: only where this call asked for it, whatever is stored."""
    return F.coalesce(asked, F.lit(False)) & F.coalesce(there, F.lit(False))


def missing_enrichments(summary: Column, has_summary: Column, speakers: Column, wanted_key: Column, stored_key: Column) -> Column:
    """The extras that were asked for and are not stored as asked: speakers count only under the same key."""
    lacks_speakers = F.coalesce(speakers, F.lit(False)) & ~stored_key.eqNullSafe(wanted_key)
    lacks_summary = F.coalesce(summary, F.lit(False)) & ~F.coalesce(has_summary, F.lit(False))
    return F.array_compact(F.array(F.when(lacks_summary, "summary"), F.when(lacks_speakers, "speakers")))


def gated(prompt: Column, dictionary: Column, bias: Column) -> Column:
    """The glossary's prompt where the glossary and its bias are on, else empty."""
    return F.when(F.coalesce(dictionary & bias, F.lit(False)), F.coalesce(prompt, F.lit(""))).otherwise("")


def cross_checks(asked: DataFrame, usable: DataFrame) -> DataFrame:
    """``asked`` (``name``) with ``skipped`` and a ``warning`` for what is not ``usable`` (``name``); never an error."""
    there = usable.select("name").distinct().withColumn("_ok", F.lit(True))
    found = join_small(asked, there, ["name"], "left", ENGINES)
    skipped = F.col("_ok").isNull()
    return found.withColumn("skipped", skipped).withColumn("warning", F.when(skipped, F.concat(F.lit("cross-check "), "name", F.lit(" skipped: unavailable")))).drop("_ok")


def settled(rows: DataFrame, engines: DataFrame) -> DataFrame:
    """``rows`` as their engine will decode them: ``context`` renamed, ``limits`` what it cannot do (sorted, each once).

    ``rows`` have ``backend, context, compare, prompt`` (the gated glossary) and ``skipped`` (names of
    cross checks left out); ``engines`` have ``backend, has_budget, can_pin, pin_costs``. An engine
    without a budget decodes ``short`` as ``full``; a glossary that is pinned at the price of context
    makes ``off`` a ``short``, unless a comparison pass needs the difference. An engine that is not
    listed can do nothing of this.
    """
    known = engines.select("backend", *[F.col(c).alias(f"_{c}") for c in ("has_budget", "can_pin", "pin_costs")])
    out = join_small(rows, known, ["backend"], "left", ENGINES)
    has_budget, can_pin, pin_costs = (F.coalesce(F.col(f"_{c}"), F.lit(False)) for c in ("has_budget", "can_pin", "pin_costs"))
    carried = F.coalesce("prompt", F.lit("")) != ""
    renamed = F.when((context_tokens(F.col("context")) > 0) & ~has_budget, "full").otherwise(F.col("context"))
    bought = (F.col("context") == "off") & (F.col("compare") == "off") & carried & pin_costs & can_pin
    pinless = F.when(carried & ~can_pin, F.concat("backend", F.lit(" cannot pin the glossary")))
    out = out.withColumn("context", F.when(bought, "short").otherwise(renamed))
    gone = F.transform(F.coalesce("skipped", F.array().cast("array<string>")), lambda n: F.concat(n, F.lit(" was unavailable")))
    return out.withColumn("limits", F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(pinless)), gone)))).drop("_has_budget", "_can_pin", "_pin_costs")


def warned(warnings: Column, limits: Column) -> Column:
    """The warnings of a transcript with what its engines could not do, so that they are read with it."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(warnings, none), F.coalesce(limits, none))
