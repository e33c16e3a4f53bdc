"""Free-text timestamps to one instant in UTC.

A text is tried against every known format. Each format that fits and names a real date and time of
day gives a candidate instant; that the text is no stamp at all is a candidate too. A mixture of formats
per source, fitted by expectation-maximisation over the counts of candidate sets, gives each candidate
its posterior. A convention that is known beforehand, as month first with slashes, enters as the prior
likelihood of the reading that breaks it. What stays undecided is marked ``ambiguous`` and gets no instant.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, small_rows

#: Offsets in minutes that an abbreviation may stand for; several make it ambiguous.
ABBREVIATIONS: Mapping[str, tuple[int, ...]] = {
    "Z": (0,), "UT": (0,), "UTC": (0,), "GMT": (0,), "WET": (0,), "WEST": (60,), "CET": (60,), "CEST": (120,),
    "EET": (120,), "EEST": (180,), "MSK": (180,), "BST": (60, 360), "IST": (330, 60, 120), "NPT": (345,), "JST": (540,),
    "KST": (540,), "AEST": (600,), "AEDT": (660,), "ACST": (570,), "AWST": (480,), "NZST": (720,), "NZDT": (780,),
    "EST": (-300,), "EDT": (-240,), "CST": (-360, 480), "CDT": (-300,), "MST": (-420,), "MDT": (-360,),
    "PST": (-480,), "PDT": (-420,), "AKST": (-540,), "AKDT": (-480,), "HST": (-600,),
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ZONE = r"(?:\s*((?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,4})?(?:\[([A-Za-z0-9_+\-/]+)\])?)"
_WORD = r"(?:[A-Za-z]+[ _-])?"
_WEEKDAY = r"(?:[A-Za-z]{3,9},? )?"


@dataclass(frozen=True)
class Format:
    """A pattern and, for each field, the text that its groups make (``$1`` and so on)."""

    name: str
    pattern: str
    fields: str  # year, month, day, hour, minute, second, fraction, half, zone, region


#: ``fields`` are joined by ``|``; a day of the year or of an ISO week stands in ``day`` with an empty or ``W`` month.
FORMATS: tuple[Format, ...] = (
    Format("iso", rf"^{_WORD}(\d{{4}})([-/.])(\d{{2}})\2(\d{{2}})(?:[Tt_]| +)(\d{{2}})([:.\-])(\d{{2}})(?:\6(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$3|$4|$5|$7|$8|$9||$10|$11"),
    Format("compact", rf"^{_WORD}(\d{{4}})(\d{{2}})(\d{{2}})[Tt_ -]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    Format("exif", rf"^(\d{{4}}):(\d{{2}}):(\d{{2}}) +(\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    Format("ordinal", rf"^(\d{{4}})-(\d{{3}})[Tt ](\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1||$2|$3|$4|$5|$6||$7|$8"),
    Format("slash_mdy", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?: *([AaPp])\.?[Mm]\.?)?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    Format("slash_dmy", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?: *([AaPp])\.?[Mm]\.?)?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    Format("dot_dmy", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    Format("dot_mdy", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7||$8|$9"),
    Format("day_name", rf"^{_WEEKDAY}(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}}),? +(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?: *([AaPp])[Mm])?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    Format("name_day", rf"^{_WEEKDAY}([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? +(\d{{4}}),? +(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?: *([AaPp])[Mm])?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
)
#: Digits before the point of a count since 1970, and how many of the count make a second.
EPOCHS = (("epoch_s", r"^(\d{9,10})(?:[.,](\d+))?$", 0), ("epoch_ms", r"^(\d{12,13})(?:[.,](\d+))?$", 3), ("epoch_us", r"^(\d{16})$", 6), ("epoch_ns", r"^(\d{19})$", 9))
#: Likelihood of a reading that breaks a convention: month first with slashes, day first with dots.
CONVENTIONS: Mapping[str, float] = {"slash_dmy": 1e-24, "dot_mdy": 1e-24}
#: Likelihood of a text that fits a format and yet is no stamp: below the share of any format, however rare in however many rows.
JUNK, JUNK_LIKELIHOOD = "none", 1e-15
#: A posterior below this leaves a text ambiguous.
CERTAIN = 0.9
ROUNDS = 25
#: Rows of weights (source, format) up to which they are broadcast.
BROADCAST_WEIGHTS = 50_000

#: A candidate's instant, given or not: a wall clock waits for its zone.
_CANDIDATE = "struct<fmt:string,wall_us:bigint,offset_min:int,region:string>"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` stands for a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_NONE = f"cast(array() as array<{_CANDIDATE}>)"
_LEAP = "((n.year % 4 = 0 and n.year % 100 <> 0) or n.year % 400 = 0)"
#: Days since 1970 of a civil date, or of a day counted from the start of its year; null if there is none.
_CIVIL = f"""case when n.year >= 1 and n.month between 1 and 12 and n.day between 1 and
  (case when n.month in (4, 6, 9, 11) then 30 when n.month = 2 then if({_LEAP}, 29, 28) else 31 end)
  then unix_date(make_date(n.year, n.month, n.day)) end"""
_NTH = f"case when n.year >= 1 and n.day between 1 and if({_LEAP}, 366, 365) then unix_date(make_date(n.year, 1, 1)) + n.day - 1 end"


def _micros(fraction: str) -> str:
    return f"cast(substring(rpad({fraction}, 6, '0'), 1, 6) as bigint)"


def _offsets(zone: str) -> str:
    """The offsets in minutes that a zone text may mean: one for a number, some for a known name, else none."""
    names = ", ".join(f"'{k}', array({', '.join(map(str, v))})" for k, v in ABBREVIATIONS.items())
    hours, minutes = "cast(substring(z, 2, 2) as int)", "coalesce(try_cast(replace(substring(z, 4, 3), ':', '') as int), 0)"
    value = f"if({hours} <= 18 and {minutes} < 60, array(({hours} * 60 + {minutes}) * if(z like '-%', -1, 1)), cast(array() as array<int>))"
    numeric = _let(rf"regexp_replace({zone}, r'^(?:UTC|GMT)', '')", "z", value)
    return rf"if({zone} rlike r'^(?:UTC|GMT)?[+-]\d', {numeric}, coalesce(map({names})[upper({zone})], cast(array() as array<int>)))"


def _made(fmt: str, wall: str, offset: str, region: str) -> str:
    return f"named_struct('fmt', '{fmt}', 'wall_us', {wall}, 'offset_min', cast({offset} as int), 'region', cast({region} as string))"


def _calendar(fmt: Format) -> str:
    """SQL of one calendar format's candidates for the text ``t``: an array, empty where it does not fit."""
    month = f"cast(array_position(array({', '.join(repr(m) for m in MONTHS)}), substring(lower(p[1]), 1, 3)) as int)" if fmt.name in ("day_name", "name_day") else "try_cast(p[1] as int)"
    hour = "case when p[7] = '' then int(p[3]) when int(p[3]) between 1 and 12 then int(p[3]) % 12 + if(lower(p[7]) = 'p', 12, 0) end"
    numbers = f"named_struct('year', int(p[0]), 'month', {month}, 'day', int(p[2]), 'hour', {hour}, 'minute', int(p[4]), 'second', coalesce(try_cast(p[5] as int), 0))"
    days = _NTH if fmt.name == "ordinal" else _CIVIL
    wall = f"case when n.hour < 24 and n.minute < 60 and n.second < 60 then (bigint({days}) * 86400 + n.hour * 3600 + n.minute * 60 + n.second) * 1000000 + {_micros('p[6]')} end"
    bare = f"array({_made(fmt.name, 'w', 'null', "nullif(p[9], '')")})"
    zoned = f"transform({_offsets('p[8]')}, o -> {_made(fmt.name, 'w', 'o', 'null')})"
    placed = f"case when w is null then {_NONE} when p[8] = '' then {bare} else {zoned} end"
    parts = rf"split(regexp_replace(t, r'{fmt.pattern}', '{fmt.fields}'), r'\|')"
    return f"if(t rlike r'{fmt.pattern}', {_let(parts, 'p', _let(_let(numbers, 'n', wall), 'w', placed))}, {_NONE})"


def _counted(name: str, pattern: str, digits: int) -> str:
    """SQL of the candidate of a count of seconds, milliseconds, microseconds or nanoseconds."""
    whole = f"cast(regexp_extract(t, r'{pattern}', 1) as bigint)"
    micros = f"{whole} div 1000" if digits > 6 else f"{whole} * {10 ** (6 - digits)}"
    finer = f" + {_micros(rf"regexp_extract(t, r'{pattern}', 2)")} div {10**digits}" if pattern.count("(") > 1 else ""
    return f"if(t rlike r'{pattern}', array({_made(name, micros + finer, '0', 'null')}), {_NONE})"


def candidates(text: str) -> Column:
    """Every valid reading of the column ``text``: an array of format, wall clock, offset and region."""
    every = ", ".join([_calendar(f) for f in FORMATS] + [_counted(*e) for e in EPOCHS])
    trimmed = rf"regexp_replace(`{text}`, r'^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '')"
    return F.expr(f"if(`{text}` is null, {_NONE}, {_let(trimmed, 't', f'concat({every})')})")


def to_utc(wall_us: Column, zone: Column) -> Column:
    """Microseconds since 1970 of a wall clock in a zone; null for a zone that is unknown.

    A clock that occurs twice means the first time, a skipped one moves on by the skip's length.
    """
    known = zone.isin(sorted(available_timezones()))
    return F.when(known & wall_us.isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone)))


def fit_weights(counts: DataFrame, conventions: Mapping[str, float] = CONVENTIONS) -> DataFrame:
    """EM per source: ``source, readings, n`` (``readings``: the formats that fit) to ``source, fmt, weight``.

    A weight is the format's share of the source's texts times the likelihood that its convention
    leaves it, so that the posterior of a reading is its part of the weights of all readings of its
    text. The rows are counts of candidate sets, so a group has as many rows as there are different
    sets of formats, however many texts its source has.
    """

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [*sorted({f for r in pdf["readings"] for f in r}), JUNK]
        at = {f: i for i, f in enumerate(names)}
        prior = np.array([conventions.get(f.partition("@")[0], 1.0) for f in names[:-1]] + [JUNK_LIKELIHOOD])
        likely = np.zeros((len(pdf), len(names)))
        likely[:, -1] = JUNK_LIKELIHOOD
        for i, r in enumerate(pdf["readings"]):
            for f in r:
                likely[i, at[f]] = prior[at[f]]
        n = pdf["n"].to_numpy(float)[:, None]
        share = np.full(len(names), 1 / len(names))
        for _ in range(ROUNDS):
            post = likely * share
            post /= post.sum(1, keepdims=True)
            share = (post * n).sum(0) + 1e-3  # a light prior keeps every format possible
            share /= share.sum()
        return pd.DataFrame({"source": pdf["source"].iloc[0], "fmt": names, "weight": share * prior})

    return counts.groupBy("source").applyInPandas(em, "source string, fmt string, weight double")


def resolve(df: DataFrame, text: str, source: Column, home_zone: Column, naive_utc: Column, conventions: Mapping[str, float] = CONVENTIONS) -> DataFrame:
    """Add ``epoch_us``, ``stamp_status`` (``ok``, ``ambiguous``, ``unusable``) and ``stamp_readings`` to ``df``.

    ``source`` groups texts that share habits, ``naive_utc`` says whether a text without a zone is
    UTC; else it is the wall clock of ``home_zone`` and unusable where that is null or unknown. Null,
    empty and unreadable texts and impossible dates are unusable, as are texts of which the mixture
    rather believes that they are no stamp. ``stamp_readings`` counts the formats that fit. Rows are
    neither joined away nor repeated; columns that the operator adds while it works start with ``_stamp_``.
    Each row's text is parsed once: the readings are written to the shared folder, from where the
    weights are fitted and the rows decided.
    """
    zone = F.when(naive_utc, F.lit("UTC")).otherwise(home_zone)
    base = df.withColumn("_stamp_source", F.coalesce(source, F.lit(""))).withColumn("_stamp_zone", zone)
    read = F.transform(candidates(text), lambda c: F.struct(
        F.concat(c["fmt"], F.coalesce(F.concat(F.lit("@"), c["offset_min"].cast("string")), F.lit(""))).alias("fmt"), c["fmt"].alias("plain"),
        c["wall_us"].alias("wall_us"), c["offset_min"].alias("offset_min"), c["region"].alias("region")))
    base = cut(base.withColumn("_stamp_read", read))
    # the zone of a number or an unambiguous name is no habit worth a component
    base = base.withColumn("_stamp_many", F.size(F.array_distinct(F.transform("_stamp_read", lambda c: c["wall_us"] - F.coalesce(c["offset_min"], F.lit(0)).cast("long") * 60_000_000))) > 1)
    base = base.withColumn("_stamp_key", F.transform("_stamp_read", lambda c: F.when(F.col("_stamp_many"), c["fmt"]).otherwise(c["plain"])))
    counts = base.select(F.col("_stamp_source").alias("source"), F.array_sort(F.array_distinct("_stamp_key")).alias("readings")).groupBy("source", "readings").agg(F.count("*").alias("n"))
    fitted = fit_weights(counts, conventions)
    rows = small_rows(fitted, BROADCAST_WEIGHTS)
    if rows is not None:
        fitted = df.sparkSession.createDataFrame(rows, fitted.schema)
    maps = fitted.groupBy(F.col("source").alias("_stamp_source")).agg(F.map_from_entries(F.collect_list(F.struct("fmt", "weight"))).alias("_stamp_weights"))
    base = base.join(F.broadcast(maps) if rows is not None else maps, "_stamp_source", "left")
    weight = lambda key: F.coalesce(F.element_at(F.coalesce("_stamp_weights", F.create_map().cast("map<string,double>")), key), F.lit(1e-30))
    weigh = F.transform(F.arrays_zip("_stamp_read", "_stamp_key"), lambda z: F.struct(
        weight(z["_stamp_key"]).alias("w"),
        F.when(z["_stamp_read"]["offset_min"].isNotNull(), z["_stamp_read"]["wall_us"] - z["_stamp_read"]["offset_min"].cast("long") * 60_000_000)
        .otherwise(to_utc(z["_stamp_read"]["wall_us"], F.coalesce(z["_stamp_read"]["region"], F.col("_stamp_zone")))).alias("us")))
    base = base.withColumn("_stamp_weighed", weigh).withColumn("_stamp_junk", weight(F.lit(JUNK)))
    total = F.aggregate("_stamp_weighed", F.col("_stamp_junk"), lambda a, x: a + x["w"])
    best = F.array_max("_stamp_weighed")
    same = F.aggregate(F.filter("_stamp_weighed", lambda x: x["us"].eqNullSafe(best["us"])), F.lit(0.0), lambda a, x: a + x["w"])
    base = base.withColumn("_stamp_best", best).withColumn("_stamp_same", same).withColumn("_stamp_total", total)
    status = (
        F.when((F.size("_stamp_weighed") == 0) | (F.col("_stamp_junk") >= F.col("_stamp_same")), "unusable")
        .when(F.col("_stamp_same") < CERTAIN * F.col("_stamp_total"), "ambiguous").when(F.col("_stamp_best.us").isNull(), "unusable").otherwise("ok")
    )
    out = base.withColumn("stamp_status", status).withColumn("epoch_us", F.when(F.col("stamp_status") == "ok", F.col("_stamp_best.us"))).withColumn("stamp_readings", F.size(F.array_distinct("_stamp_key")))
    return out.drop(*[c for c in out.columns if c.startswith("_stamp_")])


def source_name(column: Column) -> Column:
    """One spelling for a source: lower case, single spaces for underscores and runs of white space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit("unknown"))), r"[\s_]+", " "))


def instants(media: DataFrame, runs: DataFrame) -> DataFrame:
    """``origin, rec_key, stamp, habit, epoch_us, stamp_status, stamp_readings``, one row per different stamp of a record."""
    source = source_name(F.col("recorded_at_source"))
    m = media.select(F.lit("media").alias("origin"), F.col("sha256").alias("rec_key"), F.col("recorded_at").alias("stamp"), source.alias("habit"), F.col("home_zone").alias("zone"), (source == "container tag").alias("utc"))
    r = runs.select(F.lit("runs").alias("origin"), F.col("run_id").alias("rec_key"), F.col("created_at").alias("stamp"), F.lit("created_at").alias("habit"), F.lit(None).cast("string").alias("zone"), F.lit(True).alias("utc"))
    rows = m.unionByName(r).distinct()
    return resolve(rows, "stamp", F.col("habit"), F.col("zone"), F.col("utc")).select("origin", "rec_key", "stamp", "habit", "epoch_us", "stamp_status", "stamp_readings")


_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_IN_NAME = re.compile(r"\d{4}[-_]?\d{2}[-_]?\d{2}[ _T]?\d{2}[.\-:]?\d{2}[.\-:]?\d{2}")
_NAME_FORMATS = ("%Y-%m-%d %H.%M.%S", "%Y-%m-%d %H-%M-%S", "%Y-%m-%d_%H-%M-%S", "%Y-%m-%d_%H.%M.%S", "%Y%m%d-%H%M%S", "%Y%m%d_%H%M%S")


def iso_micros(value: str | None) -> int | None:
    """Microseconds since 1970 of a text in any ISO notation, UTC where it names no zone; null for other texts."""
    try:
        at = datetime.fromisoformat(value) if value else None
    except ValueError:
        return None
    return at and ((at if at.tzinfo else at.replace(tzinfo=UTC)) - _EPOCH) // timedelta(microseconds=1)


def tag_micros(value: str | None) -> int | None:
    """``iso_micros`` of a container's tag, which may have white space around it."""
    return iso_micros(value.strip().replace("Z", "+00:00")) if value else None


def name_date(path: str | None) -> str | None:
    """The time of day by the clock that a file's name carries, null where it has none."""
    found = _IN_NAME.search(os.path.splitext(os.path.basename(path))[0]) if path else None
    for pattern in _NAME_FORMATS if found else ():
        try:
            return str(datetime.strptime(found[0], pattern))
        except ValueError:
            continue
    return None


def each(value: Column, f: Callable[[str | None], object], kind: str) -> Column:
    """``f`` over a column of texts; no expression reads every ISO notation."""

    @F.udf(kind)
    def run(t):  # noqa: ANN001, ANN202
        return f(t)

    return run(value)
