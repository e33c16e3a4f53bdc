"""Freely typed values mapped to the entries of a reference list.

Entries stand in BK-trees under the Levenshtein distance, one tree over what is written and one over
what it sounds like. The triangle inequality prunes: of a node at distance d from the query only the
children at distances d - r to d + r can hold entries within r, so a search returns every one of them.
Keys whose lengths differ by more than r are further apart than r, so there is a tree for each length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spelling
from tidemark.session import small_rows, spread

#: Spellings up to which the trees are broadcast; a longer list is cut into shards of this size.
SHARD = 20_000
#: Distinct values that one shard's task searches.
BLOCK = 100_000


class Probe:
    """A word prepared for its Levenshtein distances to others, by bit-parallel columns."""

    def __init__(self, word: str) -> None:
        self.word, self.places = word, {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | (1 << i)
        self.mask, self.last = (1 << len(word)) - 1, (1 << len(word)) >> 1

    def distance(self, other: str) -> int:
        if not self.word or not other:
            return len(self.word) + len(other)
        places, mask, last = self.places, self.mask, self.last
        pv, mv, score = mask, 0, len(self.word)
        for c in other:
            eq = places.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & mask, pv & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph, mh = (ph << 1) | 1, mh << 1
            pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
        return score


def distance(a: str, b: str) -> int:
    """Levenshtein distance, a true metric."""
    return Probe(a).distance(b)


class BKTree:
    """Keys with payloads under ``distance``; built in the order given."""

    def __init__(self, items: Iterable[tuple[str, tuple]]) -> None:
        self.keys: list[str] = []
        self.payloads: list[list[tuple]] = []
        self.children: list[dict[int, int]] = []
        for key, payload in items:
            self.add(key, payload)

    def add(self, key: str, payload: tuple) -> None:
        at, probe = 0, Probe(key)
        while self.keys:
            d = probe.distance(self.keys[at])
            if d == 0:
                self.payloads[at].append(payload)
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.keys)
                break
            at = self.children[at][d]
        self.keys.append(key)
        self.payloads.append([payload])
        self.children.append({})

    def within(self, key: str, radius: int) -> Iterator[tuple[int, str, list[tuple]]]:
        """Every key at most ``radius`` away, with its distance and payloads."""
        open_, probe = [0] if self.keys else [], Probe(key)
        while open_:
            at = open_.pop()
            d = probe.distance(self.keys[at])
            if d <= radius:
                yield d, self.keys[at], self.payloads[at]
            open_.extend(child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius)


class Forest:
    """A BK-tree for each length of key."""

    def __init__(self, items: Iterable[tuple[str, tuple]]) -> None:
        by_length: dict[int, list[tuple[str, tuple]]] = {}
        for key, payload in items:
            by_length.setdefault(len(key), []).append((key, payload))
        self.trees = {n: BKTree(own) for n, own in by_length.items()}

    def within(self, key: str, radius: int) -> Iterator[tuple[int, str, list[tuple]]]:
        """Every key at most ``radius`` away, with its distance and payloads."""
        for n in range(len(key) - radius, len(key) + radius + 1):
            if n in self.trees:
                yield from self.trees[n].within(key, radius)


def written_radius(length: int) -> int:
    """Edits forgiven in what is written."""
    return 0 if length < 4 else 1 if length < 6 else 2


def sound_radius(length: int) -> int:
    """Edits forgiven in what it sounds like."""
    return 0 if length < 6 else 1 if length < 10 else 2


#: Share of the written length by which a value may differ from an entry that it sounds like.
FAR = 0.25


def _digits(key: str) -> str:
    return "".join(c for c in key if c.isdigit())


@dataclass
class Index:
    """The trees of writing and of sound over one shard of the list."""

    written: Forest
    sound: Forest
    exact: dict[str, int]

    @classmethod
    def of(cls, spellings: Sequence[tuple[int, str]]) -> Index:
        rows = sorted({(spelling.key(text), int(entry)) for entry, text in spellings if text} - {("", 0)})
        rows = [(k, e) for k, e in rows if k]
        exact = {k: e for k, e in reversed(rows)}
        return cls(Forest((k, (e, k)) for k, e in rows), Forest((spelling.sound(k), (e, k)) for k, e in rows), exact)

    def best(self, value: str | None) -> tuple[float, int, int, int] | None:
        """(rank, written distance, sound distance, entry) of the closest entry, or None for no entry.

        A digit is never an edit: the number in a name tells entries apart. Ties go to the smaller
        written distance, then to the smaller sound distance, then to the lower entry.
        """
        found: tuple[float, int, int, int] | None = None
        keys = spelling.bare_keys(value)
        same = [self.exact[k] for k in keys if k in self.exact]
        if same:  # nothing is nearer than an entry itself
            return (0.0, 0, 0, min(same))
        for key in keys:
            sound, digits = spelling.sound(key), _digits(key)
            near: dict[tuple[int, str], tuple[int, int]] = {}
            for d, k, payloads in self.written.within(key, written_radius(len(key))):
                for entry, _ in payloads:
                    near[entry, k] = (d, distance(sound, spelling.sound(k)))
            # up to eight characters a quarter of the length is no more than the written search forgives
            radius = sound_radius(len(sound)) if len(key) > 8 else 0
            if len(sound) > 2:
                for d, _, payloads in self.sound.within(sound, radius):
                    for entry, k in payloads:
                        w = distance(key, k)
                        if d == 0 or w <= FAR * max(len(key), len(k)):
                            near.setdefault((entry, k), (w, d))
            for (entry, k), (w, s) in near.items():
                if _digits(k) == digits:
                    rank = (min(float(w), s + 0.5), w, s, entry)
                    if found is None or rank < found:
                        found = rank
        return found


_MATCH = "entry bigint, written_distance int, sound_distance int, rank double"


def _matched(index: Index, values: Iterable[str | None], memo: dict) -> pd.DataFrame:
    out = []
    for v in values:
        if v not in memo:
            memo[v] = index.best(v)
        got = memo[v]
        out.append((got[3], got[1], got[2], got[0]) if got else (None, None, None, None))
    frame = pd.DataFrame(out, columns=["entry", "written_distance", "sound_distance", "rank"])
    return frame.astype({"entry": "Int64", "written_distance": "Int32", "sound_distance": "Int32", "rank": "float64"})


def map_to_entries(df: DataFrame, value: str, spellings: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Add ``match`` to ``df``: the entry that ``value`` stands for and how far it is, null for none.

    ``spellings`` has the columns ``entry`` (a number) and ``spelling``. Null, blank and placeholder
    values match nothing, nor do values near no entry; null and blank spellings are ignored; repeated
    ones count once. Ties go to the lower entry. With at most ``shard`` spellings the trees are
    broadcast and no row moves; beyond that the list is cut into shards, distinct values meet every
    shard in blocks, and the shards' winners are merged. One small job counts the spellings.
    """
    spark = df.sparkSession
    listed = spellings.select(F.col("entry").cast("bigint").alias("entry"), F.col("spelling").cast("string").alias("spelling")).filter("entry is not null and trim(spelling) <> ''").distinct()
    rows = small_rows(listed, shard)
    if rows is not None:
        index = spark.sparkContext.broadcast(Index.of([(r["entry"], r["spelling"]) for r in rows]))

        @F.pandas_udf(_MATCH)
        def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            memo: dict = {}
            for s in batches:
                if len(memo) > 500_000:
                    memo.clear()
                yield _matched(index.value, (None if pd.isna(v) else v for v in s), memo)

        # else a filter on the match would be pushed below it and search twice
        found = match.asNondeterministic()(F.col(value).cast("string"))
        return spread(df, value).withColumn("match", found).withColumn("match", F.when(F.col("match.entry").isNotNull(), F.col("match")))
    return _sharded(df, value, listed, shard, block)


def _sharded(df: DataFrame, value: str, listed: DataFrame, shard: int, block: int) -> DataFrame:
    """The join for lists that are too long to broadcast: shards of entries by blocks of distinct values."""
    distinct = df.select(F.col(value).cast("string").alias("_value")).filter("_value is not null").distinct()
    shards = max(1, -(-listed.count() // shard))
    blocks = max(1, -(-distinct.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = listed.withColumn("_shard", F.pmod(F.xxhash64("spelling"), F.lit(shards)).cast("int")).withColumn("_block", every(blocks))
    right = distinct.withColumn("_block", F.pmod(F.xxhash64("_value"), F.lit(blocks)).cast("int")).withColumn("_shard", every(shards))

    def search(entries: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        index = Index.of(list(zip(entries["entry"], entries["spelling"], strict=True)))
        out = _matched(index, values["_value"], {})
        out.insert(0, "_value", values["_value"].to_numpy())
        return out.dropna(subset=["entry"])

    by = ["_shard", "_block"]
    won = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, f"_value string, {_MATCH}")
    order = F.struct("rank", "written_distance", "sound_distance", "entry")
    best = won.groupBy("_value").agg(F.min_by(F.struct("entry", "written_distance", "sound_distance", "rank"), order).alias("match"))
    return df.join(best, F.col(value).cast("string") == F.col("_value"), "left").drop("_value")


def spellings_of(terms: DataFrame) -> DataFrame:
    """``entry, spelling``: a glossary's terms and their other spellings, by priority."""
    spelled = F.explode(F.concat(F.array("term"), F.coalesce("aka", F.array().cast("array<string>"))))
    return terms.select(F.col("priority").cast("bigint").alias("entry"), spelled.alias("spelling"))
