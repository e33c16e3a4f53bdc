"""A glossary: which terms are admitted, what is put in their place, what merely resembles them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.session import small_rows, spread

# Limits of a glossary, which keep the broadcast side of every join here small.
MAX_TERMS, MAX_ALIASES, MAX_CHARS, MAX_WORDS, MIN_CHARS = 500, 24, 80, 8, 4
#: Likeness that is worth a flag, what more is asked of a phrase of more words, and its length's slack.
LIKE, WIDE, SLACK = 0.8, 0.15, 2
PROMPT_TERMS, PROMPT_CHARS, LINES_CHARS = 24, 220, 4000


def fits(value: Column) -> Column:
    """Short enough to be a name."""
    return (F.length(value) <= MAX_CHARS) & (F.size(text.tokens(value)) <= MAX_WORDS)


def admitted(terms: DataFrame) -> DataFrame:
    """The terms that are screened: long enough, short enough, the first ``MAX_TERMS`` by priority."""
    good = terms.filter((F.length("term") >= MIN_CHARS) & fits(F.col("term")))
    # a top-k by one column: each task sends MAX_TERMS rows
    return good.orderBy("priority").limit(MAX_TERMS)


def spellings(terms: DataFrame) -> DataFrame:
    """``priority, term, alias, nth``: every usable spelling, trimmed; blank ones and those past the cap are left out."""
    rows = terms.select("priority", "term", F.posexplode("aka").alias("nth", "alias")).filter(F.col("nth") < MAX_ALIASES)
    return rows.withColumn("alias", text.trimmed(F.col("alias"))).filter("alias <> ''")


def alias_index(terms: DataFrame) -> DataFrame:
    """``alias, term``: spellings in one case that stand for one term only and are no other term's name.

    Long ones do not count. A spelling that two entries or one entry twice claim is left alone.
    """
    claims = spellings(terms).withColumn("key", text.casefold(F.col("alias")))
    single = claims.groupBy("key").agg(F.count("*").alias("n"), F.min("term").alias("term"), F.first("alias").alias("alias")).filter("n = 1")
    names = terms.select(text.casefold(F.col("term")).alias("key"), F.col("term").alias("owner"))
    free = single.join(names, "key", "left").filter(F.col("owner").isNull() | (text.casefold(F.col("owner")) == text.casefold(F.col("term"))))
    return free.filter(fits(F.col("alias"))).select(F.col("key").alias("alias"), "term").distinct()


def ambiguous(terms: DataFrame) -> DataFrame:
    """``alias, terms``: spellings that more than one term claims, or that are another term's name."""
    a = spellings(terms).select(text.casefold(F.col("alias")).alias("alias"), "term")
    b = terms.select(text.casefold(F.col("term")).alias("alias"), "term")
    both = a.unionByName(b).groupBy("alias").agg(F.count_distinct("term").alias("terms"))
    return both.filter("terms > 1")


def substitute(df: DataFrame, column: str, terms: DataFrame, name: str = "corrected") -> DataFrame:
    """Add ``name``: ``column`` with every recorded spelling replaced by its term, whole words, longest first."""
    found = substituted(df, column, terms)
    return found.withColumn(name, F.col("_done.text")).drop("_done")


def substituted(df: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Add ``_done``: the ``text`` after substitution and the pairs ``heard, term`` that were ``replaced``, in their order.

    Texts are read once, from word to word, so a longer spelling is never cut by a shorter and nothing
    is replaced twice; no chain of replacements says the same. The index has at most ``MAX_TERMS * MAX_ALIASES`` rows and is read
    to the driver once. Null stays null.
    """
    rows = small_rows(alias_index(terms), MAX_TERMS * MAX_ALIASES)
    if rows is None:
        raise ValueError("the glossary has more spellings than its limits allow")
    swap = {r["alias"]: r["term"] for r in rows}
    shared = df.sparkSession.sparkContext.broadcast(swap)

    @F.pandas_udf("text string, replaced array<struct<heard: string, term: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # by first word, the longest first; a spelling that opens with a sign stands under its first word too
        by_lead: dict[str, list[tuple[int, str]]] = {}
        for alias in sorted(shared.value, key=lambda a: (-len(a), a)):
            if lead := re.search(r"\w+", alias):
                by_lead.setdefault(lead[0], []).append((lead.start(), alias))

        def fix(t: object) -> tuple[str | None, list]:
            if not isinstance(t, str):
                return None, []
            out, pairs, done = [], [], 0
            for word in re.finditer(r"\w+", t):
                for back, alias in by_lead.get(word[0].casefold(), ()):
                    at = word.start() - back
                    end = at + len(alias)
                    if at >= done and t[at:end].casefold() == alias and not re.match(r"\w", t[end : end + 1]):
                        out += [t[done:at], shared.value[alias]]
                        if t[at:end] != shared.value[alias]:
                            pairs.append({"heard": t[at:end], "term": shared.value[alias]})
                        done = end
                        break
            return ("".join(out) + t[done:] if done else t), pairs

        for s in batches:
            yield pd.DataFrame([fix(t) for t in s], columns=["text", "replaced"])

    # else a filter on the result would be pushed below it and read every text twice
    return spread(df).withColumn("_done", run.asNondeterministic()(F.col(column)))


def phrases(value: Column, width: int) -> Column:
    """Runs of one to ``width`` words of letters, of ``MIN_CHARS`` characters and more."""
    words = text.letter_runs(value)
    n = F.size(words)
    sizes = F.filter(F.sequence(F.lit(1), F.lit(width)), lambda k: k <= n)
    runs = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    return F.filter(runs, lambda p: F.length(p) >= MIN_CHARS)


def width_of(terms: DataFrame) -> int:
    """Words of a phrase that is looked at: one more than the longest admitted term has (one small job)."""
    most = admitted(terms).agg(F.max(F.size(text.tokens(F.col("term")))).alias("n")).collect()[0]["n"]
    return (most or 1) + 1


def letters(column: str) -> Column:
    """The letters of a text as 64 bits. An edit takes or brings one letter, so letters that are missing count edits."""
    return F.expr(f"aggregate(split({column}, ''), 0L, (m, c) -> m | shiftleft(1L, pmod(ascii(c), 64)))")


def lookalikes(values: DataFrame, terms: DataFrame, like: float = LIKE, heard: bool = False, wide: float | None = None) -> DataFrame:
    """``phrase, term, score, caught``: each distinct phrase of ``values`` with the term that it is most like, if like enough.

    A phrase that holds the term is not one, a phrase of more words must be of about the same length
    and score ``wide`` (``WIDE`` more than ``like``). With ``heard`` the likeness of the sound counts
    too, and the better reading of a pair decides. Ties go to the term with priority. ``caught`` says
    whether the phrase is like enough to some term for a flag, whatever ``like`` is.

    Terms, at most ``MAX_TERMS``, stand in every length that can reach the likeness and meet phrases
    by length, as written and as heard; edits are counted only for pairs whose letters allow it, and
    no further than ``like`` does.
    """
    good = admitted(terms).select("priority", "term", text.casefold(F.col("term")).alias("low"))
    distinct = values.select("phrase").distinct().withColumn("phrase_low", text.casefold(F.col("phrase")))
    # scoring costs far more than moving a phrase, and phrases are too few bytes for AQE to spread
    session = values.sparkSession
    parts = max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    s, t = distinct.repartition(parts, "phrase"), good
    if heard:
        s, t = s.withColumn("sound", skeletons(F.col("phrase"))), t.withColumn("term_sound", skeletons(F.col("term")))
    reach = lambda n: F.sequence(F.ceil(n * like - 1e-9).cast("int"), F.floor(n / like + 1e-9).cast("int"))
    many = F.size(F.split("phrase", " ")) > F.col("term_words")
    tight = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
    near = F.abs(F.col("tight") - F.col("term_tight")) <= SLACK
    need = F.when(many, like + WIDE if wide is None else wide).otherwise(F.lit(like))
    flag = F.col("score") >= F.when(many, LIKE + WIDE).otherwise(F.lit(LIKE))
    s = s.withColumn("tight", tight(F.col("phrase")))
    t = t.withColumn("term_tight", tight(F.col("term"))).withColumn("term_words", F.size(text.tokens(F.col("term"))))

    def read(phrase: str, term: str) -> DataFrame:
        placed = t.withColumn("theirs", letters(term)).withColumn("length", F.explode(reach(F.length(term))))
        pairs = s.withColumn("own", letters(phrase)).withColumn("length", F.length(phrase)).join(F.broadcast(placed), "length").filter(~many | near)
        longest = F.greatest(F.length(phrase), F.length(term))
        pairs = pairs.withColumn("longest", longest).withColumn("within", F.floor((1 - like) * longest + 1e-9).cast("int"))
        alike = pairs.filter(F.expr("bit_count(own & ~theirs) <= within and bit_count(theirs & ~own) <= within"))
        counted = alike.withColumn("d", F.expr(f"levenshtein({phrase}, {term}, within)")).filter("d >= 0").filter(~F.contains("phrase_low", "low"))
        score = F.when(F.col("longest") == 0, F.lit(1.0)).otherwise(1 - F.col("d") / F.col("longest"))
        return counted.withColumn("score", score).filter(F.col("score") >= need).select("phrase", "priority", "term", "score", flag.alias("caught"))

    scored = read("phrase_low", "low")
    if heard:
        scored = read("sound", "term_sound").unionByName(scored)
    best = F.max(F.struct("score", (-F.col("priority")).alias("minus"), "term"))
    return scored.groupBy("phrase").agg(best.alias("b"), F.bool_or("caught").alias("caught")).select("phrase", "b.term", "b.score", "caught")


def near_misses(values: DataFrame, terms: DataFrame, most: int = 20, floor: float = 0.5) -> DataFrame:
    """``phrase, term, score``: the ``most`` phrases most like a term among those that no term catches.

    A phrase of more words must score ``WIDE`` over ``floor``. The search goes down from close below
    the flag and stops where enough are found: whatever scores less cannot come before them.
    """
    for like in (0.75, 0.65, floor):
        found = lookalikes(values, terms, like, heard=True, wide=max(like, floor + WIDE)).filter("not caught").drop("caught")
        top = found.orderBy(F.desc("score"), "phrase").limit(most)
        rows = top.collect()  # at most ``most``
        if len(rows) == most or like == floor:
            break
    return values.sparkSession.createDataFrame(rows, found.schema)


# Cyrillic letters in a Latin skeleton, and sounds that a recording does not keep apart.
CYRILLIC = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "i", "ь": "", "э": "e", "ю": "u", "я": "a"}
FOLDED = {"p": "b", "t": "d", "k": "g", "c": "g", "q": "g", "f": "v", "s": "z", "sh": "zh", "ch": "zh", "y": "i", "x": "gz"}
_LATIN = str.maketrans(CYRILLIC)
#: One sign for ``sh`` and ``ch`` while letters are folded one by one.
_HUSH = "\1"
_SOUNDS = str.maketrans(dict.fromkeys("aeiou", "a") | {k: v for k, v in FOLDED.items() if len(k) == 1} | {_HUSH: FOLDED["sh"]})
_OTHER = re.compile("[^a-z]+")
_TWICE = re.compile(r"(.)\1+")


def skeleton(word: str) -> str:
    """The sound of a word: Latin, voiced and voiceless as one, all vowels as one, doubles once."""
    low = word.casefold()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low).translate(_LATIN)
    latin = _OTHER.sub("", low).replace("sh", _HUSH).replace("ch", _HUSH)
    return _TWICE.sub(r"\1", latin.translate(_SOUNDS))


def skeletons(value: Column) -> Column:
    """``skeleton`` over a column; decomposing accents needs more than Spark's functions."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: skeleton(t) if isinstance(t, str) else None)

    return run(value)


def likeness(a: Column, b: Column, sound_a: Column, sound_b: Column) -> Column:
    """The better of the likeness as written and as heard; 0 where either text is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(text.ratio(text.casefold(a), text.casefold(b)), text.ratio(sound_a, sound_b)))


def _ordered(terms: DataFrame) -> Column:
    return F.array_sort(F.collect_list(F.struct("priority", "term", "aka", "note")))


def prompt(terms: DataFrame) -> DataFrame:
    """``prompt``: the first terms that fit the budget as a sentence; one that does not fit is passed over."""
    first = terms.orderBy("priority").limit(PROMPT_TERMS).agg(_ordered(terms).alias("t"))
    start = F.struct(F.array().cast("array<string>").alias("chosen"), F.lit(0).alias("used"))

    def take(state: Column, row: Column) -> Column:
        size = state["used"] + F.length(row["term"]) + 2
        return F.when(size > PROMPT_CHARS, state).otherwise(F.struct(F.concat(state["chosen"], F.array(row["term"])).alias("chosen"), size.alias("used")))

    chosen = F.aggregate("t", start, take)["chosen"]
    return first.select(F.when(F.size(chosen) > 0, F.concat(F.lit("Glossary: "), F.array_join(chosen, ", "), F.lit("."))).otherwise("").alias("prompt"))


def describe(term: Column, aka: Column, note: Column) -> Column:
    heard = F.when(F.size(F.coalesce(aka, F.array().cast("array<string>"))) > 0, F.concat(F.lit("(heard as: "), F.array_join(aka, ", "), F.lit(")")))
    return F.concat_ws(" ", term, heard, F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("— "), text.note(note))))


def lines(terms: DataFrame) -> DataFrame:
    """``line_no, line``: the glossary inside its budget of characters, then how many terms were left out.

    The terms of a glossary are bounded, so one window orders them all.
    """
    w = W.orderBy("priority")
    rows = terms.select("priority", describe(F.col("term"), F.col("aka"), F.col("note")).alias("line"))
    used = F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.select(F.row_number().over(w).alias("line_no"), "line", used.alias("used"))
    kept = rows.filter(F.col("used") <= LINES_CHARS).select("line_no", "line")
    over = rows.agg(F.count("*").alias("n"), F.count_if(F.col("used") <= LINES_CHARS).alias("k")).filter("n > k")
    rest = over.select((F.col("k") + 1).cast("int").alias("line_no"), F.format_string("... and %d more term(s), omitted", F.col("n") - F.col("k")).alias("line"))
    return kept.unionByName(rest)


def parse_lines(line: Column) -> Column:
    """``Term = alias, alias  # note`` as a struct of term, aka and note; null for a line that names nothing."""
    body = F.substring_index(line, "#", 1)
    note = F.when(F.contains(line, F.lit("#")), F.trim(F.expr(f"substring({_name(line)}, locate('#', {_name(line)}) + 1)"))).otherwise("")
    term = text.trimmed(F.substring_index(body, "=", 1))
    rest = F.when(F.contains(body, F.lit("=")), F.expr(f"substring(substring_index({_name(line)}, '#', 1), locate('=', {_name(line)}) + 1)")).otherwise("")
    aka = F.filter(F.transform(F.split(rest, ","), text.trimmed), lambda a: a != "")
    return F.when(term != "", F.struct(term.alias("term"), aka.alias("aka"), note.alias("note")))


def _name(column: Column) -> str:
    return f"`{column._jc.toString()}`"


def merge_aliases(entries: DataFrame) -> DataFrame:
    """``key, term, aka``: entries of one name as one; the first spelling of each alias counts, at most ``MAX_ALIASES``.

    ``entries`` has ``n`` (their order), ``term`` and ``aka``.
    """
    flat = entries.select("n", text.squeeze(F.col("term")).alias("term"), F.posexplode_outer("aka").alias("i", "alias")).withColumn("alias", text.squeeze(F.col("alias")))
    keyed = flat.filter("term <> ''").withColumn("key", text.casefold(F.col("term"))).withColumn("low", text.casefold(F.col("alias")))
    firsts = keyed.groupBy("key", "low").agg(F.min(F.struct("n", "i", "alias")).alias("a"), F.min(F.struct("n", "term")).alias("t"))
    grouped = firsts.groupBy("key").agg(F.min("t").alias("t"), F.array_sort(F.collect_list(F.when(F.coalesce("low", F.lit("")) != "", F.col("a")))).alias("a"))
    return grouped.select("key", "t.term", F.slice(F.transform("a", lambda x: x["alias"]), 1, MAX_ALIASES).alias("aka"))
