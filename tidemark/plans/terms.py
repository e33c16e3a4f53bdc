"""Queries over the glossary and the words that resemble it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import glossary
from tidemark.plans import base
from tidemark.plans.base import SEGMENTS, oracle
from tidemark.session import join_small, table

QUERIES: dict = {}
ORACLES: dict = {}
#: Terms up to which a glossary is broadcast to names.
KNOWN_TERMS = 100_000


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_ALIASES = r"""al AS (SELECT priority, term, regexp_replace(a, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS alias FROM (SELECT priority, term, unnest(aka) AS a FROM terms)),
ak AS (SELECT *, replace(lower(alias), 'ß', 'ss') AS k FROM al WHERE alias <> '')"""


@query("SELECT priority, term FROM (SELECT priority, term FROM terms WHERE length(term) >= 4 AND length(term) <= 80 ORDER BY priority LIMIT 500)")
def p07_admitted(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.admitted(table(spark, sf, "terms")).select("priority", "term")


@query(oracle(_ALIASES, select="""SELECT k AS alias, min(term) AS term FROM ak WHERE length(alias) <= 80
AND NOT EXISTS (SELECT 1 FROM terms t WHERE replace(lower(t.term), 'ß', 'ss') = ak.k AND lower(t.term) <> lower(ak.term)) GROUP BY k HAVING count(*) = 1"""))
def j05_alias_index(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.alias_index(table(spark, sf, "terms"))


@query(oracle(_ALIASES, select="SELECT alias, count(DISTINCT term) AS terms FROM (SELECT k AS alias, term FROM ak UNION ALL SELECT replace(lower(term), 'ß', 'ss'), term FROM terms) GROUP BY alias HAVING count(DISTINCT term) > 1"))
def j12_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.ambiguous(table(spark, sf, "terms"))


@query(oracle(_ALIASES, select="SELECT k AS alias, count(*) AS claims FROM ak GROUP BY k"))
def a15_alias_claims(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.spellings(table(spark, sf, "terms")).groupBy(text.casefold(F.col("alias")).alias("alias")).agg(F.count("*").alias("claims"))


@query()
def j05_substitute(spark: SparkSession, sf: str) -> DataFrame:
    found = glossary.substitute(base.segments(spark, sf).select("run_id", "seg_idx", "text"), "text", table(spark, sf, "terms"))
    return found.filter("corrected <> text").select("run_id", "seg_idx", "corrected")


@query()
def c04_correct_text(spark: SparkSession, sf: str) -> DataFrame:
    found = glossary.substitute(table(spark, sf, "documents").select("doc_id", "text"), "text", table(spark, sf, "terms"))
    return found.filter("corrected <> text").select("doc_id", "corrected")


@query()
def a09_dictionary_report(spark: SparkSession, sf: str) -> DataFrame:
    """Segments rewritten, replacements and phrases flagged, by run; the last two also as lists of ``heard, term``."""
    terms = table(spark, sf, "terms")
    fixed = glossary.substituted(base.segments(spark, sf).select("run_id", "seg_idx", "text"), "text", terms)
    replaced = F.array_sort(F.collect_list(F.when(F.size("_done.replaced") > 0, F.struct("seg_idx", F.col("_done.replaced").alias("pairs")))))
    report = fixed.groupBy("run_id").agg(F.count_if(F.expr("_done.text <> text")).alias("rewritten"), F.flatten(F.transform(replaced, lambda r: r["pairs"])).alias("replaced"))
    flagged = c03_apply_glossary(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "heard", "term"))).alias("f"))
    both = report.join(flagged, "run_id", "left")
    pairs = F.coalesce(F.transform("f", lambda x: F.struct(x["heard"].alias("heard"), x["term"].alias("term"))), F.array().cast("array<struct<heard: string, term: string>>"))
    return both.select("run_id", "rewritten", F.size("replaced").alias("replacements"), F.size(pairs).alias("flags"), "replaced", pairs.alias("flagged"))


_GRAMS = r"""tk AS (SELECT run_id, seg_idx, regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+') AS ws FROM segments),
ng AS (SELECT DISTINCT array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT ws, unnest(range(1, (SELECT max(len(string_split(term, ' '))) + 2 FROM terms))) AS k FROM tk) WHERE len(ws) >= k)),
gr AS (SELECT phrase FROM ng WHERE length(phrase) >= 4)"""


def _phrases(spark: SparkSession, sf: str, width: int) -> DataFrame:
    return base.segments(spark, sf).select(F.explode(glossary.phrases(F.col("text"), width)).alias("phrase"))


@query(oracle(SEGMENTS, _GRAMS, select="SELECT phrase FROM gr"))
def w14_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return _phrases(spark, sf, glossary.width_of(table(spark, sf, "terms"))).distinct()


@query(oracle(SEGMENTS, _GRAMS, r"""pr AS (SELECT phrase, term, priority, replace(lower(phrase), 'ß', 'ss') AS a, replace(lower(term), 'ß', 'ss') AS b, len(string_split(phrase, ' ')) > len(string_split(term, ' ')) AS wide FROM gr JOIN terms ON length(term) >= 4),
sc AS (SELECT phrase, term, priority, wide, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS score FROM pr WHERE abs(length(a) - length(b)) <= 0.21 * greatest(length(a), length(b)) AND NOT contains(a, b) AND (NOT wide OR abs(length(replace(phrase, ' ', '')) - length(replace(term, ' ', ''))) <= 2)),
bt AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, priority) AS k FROM sc WHERE score >= CASE WHEN wide THEN 0.95 ELSE 0.8 END)""",
    select="SELECT phrase, term, round(score, 6) AS score FROM bt WHERE k = 1"))
def j04_lookalikes(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "terms")
    found = glossary.lookalikes(_phrases(spark, sf, glossary.width_of(terms)), terms).drop("caught")
    return found.withColumn("score", F.round("score", 6))


@query()
def j04_soundalikes(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "terms")
    found = glossary.lookalikes(_phrases(spark, sf, glossary.width_of(terms)), terms, heard=True).drop("caught")
    return found.withColumn("score", F.round("score", 6))


@query()
def c03_apply_glossary(spark: SparkSession, sf: str) -> DataFrame:
    """Segments after substitution, with the phrases that still resemble a term as written or by sound."""
    terms = table(spark, sf, "terms")
    fixed = glossary.substitute(base.segments(spark, sf).select("run_id", "seg_idx", "text"), "text", terms)
    grams = fixed.select("run_id", "seg_idx", F.explode(F.array_distinct(glossary.phrases(F.col("corrected"), glossary.width_of(terms)))).alias("phrase"))
    likes = glossary.lookalikes(grams, terms, heard=True)
    return grams.join(likes, "phrase").select("run_id", "seg_idx", F.col("phrase").alias("heard"), "term")


@query()
def o04_near_misses(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 phrases most like a term, as written or by sound, among those that stay below the threshold."""
    terms = table(spark, sf, "terms")
    found = glossary.near_misses(_phrases(spark, sf, glossary.width_of(terms)), terms)
    return found.withColumn("score", F.round("score", 6))


@query()
def f03_f04_ratio(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "hits").filter("phrase is not null and term is not null")
    return hits.select("hit_id", F.round(text.ratio(F.col("phrase"), F.col("term")), 6).alias("ratio"), F.levenshtein("phrase", "term").alias("distance"))


@query()
def f05_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "terms").select("priority", glossary.skeletons(F.col("term")).alias("skeleton"))


@query()
def f06_likeness(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "hits").filter("phrase is not null and term is not null")
    sounded = hits.withColumn("a", glossary.skeletons(F.col("phrase"))).withColumn("b", glossary.skeletons(F.col("term")))
    return sounded.select("hit_id", F.round(glossary.likeness(F.col("phrase"), F.col("term"), F.col("a"), F.col("b")), 6).alias("likeness"))


@query("""WITH RECURSIVE o AS (SELECT term, row_number() OVER (ORDER BY priority) AS i FROM terms), f AS (
SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS chosen, CAST(0 AS BIGINT) AS used
UNION ALL SELECT o.i, CASE WHEN used + length(term) + 2 > 220 THEN chosen ELSE list_append(chosen, term) END, CASE WHEN used + length(term) + 2 > 220 THEN used ELSE used + length(term) + 2 END FROM f JOIN o ON o.i = f.i + 1 WHERE o.i <= 24)
SELECT 'Glossary: ' || array_to_string(arg_max(chosen, i), ', ') || '.' AS prompt FROM f""")
def w11_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.prompt(table(spark, sf, "terms"))


@query(r"""WITH d AS (SELECT priority, term || CASE WHEN len(aka) > 0 THEN ' (heard as: ' || array_to_string(aka, ', ') || ')' ELSE '' END || CASE WHEN coalesce(note, '') <> '' THEN ' — ' || note ELSE '' END AS line FROM terms),
u AS (SELECT row_number() OVER (ORDER BY priority) AS line_no, line, sum(length(line) + 1) OVER (ORDER BY priority ROWS UNBOUNDED PRECEDING) AS used FROM d)
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM u WHERE used <= 4000
UNION ALL SELECT CAST(count(*) FILTER (used <= 4000) + 1 AS INTEGER), '... and ' || count(*) FILTER (used > 4000) || ' more term(s), omitted' FROM u HAVING count(*) FILTER (used > 4000) > 0""")
def w12_glossary_lines(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.lines(table(spark, sf, "terms"))


_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE kind = 'glossary' AND text IS NOT NULL)"


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").filter("kind = 'glossary' and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.withColumn("entry", glossary.parse_lines(F.col("line"))).filter("entry is not null")


@query(oracle(_LINES, r"""pa AS (SELECT doc_id, i, line, CASE WHEN contains(line, '#') THEN line[1:strpos(line, '#') - 1] ELSE line END AS body FROM ln),
pb AS (SELECT *, regexp_replace(CASE WHEN contains(body, '=') THEN body[1:strpos(body, '=') - 1] ELSE body END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS term,
 CASE WHEN contains(body, '=') THEN body[strpos(body, '=') + 1:] ELSE '' END AS rest FROM pa)""",
    select=r"""SELECT doc_id, CAST(i AS INTEGER) AS line_no, term, array_to_string(list_filter(list_transform(string_split(rest, ','), lambda a: regexp_replace(a, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda a: a <> ''), '|') AS aka,
trim(CASE WHEN contains(line, '#') THEN line[strpos(line, '#') + 1:] ELSE '' END, ' ') AS note FROM pb WHERE term <> ''"""))
def s08_glossary_import(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("doc_id", F.col("i").alias("line_no"), "entry.term", F.array_join("entry.aka", "|").alias("aka"), "entry.note")


@query()
def t04_merge_aliases(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entries(spark, sf).select((F.col("doc_id") * 100_000 + F.col("i")).alias("n"), "entry.term", "entry.aka")
    return glossary.merge_aliases(rows).select("key", "term", F.array_join("aka", "|").alias("aka"))


@query(oracle(_LINES, r"""nm AS (SELECT DISTINCT lower(trim(regexp_replace(translate(regexp_replace(regexp_replace(CASE WHEN contains(line, '#') THEN line[1:strpos(line, '#') - 1] ELSE line END, '=.*$', ''), '[\p{C}]', '', 'g'), ',|~', '   '), '[\s\p{Z}]+', ' ', 'g'))) AS name FROM ln)""",
    select="SELECT name FROM nm WHERE name <> '' AND name NOT IN (SELECT lower(term) FROM terms)"))
def t05_new_terms(spark: SparkSession, sf: str) -> DataFrame:
    names = _entries(spark, sf).select(F.lower(text.squeeze(F.col("entry.term"))).alias("name")).filter("name <> ''").distinct()
    return join_small(names, table(spark, sf, "terms").select(F.lower("term").alias("name")), ["name"], "left_anti", KNOWN_TERMS)


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS norm FROM documents WHERE kind = 'note'")
def f01_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("kind = 'note'").select("doc_id", text.norm(F.col("text")).alias("norm"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS sha FROM documents")
def f01_norm_all(spark: SparkSession, sf: str) -> DataFrame:
    """The norm of every document, as its hash."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.norm(F.col("text")), 256).alias("sha"))


@query(r"SELECT doc_id, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS n, sha256(array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), ' ')) AS sha FROM documents WHERE text IS NOT NULL")
def f02_words(spark: SparkSession, sf: str) -> DataFrame:
    w = text.words(F.col("text"))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.size(w).alias("n"), F.sha2(F.array_join(w, " "), 256).alias("sha"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda t: t <> '')) AS words FROM documents WHERE text IS NOT NULL")
def p11_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.size(text.tokens(F.col("text"))).alias("words"))


@query(r"""SELECT priority, CASE WHEN length(n) <= 30 THEN n ELSE rtrim(n[1:29]) || '…' END AS note, trim(regexp_replace(translate(coalesce(note, ''), ',|~', '   '), '[\s\p{Z}]+', ' ', 'g')) AS squeezed
FROM (SELECT priority, note, trim(regexp_replace(coalesce(note, ''), '[\s\p{Z}]+', ' ', 'g')) AS n FROM terms)""")
def f15_notes(spark: SparkSession, sf: str) -> DataFrame:
    value = F.coalesce("note", F.lit(""))
    return table(spark, sf, "terms").select("priority", text.note(value, 30).alias("note"), text.squeeze(value).alias("squeezed"))


@query("SELECT substr(sha256(string_agg(term || chr(31) || coalesce(array_to_string(aka, chr(30)), '') || chr(31) || coalesce(note, ''), chr(10) ORDER BY priority)), 1, 12) AS digest FROM terms")
def f14_digest(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("\x1f", "term", F.coalesce(F.array_join("aka", "\x1e"), F.lit("")), F.coalesce("note", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("priority", line.alias("l"))))
    return table(spark, sf, "terms").agg(F.substring(F.sha2(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n"), 256), 1, 12).alias("digest"))
