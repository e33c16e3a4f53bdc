"""Raw turns and their words to clean, ordered speaker turns.

Words are classed one by one as spoken, filler, sound annotation or time mark. Labels are brought to
the voices of their recording. Whether a turn goes on with the voice before it is decided by gradient-
boosted trees over labels, gaps and context. They are fitted on neighbours whose labels leave no doubt,
of which one label is then spelled as speakers are misspelled elsewhere: with a slip, as a first or last
name alone, with an initial. The trees see how the altered label reads among the labels around it, and
have to tell what the untouched labels said.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import boosting, speakers
from tidemark.operators.carry import carry_last, running_count
from tidemark.session import cut

#: Pairs of neighbours that the boundary model is fitted on at most, drawn by stretches of recordings, and
#: how many of them are fitted on with an altered label.
SAMPLE, ALTERED = 4000, 1200
#: Seconds of a recording that one window task orders.
BUCKET_S = 1800
SALTS = 8

# Words for sounds, by language.
SOUNDS = "music|musik|música|музыка|applau|аплод|beifall|laugh|lach|gelächter|risa|смех|смеётся|cough|husten|tos|кашель|sigh|seufz|suspir|вздох|noise|geräusch|ruido|шум|silence|stille|silencio|тишина|inaudible|unverständlich|inaudible|неразборчиво|crosstalk|breath|atem|respir|дыхание|door|tür|puerta|дверь|phone|telefon|teléfono|телефон|ring|click|klick|keyboard|throat|räusper|chair|blank|beep|bell|typing|knock|clap|whistl|sneez|sniff|chatter|static|footstep|pause"
# German words by which `er` and `um` are words and no hesitation.
GERMAN = "der|die|das|und|ist|nicht|ein|eine|wir|ich|sie|es|auf|mit|von|zu|im|den|dem|wird|hat|war"

_TIME = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d+)?|(?:\d+h)?\d+m\d+s"
#: Time marks and annotations in the text of a turn, which may run over several words.
MARKS = (
    rf"<\|[^|>]*\|>|\[_[^\]]*\]|[\[(<]\s*(?:{_TIME})\s*[\])>]|(?<!\S)(?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}[.,]\d+(?!\S)"
    r"|\[+[^\[\]]*\]+|<[^<>]*>|\{[^{}]*\}|(?<!\S)\*[^*]+\*(?!\w)|[♪♫♬]+|(?<!\S)-[\p{L}]+-(?!\S)"
    rf"|\((?i:[^()]*(?:{SOUNDS})[^()]*)\)|(?<!\S)[\[{{][^\]}}]*$"
)
#: Hesitations, as a whole word in lower case without punctuation.
FILLER = r"^(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h*m*|e+h+m*|e+m+|a+h+m*|ä+h+m*|ä+m+|ö+h+m*|ö+m+|э+(?:-э+)*м*|м+(?:-м+)*|х+м+|а+(?:-а+)+|m+-h+m+)$"


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def spoken_words(words: Column) -> Column:
    """The spoken ones of an array of words in order: no time marks, annotations or fillers."""
    joined = F.array_join(F.transform(words, lambda w: F.trim(w)), " ")
    left = F.split(F.trim(F.regexp_replace(joined, f"(?u){MARKS}", " ")), r"\s+")
    german = joined.rlike(rf"(?iu)(?<![\p{{L}}])(?:{GERMAN})(?![\p{{L}}])")
    bare = lambda w: _bare(w)
    return F.filter(left, lambda w: (bare(w) != "") & (~bare(w).rlike(FILLER) | (german & bare(w).isin("er", "um"))))


def turn_words(words: DataFrame) -> DataFrame:
    """``run_id, turn_idx, spoken``: the spoken words of each turn; repeated deliveries count once.

    Only what belongs to one turn meets in one group, however long the recording is.
    """
    rows = words.filter("run_id is not null and turn_idx is not null and text is not null")
    grouped = rows.groupBy("run_id", "turn_idx").agg(F.array_sort(F.collect_set(F.struct("word_idx", "text"))).alias("_words"))
    return grouped.select("run_id", "turn_idx", spoken_words(F.col("_words.text")).alias("spoken"))


_VOICES = "array<struct<speaker:string,voice:string,cost:int,margin:int,whole:boolean>>"


def voice_map(turns: DataFrame) -> DataFrame:
    """``run_id, speaker, voice, cost, margin, whole``: every label of a recording as ``speakers.readings`` has it; a group holds distinct labels only."""

    @F.arrow_udf(_VOICES)
    def resolve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("speaker", pa.string()), ("voice", pa.string()), ("cost", pa.int32()), ("margin", pa.int32()), ("whole", pa.bool_())]))
        for batch in batches:
            out = [[{"speaker": k, "voice": v.voice, "cost": v.cost, "margin": v.margin, "whole": v.whole} for k, v in speakers.readings([(x["speaker"], x["n"]) for x in labels]).items()] for labels in batch.to_pylist()]
            yield pa.array(out, kind)

    counts = turns.groupBy("run_id", "speaker").agg(F.count("*").alias("n"))
    lists = counts.groupBy("run_id").agg(F.collect_list(F.struct("speaker", "n")).alias("labels"))
    return lists.select("run_id", F.explode(resolve("labels")).alias("v")).select("run_id", "v.*")


#: What the trees see of two neighbours. ``f_read`` is whether both labels are read as one voice, which
#: an altered label need not be.
FEATURES = ["f_read", "f_cost", "f_margin", "f_label", "f_near", "f_nobody", "f_gap", "f_before", "f_words", "f_ended"]


def _pairs(rows: DataFrame) -> DataFrame:
    """Rows with the features of each turn and the one before it."""
    order = [F.col("start_s"), F.col("turn_idx")]
    now = F.struct("speaker", "voice", "cost", "margin", "whole", "end_s", "n_words", "ended")
    linked = carry_last(rows, ["run_id"], "bucket", order, now, "prior")
    said = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    a, b = said(F.col("prior.speaker")), said(F.col("speaker"))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return linked.select(
        "*", flag(F.col("prior.voice") == F.col("voice")).alias("f_read"), F.greatest(F.col("prior.cost"), F.col("cost")).cast("double").alias("f_cost"),
        F.least(F.col("prior.margin"), F.col("margin")).cast("double").alias("f_margin"), flag(a == b).alias("f_label"),
        (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))).alias("f_near"),
        flag((F.col("prior.voice") == "?") | (F.col("voice") == "?")).alias("f_nobody"),
        F.coalesce(F.least(F.greatest(F.col("start_s") - F.col("prior.end_s"), F.lit(-60.0)), F.lit(600.0)), F.lit(0.0)).alias("f_gap"),
        F.coalesce(F.col("prior.n_words").cast("double"), F.lit(0.0)).alias("f_before"), F.col("n_words").cast("double").alias("f_words"), flag(F.col("prior.ended")).alias("f_ended"),
    )


def altered(label: str, r: np.random.Generator) -> str:
    """A whole label as it may stand elsewhere: with a slip, short, with an initial, turned round or in other case."""
    words = label.split()
    if len(words) < 2 or any(c.isdigit() for c in label):
        return label.lower() if r.random() < 0.5 else f"[{label}]"
    first, last = words[0], words[-1]
    k = int(r.integers(1, max(2, len(first))))
    return (first, last, f"{first[0]}. {last}", f"{first} {last[0]}.", f"{first[:k]}{first[k + 1 :]} {last}", f"{last}, {first}", label.upper())[int(r.integers(7))]


def _learnt(pairs: pd.DataFrame, most: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and truths of certain pairs: as they are, and of ``most`` of them with one label altered."""
    r = np.random.default_rng(seed)
    said = lambda t: re.sub(r"[\W_]+", "", (t or "").lower())
    sure = pairs[(pairs["p_cost"] + pairs["cost"] == 0) & pairs["p_whole"] & pairs["whole"]]
    x = [sure[FEATURES].to_numpy(float)]
    truth = [(sure["p_voice"] == sure["voice"]).to_numpy(float)]
    around: dict[tuple, dict[str | None, int]] = {}
    for key, a, b in zip(zip(pairs["run_id"], pairs["bucket"], strict=True), pairs["p_speaker"], pairs["speaker"], strict=True):
        own = around.setdefault(key, {})
        for label in (a, b):
            label = label if isinstance(label, str) else None
            own[label] = own.get(label, 0) + 1
    # names are what can be misread, and one voice going on is rarer than a change, so both kinds are drawn alike
    names = sure[~sure["p_voice"].str.startswith(("#", "?")) & ~sure["voice"].str.startswith(("#", "?"))]
    same = (names["p_voice"] == names["voice"]).to_numpy()
    part = [names[s].iloc[r.permutation(int(s.sum()))[: most // 2]] for s in (same, ~same)]
    for row in pd.concat(part).to_dict("records"):
        labels = dict(around[row["run_id"], row["bucket"]])
        other = altered(row["speaker"], r)
        labels[other] = labels.get(other, 0) + 1
        read = speakers.readings(list(labels.items()))
        before, now = read[row["p_speaker"]], read[other]
        a, b = said(row["p_speaker"]), said(other)
        changed = {
            "f_read": float(before.voice == now.voice), "f_cost": float(max(before.cost, now.cost)), "f_margin": float(min(before.margin, now.margin)),
            "f_label": float(a == b), "f_near": 1 - speakers.distance(a, b) / max(len(a), len(b), 1),
        }
        x.append(np.array([[changed.get(f, row[f]) for f in FEATURES]], float))
        truth.append(np.array([float(row["p_voice"] == row["voice"])]))
    # what is known beforehand, so that a table of few turns is decided alike: one voice goes on however its label is spelled
    known = [[read, cost, 9.0, label, near, 0.0, 0.0, 1.0, 1.0, 0.0] for read in (1.0, 0.0) for cost in (0.0, 1.0, 3.0) for label, near in ((read, read), (0.0, 0.5), (0.0, 0.0))] * 3
    x.append(np.array(known))
    truth.append(np.array([k[0] for k in known]))
    return np.concatenate(x), np.concatenate(truth)


def fit_boundaries(pairs: DataFrame, total: int, sample: int = SAMPLE) -> boosting.Boosted:
    """The boundary model of ``total`` pairs (one job, bounded rows).

    Stretches of recordings are drawn by a hash so that about twice the sample is met, of which the
    first ``sample`` rows by the hash are taken: what leaves a task does not grow with the table.
    """
    million = 1_000_000
    share = min(million, -(-2 * sample * million // max(1, total)))
    drawn = pairs.withColumn("_h", F.xxhash64("run_id", "bucket")).filter(F.col("prior").isNotNull() & (F.pmod("_h", F.lit(million)) < share))
    wanted = drawn.select(*FEATURES, "run_id", "bucket", "speaker", "voice", "cost", "whole", *[F.col(f"prior.{c}").alias(f"p_{c}") for c in ("speaker", "voice", "cost", "whole")], "_h", "start_s", "turn_idx")
    got = wanted.orderBy("_h", "run_id", "bucket", "start_s", "turn_idx").limit(sample).toPandas()
    return boosting.boost(*_learnt(got, ALTERED), FEATURES)


def clean_turns(turns: DataFrame, words: DataFrame, with_text: bool = True) -> DataFrame:
    """``run_id, first_idx, last_idx, speaker_no, start_s, end_s, text``: clean turns in order of time.

    Turns lacking their run, number or start are left out, as are turns without a spoken word;
    repeated deliveries count once; equal starts go by ``turn_idx``. Null and meaningless labels of a
    recording are one voice. ``end_s`` is the latest end that is not before its start, or null.
    Columns of other names do not matter. Writes one table of turns and fits one small model.
    """
    base = turns.filter("run_id is not null and turn_idx is not null and start_s is not null and not isnan(start_s)")
    base = base.groupBy("run_id", "turn_idx").agg(*[F.min(c).alias(c) for c in ("start_s", "end_s", "speaker")])
    said = turn_words(words)
    labels = voice_map(base)
    kept = base.join(said, ["run_id", "turn_idx"]).filter(F.size("spoken") > 0)
    salt = F.pmod(F.xxhash64("turn_idx"), F.lit(SALTS)).cast("int")
    spread = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.col("run_id").alias("_run"), F.col("speaker").alias("_speaker"), F.col("salt").alias("_salt"), "voice", "cost", "margin", "whole")
    voiced = kept.withColumn("salt", salt).join(spread, (F.col("run_id") == F.col("_run")) & F.col("speaker").eqNullSafe(F.col("_speaker")) & (F.col("salt") == F.col("_salt")))
    rows = voiced.select(
        "run_id", "turn_idx", "start_s", F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")).alias("end_s"), "speaker", "voice", "cost", "margin", "whole",
        F.floor(F.col("start_s") / BUCKET_S).cast("long").alias("bucket"), F.size("spoken").alias("n_words"),
        F.element_at("spoken", -1).rlike(r"[.!?…]$").alias("ended"), *([F.array_join("spoken", " ").alias("said")] if with_text else []),
    )
    rows = cut(rows)
    pairs = _pairs(rows)
    model = fit_boundaries(pairs, rows.count())
    opens = F.col("prior").isNull() | (F.expr(model.sql()) < 0)
    order = [F.col("start_s"), F.col("turn_idx")]
    marked = running_count(pairs, ["run_id"], "bucket", order, opens, "turn_no")
    at = F.struct("start_s", "turn_idx")
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "turn_idx", "said"))), lambda t: t["said"]), " ").alias("text")] if with_text else []
    merged = marked.groupBy("run_id", "turn_no").agg(
        F.min_by("turn_idx", at).alias("first_idx"), F.max_by("turn_idx", at).alias("last_idx"), F.min_by("voice", at).alias("voice"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), *text,
    )
    begun = merged.groupBy("run_id", "voice").agg(F.min("turn_no").alias("_no"))
    numbered = begun.select("run_id", "voice", F.row_number().over(W.partitionBy("run_id").orderBy("_no")).alias("speaker_no"))
    salted = numbered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = merged.withColumn("salt", F.pmod("turn_no", F.lit(SALTS)).cast("int")).join(salted, ["run_id", "voice", "salt"])
    return out.select("run_id", "first_idx", "last_idx", "speaker_no", "start_s", "end_s", *(["text"] if with_text else []))
