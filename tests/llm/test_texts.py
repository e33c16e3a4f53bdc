import base64
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import abuse, boosting, bpe, speakers, transcripts

TOKENIZERS = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(TOKENIZERS.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=TOKENIZERS.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_vocabularys():
    assert bpe.PATTERN == TOKENIZERS.PATTERN


def test_encoding_like_the_library(ranks, reference):
    ours, r = bpe.Encoder(ranks), random.Random(0)
    texts = ["", " ", "a", "\n\n  x", "<|endoftext|>", "it's WE'LL", "نص عربي", "日本語", "👩‍💻", "x" * 20_000, "ab" * 5000, "!?" * 3000, "\x00\x7f﻿", "é" * 777]
    texts += ["".join(r.choice("abceinrt  é中\n😀!'-0129​шд") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    for t in texts:
        ids = ours.encode(t)
        assert ids == reference.encode_ordinary(t), t[:50]
        assert reference.decode_bytes(ids) == t.encode()


def test_merge_like_a_plain_scan(ranks):
    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    r = random.Random(1)
    for _ in range(600):
        piece = bytes(r.choice(b"aabbehlnort \xd0\xb0\xff") for _ in range(r.randint(1, 60)))
        assert bpe.merge(piece, ranks) == plain(piece)


def test_encode_column(spark, reference):
    rows = [(1, "hello world", "clash"), (2, None, "x"), (3, "", "y"), (4, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    want = reference.encode_ordinary("hello world")
    assert got == {1: want, 2: [], 3: [], 4: want}
    assert bpe.encode_corpus(df.limit(0)).collect() == []
    counts = df.select("doc_id", bpe.token_count(spark, F.col("text")).alias("n")).collect()
    assert [c["n"] for c in counts] == [len(want), 0, 0, len(want)]


def test_other_vocabulary(spark, tmp_path):
    (tmp_path / "tiny.tiktoken").write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate([b"a", b"b", b"ab", b" "])))
    df = spark.createDataFrame([("ab ba",)], "text string")
    assert bpe.encode_corpus(df, vocabulary="tiny", folder=str(tmp_path)).collect()[0]["ids"] == [2, 3, 1, 0]


# --- speakers and turns ----------------------------------------------------------------------


@pytest.mark.parametrize(("groups"), [
    [["Selvi Tollvik", "selvi tollvik", "Tollvik, Selvi", "Selvi_Tollvik", "[Selvi Tollvik]", "Selvi Tollvik (host)", "Seli Tollvik", "S. Tollvik", "Selvi T.", "Selvi", "Tollvik", " Selvi  Tollvik :"], ["Orla Rostvan", "Orla", "O. Rostvan"]],
    [["SPEAKER_01", "speaker1", "Spkr. 1", "SPK1", "Speaker 01:", " SPEAKER-01 "], ["SPEAKER_00", "Speaker 0"], ["SPEAKER_11"]],
    [[None, "", " ", "?", "UNKNOWN", "n/a", "Unknown Speaker"], ["Vesna-Mo Abernal", "Vesna-Mo", "VESNA-MO ABERNAL"]],
])
def test_voices(groups):
    found = speakers.voices([(label, 3) for g in groups for label in g])
    voices = [{found[label] for label in g} for g in groups]
    assert all(len(v) == 1 for v in voices) and len(set.union(*voices)) == len(groups)


TURN = "run_id string, turn_idx int, start_s double, end_s double, speaker string, voice string, prior string"
WORD = "run_id string, turn_idx int, word_idx int, start_s double, text string, bucket int"


def clean(spark, turns, words):
    t = spark.createDataFrame([(*x, "clash", "clash") for x in turns], TURN)
    said = [(r, t_, i, None, w, 1) for r, t_, ws in words for i, w in enumerate(ws.split(" "), start=t_ * 100)]
    w = spark.createDataFrame(said + said[:3], WORD)
    rows = transcripts.clean_turns(t, w).orderBy("run_id", "first_idx").collect()
    return [(r["run_id"], r["first_idx"], r["last_idx"], r["speaker_no"], r["text"]) for r in rows]


def test_clean_turns(spark):
    turns = [("a", 1, 5.0, 9.0, "Ann Lee"), ("a", 0, 1.0, 2.0, "A. Lee"), ("a", 2, 6.0, None, "?"), ("a", 3, 7.0, 8.0, None), ("a", 4, 4000.0, 4.0, "Bob Roy"), ("a", 5, 3.0, 4.0, "Bob Roy"), ("a", 6, None, 4.0, "Bob Roy"), ("b", 0, 0.0, 1.0, "S1"), (None, 0, 0.0, 1.0, "x")]
    words = [("a", 1, "um hello there."), ("a", 0, "[door slams] hi"), ("a", 2, "<|2.00|> what"), ("a", 3, "(second take) yes"), ("a", 4, "again"), ("a", 5, "uh *clears throat* [00:01:02] ♪"), ("a", 6, "lost"), ("b", 0, "mm")]
    got = clean(spark, turns + turns[:2], words)
    assert got == [("a", 0, 1, 1, "hi hello there."), ("a", 2, 3, 2, "what (second take) yes"), ("a", 4, 4, 3, "again")]


def test_no_turns(spark):
    assert clean(spark, [], [("a", 1, "x")]) == []
    assert clean(spark, [("a", 1, 1.0, 2.0, "S1")], []) == []


@pytest.mark.parametrize(("words", "spoken"), [
    ("er sagt das", ["er", "sagt", "das"]), ("er well", ["well"]), ("Öhr? ermine umbrella?", ["Öhr?", "ermine", "umbrella?"]), ("э-э Эм, м-м хм", []),
    ("[background noise] (phone ringing) {breath} -laughs- [[crosstalk]]", []), ("01:51:05.000 (50:06) [37m15s] [_TT_190] <|3.61|>", []), ("music", ["music"]), ("", []),
])
def test_spoken(spark, words, spoken):
    row = spark.createDataFrame([(words.split(" "),)], "w array<string>").select(transcripts.spoken_words(F.col("w")).alias("s")).collect()[0]
    assert row["s"] == spoken


def test_turns_like_one_after_another(spark):
    """Over a whole small table, against voices and neighbours taken one by one."""
    turns, words = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("turns", "words"))
    said = {(r["run_id"], r["turn_idx"]) for r in transcripts.turn_words(words).filter("size(spoken) > 0").collect()}
    runs: dict = {}
    for r in turns.collect():
        runs.setdefault(r["run_id"], {})[r["turn_idx"]] = (r["start_s"], r["speaker"])
    want = set()
    for run, items in runs.items():
        counts: dict = {}
        for _, s in items.values():
            counts[s] = counts.get(s, 0) + 1
        voice, out, order = speakers.voices(counts.items()), [], {}
        for (_, s), i in sorted(((v, i) for i, v in items.items() if (run, i) in said), key=lambda x: (x[0][0], x[1])):
            if out and out[-1][2] == voice[s]:
                out[-1][1] = i
            else:
                out.append([i, i, voice[s]])
        for a, b, v in out:
            order.setdefault(v, len(order) + 1)
            want.add((run, a, b, order[v]))
    got = {(r["run_id"], r["first_idx"], r["last_idx"], r["speaker_no"]) for r in transcripts.clean_turns(turns, words, with_text=False).collect()}
    assert got == want and len(want) > 50


def neighbours(n, seed):
    """Certain pairs of a recording in which two share a first name, so that it alone says nothing: only the gap does."""
    r = np.random.default_rng(seed)
    names, rows = ["Orla Venn", "Orla Kolvic", "Hestra Ulm"], []
    for i in range(n):
        a, b = (names[k] for k in r.integers(0, 3, 2))
        gap = r.uniform(0, 1) if a == b else r.uniform(2, 9)
        rows.append({"run_id": "r", "bucket": i // 40, "p_speaker": a, "speaker": b, "p_voice": f"n{names.index(a)}", "voice": f"n{names.index(b)}", "p_cost": 0, "cost": 0, "p_whole": True, "whole": True,
                     "f_read": float(a == b), "f_cost": 0.0, "f_margin": 9.0, "f_label": float(a == b), "f_near": 1.0 if a == b else 0.4, "f_nobody": 0.0, "f_gap": gap, "f_before": 5.0, "f_words": 5.0, "f_ended": 0.0})
    return pd.DataFrame(rows)


def test_boundaries_learn_from_more_than_labels():
    x, y = transcripts._learnt(neighbours(900, 1), 600)
    model = boosting.boost(x, y, transcripts.FEATURES)
    held, truth = transcripts._learnt(neighbours(900, 2), 600)
    by_label = (held[:, 0] == truth).mean()
    assert ((model.log_odds(held) > 0) == (truth > 0)).mean() > max(0.97, by_label)
    assert model.splits()["f_gap"] > 0
    pair = dict.fromkeys(transcripts.FEATURES, 0.0) | {"f_read": 1.0, "f_near": 0.6, "f_before": 5.0, "f_words": 5.0}
    near, far = (np.array([[(pair | {"f_gap": gap})[f] for f in transcripts.FEATURES]]) for gap in (0.3, 6.0))
    assert model.log_odds(near)[0] > 0 > model.log_odds(far)[0]


def test_altered_labels_keep_their_voice():
    r = np.random.default_rng(5)
    for _ in range(200):
        label = ["Selvi Tollvik", "SPEAKER_01", "Vesna-Mo Abernal"][int(r.integers(3))]
        read = speakers.readings([("Selvi Tollvik", 9), ("SPEAKER_01", 9), ("Vesna-Mo Abernal", 9), (transcripts.altered(label, r), 1)])
        assert len({v.voice for v in read.values()}) == 3


def test_trees_in_sql_and_numpy(spark):
    r = np.random.default_rng(3)
    x = r.random((600, 3))
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.7)).astype(float)
    model = boosting.boost(x, y, ["a", "b", "c"])
    assert ((model.log_odds(x) > 0) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double")
    assert np.allclose([row[0] for row in df.select(F.expr(model.sql())).collect()], model.log_odds(x))
    assert boosting.boost(np.zeros((0, 3)), np.zeros(0), ["a", "b", "c"]).sql()


# --- abuse -----------------------------------------------------------------------------------


def corpus(n, seed):
    r = random.Random(seed)
    neutral = ["we counted {} speakers in the hall", "the file stopped at {} percent", "the report says {} people were called names", "please trim part {} of the tape", "he laughed at his own silly mistake {}"]
    bad = ["you are a worthless gronk number {}", "shut up you stupid gronk {}", "i will break your {} teeth tonight"]
    out = []
    for _ in range(n):
        y = r.random() < 0.35
        parts = [r.choice(neutral).format(r.randint(1, 60)) for _ in range(r.randint(1, 25))]
        if y:
            parts.insert(r.randrange(len(parts) + 1), r.choice(bad).format(r.randint(1, 60)))
        out.append((". ".join(parts), float(y)))
    return out


@pytest.fixture(scope="module")
def model():
    read, rows = abuse.Tokens(), corpus(500, 1)
    noisy = [1 - y if i % 33 == 0 else y for i, (_, y) in enumerate(rows)]
    return abuse.train([read(t) for t, _ in rows], np.array(noisy, np.float32))


def test_held_out_accuracy(model):
    read, rows = abuse.Tokens(), corpus(400, 2)
    s = model.scores([read(t) for t, _ in rows])
    assert ((s > 0.5) == (np.array([y for _, y in rows]) > 0.5)).mean() > 0.95


def test_one_sentence_in_a_long_text(model):
    read = abuse.Tokens()
    long = ". ".join(["we counted 5 speakers in the hall"] * 3000)
    a, b, c = model.scores([read(long), read(long + ". shut up you stupid gronk 3"), read("shut up you stupid gronk 3")])
    assert a < 0.5 < b and abs(b - c) < 0.4


@pytest.mark.parametrize("hidden", ["stup1d gr0nk", "s t u p i d gronk", "s.t.u.p.i.d gronk", "STUPID GRONK", "stu​pid gro­nk", "stuuuupid gronnnk", "ѕtupid grоnk"])
def test_hidden_words_read_as_plain(hidden):
    read = abuse.Tokens()
    assert read(hidden)[:, 0].tolist() == read("stupid gronk")[:, 0].tolist()


def test_batches_do_not_matter(model):
    read = abuse.Tokens()
    docs = [read(t) for t, _ in corpus(40, 3)] + [read(""), read("x")]
    together, alone = model.scores(docs), np.concatenate([model.scores([d]) for d in docs])
    assert np.allclose(together, alone, atol=1e-5) and together[-2] == 0


def test_tables(spark):
    rows = [(i, t, lang, "s", 0.1) for i, ((t, _), lang) in enumerate(zip(corpus(120, 4), ["en", None, "EN-x", "eng"] * 30, strict=True))] + [(900, None, "en", None, 0.0), (901, "", None, None, 0.0), (902, "你好", "zh", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, abuse_score double")
    marks = spark.createDataFrame([(i, "r", int(y)) for i, (_, y) in enumerate(corpus(120, 4))] + [(1, "r2", None), (5000, "r", 1), (None, "r", 1), (900, "r", 1)], "doc_id int, reviewer string, abusive int")
    fitted = abuse.fit(docs, marks)
    got = {r["doc_id"]: r for r in abuse.classify(docs.drop("abuse_score"), fitted).collect()}
    assert len(got) == len(rows) and got[900]["abuse_score"] == 0 and not got[901]["abusive"] and set(fitted.thresholds) >= {""}
    none = abuse.classify(docs, abuse.fit(docs, marks.limit(0)))
    assert none.filter("abusive").count() == 0 and none.columns == ["doc_id", "lang", "source", "abuse_score", "abusive"]
    assert abuse.classify(docs.limit(0), fitted).collect() == []


def test_contradicted_marks_are_set_aside():
    read, rows = abuse.Tokens(), corpus(600, 5)
    truth = np.array([y for _, y in rows], np.float32)
    wrong = np.arange(len(rows)) % 25 == 0
    marks = np.where(wrong, 1 - truth, truth)
    docs = [read(t) for t, _ in rows]
    crossed = np.array([w.max() for w in abuse.cross_fit(docs, marks, np.arange(len(rows)) % 2 == 0)])
    keep = abuse.believable(marks, crossed)
    assert (~keep & wrong).sum() >= 0.6 * wrong.sum() and (~keep & ~wrong).sum() <= 4


def test_nothing_is_set_aside_by_a_blind_model():
    r = np.random.default_rng(0)
    assert abuse.believable(r.integers(0, 2, 200).astype(float), r.normal(0, 6, 200)).all()


def test_thresholds_at_the_rate_of_the_corpus():
    """Marks with a third of cases, a corpus with a twentieth: the threshold rises, and by language."""
    r = np.random.default_rng(1)
    draw = lambda yes, no: np.concatenate([r.normal(2, 1.5, yes), r.normal(-3, 1.5, no)])
    target = np.repeat([1.0, 0.0], [1000, 2000])
    crossed = (draw(1000, 2000), target, ["en"] * 3000)
    count = lambda x: np.bincount(abuse._bin(x), minlength=abuse.BINS).astype(float)
    alike = abuse.calibrate(crossed, {"en": count(draw(10_000, 20_000))})
    rare = abuse.calibrate(crossed, {"en": count(draw(1500, 28_500)), "ru": count(draw(0, 300))})
    assert alike["en"] < rare["en"] and set(rare) == {"", "en", "ru"}
    log_odds = draw(1500, 28_500)
    share = (log_odds >= np.log(rare["en"] / (1 - rare["en"]))).mean()
    assert 0.03 < share < 0.07
    assert abuse.calibrate((np.zeros(0), np.zeros(0), []), {}) == {"": 1.1}


def test_ids_fit_tables():
    assert all(0 <= i < abuse.WORDS and 0 <= j < abuse.SHAPES for t in ("a", "f**k", "$7up1d", "日本", "0") for i, j in [abuse.token_ids(t)])
