"""Scoring texts for insults, threats, demeaned groups and explicit sex.

A small convolutional classifier, trained here in numpy from review marks. Words, with the usual ways
of hiding them undone, are hashed to embeddings, a second hash of first letter, last letter and length
stands for masked ones; filters of several widths run over the text, their maxima are taken over
windows of a sentence's length, and a hidden layer scores each window. A text scores as its worst
window does, so one sentence in a long text counts as much as one alone.

Marks are made by hand and some are wrong. Two models, each fitted on one half, read the other half;
a mark that such a model contradicts plainly is set aside before the model proper is fitted. The marked
sample holds far more cases than the corpus does, so thresholds are not taken from its rates: the share
of cases is estimated by expectation-maximisation over the scores of all documents, and the threshold
of each language is the score at which the expected F1 at that share is best.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import spelling
from tidemark.session import cut

#: Marked documents that a model is fitted on at most, drawn by a hash of the key, code points of each
#: of their texts, and of all of them together: what the driver holds is bounded by these.
MARKED = 12_000
LONGEST = 40_000
MARKED_CHARS = 30_000_000
#: Scores of a half's model on the other half below or above which it contradicts a mark, and the
#: share of marks it must bear out among all that it is as sure of for its word to count.
DOUBT = (0.2, 0.95)
RELIABLE = 0.85
#: Marks and documents that a language's own figures count against those of all languages.
SHRINK_MARKS, SHRINK_DOCUMENTS = 40, 400
#: Bins of the log odds, from -BINS / 4 to BINS / 4.
BINS = 96

WORDS, SHAPES = 1 << 15, 1 << 11
DIM, FILTERS, HIDDEN = 16, 12, 16
WIDTHS = (1, 2, 3, 5)
#: Words of a block; a window is three blocks. Words that go through the filters together.
BLOCK, TOGETHER = 8, 8_000
EPOCHS, HALF_EPOCHS = 6, 5
#: Part of the embeddings taken off after each round: what only chance upholds fades.
DECAY = 0.05

# Letters written as digits or signs.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"})
_HIDDEN = re.compile("[­​-‏‪-‮⁠﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .]){2,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_][\w@#*$]*|\$[\w@#*$]+")
_MASK = re.compile(r"[@#*]")
_NUMBER = re.compile(r"\d[\d_]*[a-z]?\d*|[a-z]\d+")
_COUNTED = re.compile(r"_+\d+$")
_RUN = re.compile(r"(.)\1+")


def _hash(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % (size - 1) + 1


def token_ids(token: str) -> tuple[int, int]:
    """Hashes of a token and of its shape; clocks, dates and counted labels are no hidden words."""
    token = token.rstrip("@#")
    if _NUMBER.fullmatch(token):
        return _hash("0", WORDS), 0
    token = _COUNTED.sub("", token).replace("_", "")
    letters = sum(c.isalpha() for c in token)
    if not letters and not _MASK.search(token) and "$" not in token:
        return _hash("0", WORDS), 0
    plain = token
    if letters < len(token):
        masked = _MASK.sub("*", token)
        digits = sum(c in "01345 7$".replace(" ", "") for c in token)
        plain = token.translate(LEET) if digits and (letters or "$" in token) else masked
    if any("а" <= c <= "ӿ" for c in plain) and any("a" <= c <= "z" for c in plain):
        plain = spelling._one_script(plain)
    shape = f"{plain[:1]}{len(plain)}{plain[-1:]}"
    if "*" in plain:
        return 0, _hash(shape, SHAPES)
    return _hash(_RUN.sub(r"\1", plain), WORDS), _hash(shape, SHAPES)


class _Known(dict):
    """Both hashes of every token met, as one number."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        word, shape = token_ids(token)
        got = self[token] = word * SHAPES + shape
        return got


class Tokens:
    """Texts to arrays of word and shape hashes; remembers tokens."""

    def __init__(self) -> None:
        self.known = _Known()

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros((0, 2), np.int32)
        text = text.lower()
        if not text.isascii():
            text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        text = _SPACED.sub(lambda m: m.group().replace(" ", "").replace(".", ""), text)
        both = np.fromiter(map(self.known.__getitem__, _TOKEN.findall(text)), np.int64)
        return np.stack(np.divmod(both, SHAPES), axis=1).astype(np.int32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the classifier and a threshold per language."""

    words: np.ndarray
    shapes: np.ndarray
    filters: list[np.ndarray]  # by offset: of the widths beyond it, side by side
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Log odds, mark and language of marked documents, each by a model that did not see it.
    crossed: tuple[np.ndarray, np.ndarray, list[str]] = field(default_factory=lambda: (np.zeros(0), np.zeros(0), []))

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        draw = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        wide = len(WIDTHS) * FILTERS
        filters = [draw(DIM, FILTERS * sum(w > j for w in WIDTHS), s=0.3) for j in range(max(WIDTHS))]
        return cls(draw(WORDS, DIM, s=0.1), draw(SHAPES, DIM, s=0.02), filters, np.zeros(wide, np.float32), draw(wide, HIDDEN, s=0.25), np.zeros(HIDDEN, np.float32), draw(HIDDEN, s=0.3), np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def activations(self, ids: np.ndarray) -> np.ndarray:
        """Filter outputs at each position of ``ids`` (positions past the end count as blank)."""
        x = self.words[ids[:, 0]] + self.shapes[ids[:, 1]]
        x[(ids[:, 0] == 0) & (ids[:, 1] == 0)] = 0
        n = len(x)
        a = np.tile(self.bias, (n, 1))
        for j, f in enumerate(self.filters):
            if n > j:
                a[: n - j, a.shape[1] - f.shape[1] :] += x[j:] @ f
        return np.maximum(a, 0, out=a)

    def windows(self, docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the windows of all ``docs`` and where each document's windows start.

        Documents go through the filters together up to ``TOGETHER`` words, which bounds the memory.
        """
        ends = np.cumsum([len(d) + BLOCK for d in docs])
        scores, firsts, at, done = [], [np.zeros(1, np.int64)], 0, 0
        while at < len(docs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER)))
            logit, first = self._windows(docs[at:to])
            scores.append(logit)
            firsts.append(first[1:] + done)
            at, done = to, done + len(logit)
        return np.concatenate([np.zeros(0, np.float32), *scores]), np.concatenate(firsts)

    def _windows(self, docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        blocks = np.array([max(1, -(-(len(d) + max(WIDTHS) - 1) // BLOCK)) for d in docs])
        first = np.concatenate([[0], np.cumsum(blocks)])
        ids = np.zeros((first[-1] * BLOCK, 2), np.int32)
        own = np.zeros(len(ids), bool)
        for d, at in zip(docs, first[:-1], strict=True):
            ids[at * BLOCK : at * BLOCK + len(d)] = d
            own[at * BLOCK : at * BLOCK + len(d)] = True
        seen = self.activations(ids)
        # a filter that begins in a document ends in it or its blanks; one that begins in the blanks
        # sees nothing, whatever document comes next
        seen[~own] = np.maximum(self.bias, 0)
        top = seen.reshape(-1, BLOCK, len(self.bias)).max(1)
        pooled = top.copy()
        same = np.repeat(np.arange(len(docs)), blocks)
        for k in (1, 2):
            joined = same[k:] == same[:-k]
            pooled[:-k][joined] = np.maximum(pooled[:-k][joined], top[k:][joined])
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return h @ self.out + self.out_bias[0], first

    def log_odds(self, docs: Sequence[np.ndarray]) -> np.ndarray:
        """Log odds of each document: those of its worst window."""
        if not len(docs):
            return np.zeros(0, np.float32)
        logit, first = self.windows(docs)
        return np.maximum.reduceat(logit, first[:-1])

    def scores(self, docs: Sequence[np.ndarray]) -> np.ndarray:
        """Probability of each document; 0 for one without words."""
        return np.where([len(d) > 0 for d in docs], _logistic(self.log_odds(docs)), 0.0)


def _step(model: Model, ids: np.ndarray, target: np.ndarray, memory: dict, rate: float) -> None:
    """One Adagrad step on windows ``ids`` (n, words, 2)."""
    n, length, _ = ids.shape
    blank = (ids[..., 0] == 0) & (ids[..., 1] == 0)
    x = model.words[ids[..., 0]] + model.shapes[ids[..., 1]]
    x[blank] = 0
    wide = len(model.bias)
    a = np.tile(model.bias, (n, length, 1))
    for j, f in enumerate(model.filters):
        a[:, : length - j, wide - f.shape[1] :] += x[:, j:] @ f
    at = a.argmax(1)
    pooled = np.maximum(np.take_along_axis(a, at[:, None, :], 1)[:, 0], 0)
    pre = pooled @ model.hidden + model.hidden_bias
    h = np.maximum(pre, 0)
    p = _logistic(h @ model.out + model.out_bias[0])
    d = ((p - target) / n).astype(np.float32)
    g_out, g_out_bias = h.T @ d, np.array([d.sum()])
    dh = np.outer(d, model.out) * (pre > 0)
    g_hidden, g_hidden_bias = pooled.T @ dh, dh.sum(0)
    dp = (dh @ model.hidden.T) * (pooled > 0)
    rows = np.arange(n)[:, None]
    dx = np.zeros_like(x)
    g_filters = []
    for j, f in enumerate(model.filters):
        lo = wide - f.shape[1]
        where = at[:, lo:] + j
        # a filter has one maximum in a window, so no cell is met twice
        cells = np.zeros((n, length, f.shape[1]), np.float32)
        cells[rows, np.minimum(where, length - 1), np.arange(f.shape[1])] = dp[:, lo:] * (where < length)
        flat = cells.reshape(n * length, -1)
        g_filters.append(x.reshape(n * length, -1).T @ flat)
        dx += (flat @ f.T).reshape(x.shape)
    dx[blank] = 0
    for name, value, grad in zip(range(99), model.params(), [*g_filters, dp.sum(0), g_hidden, g_hidden_bias, g_out, g_out_bias], strict=False):
        m = memory.setdefault(name, np.full(value.shape, 1e-4, np.float32))
        m += grad * grad
        value -= rate * grad / np.sqrt(m)
    felt = dx.any(-1)
    if not felt.any():
        return
    moved = dx[felt]
    for table, column in ((model.words, 0), (model.shapes, 1)):
        index = ids[..., column][felt]
        order = np.argsort(index, kind="stable")
        used, begin = np.unique(index[order], return_index=True)
        grad = np.add.reduceat(moved[order], begin, axis=0)
        m = memory.setdefault(("table", column), np.full(table.shape, 1e-4, np.float32))
        m[used] += grad * grad
        table[used] -= rate * grad / np.sqrt(m[used])


def train(docs: Sequence[np.ndarray], target: np.ndarray, seed: int = 7, epochs: int = EPOCHS, seen_by: Sequence[np.ndarray] | None = None) -> Model:
    """Fit by the worst windows: each round scores all windows and learns from each document's worst.

    ``seen_by`` has the log odds of each document's windows by a model that did not see it. Where that
    model finds a case, the window it means is taken, as it cannot know the document by chance words.
    """
    r = np.random.default_rng(seed)
    model = Model.fresh(seed)
    if not len(docs):
        return model
    # the first embedding starts as the log odds of the word, which gives the first round its windows
    odds = np.zeros((2, WORDS), np.float32)
    for d, y in zip(docs, target, strict=True):
        used = np.unique(d[:, 0])
        odds[1, used] += y
        odds[0, used] += 1 - y
    total = odds.sum(0)
    base = (target.sum() + 1) / (len(target) + 2)
    model.words[:, 0] = np.log((odds[1] + 2 * base) / (odds[0] + 2 * (1 - base))) - np.log(base / (1 - base))
    model.words[total < 2, 0] = 0
    model.words[:, 0] = np.clip(model.words[:, 0], -2, 2) / 2
    for f in model.filters:
        f[0] = np.abs(f[0])
    padded = [np.concatenate([d, np.zeros(((-len(d)) % BLOCK + 4 * BLOCK, 2), np.int32)]) for d in docs]
    span = 3 * BLOCK + max(WIDTHS) - 1
    memory: dict = {}
    for epoch in range(epochs):
        logit, first = model.windows(docs)
        picked, wanted = [], []
        for i, y in enumerate(target):
            own = logit[first[i] : first[i + 1]]
            worst = int(own.argmax())
            if y <= 0.5:
                chosen = {worst, *np.argsort(-own)[1:3].tolist(), int(r.integers(len(own)))}
            elif seen_by is not None and seen_by[i].max() > 0:
                chosen = {int(seen_by[i].argmax())}
            elif epoch >= 4 and _logistic(own[worst]) < 0.03:
                continue  # a mark that the rest of the sample contradicts
            else:
                chosen = {worst}
            for k in chosen:
                easy = abs(_logistic(own[k]) - y) < 0.02
                if epoch and easy and r.random() > 0.15:
                    continue
                picked.append(padded[i][k * BLOCK : k * BLOCK + span])
                wanted.append(y)
        ids = np.zeros((len(picked), span, 2), np.int32)
        for row, w in zip(ids, picked, strict=True):
            row[: len(w)] = w
        y = np.array(wanted, np.float32)
        for _ in range(2):
            order = r.permutation(len(ids))
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                seen = ids[part].copy()
                seen[r.random(seen.shape[:2]) < 0.1] = 0  # a word less: no name or number may decide
                _step(model, seen, y[part], memory, 0.06 if 2 * epoch < epochs else 0.03)
        model.words *= 1 - DECAY
        model.shapes *= 1 - DECAY
    return model


def cross_fit(docs: Sequence[np.ndarray], target: np.ndarray, half: np.ndarray) -> list[np.ndarray]:
    """Log odds of each document's windows by a model fitted on the half that it is not in."""
    out = [np.zeros(1)] * len(docs)
    for side in (False, True):
        others, own = np.flatnonzero(half != side), np.flatnonzero(half == side)
        if len(others) and len(own):
            logit, first = train([docs[i] for i in others], target[others], 7 + side, HALF_EPOCHS).windows([docs[i] for i in own])
            for i, at, to in zip(own, first[:-1], first[1:], strict=True):
                out[i] = logit[at:to]
    return out


def believable(target: np.ndarray, crossed: np.ndarray) -> np.ndarray:
    """Which marks to keep: all but those plainly contradicted by the half that did not see them.

    Nothing is set aside for a side (abusive or not) on which the contradicting models are wrong too
    often, as those of a few marks are.
    """
    p = _logistic(crossed)
    yes = target > 0.5
    keep = np.ones(len(target), bool)
    for sure, against in ((p < DOUBT[0], yes), (p > DOUBT[1], ~yes)):
        if sure.any() and (sure & ~against).sum() >= RELIABLE * sure.sum():
            keep &= ~(sure & against)
    return keep


def _bin(log_odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.asarray(log_odds) * 2) + BINS // 2, 0, BINS - 1).astype(int)


def _shares(counts: np.ndarray, yes: np.ndarray, no: np.ndarray, start: float, weight: float) -> float:
    """The share of cases in ``counts`` (documents by bin) by EM, given how cases and others spread over the bins."""
    share = start
    for _ in range(200):
        of = share * yes / np.maximum(share * yes + (1 - share) * no, 1e-12)
        share = float((counts @ of + weight * start) / max(1e-9, counts.sum() + weight))
    return share


def calibrate(crossed: tuple[np.ndarray, np.ndarray, list[str]], counts: dict[str, np.ndarray]) -> dict[str, float]:
    """Threshold by language (``""`` for the others), from marked documents and scores of the corpus.

    ``counts`` has the corpus's documents by bin of their log odds, by language. The share of cases
    comes from EM over them, with the spread of cases and others as the marks have it; the expected F1
    of a threshold then needs the share, what part of the marked cases passes and how many documents
    of the corpus do. A language counts by itself as far as its own marks and documents go.
    """
    log_odds, target, tags = crossed
    total = sum(counts.values(), np.zeros(BINS))
    if not (target > 0.5).any():
        return {"": 1.1}
    if not total.sum() or (target > 0.5).all():
        return {"": 0.5}
    tags = np.array(tags)
    bins = _bin(log_odds)
    kernel = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)

    def spread(which: np.ndarray) -> np.ndarray:
        """Part of the marks in each bin, smoothed."""
        x = np.convolve(np.bincount(bins[which], minlength=BINS), kernel / kernel.sum(), "same") + 1e-6
        return x / x.sum()

    def best(share: float, yes: np.ndarray, seen: np.ndarray) -> float:
        passed = np.cumsum(yes[::-1])[::-1]
        flagged = np.cumsum(seen[::-1])[::-1] / seen.sum()
        f1 = 2 * np.minimum(share * passed, flagged) / (share + flagged)
        top = np.flatnonzero(f1 >= f1.max() - 0.003)  # of near equals the middle
        return float(_logistic((top[len(top) // 2] - BINS // 2) / 2))

    sides = {True: target > 0.5, False: target <= 0.5}
    common = {side: spread(which) for side, which in sides.items()}
    share = _shares(total, common[True], common[False], 0.5, 0.0)
    out = {"": best(share, common[True], total)}
    for tag, seen in counts.items():
        if not seen.sum():
            continue
        own = {}
        for side, which in sides.items():
            mine = which & (tags == tag)
            own[side] = (mine.sum() * spread(mine) + SHRINK_MARKS * common[side]) / (mine.sum() + SHRINK_MARKS)
        mixed = seen + total * SHRINK_DOCUMENTS / max(1.0, total.sum())
        out[tag] = best(_shares(seen, own[True], own[False], share, SHRINK_DOCUMENTS), own[True], mixed)
    return out


def language_of(lang: Column, text: Column) -> Column:
    """Two letters: the tag in one spelling, or by the script of the text where there is none."""
    tag = F.lower(F.substring(F.trim(lang), 1, 2))
    known = F.when(tag == "sp", "es").when(tag == "ge", "de").otherwise(tag)
    guess = F.when(text.rlike("[а-яА-Я]{3}"), "ru").otherwise("en")
    return F.coalesce(F.when(known.rlike("^[a-z]{2}$"), known), guess, F.lit("en"))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", mark: str = "abusive", marked: int = MARKED) -> Model:
    """Train on a bounded sample of marked documents (one job, rows to the driver).

    Marks of one document are averaged; null marks and texts do not count. The sample holds at most
    ``marked`` documents of at most ``LONGEST`` code points each and ``MARKED_CHARS`` together, so its
    size is bounded whatever the tables hold. Without marks the model scores everything alike and no
    text passes the threshold.
    """
    marks = labels.filter(F.col(mark).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.avg(F.col(mark).cast("double")).alias("_y"))
    sample = F.broadcast(marks.orderBy(F.xxhash64("_key"), "_key").limit(marked))
    texts = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), language_of(F.col(lang), F.col(text)).alias("_lang"))
    own = texts.join(sample, "_key").filter(F.length("_text") <= LONGEST).groupBy("_key").agg(F.first("_text").alias("_text"), F.first("_lang").alias("_lang"), F.first("_y").alias("_y"))
    so_far = F.sum(F.length("_text")).over(Window.orderBy(F.xxhash64("_key"), "_key"))  # at most ``marked`` rows
    rows = own.withColumn("_chars", so_far).filter(F.col("_chars") <= MARKED_CHARS).drop("_chars").toPandas()
    rows = rows.sort_values("_key", ignore_index=True)
    read = Tokens()
    docs = [read(t) for t in rows["_text"]]
    target = rows["_y"].to_numpy(np.float32)
    if not len(docs):
        model = Model.fresh()
        model.thresholds = {"": 1.1}
        return model
    half = np.array([zlib.crc32(str(k).encode()) % 2 == 0 for k in rows["_key"]])
    by_window = cross_fit(docs, target, half)
    crossed = np.array([w.max() for w in by_window])
    keep = np.flatnonzero(believable(target, crossed))
    model = train([docs[i] for i in keep], target[keep], seen_by=[by_window[i] for i in keep])
    model.crossed = (crossed[keep], target[keep], rows["_lang"].iloc[keep].tolist())
    model.thresholds = {"": 0.5}
    return model


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``abuse_score`` to ``documents``: whole texts, every row, no row moves.

    Null, empty and wordless texts score 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read, net = Tokens(), shared.value
        for texts in batches:
            yield pd.Series(net.scores([read(None if pd.isna(t) else t) for t in texts]), dtype=float)

    return documents.withColumn("abuse_score", run(F.col(text).cast("string")))


def classify(documents: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """Score ``documents`` and add ``abusive``; the text leaves, the other columns stay.

    Scores are written once and counted by language over all rows; the thresholds follow from these
    counts (``calibrate``). Null, empty and wordless texts score 0, are not counted and are not abusive.
    """
    tagged = score(documents.withColumn("_tag", language_of(F.col(lang), F.col(text))), model, text)
    scored = cut(tagged.drop(text))
    odds = F.log(F.col("abuse_score")) - F.log1p(-F.col("abuse_score"))
    place = F.least(F.greatest(F.floor(odds * 2).cast("int") + BINS // 2, F.lit(0)), F.lit(BINS - 1))
    # one row per language (two letters) and bin, whatever the number of documents
    found = scored.filter("abuse_score > 0 and abuse_score < 1").groupBy("_tag", place.alias("_bin")).agg(F.count("*").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for tag, at, n in found:
        counts.setdefault(tag, np.zeros(BINS))[at] += n
    limits = calibrate(model.crossed, counts) if len(model.crossed[0]) else model.thresholds
    model.thresholds = limits
    least = F.lit(float(limits.get("", 0.5)))
    for name, value in limits.items():
        if name:
            least = F.when(F.col("_tag") == name, float(value)).otherwise(least)
    return scored.withColumn("abusive", (F.col("abuse_score") > 0) & (F.col("abuse_score") >= least)).drop("_tag")
