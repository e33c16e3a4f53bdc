"""Spellings of speaker labels to the voices of a recording."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

from tidemark.llm.canonical import distance

#: Labels that name nobody, without marks around them.
NOBODY = frozenset(("", "unknown", "unknown speaker", "speaker", "speaker unknown", "na", "n/a", "none", "null", "nan", "unidentified", "unidentified speaker", "nobody", "tbd", "x"))

_NUMBERED = re.compile(r"^(?:speaker|spkr|spk|sprecher|hablante|спикер|voice|s)\W*0*(\d+)$")
_ASIDE = re.compile(r"\([^)]*\)|\[\s*\]")
_EDGE = re.compile(r"^[\W_]+|[^\w.]+$")


@dataclass
class Label:
    """What a label says: a number, the words of a name, or nothing."""

    number: int | None = None
    words: tuple[str, ...] = ()

    @property
    def nobody(self) -> bool:
        return self.number is None and not self.words


def read(label: str | None) -> Label:
    """One spelling of a label: case, brackets, asides, separators and ``Last, First`` undone."""
    if label is None:
        return Label()
    text = unicodedata.normalize("NFKC", label).casefold()
    text = _ASIDE.sub(" ", text).replace("_", " ")
    text = " ".join(_EDGE.sub("", text).split())
    if text.strip(" .?-") in NOBODY or not re.search(r"[^\W_]", text):
        return Label()
    numbered = _NUMBERED.match(text)
    if numbered:
        return Label(number=int(numbered[1]))
    if text.count(",") == 1:
        last, first = (t.strip() for t in text.split(","))
        text = f"{first} {last}" if first and last else first or last
    return Label(words=tuple(text.replace(",", " ").split()))


def _initial(word: str) -> bool:
    return len(word.rstrip(".")) == 1


@dataclass
class Voice:
    names: list[tuple[str, ...]] = field(default_factory=list)
    weight: int = 0


def _near(a: str, b: str) -> int:
    """0 for equal words, 1 for one slip in a word of four letters or more, else 9."""
    if a == b:
        return 0
    return 1 if min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 4 and distance(a, b) == 1 else 9


def _fit(words: tuple[str, ...], name: tuple[str, ...]) -> int:
    """How badly a short form fits a name: 0 not at all badly, 9 or more it does not."""
    if len(words) == 1:
        return min((_near(words[0], w) if not _initial(w) else (3 if words[0][0] == w[0] else 9)) for w in name)
    if len(name) == 1:
        return _fit(name, words)
    score = 0
    for w, n in ((words[0], name[0]), (words[-1], name[-1])):
        score += (0 if w[0] == n[0] else 9) if _initial(w) or _initial(n) else _near(w, n)
    return score


@dataclass(frozen=True)
class Reading:
    """The voice of a label, how badly the label fits it (0: plainly it), by how much any other fits worse, and whether it is a whole name or number."""

    voice: str
    cost: int = 0
    margin: int = 9
    whole: bool = True


def readings(labels: Iterable[tuple[str | None, int]]) -> dict[str | None, Reading]:
    """Label to voice for the labels of one recording, given how often each occurs.

    Labels that name nobody share the voice ``?``. Full names gather spellings one slip away; then
    short forms and initials join the voice that they fit best, the more frequent one among equals,
    and stand for a voice of their own where they fit none.
    """
    out: dict[str | None, Reading] = {}
    named: dict[tuple[str, ...], int] = {}
    spelled: dict[tuple[str, ...], list[str | None]] = {}
    for raw, n in labels:
        label = read(raw)
        if label.nobody:
            out[raw] = Reading("?")
        elif label.number is not None:
            out[raw] = Reading(f"#{label.number}")
        else:
            named[label.words] = named.get(label.words, 0) + n
            spelled.setdefault(label.words, []).append(raw)
    found: list[Voice] = []
    full = lambda w: len(w) > 1 and not any(map(_initial, w))
    rank = lambda w: (not full(w), len(w) == 1, -named[w], w)
    of: dict[tuple[str, ...], tuple[int, int, int]] = {}
    for words in sorted(named, key=rank):
        best, where = 3 if not full(words) else 2, -1
        fits = []
        for i, voice in enumerate(found):
            fits.append(9)
            for name in voice.names:
                if full(words) and full(name):
                    a, b = " ".join(words), " ".join(name)
                    fit = 0 if a == b else 1 if distance(a, b) <= (1 if len(a) < 12 else 2) and _fit(words, name) < 9 else 9
                else:
                    fit = _fit(words, name)
                fits[-1] = min(fits[-1], fit)
                if fit < best or (fit == best and fit < 9 and where >= 0 and voice.weight > found[where].weight and fit > 0):
                    best, where = fit, i
                elif fit == best and fit == 3 and where < 0:
                    where = i
        rivals = [f for i, f in enumerate(fits) if i != where]
        of[words] = (where, fits[where], min([9, *rivals]) - fits[where]) if where >= 0 else (len(found), 0, 9)
        if where < 0:
            found.append(Voice())
            where = len(found) - 1
        found[where].names.append(words)
        found[where].weight += named[words]
    for words, raws in spelled.items():
        where, cost, margin = of[words]
        for raw in raws:
            out[raw] = Reading(f"n{where}", cost, max(0, margin), full(words))
    return out


def voices(labels: Iterable[tuple[str | None, int]]) -> dict[str | None, str]:
    """Label to voice for the labels of one recording."""
    return {raw: r.voice for raw, r in readings(labels).items()}
