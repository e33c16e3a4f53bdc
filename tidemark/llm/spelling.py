"""Two keys of a freely typed value: what was written, and what it sounds like."""

from __future__ import annotations

import re
import unicodedata

# Letters of two scripts that look alike.
LOOKS_LATIN = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w"}
LOOKS_CYRILLIC = {"a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "k": "к", "m": "м", "o": "о", "p": "р", "t": "т", "x": "х", "y": "у"}
# Cyrillic letters in Latin ones.
LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "i", "ь": "", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ї": "i", "є": "e", "ґ": "g"}
# Spellings of one sound, longest first.
SOUNDS = (("sch", "s"), ("kh", "k"), ("ch", "k"), ("ck", "k"), ("sh", "s"), ("zh", "s"), ("ph", "f"), ("th", "t"), ("qu", "kf"), ("oo", "u"), ("ou", "u"), ("ee", "i"), ("ae", "e"), ("x", "ks"), ("q", "k"), ("c", "k"), ("g", "k"), ("b", "p"), ("d", "t"), ("v", "f"), ("w", "f"), ("z", "s"), ("y", "i"), ("j", "i"), ("h", ""))
#: Words that may stand before or after a value and are no part of it.
AROUND = frozenset("a an the our my your his her their this that on in at with for from of to and then please der die das el la los las".split())
#: Values that say that nothing was heard.
NOTHING = frozenset(("", "na", "null", "none", "inaudible", "unknown", "unintelligible", "blankaudio", "silence", "nan", "tbd"))

_WORD = re.compile(r"[^\W_]+")
_POSSESSIVE = re.compile(r"['’ʼ`]s?(?=\W*$)")
_PLURAL_POSSESSIVE = re.compile(r"s['’ʼ`]\W*$")


def _one_script(word: str) -> str:
    """A word whose letters come from two scripts, in the one that most of them are from."""
    cyrillic = sum("а" <= c <= "ӿ" for c in word)
    latin = sum("a" <= c <= "z" for c in word)
    if cyrillic and latin:
        swap = LOOKS_LATIN if latin >= cyrillic else LOOKS_CYRILLIC
        word = "".join(swap.get(c, c) for c in word)
    return "".join(LATIN.get(c, c) for c in word)


def words(value: str | None) -> list[str]:
    """Lower-case Latin words of a value, without marks, punctuation and a final possessive."""
    if not value:
        return []
    text = unicodedata.normalize("NFKC", value).casefold()
    text = _POSSESSIVE.sub("", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("й", "\0")) if not unicodedata.combining(c)).replace("\0", "й")
    return [_one_script(w) for w in _WORD.findall(text)]


def key(value: str | None) -> str:
    """What was written: letters and digits only."""
    return "".join(words(value))


def bare_keys(value: str | None) -> list[str]:
    """The written key, then those without the words around the value; none for a value that says nothing."""
    found = words(value)
    if "".join(found) in NOTHING:
        return []
    ways = [found]
    if value and _PLURAL_POSSESSIVE.search(unicodedata.normalize("NFKC", value).casefold()) and len(found[-1]) > 1:
        ways.append([*found[:-1], found[-1].removesuffix("s")])
    out = []
    for way in ways:
        out.append("".join(way))
        while len(way) > 1 and way[0] in AROUND:
            way = way[1:]
            out.append("".join(way))
        while len(way) > 1 and way[-1] in AROUND:
            way = way[:-1]
            out.append("".join(way))
    return list(dict.fromkeys(out))


_SOUND = re.compile("|".join(a for a, _ in sorted(SOUNDS, key=lambda p: -len(p[0]))))
_SOUND_OF = dict(SOUNDS)
_TWICE = re.compile(r"([a-z])\1+")


def sound(written: str) -> str:
    """What a written key sounds like: spellings of one sound, voiced or not, fall together; doubles once."""
    return _TWICE.sub(r"\1", _SOUND.sub(lambda m: _SOUND_OF[m.group()], written))
