"""A glossary as its owner edits it: read with every flaw named, changed within its limits, written only if it can be read.

A glossary is small by its limits and lives on the driver; ``frame`` hands it to the operators.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.glossary import MAX_ALIASES, MAX_CHARS, MAX_TERMS, MAX_WORDS

#: Bytes of a file that is read or written.
MAX_BYTES = 8 << 20
_SEPARATORS = str.maketrans(",|~", "   ")


class BadGlossary(ValueError):
    """What is wrong with a glossary, entry by entry."""


def plain(value: str) -> str:
    """A text without separators and control characters, white space once."""
    shown = "".join(c if not unicodedata.category(c).startswith("C") or c.isspace() else "" for c in value.translate(_SEPARATORS))
    return re.sub(r"\s+", " ", shown).strip()


@dataclass
class Term:
    term: str
    aka: list[str] = field(default_factory=list)
    note: str = ""


def _within(value: str) -> None:
    if len(value) > MAX_CHARS or len(value.split()) > MAX_WORDS:
        raise BadGlossary(f"{value[:40]!r} is no name: at most {MAX_CHARS} characters and {MAX_WORDS} words")


class Glossary:
    """Terms in order. A change that would break a limit raises and changes nothing."""

    def __init__(self, terms: Iterable[Term] = ()) -> None:
        self.terms = list(terms)

    def find(self, name: str) -> Term | None:
        return next((t for t in self.terms if t.term.casefold() == name.casefold()), None)

    def add(self, term: str, aka: Iterable[str] = (), note: str = "") -> bool:
        """Add a term, or its new spellings to the one of that name; whether it was new.

        A spelling belongs to one term only; the first way of writing it stays; a new note replaces
        the old one.
        """
        name = plain(term)
        if not name:
            raise BadGlossary("a term is empty once separators are gone")
        spelled = {a.casefold(): a for a in reversed([plain(a) for a in aka]) if a}
        for value in (name, *spelled.values()):
            _within(value)
        old = self.find(name)
        have = {a.casefold() for a in old.aka} if old else set()
        if len(have | set(spelled)) > MAX_ALIASES:
            raise BadGlossary(f"{name!r} would have more than {MAX_ALIASES} spellings")
        wanted = set(spelled) | {name.casefold()}
        for other in self.terms:
            if other is old:
                continue
            clash = next((a for a in other.aka if a.casefold() in wanted), other.term if other.term.casefold() in spelled else None)
            if clash:
                raise BadGlossary(f"{clash!r} already belongs to {other.term!r}")
        if old is None:
            if len(self.terms) >= MAX_TERMS:
                raise BadGlossary(f"the glossary holds {MAX_TERMS} terms already")
            self.terms.append(Term(name, list(reversed(spelled.values())), plain(note)))
            return True
        old.aka += [a for k, a in reversed(spelled.items()) if k not in have]
        old.note = plain(note) or old.note
        return False

    def remove(self, name: str) -> bool:
        """Whether a term of that name was there."""
        found = self.find(name)
        if found:
            self.terms.remove(found)
        return found is not None

    def take(self, lines: Iterable[str]) -> int:
        """Import lines ``Term = alias, alias  # note``: all of them or, where one is wrong, none; how many were new."""
        trial = Glossary([Term(t.term, list(t.aka), t.note) for t in self.terms])
        new = 0
        for n, text in enumerate(lines, 1):
            body, _, note = text.partition("#")
            name, _, rest = body.partition("=")
            if not name.strip():
                continue
            try:
                new += trial.add(name, rest.split(","), note)
            except BadGlossary as e:
                raise BadGlossary(f"line {n}: {e}") from e
        self.terms = trial.terms
        return new

    def frame(self, spark: SparkSession) -> DataFrame:
        """``priority, term, aka, note`` for the operators."""
        return spark.createDataFrame([(i, t.term, t.aka, t.note) for i, t in enumerate(self.terms, 1)], "priority int, term string, aka array<string>, note string")


def parse(text: str) -> Glossary:
    """A glossary from JSON; every entry of a wrong shape is an error, as a skipped one would be lost with the next save."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise BadGlossary(f"no JSON: {e}") from e
    entries = raw.get("terms") if isinstance(raw, Mapping) else None
    if not isinstance(entries, list):
        raise BadGlossary('no object with a list "terms"')
    terms = []
    for n, item in enumerate(entries, 1):
        if not isinstance(item, Mapping) or not str(item.get("term", "")).strip():
            raise BadGlossary(f"entry {n} has no term")
        aka, note = item.get("aka", []), item.get("note", "")
        if not isinstance(aka, list) or not all(isinstance(a, str) for a in aka):
            raise BadGlossary(f"entry {n}: aka is no list of texts")
        if not isinstance(note, str):
            raise BadGlossary(f"entry {n}: note is no text")
        name = plain(str(item["term"]))
        if not name:
            raise BadGlossary(f"entry {n} is nothing but separators")
        once = {a.casefold(): a for a in reversed([plain(a) for a in aka]) if a}
        terms.append(Term(name, list(reversed(once.values())), plain(note)))
    return Glossary(terms)


def load(path: str) -> Glossary:
    """The glossary in a file; none where there is no file."""
    p = Path(path)
    if not p.exists():
        return Glossary()
    if not p.is_file() or p.stat().st_size > MAX_BYTES:
        raise BadGlossary(f"{path}: no regular file of at most {MAX_BYTES} bytes")
    try:
        return parse(p.read_text("utf-8"))
    except (UnicodeDecodeError, RecursionError, BadGlossary) as e:
        raise BadGlossary(f"{path}: {e}") from e


def serialized(glossary: Glossary) -> str:
    """The JSON of a glossary, refused where ``load`` would refuse it."""
    items = [{"term": t.term} | ({"aka": t.aka} if t.aka else {}) | ({"note": t.note} if t.note else {}) for t in glossary.terms]
    text = json.dumps({"terms": items}, ensure_ascii=False, indent=2) + "\n"
    if len(text.encode()) > MAX_BYTES:
        raise BadGlossary(f"the glossary would take more than {MAX_BYTES} bytes")
    parse(text)
    return text


def save(glossary: Glossary, path: str) -> None:
    """Write a glossary whole or not at all."""
    text = serialized(glossary)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(text)
    os.replace(f.name, path)
