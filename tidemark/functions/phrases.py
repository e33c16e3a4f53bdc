"""Phrases that decoders invent over silence, as patterns for Spark and for the oracle alike."""

from __future__ import annotations

# Never said in a recording of one's own, so always taken out.
ALWAYS = (
    r"субтитры\s+(с)?делал",
    r"субтитры\s+создавал",
    r"субтитры\s+и\s+перевод",
    r"редактор\s+субтитров",
    r"корректор\s+[А-ЯЁ]\.",
    r"dimatorzok",
    r"субтитр(ы|ов)\s+от\b",
    r"подписывайтесь\s+на\s+(канал|наш)",
    r"ставьте\s+лайк",
    r"жмите\s+колокольчик",
    r"subtitles?\s+by\s+",
    r"subs?\s+by\s+",
    r"amara\.org",
    r"zeoranger\.co\.uk",
    r"mooji\.org",
    r"transcription\s+by\s+eso",
    r"translated\s+by\s+\S+$",
    r"please\s+subscribe\s+to\s+(my|our|the)\s+channel",
    r"like\s+and\s+subscribe",
    r"^\W*(музыка|music|аплодисменты|applause|laughter|смех)\W*$",
    r"^[\s♪♫»«\-—…\.]+$",
)
# Ordinary phrases, taken out only where the sound speaks against them.
CONTEXTUAL = (
    r"^\W*продолжение\s+следует\W*$",
    r"^\W*спасибо\s+за\s+просмотр\W*$",
    r"^\W*спасибо\s+за\s+внимание\W*$",
    r"^\W*всем\s+пока\W*$",
    r"^\W*до\s+новых\s+встреч\W*$",
    r"^\W*thanks?\s+(you\s+)?for\s+watching\W*$",
    r"^\W*thank\s+you\W*$",
    r"^\W*thanks\W*$",
    r"^\W*you\W*$",
    r"^\W*bye\W*$",
    r"^\W*see\s+you\W*$",
    r"^\W*okay\W*$",
    r"^\W*продолжение\W*$",
    r"^\W*ну\W*$",
    r"^\W*да\W*$",
    r"^\W*так\W*$",
)


def one_pattern(patterns: tuple[str, ...], flags: str) -> str:
    """All patterns as one alternation, with classes that know every script."""
    wide = [p.replace(r"\W", r"[^\p{L}\p{N}_]").replace(r"\b", r"(?:[^\p{L}\p{N}_]|$)") for p in patterns]
    return f"({flags})(?:{'|'.join(wide)})"


SPARK_ALWAYS, SPARK_CONTEXTUAL = one_pattern(ALWAYS, "?iu"), one_pattern(CONTEXTUAL, "?iu")
SQL_ALWAYS, SQL_CONTEXTUAL = one_pattern(ALWAYS, "?i"), one_pattern(CONTEXTUAL, "?i")
