"""Text and time functions, all as expressions that stay in generated code.

``\\w`` of Spark's patterns knows ASCII only, so word characters are written out by Unicode class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
BLANK = r"[\s\p{Z}]+"
#: What a spreadsheet takes for the start of a formula.
FORMULA = r"^[=+\-@\t\r]"


def norm(text: Column) -> Column:
    """Lower case, everything but word characters as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), f"{NOT_WORD}+", " "))


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """The words of a text in one case."""
    return F.regexp_extract_all(casefold(text), F.lit(f"({WORD}+)"), 1)


def same_words(a: Column, b: Column) -> Column:
    return words(a) == words(b)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}|{BLANK}$", "")


def tokens(text: Column) -> Column:
    """Parts between white space of any script."""
    return F.filter(F.split(text, BLANK), lambda t: t != "")


def letter_runs(text: Column) -> Column:
    """Runs of letters, without digits and underscores."""
    return F.regexp_extract_all(text, F.lit(f"({LETTERS})"), 1)


def ratio(a: Column, b: Column) -> Column:
    """Likeness by edit distance against the longer text; 1 for equal ones, also two empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    t = F.greatest(ms, F.lit(0))
    whole = lambda x: F.floor(x).cast("long")
    return whole(t / 3_600_000), whole(t / 60_000) % 60, whole(t / 1000) % 60, t % 1000


def clock(ms: Column, millis: bool = False) -> Column:
    """``H:MM:SS`` or ``H:MM:SS.mmm`` of whole milliseconds; what is before 0 shows as 0, null stays null."""
    h, m, s, rest = _parts(ms)
    shown = F.format_string("%d:%02d:%02d.%03d", h, m, s, rest) if millis else F.format_string("%d:%02d:%02d", h, m, s)
    return F.when(ms.isNotNull(), shown)


def cue_time(ms: Column, mark: str = ",") -> Column:
    """``HH:MM:SS,mmm`` for subtitles, with ``.`` as the mark for the web's form; null stays null."""
    h, m, s, rest = _parts(ms)
    return F.when(ms.isNotNull(), F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, s, rest))


def inert(cell: Column) -> Column:
    """A cell that a spreadsheet shows and does not run."""
    return F.when(cell.rlike(FORMULA), F.concat(F.lit("'"), cell)).otherwise(cell)


def printable(text: Column) -> Column:
    """Without control characters but the tab."""
    return F.regexp_replace(text, r"[\p{C}&&[^\t]]", "")


def squeeze(text: Column) -> Column:
    """Separators and runs of white space as single spaces, trimmed, no control characters."""
    return F.trim(F.regexp_replace(printable(F.translate(text, ",|~", "   ")), BLANK, " "))


def note(text: Column, most: int = 120) -> Column:
    """One line of at most ``most`` characters, an ellipsis where it was cut."""
    line = F.trim(F.regexp_replace(printable(text), BLANK, " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def in_units(size: Column) -> Column:
    """Bytes in whole MiB, or in whole KiB below one MiB; what is left over is cut off."""
    mib, kib = F.floor(size / (1 << 20)).cast("long"), F.floor(size / (1 << 10)).cast("long")
    return F.when(mib >= 1, F.format_string("%d MiB", mib)).otherwise(F.format_string("%d KiB", kib))


def bar(level: Column, threshold: Column, width: int = 32) -> Column:
    """A meter whose middle is the threshold: filled by ``#``, the middle marked while it is not passed."""
    middle = width // 2
    filled = F.least(F.lit(width), F.floor(level / F.greatest(threshold, F.lit(1.0)) * middle).cast("int"))
    low = F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(middle) - filled), F.lit("|"), F.lit("-" * (width - middle - 1)))
    high = F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled))
    return F.when(filled <= middle, low).otherwise(high)


def as_int(text: Column, default: int = 0) -> Column:
    """A whole number from free text, cut towards 0; the default where there is none."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def as_float(text: Column, default: float | None = None) -> Column:
    number = text.try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return finite if default is None else F.coalesce(finite, F.lit(default))
