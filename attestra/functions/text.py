"""String expressions that run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white-space code points of normalisation v1, as a character class of a regular expression.
WHITE_SPACE = (
    "\\u0009-\\u000d\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)
#: Fixed value: a lexeme is a run of letters and digits, joined inside by single hyphens or apostrophes.
LEXEME = "[\\p{L}\\p{N}]+(?:['-][\\p{L}\\p{N}]+)*"


def strip(text: Column) -> Column:
    """Without white space (any of WHITE_SPACE) at both ends."""
    return F.regexp_replace(text, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def fold(text: Column) -> Column:
    """Letter case and white space at both ends ignored; null stays null."""
    return F.lower(strip(text))


def normalize(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"[{WHITE_SPACE}]+", " "), "^ | $", "")


def content_hash(text: Column) -> Column:
    """SHA-256 (hex) of the normalised text."""
    return F.sha2(F.encode(normalize(text), "UTF-8"), 256)


def casefold_normalize(text: Column) -> Column:
    """Comparison form of a text: normalised and lower case."""
    return F.lower(normalize(text))


def lexemes(text: Column) -> Column:
    """All lexemes of the lower-cased text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({LEXEME})"), 1)


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines first..last (1-based, inclusive), stripped, with a newline at the end; null beyond the last line."""
    lines = F.split(text, "\n")
    return F.when(
        (F.lit(first) >= 1) & (F.lit(last) >= first) & (F.size(lines) >= last),
        F.concat(strip(F.array_join(F.slice(lines, first, last - first + 1), "\n")), F.lit("\n")),
    )


def relative_path(path: Column) -> Column:
    """POSIX form of a relative path; null where it is empty, absolute or has an empty, ``.`` or ``..`` part."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.exists(F.split(posix, "/"), lambda part: part.isin("", ".", ".."))
    return F.when(~bad & ~posix.rlike("^[A-Za-z]:"), posix)
