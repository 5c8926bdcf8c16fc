"""Text expressions: whitespace handling, word counts, cuts and content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace when stripping or splitting.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a pattern; the Unicode class is far faster than a list of ranges.
SPACE_RUN = r"(?U)[\s\x{1c}-\x{1f}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def words(text: Column) -> Column:
    """Whitespace-separated words; splitting an empty text gives no word."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def folded_words(text: Column) -> Column:
    return words(F.lower(text))


def alnum_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokens_by_words(text: Column) -> Column:
    """Token estimate of 1.3 per word, at least 1."""
    return F.greatest(F.lit(1), (F.size(words(text)) * F.lit(1.3)).cast("int"))


def tokens_by_chars(text: Column) -> Column:
    """Token estimate of one per four characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def tokens_as_words(text: Column) -> Column:
    """Word count, at least 1."""
    return F.greatest(F.lit(1), F.size(words(text)))


def filled(text: Column, default: str | None) -> Column:
    """Stripped text, or the default when nothing is left."""
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(default))


def cut(text: Column, limit: int = 120) -> Column:
    """First `limit` characters with an ellipsis when something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts joined by '||'; a missing part counts as empty."""
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit("||"))
        pieces.append(F.coalesce(part, F.lit("")))
    return F.sha2(F.concat(*pieces), 256)
