"""Tokenisers, the minimum term length and the snippet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TERM_LENGTH = 3
SNIPPET_KEEP = 75


def space_tokens(text: Column) -> Column:
    """Learning and per-document scoring: split on exactly one space.

    Repeated spaces leave empty tokens; they are shorter than any term and vanish later.
    """
    return F.split(text, " ")


def whitespace_tokens(
    text: Column, max_tokens: int | None = None, max_word: int | None = None
) -> Column:
    """Index side: runs of non-whitespace, case kept; the no-break spaces do not separate tokens.

    By default every token is kept whole. ``max_tokens`` keeps the first tokens of a field only,
    ``max_word`` cuts a longer run into pieces of that length, as the reference's limited mode does.
    """
    size = "+" if max_word is None else "{1,%d}" % max_word
    runs = F.regexp_extract_all(text, F.lit(r"\P{javaWhitespace}" + size), F.lit(0))
    return runs if max_tokens is None else F.slice(runs, 1, max_tokens)


def long_enough(term: Column, minimum: int = MIN_TERM_LENGTH) -> Column:
    """At least ``minimum`` UTF-16 units; a character outside the BMP (four bytes) counts as two."""
    utf16_units = F.octet_length(F.encode(term, "UTF-16BE")) / 2
    # The encoding is only looked at for terms whose character count leaves it open.
    return (F.length(term) >= minimum) | (
        (F.length(term) >= (minimum + 1) // 2)
        & (F.octet_length(term) >= 4)
        & (utf16_units >= minimum)
    )


def snippet(text: Column, keep: int = SNIPPET_KEEP) -> Column:
    """Texts of up to keep + 1 characters stay whole, longer ones end in '...'."""
    return F.when(
        F.length(text) > keep + 1, F.concat(F.substring(text, 1, keep), F.lit("..."))
    ).otherwise(text)

