"""Tokens: runs of letters and digits, lower case, diacritics folded; one definition for texts and queries."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import QUERY_TOKENS

#: Which letters fold to which.
FOLD = {
    "a": "àáâãäåāăąæ",
    "e": "èéêëēĕėęě",
    "i": "ìíîïĩīĭį",
    "o": "òóôõöøōŏőœ",
    "u": "ùúûüũūŭůűų",
    "y": "ýÿŷ",
    "c": "çćĉċč",
    "n": "ñńņň",
    "s": "ß",
}
FROM = "".join(FOLD.values())
TO = "".join(k * len(v) for k, v in FOLD.items())


def spaced(text: str | Column) -> Column:
    """A text's tokens in a row, each between two blanks of its own, one more at either end; two blanks without tokens and for null. Cut before lower-casing,
    which may add marks. No branches, so that the text is cut once."""
    c = F.col(text) if isinstance(text, str) else text
    padded = F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    return F.translate(F.lower(F.regexp_replace(padded, r"[^\p{IsAlphabetic}\p{N}]+", "  ")), FROM, TO)


def token_count(row: Column) -> Column:
    """How many tokens a row made by spaced() has."""
    return ((F.length(row) - F.length(F.replace(row, F.lit(" "), F.lit("")))) / 2 - 1).cast("long")


def term_count(row: Column, term: str) -> Column:
    """How often a term stands in a row made by spaced()."""
    return ((F.length(row) - F.length(F.replace(row, F.lit(f" {term} "), F.lit("")))) / (len(term) + 2)).cast("long")


def tokens(text: str | Column) -> Column:
    return F.array_remove(F.split(F.trim(spaced(text)), "  "), "")


def words(text: str) -> list[str]:
    """A text's tokens before folding, cut as tokens() cuts."""
    return [w.lower() for w in regex.split(r"[^\p{Alphabetic}\p{N}]+", text) if w]


def query_terms(query: str) -> list[str]:
    """The first tokens of a query, repeats kept."""
    return [w.translate(str.maketrans(FROM, TO)) for w in words(query)[:QUERY_TOKENS]]


def match_expression(query: str) -> str | None:
    return " OR ".join(f'"{w}"' for w in words(query)[:QUERY_TOKENS]) or None


def parse_match(expression: str) -> list[str]:
    """The terms of a quoted disjunction; anything else is an error."""
    if not re.fullmatch(r'"[^"\s]+"( OR "[^"\s]+")*', expression):
        raise ValueError(f"not a match expression: {expression!r}")
    return [t.translate(str.maketrans(FROM, TO)) for t in re.findall(r'"([^"]+)"', expression)]
