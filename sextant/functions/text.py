"""Text as Columns: tokens, word n-grams, entities, word counts.  No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, tags and limits that results depend on.
TOKEN_PATTERN = r"[a-z0-9§][a-z0-9§.\-()]*"
QUOTE_CHARACTERS = '"“”'
GRAM_SEPARATOR = "_"
ENTITY_PATTERNS = {
    "usc": r"(?U)\d+\s+U\.S\.C\.\s*§+\s*[\dA-Za-z().\-]+",
    "reporter": (
        r"(?U)\d+\s+(?:U\.S\.|S\.\s?Ct\.|F\.(?:2d|3d)?|F\.\s?Supp\.(?:\s?2d)?|Stat\.|L\.\s?Ed\.(?:\s?2d)?|B\.R\.|A\.(?:2d)?|P\.(?:2d|3d)?"
        r"|N\.E\.(?:2d)?|N\.W\.(?:2d)?|S\.E\.(?:2d)?|S\.W\.(?:2d|3d)?|So\.(?:2d)?)\s+\d+"
    ),
    "section": r"(?U)§+\s*\d[\dA-Za-z().\-]*",
    "case": r"(?U)[A-Z][A-Za-z'’.\-]+\s+v\.\s+[A-Z][A-Za-z'’.\-]+",
}


def tokenize(text: Column) -> Column:
    """Lower-case tokens that keep identifiers together; dots at a token's end go."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(found, lambda t: F.rtrim(t, F.lit(".")))


def ngrams_of(tokens: Column, n: int) -> Column:
    """The word n-grams of one order, repeats kept.

    Pass a column of tokens, not the expression that makes them: it is used once per gram.
    """
    if n == 1:
        return tokens
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))  # would count down on short arrays
    grams = F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), GRAM_SEPARATOR))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, max_n: int) -> Column:
    """All orders from 1 to max_n, lower ones first."""
    return F.concat(*(ngrams_of(tokens, n) for n in range(1, max_n + 1)))


def gram_structs(tokens: Column, max_n: int) -> Column:
    """The same with each gram's order: array<struct<gram, n>>."""
    return F.concat(*(_tagged(ngrams_of(tokens, n), n) for n in range(1, max_n + 1)))


def _tagged(grams: Column, n: int) -> Column:
    return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(n).alias("n")))


def entities(text: Column) -> Column:
    """Distinct kind:identifier strings, lower case, white space single."""

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.lit(f"{kind}:"), F.regexp_replace(F.lower(F.regexp_replace(m, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")))

    return F.array_distinct(F.concat(*(of_kind(k, p) for k, p in ENTITY_PATTERNS.items())))


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def has_quote(text: Column) -> Column:
    """Whether a straight or curly double quote occurs."""
    return text.rlike(f"[{QUOTE_CHARACTERS}]")


def normalised(text: Column) -> Column:
    """Words re-joined by single spaces."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), F.lit(0)), " ")


def gram_hash(gram: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes."""
    return F.crc32(F.encode(gram, "UTF-8"))
