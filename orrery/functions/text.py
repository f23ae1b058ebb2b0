"""Text functions as column expressions: words, counts, white space, lines, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word rules and the line ends of universal newlines plus the other line separators
F1_PATTERN = r"[a-z]+(?:'[a-z]+)*"
F2_PATTERN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANKS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SIZE_UNITS = {"B": 1, "KIB": 1 << 10, "MIB": 1 << 20, "GIB": 1 << 30}


def f1_words(text: Column) -> Column:
    """Lower-case ASCII words with inner apostrophes, the typographic one included; null for null."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit(F1_PATTERN), F.lit(0))


def f1_count(text: Column) -> Column:
    return F.size(f1_words(text)).cast("bigint")


def f2_count(text: Column) -> Column:
    """Words of letters and digits of any script, case kept."""
    return F.regexp_count(text, F.lit(F2_PATTERN)).cast("bigint")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def collapse_blanks(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def flatten_breaks(text: Column) -> Column:
    """Carriage return, line feed and tab as one space each; nothing is collapsed."""
    return F.translate(text, "\r\n\t", "   ")


def lines(text: Column) -> Column:
    """The lines of a text, at every line separator; the piece after a last separator is not a line."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def blank_tokens(text: Column) -> Column:
    """Tokens between white space."""
    bare = collapse_blanks(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def parse_size(size: Column) -> Column:
    """Bytes of '128', '2MiB', '3 GiB' style sizes (B, KiB, MiB, GiB in any case); anything else raises."""
    size = F.trim(size)
    number, unit = F.regexp_extract(size, r"(?i)^(\d+)(?:b|kib|mib|gib)?$", 1), F.upper(F.regexp_extract(size, r"(?i)^\d+(b|kib|mib|gib)?$", 1))
    factor = F.lit(1)
    for u, n in SIZE_UNITS.items():
        factor = F.when(unit == u, n).otherwise(factor)
    return F.when(number == "", F.raise_error(F.concat(F.lit("invalid size: "), F.coalesce(size, F.lit("null"))))).otherwise(number.cast("bigint") * factor)


def excerpt(tokens: Column, n: int = 14) -> Column:
    """The first n tokens, with an ellipsis if there are more."""
    return F.concat(F.array_join(F.slice(tokens, 1, n), " "), F.when(F.size(tokens) > n, " ...").otherwise(""))
