"""Tokens of names: what stands between ASCII punctuation and blanks. Bytes from 0x80 on separate nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: NUL, blanks and ASCII punctuation. Fixed values.
SEPARATORS = "\x00 \t\n\r-,.:'~`!@#$%^&*()_+={}[]|\\;\"<>/?"
SEPARATOR = "[" + "".join(f"\\x{ord(c):02x}" for c in SEPARATORS) + "]"
SEPARATOR_CLASS = SEPARATOR + "+"


def tokens(name: Column) -> Column:
    return F.filter(F.split(name, SEPARATOR_CLASS), lambda t: t != "")


def tokenized(name: Column) -> Column:
    return F.array_join(tokens(name), " ")


def same_chain(a: Column, b: Column) -> Column:
    """Whether two strings are equal but for separators."""
    return tokens(a) == tokens(b)


def is_head(a: Column, b: Column) -> Column:
    """Whether the tokens of a are the first tokens of b. An empty chain is the head of any."""
    n = F.size(tokens(a))
    return F.when(n == 0, F.lit(True)).otherwise(F.slice(tokens(b), F.lit(1), F.greatest(n, F.lit(1))) == tokens(a))


def head_end(a: Column, b: Column) -> Column:
    """How many characters of b the tokens of a take, separators before and between them included; null if a is not the head of b."""
    pieces = F.regexp_extract_all(b, F.lit(f"({SEPARATOR}*[^{SEPARATOR[1:-1]}]+)"), F.lit(1))
    length = F.aggregate(F.slice(pieces, F.lit(1), F.size(tokens(a))), F.lit(0), lambda n, p: n + F.length(p))
    return F.when(is_head(a, b), length)
