"""Text normalization with offsets into the source.

`fold` works per code point: compatibility decomposition, code points of a combining class other than 0 are
dropped, simple lower case, runs of white space become one blank, leading white space goes. One trailing
blank may stay. Offsets are worked out only where a match needs them.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .worker import once

#: White space of Unicode as str.isspace knows it, and a class of it for regular expressions.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "]+"
BLANKS = re.compile("  +")
ASCII_FOLD = bytes(32 if chr(b).isspace() else ord(chr(b).lower()) for b in range(128)) + bytes(range(128, 256))


class Folding(dict):
    """What each code point becomes; filled as code points are met."""

    def __missing__(self, point: int) -> str:
        kept = (c for c in unicodedata.normalize("NFKD", chr(point)) if unicodedata.combining(c) == 0)
        out = "".join(" " if c.isspace() else lower if len(lower := c.lower()) == 1 else c for c in kept)
        self[point] = out
        return out


#: The plain variant: white space of ASCII and the full stop are blanks, A-Z are lowered. Fixed values.
PLAIN = {p: " " for p in map(ord, "\t\n\v\f\r .")} | {p: chr(p + 32) for p in range(65, 91)}


def folding() -> Folding:
    """One of each worker."""
    return once("folding", Folding)


def folded(text: str, how: str) -> str:
    """What the characters of a text become, before white space runs together."""
    if how == "ascii":
        return text.translate(PLAIN)
    return text.encode().translate(ASCII_FOLD).decode() if text.isascii() else text.translate(folding())


def fold(text: str, how: str = "unicode") -> str:
    """The normalized text. how: `unicode`, `ascii` (the plain variant) or `none`."""
    return text if how == "none" else BLANKS.sub(" ", folded(text, how)).lstrip(" ")


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def origins(text: str, how: str = "unicode") -> np.ndarray:
    """For each character of fold(text, how) the index of the source character it came from; then the source's length."""
    if how == "none":
        return np.arange(len(text) + 1)
    space = points(folded(text, how)) == 32
    at = np.arange(len(text))
    if len(space) != len(text) or how == "unicode" and not text.isascii():
        # How many characters each one becomes, looked up by code point; -1 if not known yet.
        counts, source = once("counts", lambda: np.full(0x110000, -1, np.int8)), points(text)
        for p in set(source[counts[source] < 0].tolist()):
            counts[p] = len(folding()[p])
        at = np.repeat(at, counts[source])
    before = np.concatenate(([True], space[:-1]))
    return np.append(at[~(space & before)], len(text))


def byte_offsets(text: str) -> np.ndarray:
    """The UTF-8 offset of each character and of the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    x = points(text)
    return np.concatenate(([0], np.cumsum(1 + (x > 0x7F) + (x > 0x7FF) + (x > 0xFFFF))))


def valid_prefix(raw: bytes | None) -> str | None:
    """The text up to the first byte sequence that is not UTF-8."""
    if raw is None:
        return None
    try:
        return bytes(raw).decode()
    except UnicodeDecodeError as e:
        return bytes(raw)[: e.start].decode()


@F.arrow_udf(StringType())
def normalized(texts):
    """fold as a column function."""
    import pyarrow as pa

    return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def decoded_prefix(raws):
    """valid_prefix as a column function."""
    import pyarrow as pa

    return pa.array([valid_prefix(x) for x in raws.to_pylist()], pa.string())


def normalized_ascii(text: Column) -> Column:
    """The plain variant without Unicode tables: white space of ASCII and the full stop collapse to one blank, A-Z are lowered."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.ltrim(F.regexp_replace(lowered, r"[\t-\r .]+", " "))


def normal_form(text: Column, how: str) -> Column:
    """fold(text, how) as a column."""
    return {"unicode": normalized, "ascii": normalized_ascii, "none": lambda c: c}[how](text)
