"""Settings of a matching job."""

from __future__ import annotations

from dataclasses import dataclass

from lexispark.functions.text import SOURCES


@dataclass(frozen=True)
class MatchConfig:
    """min_bytes and max_bytes bound a name's length in UTF-8 bytes after normalization. max_names counts names
    as read. duplicates: `first` keeps the first name (by bytes) of those that normalize alike and loses the others' targets, `union` keeps all
    targets. normalize: `unicode`, `ascii` or `none`. negate keeps the documents without a mention;
    emit_empties blanks those not kept instead of dropping them. max_items is the number of documents read.
    max_broadcast bounds the bytes of names and targets that go to every worker, where the automaton takes some 40 times the bytes of
    its names; larger dictionaries are joined."""

    names_path: str | None = None
    names_format: str = "json"
    text_source: str = "clean_visible"
    min_bytes: int = 5
    max_bytes: int = 1000
    max_names: int | None = None
    duplicates: str = "first"
    normalize: str = "unicode"
    negate: bool = False
    emit_empties: bool = False
    max_items: int | None = None
    annotator_id: str = "lexispark"
    max_broadcast: int = 8 << 20

    def __post_init__(self):
        for name, value, allowed in (("text_source", self.text_source, SOURCES), ("duplicates", self.duplicates, ("first", "union")), ("normalize", self.normalize, ("unicode", "ascii", "none")), ("names_format", self.names_format, ("json", "json_inverse", "lines", "thrift", "csr", "parquet"))):
            if value not in allowed:
                raise ValueError(f"{name} {value!r} is not one of {', '.join(allowed)}")
        if not 0 < self.min_bytes <= self.max_bytes:
            raise ValueError("0 < min_bytes <= max_bytes must hold")
        if any(n is not None and n < 0 for n in (self.max_names, self.max_items)):
            raise ValueError("limits can't be negative")
