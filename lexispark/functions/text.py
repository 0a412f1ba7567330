"""Choosing the text of a document, and byte-exact helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sources in the order in which they are tried.
SOURCES = ("clean_visible", "clean_html", "raw")


def best_content(source: str = "clean_visible", columns: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(text, name of its source): the configured source if it is not empty, else the first that is not. Both are
    null if all are. columns: which column holds a source; missing sources are skipped."""
    if source not in SOURCES:
        raise ValueError(f"unknown text source {source!r}; one of {', '.join(SOURCES)}")
    columns = columns or {s: s for s in SOURCES}
    order = [s for s in (source, *SOURCES) if s in columns]
    text = lambda s: F.col(columns[s])
    form = F.lit(None).cast("string")
    for s in reversed(order):
        form = F.when(text(s) != "", s).otherwise(form)
    return F.coalesce(*[F.nullif(text(s), F.lit("")) for s in order]), form


def bytes_between(text: Column, start: Column, end: Column) -> Column:
    """The part of a text between two UTF-8 offsets."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")
