"""Catalog tables with columns of uncertain names, and their upkeep source by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_catalog(frame: DataFrame, wanted: dict[str, list[str]], needed: tuple[str, ...]) -> bool:
    """Whether each needed name has one of its columns; case doesn't matter."""
    there = {c.lower() for c in frame.columns}
    return all(any(c.lower() in there for c in wanted[name]) for name in needed)


def project(frame: DataFrame, wanted: dict[str, list[str]], first: int | None = None, last: int | None = None, key: str | None = None) -> DataFrame:
    """The wanted names from the first of their columns that exists, null where none does; only those columns are read.

    With ``key``, one of the names, only the rows from ``first`` to ``last`` (both included, open where None), as a filter that reaches the scan.
    """
    there = {c.lower(): c for c in reversed(frame.columns)}
    columns = {name: next((there[c.lower()] for c in names if c.lower() in there), None) for name, names in wanted.items()}
    rows = frame
    if key is not None and columns[key] is not None:
        if first is not None:
            rows = rows.where(F.col(f"`{columns[key]}`") >= first)
        if last is not None:
            rows = rows.where(F.col(f"`{columns[key]}`") <= last)
    return rows.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in columns.items()))


def to_read(known: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed sources (source, mtime, size) that are new or have another time or size than the known ones; a null counts as another."""
    return listed.join(known.select("source", "mtime", "size"), ["source", "mtime", "size"], "left_anti")


def synchronised(entries: DataFrame, known: DataFrame, listed: DataFrame, read: DataFrame) -> DataFrame:
    """``entries`` (source and further columns) with those of ``read`` in place of all of their sources' that have changed.

    ``listed`` says in ``readable`` whether a source could be read: one that couldn't keeps
    its old entries, as do unchanged sources and those no longer listed.
    """
    replaced = to_read(known, listed.where("readable")).select("source").distinct()
    kept = entries.join(replaced, "source", "left_anti")
    return kept.unionByName(read.join(replaced, "source", "left_semi").select(entries.columns))
