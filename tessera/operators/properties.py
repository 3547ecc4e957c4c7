"""Properties of projects by number or name, and the registry of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def property_of(fields: dict[int | str, Column], wanted: Column) -> Column:
    """The text of the field that ``wanted`` names; null for an unknown one."""
    out = F.lit(None).cast("string")
    for key, column in fields.items():
        out = F.when(wanted == F.lit(key), column.cast("string")).otherwise(out)
    return out


def set_properties(frame: DataFrame, id_col: str, changes: DataFrame, fields: dict[int | str, str], read_only: tuple[int | str, ...] = ()) -> DataFrame:
    """``frame`` with ``changes`` (id, property, value, seq) in its columns, cast to their types; the last of a property holds.

    ``fields`` names each property's column. Unknown and read-only properties, and values
    that the column's type can't hold, change nothing; a null value clears the column.
    """
    kinds = dict(frame.dtypes)
    writable = {k: c for k, c in fields.items() if k not in read_only}
    last = changes.groupBy("id").agg(*(F.max_by(F.struct("value"), F.when(F.col("property") == F.lit(k), F.col("seq"))).alias(f"__set_{n}") for n, k in enumerate(writable)))
    joined = frame.join(last, F.col(id_col) == F.col("id"), "left")
    new = {}
    for n, column in enumerate(writable.values()):
        value = F.col(f"__set_{n}.value")
        cast = value.try_cast(kinds[column])
        new[column] = F.when(F.col(f"__set_{n}").isNull() | (value.isNotNull() & cast.isNull()), F.col(column)).otherwise(cast)
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in frame.columns))


def upsert_projects(known: DataFrame, opened: DataFrame) -> DataFrame:
    """The registry (path, name, opened) with newly opened projects in place of their paths' rows, the newest first; ties by path. Null paths are left out."""
    both = known.select("path", "name", "opened").unionByName(opened.select("path", "name", "opened")).where("path is not null")
    return both.groupBy("path").agg(F.max_by(F.struct("name", "opened"), F.struct("opened", "name")).alias("r")).select("path", "r.name", "r.opened").orderBy(F.desc("opened"), "path")
