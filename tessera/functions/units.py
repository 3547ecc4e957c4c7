"""Units of log channels: normal form and scale; cylinder numbers of channel names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit in normal form, scale, the ways to write it (in lower case)
UNITS = [
    ("°", 1.0, ("°", "°kw", "° kw", "°crk", "grad", "grad kw", "°ckr", "° crk")),
    ("°C", 1.0, ("°c", "° c", "degc", "deg c", "grad c")),
    ("bar", 1.0, ("bar",)),
    ("bar", 10.0, ("mpa",)),
    ("bar", 0.001, ("hpa", "mbar")),
    ("bar", 0.01, ("kpa",)),
    ("bar", 0.0689476, ("psi",)),
    ("kg/h", 1.0, ("kg/h",)),
    ("mg/cyc", 1.0, ("mg/hub", "mg/stroke")),
    ("%", 1.0, ("%", "% dk", "°dk")),
    ("rpm", 1.0, ("1/min", "rpm")),
    ("ms", 1.0, ("ms",)),
    ("µs", 1.0, ("us",)),
    ("V", 1.0, ("v",)),
    ("V*ms", 1.0, ("v*ms",)),
    ("km/h", 1.0, ("km/h",)),
    ("Nm", 1.0, ("nm",)),
    ("g", 1.0, ("g",)),
    ("", 1.0, ("0/1", "-", "-0", "lambda", "")),
]

# fixed values: endings that hold a cylinder number, and what to add to it
CYLINDERS = [(r"(?i)\s*Array\s*\[([0-9]+)\]\s*$", 1), (r"\[([0-9]+)\]\s*$", 1), (r"(?i)\s+Cylinder\s+([0-9]+)\s*$", 0), (r"(?i)(?:Zyl|Cylin|Cyl)([0-9]+)\s*$", 0)]


def normal_unit(unit: Column) -> Column:
    """``unit, scale``; case and repeated blanks don't count; an unknown unit stays, with scale 1; null stays null."""
    plain = F.replace(F.lower(F.trim(F.regexp_replace(unit, r"\s+", " "))), F.lit("µ"), F.lit("u"))
    out = F.struct(unit.alias("unit"), F.lit(1.0).alias("scale"))
    for normal, scale, spellings in UNITS:
        out = F.when(plain.isin(*spellings), F.struct(F.lit(normal).alias("unit"), F.lit(scale).alias("scale"))).otherwise(out)
    return out


def cylinder(name: Column) -> Column:
    """``channel, cylinder`` of names that end in a cylinder number, counted from 1; else the name and null.

    The first ending that fits counts; a number in brackets counts from 0.
    """
    out = F.struct(name.alias("channel"), F.lit(None).cast("int").alias("cylinder"))
    for pattern, shift in reversed(CYLINDERS):
        number = F.regexp_extract(name, pattern, 1)
        out = F.when(number != "", F.struct(F.trim(F.regexp_replace(name, pattern, "")).alias("channel"), (number.try_cast("int") + shift).alias("cylinder"))).otherwise(out)
    return out
