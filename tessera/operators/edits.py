"""Edits of cells (array_id, pos, raw): every mode writes what a cell of ``width`` bytes can hold.

A mode works on physical values, a * raw + b; results are turned back, rounded half away
from zero and clamped. A result that is null or not finite leaves its cell as it was, and
so does a cell that ``where`` doesn't choose (a null condition chooses nothing). Empty
frames give empty frames; repeated cells are edited alike; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec

#: Modes of one cell, by name: its physical value and the mode's argument.
MODES = {
    "set": lambda v, x: F.lit(0.0) * v + x,
    "add": lambda v, x: v + x,
    "scale": lambda v, x: v * x,
    "percent": lambda v, x: v * (1.0 + x / 100.0),
    "zero": lambda v, x: F.lit(0.0) * v,
    "least": lambda v, x: F.greatest(v, x),
    "most": lambda v, x: F.least(v, x),
}


def _physical(scaling: tuple[float, float]) -> Column:
    return codec.linear(F.col("raw").cast("double"), *scaling)


def write(cells: DataFrame, value: Column, where: Column | None = None, *, width: int = 2, signed: bool = True, scaling: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """``cells`` with the chosen cells' ``raw`` replaced by what stores the physical ``value``."""
    new = codec.encode(codec.linear_inverse(value, *scaling), width, signed)["value"]
    chosen = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return cells.withColumn("raw", F.when(chosen, F.coalesce(new, F.col("raw"))).otherwise(F.col("raw")))


def edit(cells: DataFrame, mode: str, argument: Column | float = 0.0, where: Column | None = None, **format) -> DataFrame:
    """One of ``MODES`` on the chosen cells."""
    x = argument if isinstance(argument, Column) else F.lit(float(argument))
    return write(cells, MODES[mode](_physical(format.get("scaling", (1.0, 0.0))), x), where, **format)


def round_limit(cells: DataFrame, multiple: int, low: float, high: float, where: Column | None = None, **format) -> DataFrame:
    """Values rounded to a multiple (none for 0) and kept between two limits."""
    v = _physical(format.get("scaling", (1.0, 0.0)))
    rounded = F.round(v / multiple) * multiple if multiple > 0 else v
    return write(cells, F.least(F.greatest(rounded, F.lit(float(low))), F.lit(float(high))), where, **format)


def flatten(cells: DataFrame, where: Column | None = None, **format) -> DataFrame:
    """The mean of an array's chosen cells in each of them."""
    chosen = F.lit(True) if where is None else where
    mean = F.avg(F.when(chosen, _physical(format.get("scaling", (1.0, 0.0))))).over(Window.partitionBy("array_id"))
    return write(cells, mean, where, **format)


def line(cells: DataFrame, where: Column | None = None, **format) -> DataFrame:
    """An even line from the first to the last chosen cell of an array; one cell alone stays."""
    chosen = F.lit(True) if where is None else where
    whole = Window.partitionBy("array_id")
    at = F.when(chosen, F.struct("pos", _physical(format.get("scaling", (1.0, 0.0))).alias("v")))
    first, last = F.min(at).over(whole)["v"], F.max(at).over(whole)["v"]
    count = F.count(F.when(chosen, 1)).over(whole)
    place = F.count(F.when(chosen, 1)).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return write(cells, F.when(count > 1, first + F.try_divide(place.cast("double"), count - 1) * (last - first)), where, **format)


def corners(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int], **format) -> DataFrame:
    """A block of (row, col) filled between its four corner cells, bilinearly; needs ``row`` and ``col``."""
    v, whole = _physical(format.get("scaling", (1.0, 0.0))), Window.partitionBy("array_id")
    corner = lambda r, c: F.max(F.when((F.col("row") == r) & (F.col("col") == c), v)).over(whole)
    y = (F.col("row") - rows[0]) / float(max(1, rows[1] - rows[0]))
    x = (F.col("col") - cols[0]) / float(max(1, cols[1] - cols[0]))
    top = corner(rows[0], cols[0]) * (1 - x) + corner(rows[0], cols[1]) * x
    bottom = corner(rows[1], cols[0]) * (1 - x) + corner(rows[1], cols[1]) * x
    return write(cells, top * (1 - y) + bottom * y, F.col("row").between(*rows) & F.col("col").between(*cols), **format)


def replace_values(cells: DataFrame, values: DataFrame, **format) -> DataFrame:
    """Cells set to ``values`` (array_id, pos, value) where these have one; of repeated places the greatest value holds."""
    new = values.groupBy("array_id", "pos").agg(F.max("value").cast("double").alias("__value"))
    return write(cells.join(new, ["array_id", "pos"], "left"), F.col("__value"), F.col("__value").isNotNull(), **format).drop("__value")


def restore(cells: DataFrame, original: DataFrame, where: Column | None = None) -> DataFrame:
    """The chosen cells as they are in ``original``; cells that it hasn't got stay."""
    before = original.select("array_id", "pos", F.col("raw").alias("__before"))
    chosen = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return cells.join(before, ["array_id", "pos"], "left").withColumn("raw", F.when(chosen, F.coalesce("__before", "raw")).otherwise(F.col("raw"))).drop("__before")


def copy(cells: DataFrame, pairs: DataFrame, **format) -> DataFrame:
    """Each ``target`` array of ``pairs`` (source, target) takes its source's physical values place by place."""
    source = cells.select(F.col("array_id").alias("source"), "pos", _physical(format.get("scaling", (1.0, 0.0))).alias("value"))
    return replace_values(cells, pairs.join(source, "source").select(F.col("target").alias("array_id"), "pos", "value"), **format)


def batch(cells: DataFrame, steps: DataFrame, **format) -> DataFrame:
    """All of ``steps`` (array_id, mode, argument; one an array), or none if any names an unknown array or mode or has no finite argument."""
    known = cells.select("array_id").distinct().withColumn("__known", F.lit(True))
    x = F.col("argument").cast("double")
    bad = F.col("__known").isNull() | ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)) | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    refused = steps.join(known, "array_id", "left").agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("refused")).scalar()
    chosen = steps.where(~refused).select("array_id", F.col("mode").alias("__mode"), x.alias("__x"))
    v = _physical(format.get("scaling", (1.0, 0.0)))
    value = F.coalesce(*(F.when(F.col("__mode") == name, mode(v, F.col("__x"))) for name, mode in MODES.items()))
    return write(cells.join(chosen, "array_id", "left"), value, F.col("__mode").isNotNull(), **format).drop("__mode", "__x")


def write_bytes(data: DataFrame, patch: DataFrame) -> DataFrame:
    """Rows (image_id, address, byte) with those of ``patch``, of the same columns, in their place; addresses outside an image are left out."""
    new = patch.groupBy("image_id", "address").agg(F.max("byte").alias("__byte"))
    return data.join(new, ["image_id", "address"], "left").select("image_id", "address", F.coalesce("__byte", "byte").alias("byte"))


#: How an image takes over the changes from an original to a version of another one.
IMPORTS = ("absolute", "relative", "percent", "all original", "all version")
SIGNATURE, SCANNED = 32, 4096


def import_changes(images: DataFrame, mode: str) -> DataFrame:
    """``images`` (image_id, current, original, version: binary) with ``changed``: current after the import, null where sizes forbid it.

    A longer image is aligned where its first ``SCANNED`` bytes hold the original's first
    ``SIGNATURE`` bytes, else at 0. Bytes that the version hasn't changed stay, but for the
    last two modes. Relative sums are modulo 256; percentages are cut to whole numbers.
    """
    text = lambda c, a, n: F.decode(F.substring(c, a, n), "ISO-8859-1")
    longer = (F.length("current") > F.length("original")) & (F.length("original") >= SIGNATURE)
    room = F.length("current") - F.length("original")
    place = F.instr(text("current", 1, SCANNED + SIGNATURE), text("original", 1, SIGNATURE)) - 1
    at = F.when(longer & place.between(0, F.least(F.lit(SCANNED), room)), place).otherwise(0)
    fits = (F.length("version") == F.length("original")) & (F.length("original") > 0) & (F.length("current") >= F.length("version"))
    byte = lambda c, k: F.conv(F.hex(F.substring(c, k + 1, F.lit(1))), 16, 10).cast("int")
    v, o = byte(F.col("version"), F.col("k")), byte(F.col("original"), F.col("k"))
    now = byte(F.col("current"), F.col("k") + F.col("at"))
    new = {"absolute": v, "relative": F.pmod(now + v - o, F.lit(256)), "percent": F.floor(now * (v / F.greatest(o, F.lit(1)).cast("double"))).cast("int") % 256, "all original": o, "all version": v}[mode]
    each = images.where(fits).withColumn("at", at).select("*", F.explode(F.sequence(F.lit(0), F.length("version") - 1)).alias("k"))
    written = F.when((v != o) | F.lit(mode.startswith("all")), new).otherwise(now)
    part = each.select("image_id", "at", "k", F.lpad(F.hex(written), 2, "0").alias("h")).groupBy("image_id").agg(F.first("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), "").alias("h"))
    size = F.length("h") / 2
    joined = F.concat(F.substring("current", F.lit(1), F.col("at")), F.unhex("h"), F.substring("current", (F.col("at") + size + 1).cast("int"), F.length("current")))
    return images.join(part, "image_id", "left").select(*images.columns, F.when(F.col("h").isNotNull(), joined).alias("changed"))


#: Edits that can be undone, and named snapshots that are kept.
MOST_UNDO = 200


def live_edits(log: DataFrame) -> DataFrame:
    """The edits in force of logs (image_id, seq, action: edit, undo or redo; further columns): rows of ``log``.

    An undo takes back the last edit in force of the last ``MOST_UNDO``, a redo brings
    back what was last undone unless an edit came between; others do nothing. Only the
    actions of one image's history are gathered, never their data.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "action")))
    start = F.struct(F.array().cast("array<long>").alias("done"), F.array().cast("array<long>").alias("undone"), F.lit(0).alias("held"))

    def step(s, x):
        most = F.lit(MOST_UNDO)
        edited = F.struct(F.concat(s["done"], F.array(x["seq"].cast("long"))).alias("done"), F.array().cast("array<long>").alias("undone"), F.least(s["held"] + 1, most).alias("held"))
        undone = F.struct(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1).alias("done"), F.concat(s["undone"], F.slice(s["done"], -1, 1)).alias("undone"), (s["held"] - 1).alias("held"))
        redone = F.struct(F.concat(s["done"], F.slice(s["undone"], -1, 1)).alias("done"), F.slice(s["undone"], F.lit(1), F.size(s["undone"]) - 1).alias("undone"), (s["held"] + 1).alias("held"))
        return F.when(x["action"] == "edit", edited).when((x["action"] == "undo") & (s["held"] > 0), undone).when((x["action"] == "redo") & (F.size(s["undone"]) > 0), redone).otherwise(s)

    live = log.groupBy("image_id").agg(F.aggregate(steps, start, step)["done"].alias("done")).select("image_id", F.explode("done").alias("seq"))
    return log.join(live, ["image_id", "seq"], "left_semi")


def state(edits: DataFrame, till: Column | None = None) -> DataFrame:
    """What each offset holds after edits (image_id, seq, off, after) up to ``till``: the last write."""
    chosen = edits if till is None else edits.where(F.col("seq") <= till)
    return chosen.groupBy("image_id", "off").agg(F.max_by("after", "seq").alias("after"))


def between_states(edits: DataFrame, first: int, second: int) -> DataFrame:
    """Offsets that differ between two savepoints of edits (image_id, seq, off, before, after): ``before, after``."""
    old = edits.where(F.col("seq") <= first).groupBy("image_id", "off").agg(F.max_by("after", "seq").alias("a"))
    origin = edits.groupBy("image_id", "off").agg(F.min_by("before", "seq").alias("o"), F.max_by("after", F.when(F.col("seq") <= second, F.col("seq"))).alias("b"))
    both = origin.join(old, ["image_id", "off"], "left").select("image_id", "off", F.coalesce("a", "o").alias("before"), F.coalesce("b", "o").alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
