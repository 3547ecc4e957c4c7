"""Operators over cells: rows (array, row, col, value) of many two-dimensional arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells_of(arrays: DataFrame, id_col: str, values: str, columns: int, *keep: str, column_major: bool = False, rows: int = 1) -> DataFrame:
    """One row a cell of an array column: ``array_id, pos, row, col, value`` and the kept columns."""
    out = arrays.select(F.col(id_col).alias("array_id"), *keep, F.posexplode(values).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))
    row, col = (F.col("pos") % rows, F.floor(F.col("pos") / rows)) if column_major else (F.floor(F.col("pos") / columns), F.col("pos") % columns)
    return out.select("array_id", *keep, "pos", row.cast("int").alias("row"), col.cast("int").alias("col"), "value")


def statistics(cells: DataFrame) -> DataFrame:
    """Least, greatest, mean, sample deviation and range of each array."""
    v = F.col("value")
    return cells.groupBy("array_id").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("deviation"), (F.max(v) - F.min(v)).alias("spread"))


def compare(left: DataFrame, right: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The cells of two versions side by side, with ``delta`` and ``changed``."""
    other = right.select("array_id", "row", "col", F.col("value").alias("other"))
    both = left.join(other, ["array_id", "row", "col"])
    return both.select("array_id", "row", "col", "value", "other", (F.col("other") - F.col("value")).alias("delta"), (F.abs(F.col("other") - F.col("value")) > tolerance).alias("changed"))


def change_summary(compared: DataFrame) -> DataFrame:
    """Per array: changed cells, least and greatest change, mean over changed and over all cells, greatest size."""
    d, c = F.col("delta"), F.col("changed")
    return compared.groupBy("array_id").agg(
        F.count_if(c).alias("changed"), F.count("*").alias("cells"), F.min(F.when(c, d)).alias("least"), F.max(F.when(c, d)).alias("most"), F.avg(F.when(c, d)).alias("mean_changed"), F.avg(F.abs(d)).alias("mean_all"), F.max(F.abs(d)).alias("largest")
    )


def shape(cells: DataFrame) -> DataFrame:
    """Share of equal neighbours, direction, and the last places of the greatest and least value, along each array's order."""
    order = Window.partitionBy("array_id").orderBy("pos")
    step = cells.withColumn("step", F.col("value") - F.lag("value").over(order))
    last = lambda rank: F.max_by("pos", F.struct(rank, "pos"))
    return step.groupBy("array_id").agg(
        F.coalesce(F.avg((F.col("step") == 0).cast("double")), F.lit(0.0)).alias("flat_share"),
        F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)).alias("rising"),
        F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True)).alias("falling"),
        last(F.col("value")).alias("peak"),
        last(-F.col("value")).alias("valley"),
        F.avg(F.abs("step")).alias("mean_step"),
        F.max(F.abs("step")).alias("cliff"),
    )


def anomalies(cells: DataFrame, sigmas: float = 3.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Per array: whether flat, cells beyond ``sigmas`` population deviations, cells at the raw limits."""
    whole = Window.partitionBy("array_id")
    v = F.col("value")
    marked = cells.withColumn("mean", F.avg("value").over(whole)).withColumn("sigma", F.stddev_pop("value").over(whole))
    at = F.lit(False) if low is None else (v <= low) | (v >= high)
    return marked.groupBy("array_id").agg((F.min(v) == F.max(v)).alias("flat"), F.count_if((F.col("sigma") > 0) & (F.abs(v - F.col("mean")) > sigmas * F.col("sigma"))).alias("outliers"), F.count_if(at).alias("at_limits"))


def histogram(cells: DataFrame, bins: int, of: str = "value") -> DataFrame:
    """Counts of equal-width bins between each array's least and greatest value; a flat array fills bin 0."""
    whole = Window.partitionBy("array_id")
    low, high = F.min(of).over(whole), F.max(of).over(whole)
    place = F.coalesce(F.try_divide((F.col(of) - F.col("low")) * bins, F.col("high") - F.col("low")), F.lit(0.0))
    binned = cells.where(F.col(of).isNotNull()).withColumn("low", low).withColumn("high", high).withColumn("bin", F.least(F.floor(place), F.lit(bins - 1)).cast("int"))
    return binned.groupBy("array_id", "bin").agg(F.count("*").alias("n"))


def smooth_line(cells: DataFrame, half: int) -> DataFrame:
    """Moving average of ``2 * half + 1`` values along each array, cut at the ends."""
    around = Window.partitionBy("array_id").orderBy("pos").rowsBetween(-half, half)
    return cells.select("array_id", "pos", F.avg("value").over(around).alias("smooth"))


def smooth_plane(cells: DataFrame, passes: int = 1) -> DataFrame:
    """3 x 3 smoothing with weight 2 for the centre, over the neighbours that exist.

    Each cell is sent to its nine places and summed there: no join.
    """
    now = cells.select("array_id", "row", "col", "value")
    for _ in range(passes):
        near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(2.0 if a == b == 0 else 1.0).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
        sent = now.select("array_id", "row", "col", "value", F.explode(near).alias("to"))
        sent = sent.select("array_id", (F.col("row") + F.col("to.a")).alias("row"), (F.col("col") + F.col("to.b")).alias("col"), (F.col("value") * F.col("to.w")).alias("part"), F.col("to.w").alias("w"), ((F.col("to.a") == 0) & (F.col("to.b") == 0)).alias("own"))
        now = sent.groupBy("array_id", "row", "col").agg((F.sum("part") / F.sum("w")).alias("value"), F.bool_or("own").alias("own")).where("own").drop("own")
    return now


def bilinear(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (array_id, y, x in cell units) with the surface's value between its four cells."""
    at = points.withColumn("r0", F.floor("y").cast("int")).withColumn("c0", F.floor("x").cast("int"))
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    wanted = at.select("*", F.explode(corners).alias("k"))
    fy, fx = F.col("y") - F.col("r0"), F.col("x") - F.col("c0")
    weight = F.when(F.col("k.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("k.b") == 1, fx).otherwise(1 - fx)
    wanted = wanted.select(*points.columns, (F.col("r0") + F.col("k.a")).alias("row"), (F.col("c0") + F.col("k.b")).alias("col"), weight.alias("w")).where("w > 0")
    return wanted.join(cells.select("array_id", "row", "col", "value"), ["array_id", "row", "col"]).groupBy(*points.columns).agg(F.sum(F.col("w") * F.col("value")).alias("surface"))


def fingerprint(cells: DataFrame, bins: int = 32, slopes: int = 64) -> DataFrame:
    """Per array: value histogram and histogram of differences, as arrays of fixed length."""
    order = Window.partitionBy("array_id").orderBy("pos")
    deltas = cells.withColumn("delta", F.col("value") - F.lag("value").over(order))

    def packed(counts: DataFrame, length: int, name: str) -> DataFrame:
        found = counts.groupBy("array_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
        return found.select("array_id", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)).cast("double")).alias(name))

    return packed(histogram(cells, bins), bins, "values").join(packed(histogram(deltas, slopes, "delta"), slopes, "slopes"), "array_id")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def similar_to(prints: DataFrame, wanted: Column, least: float, k: int) -> DataFrame:
    """The k arrays most like one array: 0.6 of the value and 0.4 of the slope histograms' cosine.

    Where the prints have ``cols``, ``rows`` and ``width``, another number of columns or rows
    leaves 0.7 of the score, another of both 0.4, another width 0.85 of that. The single
    wanted row is broadcast.
    """
    sized = [c for c in ("cols", "rows", "width") if c in prints.columns]
    one = F.broadcast(prints.where(wanted).select(F.col("array_id").alias("of"), F.col("values").alias("v0"), F.col("slopes").alias("s0"), *(F.col(c).alias(f"{c}0") for c in sized)).limit(1))
    score = 0.6 * cosine(F.col("values"), F.col("v0")) + 0.4 * cosine(F.col("slopes"), F.col("s0"))
    if "cols" in sized and "rows" in sized:
        same = (F.col("cols") == F.col("cols0")).cast("int") + (F.col("rows") == F.col("rows0")).cast("int")
        score = score * F.when(same == 2, 1.0).when(same == 1, 0.7).otherwise(0.4)
    if "width" in sized:
        score = score * F.when(F.col("width") == F.col("width0"), 1.0).otherwise(0.85)
    scored = prints.join(one, F.col("array_id") != F.col("of")).select("of", "array_id", F.least(score, F.lit(1.0)).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "array_id").limit(k)
