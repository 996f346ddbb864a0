"""Structural evidence of grid cells, computed from occupancy maps: continuity along rows, and fragmentation.

Pixels are rows (keys..., y, x, value); pictures have their size in ``shapes`` (keys..., height, width). Pixels that are not given count as 0; those outside of the picture do not exist.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.operators.field import gap_along_row
from gleanspark.session import dealt, materialize

#: Probes of a cell, about, and the pixels and probes that one task holds.
PROBES, ROWS_PER_TASK = 16, 500_000


def cell_bounds(shapes: DataFrame, keys: list[str], rows: int = 8, cols: int = 8) -> DataFrame:
    """keys..., height, width, row, col, y0, y1, x0, x1 of every cell of every picture."""
    cells = shapes.select(*keys, "height", "width", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    bound = lambda i, size, n: F.floor(i * F.col(size) / n).cast("int")
    ends = {"y0": bound(F.col("row"), "height", rows), "y1": bound(F.col("row") + 1, "height", rows), "x0": bound(F.col("col"), "width", cols), "x1": bound(F.col("col") + 1, "width", cols)}
    return cells.withColumns(ends)


def continuity(pixels: DataFrame, angles: DataFrame, keys: list[str], shapes: DataFrame, value: str = "value", rows: int = 8, cols: int = 8) -> DataFrame:
    """keys..., row, col, angle, continuity of the cells whose picture has a row in angles(keys..., angle: of the rows, in degrees).

    Along the rows' direction every cell probes the pixels before and behind its middle (1/16 of the longest side either way, coordinates cut toward zero); probes meet pixels by an equi-join, and a
    cell's few samples are looked through for a gap between two occupied runs.
    """
    pixels = materialize(pixels.select(*keys, "y", "x", F.col(value).cast("double").alias("_v")), "occupancy")
    angles = materialize(angles, "angles")
    size = pixels.count() + angles.count() * rows * cols * PROBES
    cells = cell_bounds(shapes, keys, rows, cols).join(angles, keys).where(F.col("angle").isNotNull())
    reach = F.floor(F.greatest("height", "width") / 16).cast("int")
    probes = cells.select(*keys, "height", "width", "row", "col", "angle", "x0", "x1", "y0", "y1", F.explode(F.sequence(-reach, reach)).alias("i"))
    along = lambda lo, hi, turn: ((F.col(lo) + F.col(hi)) / 2.0 + F.col("i") * turn(F.radians("angle"))).cast("int")
    probes = probes.select(*keys, "height", "width", "row", "col", "angle", "i", along("x0", "x1", F.cos).alias("x"), along("y0", "y1", F.sin).alias("y"))
    place = [*keys, "y", "x"]
    met = dealt(probes, size, ROWS_PER_TASK, *place).join(dealt(pixels, size, ROWS_PER_TASK, *place), place, "left")
    inside = (F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height"))
    sample = F.struct("i", F.when(inside, F.coalesce("_v", F.lit(0.0))).alias("v"))
    samples = dealt(met.select(*keys, "row", "col", "angle", sample.alias("_s")), size, ROWS_PER_TASK, *keys, "row", "col")
    profiles = samples.groupBy(*keys, "row", "col", "angle").agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["v"]).alias("_profile"))

    @F.pandas_udf("double")
    def score(lists: pd.Series) -> pd.Series:
        return pd.Series([gap_along_row(np.array(p, dtype=float))[0] for p in lists])

    return profiles.select(*keys, "row", "col", "angle", score("_profile").alias("continuity"))


def fragmentation(pixels: DataFrame, keys: list[str], shapes: DataFrame, value: str = "value", in_field: str = "in_field", size: int = 15) -> DataFrame:
    """keys..., y, x, in_field, fragments: how far a pixel lies below the mean of its box, times clip(20 variance); 0 outside the field.

    Boxes are sums over lines, then over columns; at the picture's edge they are mirrored at the edge's pixels. A task holds a line or a column, not a picture.
    """
    r = size // 2
    lines = shapes.select(*keys, "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    grid = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    known = pixels.select(*keys, "y", "x", F.when(F.col(in_field), F.col(value).cast("double")).alias("v"), F.col(in_field).alias("in_field"))
    full = grid.join(known, [*keys, "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))).withColumn("in_field", F.coalesce("in_field", F.lit(False)))

    def boxed(df: DataFrame, along: str, across: str, side: str, sums: list[str]) -> DataFrame:
        """df with the sums over the r places on either side."""
        at, last = F.col(along), F.col(side) - 1
        copies = F.array_compact(F.array(at, F.when((at >= 1) & (at <= r), -at), F.when((at < last) & (at >= last - r), 2 * last - at)))
        spread = df.withColumn("_at", F.explode(copies))
        frame = Window.partitionBy(*keys, across).orderBy("_at").rowsBetween(-r, r)
        return spread.withColumns({c: F.sum(c).over(frame) for c in sums}).where((F.col("_at") >= 0) & (F.col("_at") <= last) & (F.col("_at") == at)).drop("_at")

    sums = full.withColumn("s", F.col("v")).withColumn("q", F.col("v") * F.col("v"))
    sums = boxed(boxed(sums, "x", "y", "width", ["s", "q"]), "y", "x", "height", ["s", "q"])
    mean = F.col("s") / (size * size)
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    variance = F.greatest(F.col("q") / (size * size) - mean * mean, F.lit(0.0))
    fragments = F.when(F.col("in_field"), unit(mean - F.col("v")) * unit(20 * variance)).otherwise(0.0)
    return sums.select(*keys, "height", "width", "y", "x", "in_field", fragments.alias("fragments"))


def cell_fragments(found: DataFrame, keys: list[str], rows: int = 8, cols: int = 8) -> DataFrame:
    """keys..., row, col, fragments: the mean over a cell's field pixels (0 without)."""
    row = F.least(F.floor(((F.col("y") + 1) * rows - 1) / F.col("height")), F.lit(rows - 1)).cast("int")
    col = F.least(F.floor(((F.col("x") + 1) * cols - 1) / F.col("width")), F.lit(cols - 1)).cast("int")
    mean = F.coalesce(F.avg(F.when(F.col("in_field"), F.col("fragments"))), F.lit(0.0))
    return found.groupBy(*keys, row.alias("row"), col.alias("col")).agg(mean.alias("fragments"))
