"""Crop rows of masks: votes for lines, their peaks, segments on them, rows, per picture or per unit.

Every pixel votes for the lines through it, one per whole degree of the normal, at whole distances; a task counts sectors of angles of some pictures, so a picture's votes are
never gathered, and tasks grow in number with the pixels. Peaks are votes that no stronger one nearby overrules; nearby is an equi-join on coarse buckets. Each pixel counts for its strongest peak; along a peak's line,
pixels more than a gap apart are different segments. Segments near the dominant angle merge into rows by their distance from each other.

Sines are whole millionths, so that distances are whole-number arithmetic, the same in every engine.

Defined cases: a picture without lines has no rows here; keys (picture, or picture and unit) may be several columns; pixels given twice count once; null keys form no group;
ties go to the smaller angle, then the smaller distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.operators.grid import cell_of
from gleanspark.operators.tracks import circular_median, islands
from gleanspark.session import dealt, materialize

MILLION = 1_000_000
#: Votes, length and gap of a segment, tolerances in angle and position, support of a row, longest side looked at, in pixels or degrees.
VOTES, LENGTH, GAP, ANGLE, POSITION, SUPPORT, SIDE = 30, 20, 10, 12.0, 15.0, 60.0, 800
#: Peaks this near to a stronger one, in degrees and pixels, are overruled.
NEAR_ANGLE, NEAR_RHO = 5, 8
#: Degrees that one task counts together, and the votes it counts.
SECTOR, VOTES_PER_TASK = 15, 2_000_000


def trig(angle: Column) -> tuple[Column, Column]:
    """Cosine and sine of whole degrees, in whole millionths."""
    whole = lambda c: F.floor(c * MILLION + 0.5).cast("long")
    return whole(F.cos(F.radians(angle))), whole(F.sin(F.radians(angle)))


def distance(x: Column, y: Column, cos: Column, sin: Column) -> Column:
    return F.floor((x * cos + y * sin + MILLION // 2) / MILLION).cast("long")


def scaled(pixels: DataFrame, keys: list[str], shapes: DataFrame, side: int = SIDE) -> DataFrame:
    """Pixels of pictures over ``side`` on their longest side, at the smaller size (the nearest pixel's value), with ``scale``; others as they are."""
    longest = F.greatest("height", "width")
    scale = F.when(longest > side, F.lit(float(side)) / longest).otherwise(F.lit(1.0))
    size = lambda c: F.greatest(F.bround(F.col(c) * F.col("scale")), F.lit(1)).cast("int")
    sized = shapes.withColumn("scale", scale).withColumn("h", size("height")).withColumn("w", size("width"))
    joined = pixels.join(sized, keys)

    def targets(at: str, old: str, new: str) -> Column:
        """The places of the small picture whose nearest pixel this is: those t with floor(t * old / new) = at."""
        first = F.ceil(F.col(at) * F.col(new) / F.col(old))
        behind = F.ceil((F.col(at) + 1) * F.col(new) / F.col(old))
        return F.when(first < behind, F.sequence(first, behind - 1)).otherwise(F.array().cast("array<bigint>"))

    small = joined.select(*keys, "scale", "x", "y", "width", "w", F.explode(targets("y", "height", "h")).alias("ny"))
    small = small.select(*keys, "scale", "ny", F.explode(targets("x", "width", "w")).alias("nx"))
    return small.select(*keys, "scale", F.col("ny").cast("int").alias("y"), F.col("nx").cast("int").alias("x")).distinct()


def votes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., angle (of the normal, 0 to 179), rho, n."""
    pixels = materialize(pixels.select(*keys, "x", "y"), "pixels")
    sectors = pixels.select(*keys, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(180 // SECTOR - 1))).alias("sector"))
    sectors = dealt(sectors, pixels.count() * 180, VOTES_PER_TASK, *keys, "sector")
    each = sectors.select(*keys, "sector", "x", "y", F.explode(F.sequence(F.col("sector") * SECTOR, F.col("sector") * SECTOR + SECTOR - 1)).alias("angle"))
    counted = each.select(*keys, "sector", "angle", distance(F.col("x"), F.col("y"), *trig(F.col("angle"))).alias("rho")).groupBy(*keys, "sector", "angle", "rho").agg(F.count("*").alias("n"))
    return counted.drop("sector")


def peaks(counted: DataFrame, keys: list[str], least: int = VOTES) -> DataFrame:
    """The votes (keys..., angle, rho, n) that no stronger one overrules. A line's angle and its distance's sign turn over at 180 degrees together."""
    strong = counted.where(F.col("n") >= least)
    turned = strong.select(*keys, "n", "angle", "rho", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("turn"))
    other = turned.select(*keys, F.col("n").alias("m"), F.col("angle").alias("oa"), F.col("rho").alias("orho"), (F.col("angle") + 180 * F.col("turn")).alias("a"), F.when(F.col("turn") == 0, F.col("rho")).otherwise(-F.col("rho")).alias("r"))
    other = other.where((F.col("a") >= -NEAR_ANGLE) & (F.col("a") <= 179 + NEAR_ANGLE))
    cell = lambda a, r, i=0, j=0: (F.floor(F.col(a) / (NEAR_ANGLE + 1)) + i, F.floor(F.col(r) / (NEAR_RHO + 1)) + j)
    ga, gr = cell("a", "r")
    around = F.explode(F.array(*[F.struct((ga + i).alias("ca"), (gr + j).alias("cr")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
    other = other.select("*", around).select(*keys, "m", "oa", "orho", "a", "r", "c.ca", "c.cr")
    ca, cr = cell("angle", "rho")
    own = strong.withColumn("ca", ca).withColumn("cr", cr)
    near = (F.abs(F.col("a") - F.col("angle")) <= NEAR_ANGLE) & (F.abs(F.col("r") - F.col("rho")) <= NEAR_RHO)
    stronger = F.struct(-F.col("m"), F.col("oa"), F.col("orho")) < F.struct(-F.col("n"), F.col("angle"), F.col("rho"))
    overruled = own.join(other, [*keys, "ca", "cr"]).where(near & stronger).select(*keys, "angle", "rho").distinct()
    return strong.join(overruled, [*keys, "angle", "rho"], "left_anti")


def segments(pixels: DataFrame, lines: DataFrame, keys: list[str], least: int = LENGTH, gap: int = GAP) -> DataFrame:
    """keys..., line_angle, rho, x1, y1, x2, y2, length: runs of pixels along the peaks ``lines``, which are few per picture."""
    known = lines.withColumn("cos", trig(F.col("angle"))[0]).withColumn("sin", trig(F.col("angle"))[1])
    on = pixels.select(*keys, "x", "y").distinct().join(known, keys).where(F.abs(distance(F.col("x"), F.col("y"), F.col("cos"), F.col("sin")) - F.col("rho")) <= 1)
    best = on.groupBy(*keys, "x", "y").agg(F.min(F.struct((-F.col("n")).alias("n"), "angle", "rho", "cos", "sin")).alias("l"))
    placed = best.select(*keys, "x", "y", "l.angle", "l.rho", F.floor((F.col("y") * F.col("l.cos") - F.col("x") * F.col("l.sin")) / MILLION).alias("t"))
    runs = islands(placed, [*keys, "angle", "rho"], "t", gap, ["y", "x"])
    end = lambda f: f(F.struct("t", "y", "x"))
    ends = runs.groupBy(*keys, "angle", "rho", "island").agg(end(F.min).alias("a"), end(F.max).alias("b"))
    length = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    named = ends.select(*keys, F.col("angle").alias("line_angle"), "rho", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), length.alias("length"))
    return named.where(F.col("length") >= least)


def _turn(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 180.0
    return F.least(d, 180.0 - d)


def rows_of(found: DataFrame, keys: list[str], scale: Column | None = None, support: float = SUPPORT) -> DataFrame:
    """keys..., dominant_angle and one line per row: row, angle, offset, support, lines, consistent. scale: of the picture looked at, in the segments' columns."""
    grain = F.pmod(F.round(F.degrees(F.atan2((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double"))), 3), F.lit(180.0))
    angled = found.withColumn("angle", grain).withColumn("_scale", F.lit(1.0) if scale is None else scale)
    first = circular_median(angled, keys, "angle", "angle")
    close = angled.join(first, keys).where(_turn(F.col("angle"), F.col("median_angle")) <= ANGLE).drop("median_angle")
    again = circular_median(close, keys, "angle", "angle").withColumnRenamed("median_angle", "dominant_angle")
    kept = angled.join(again, keys).where(_turn(F.col("angle"), F.col("dominant_angle")) <= ANGLE)
    theta = F.radians("dominant_angle")
    offset = (F.col("y1") + F.col("y2")) / 2.0 * F.cos(theta) - (F.col("x1") + F.col("x2")) / 2.0 * F.sin(theta)
    grouped = islands(kept.withColumn("offset", F.round(offset, 6)), keys, "offset", POSITION, ["x1", "y1", "x2", "y2"])
    angles = circular_median(grouped, [*keys, "island"], "angle", "angle")
    rows = grouped.groupBy(*keys, "dominant_angle", "_scale", "island").agg(F.median("offset").alias("offset"), F.sum("length").alias("support"), F.count("*").alias("lines"))
    rows = rows.join(angles, [*keys, "island"])
    back = lambda c: F.col(c) / F.col("_scale")
    return rows.select(*keys, "dominant_angle", F.col("island").alias("row"), F.col("median_angle").alias("angle"), back("offset").alias("offset"), back("support").alias("support"), "lines", (back("support") >= support).alias("consistent"))


def row_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., dominant_angle, consistent_rows, strongest (support of the best row; 0 without)."""
    return rows.groupBy(*keys, "dominant_angle").agg(F.count_if("consistent").alias("consistent_rows"), F.coalesce(F.max(F.when(F.col("consistent"), F.col("support"))), F.lit(0.0)).alias("strongest"))


def unit_pixels(crop: DataFrame, cells: DataFrame, keys: list[str], height: int, width: int, rows: int = 8, cols: int = 8) -> DataFrame:
    """Crop pixels (keys..., y, x) with the unit of the cell they lie in. cells: keys..., row, col, unit."""
    placed = crop.withColumn("row", cell_of(F.col("y"), height, rows)).withColumn("col", cell_of(F.col("x"), width, cols))
    return placed.join(cells.select(*keys, "row", "col", "unit"), [*keys, "row", "col"]).select(*keys, "unit", "y", "x")
