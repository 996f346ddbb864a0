"""Column functions: pixels' indices, vectors, angles, boxes and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x cut to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def excess_green(b: Column, g: Column, r: Column) -> Column:
    """2g - r - b of channels 0..255, scaled to 0..1."""
    return (2.0 * g - r - b) / 255.0


def is_vegetation(exg: Column, threshold: float = 0.05) -> Column:
    return exg > threshold


def vari(b: Column, g: Column, r: Column) -> Column:
    """(g-r)/(g+r-b); a denominator of size 1e-6 or less becomes +1e-6."""
    below = (g + r - b) / 255.0
    return ((g - r) / 255.0) / F.when(F.abs(below) <= 1e-6, F.lit(1e-6)).otherwise(below)


def lab_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Euclidean distance of mean 8-bit Lab colours, over 255."""
    return F.sqrt(sum((((x - y) / 255.0) ** 2 for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return 1.0 - dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def l2_normalised(a: Column, eps: float = 1e-8) -> Column:
    return F.transform(a, lambda x: x / (norm(a) + eps))


def angle_difference(a: Column, b: Column) -> Column:
    """Degrees between two undirected lines, 0 to 90."""
    d = F.abs(a - b) % 180.0
    return F.least(d, 180.0 - d)


def line_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y1 - y0, x1 - x0)), F.lit(180.0))


def line_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def place(cx: Column, cy: Column) -> Column:
    """The ninth of the frame that holds a centroid: north-west to south-east, in thirds."""
    row = F.when(cy < 1 / 3, "north").when(cy > 2 / 3, "south").otherwise("")
    col = F.when(cx < 1 / 3, "west").when(cx > 2 / 3, "east").otherwise("")
    return F.when((row == "") & (col == ""), "center").otherwise(F.concat(row, col))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two (x, y, w, h) boxes; 0 if the union is empty."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    tall = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = wide * tall
    union = F.greatest(zero, aw) * F.greatest(zero, ah) + F.greatest(zero, bw) * F.greatest(zero, bh) - both
    return F.when(union > 1e-9, both / union).otherwise(0.0)


def padded_box(x: Column, y: Column, w: Column, h: Column, pad: float = 0.35, least: float = 0.015) -> dict[str, Column]:
    """A box grown by a share of its sides, with a least side, cut to the frame."""
    wide, tall = F.greatest(w, F.lit(least)), F.greatest(h, F.lit(least))
    x0, y0 = F.greatest(x - wide * pad, F.lit(0.0)), F.greatest(y - tall * pad, F.lit(0.0))
    return {"x": x0, "y": y0, "w": F.least(wide * (1 + 2 * pad), 1.0 - x0), "h": F.least(tall * (1 + 2 * pad), 1.0 - y0)}


def letterbox(src_w: Column, src_h: Column, out_w: Column, out_h: Column) -> dict[str, Column]:
    """Where a picture lies in a frame that it is fitted into; the whole frame if a side is missing or 0."""
    known = F.lit(True)
    for side in (src_w, src_h, out_w, out_h):
        known = known & (F.coalesce(side, F.lit(0)) != 0)
    scale = F.least(out_w / src_w, out_h / src_h)
    w, h = F.when(known, src_w * scale).otherwise(out_w), F.when(known, src_h * scale).otherwise(out_h)
    return {"x": F.when(known, (out_w - w) / 2).otherwise(0.0), "y": F.when(known, (out_h - h) / 2).otherwise(0.0), "w": w, "h": h}


def mapped_box(box: dict[str, Column], frame: dict[str, Column]) -> dict[str, Column]:
    """A normalised box (x, y, w, h) in the pixels of the frame that :func:`letterbox` gives."""
    return {"x": frame["x"] + box["x"] * frame["w"], "y": frame["y"] + box["y"] * frame["h"], "w": box["w"] * frame["w"], "h": box["h"] * frame["h"]}


def normalised_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """A cell's box and centroid as shares of its picture."""
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    return {"cx": (x0 + x1) / 2 / w, "cy": (y0 + y1) / 2 / h, "x": x0 / w, "y": y0 / h, "w": (x1 - x0) / w, "h": (y1 - y0) / h}


def line_midpoint(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    return (x0 + x1) / 2, (y0 + y1) / 2


def iso6709(value: Column) -> Column:
    """struct<latitude,longitude,altitude> of "+40.1-088.5+041.2/"; null if it is anything else."""
    pattern = r"^([+-][0-9]+(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)?/?$"
    text = F.trim(value)
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("double")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("latitude"), part(2).alias("longitude"), part(3).alias("altitude")))


def dms_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds with a hemisphere letter as signed degrees."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def geojson_point(longitude: Column, latitude: Column) -> Column:
    """JSON of a point geometry, or null: positions are never guessed."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates"))
    return F.when(longitude.isNotNull() & latitude.isNotNull(), F.to_json(geometry))
