"""Masks of pictures of any size as runs of pixels: cleaning, components, thinning.

A mask is rows (keys..., y, x0, x1): pixels x0 to x1 - 1 of line y are in it. ``shapes`` has one row (keys..., height, width) per picture. Lines are
what tasks work on, so that a picture may be larger than a task; only thinning cuts pictures into tiles, with a margin of what the neighbours hold.

Defined cases: pixels that are not given are outside the mask; pixels given twice count once; a picture without mask has no rows (its complement is whole);
null keys, coordinates or pictures without a row in ``shapes`` have no result; what lies outside of a picture limits neither growing nor shrinking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.operators.lookup import components
from gleanspark.session import materialize, ship

BAND = 64
REACH = 256
RUNS_PER_TASK = 200_000


def ellipse(size: int) -> list[tuple[int, int]]:
    """(dy, half width) of an elliptic element of odd size."""
    r = size // 2
    return [(dy, round(r * ((r * r - dy * dy) / (r * r)) ** 0.5) if r else 0) for dy in range(-r, r + 1)]


def mask_runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of pixels(keys..., y, x)."""
    nth = F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    grouped = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct().withColumn("_g", F.col("x") - nth)
    return grouped.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_g")


def run_pixels(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels (keys..., y, x) of runs."""
    return runs.select(*keys, "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


def line_tasks(runs: DataFrame, shapes: DataFrame) -> int:
    """The tasks that lines and runs (written tables) need, so that what a task holds does not grow with the number of pictures."""
    lines = shapes.agg(F.sum("height")).first()[0] or 0
    return max(1, -(-(runs.count() + lines) // RUNS_PER_TASK))


def _by(df: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df


def merged(runs: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Runs that overlap or touch are one. tasks: what lines are dealt to (as the session has it)."""
    runs = _by(runs, [*keys, "y"], tasks)
    line = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col("x0") > before)).cast("int")
    marked = runs.select(*keys, "y", "x0", "x1").withColumn("_f", fresh)
    marked = marked.withColumn("_g", F.sum("_f").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def complement(runs: DataFrame, keys: list[str], shapes: DataFrame, tasks: int | None = None) -> DataFrame:
    """The pixels outside of merged runs, as runs."""
    lines = shapes.select(*keys, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.col("width").alias("x0"), F.col("width").alias("x1"))
    ends = _by(runs.select(*keys, "y", "x0", "x1").unionByName(lines), [*keys, "y"], tasks)
    before = F.lag("x1", 1, 0).over(Window.partitionBy(*keys, "y").orderBy("x0", "x1"))
    return ends.withColumn("_b", before).where("_b < x0").select(*keys, "y", F.col("_b").alias("x0"), F.col("x0").alias("x1"))


def dilated(runs: DataFrame, keys: list[str], shapes: DataFrame, element: list[tuple[int, int]], tasks: int | None = None) -> DataFrame:
    """Each run grows into the lines around it, by the element's half width there."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in element])).alias("s")
    grown = _by(runs.select(*keys, "y", "x0", "x1"), keys, tasks).join(_by(shapes, keys, tasks), keys).select("*", steps)
    grown = grown.select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), F.greatest(F.col("x0") - F.col("s.w"), F.lit(0)).alias("x0"), F.least(F.col("x1") + F.col("s.w"), F.col("width")).alias("x1"), "height")
    return merged(grown.where("y >= 0 AND y < height"), keys, tasks)


def eroded(runs: DataFrame, keys: list[str], shapes: DataFrame, element: list[tuple[int, int]], tasks: int | None = None) -> DataFrame:
    """What stays of a mask when its complement grows."""
    return complement(dilated(complement(runs, keys, shapes, tasks), keys, shapes, element, tasks), keys, shapes, tasks)


def opened(runs: DataFrame, keys: list[str], shapes: DataFrame, element: list[tuple[int, int]], times: int = 1, tasks: int | None = None) -> DataFrame:
    for step in [eroded] * times + [dilated] * times:
        runs = step(runs, keys, shapes, element, tasks)
    return runs


def closed(runs: DataFrame, keys: list[str], shapes: DataFrame, element: list[tuple[int, int]], times: int = 1, tasks: int | None = None) -> DataFrame:
    for step in [dilated] * times + [eroded] * times:
        runs = step(runs, keys, shapes, element, tasks)
    return runs


def cleaned(runs: DataFrame, keys: list[str], shapes: DataFrame) -> DataFrame:
    """A segmenter's mask: opened once, then closed twice over, with the ellipse of size 5."""
    runs, shapes = materialize(runs, "mask"), materialize(shapes, "shapes")
    tasks = line_tasks(runs, shapes)
    return closed(opened(runs, keys, shapes, ellipse(5), tasks=tasks), keys, shapes, ellipse(5), 2, tasks)


def _joined_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, d: int) -> np.ndarray:
    """Of runs in raster order, the place of the first run that each is connected with (d = 1: by corners too)."""
    span = int(x1.max()) + 4
    begins, ends = y * span + x0 + 1, y * span + x1 + 1
    low = np.searchsorted(ends, (y + 1) * span + x0 + 1 - d, side="right")
    high = np.maximum(np.searchsorted(begins, (y + 1) * span + x1 + 1 + d, side="left"), low)
    above = np.repeat(np.arange(len(y)), high - low)
    below = np.arange(len(above)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[above]
    root = np.arange(len(y))
    while True:
        least = np.minimum(root[above], root[below])
        after = root.copy()
        np.minimum.at(after, root[above], least)
        np.minimum.at(after, root[below], least)
        after = np.minimum(after, after[after])
        if (after == root).all():
            return root
        root = after


def labelled(runs: DataFrame, keys: list[str], diagonal: bool = True, band: int = BAND) -> DataFrame:
    """runs with component: 2^32 * y + x0 of the component's first run in raster order, which is its name within the picture.

    Runs are joined inside of bands of lines, one task each; what meets where bands touch is a small graph, whose components are found in star rounds.
    """
    ship(runs.sparkSession)
    d = int(diagonal)
    kinds = ", ".join(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys)

    def join_band(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x0", "ascending")])
        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        root = _joined_runs(y, x0, x1, d)
        return table.drop_columns("_band").append_column("part", pa.array((y[root] << 32) + x0[root]))

    banded = runs.select(*keys, "y", "x0", "x1", F.floor(F.col("y") / band).cast("long").alias("_band"))
    parts = materialize(banded.groupBy(*keys, "_band").applyInArrow(join_band, f"{kinds}, y int, x0 int, x1 int, part long"), "runs")
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(lo / REACH), F.floor(hi / REACH)))
    low = parts.where(F.col("y") % band == band - 1).select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("part").alias("pa"), tiles(F.col("x0") - d, F.col("x1") - 1 + d).alias("t"))
    high = parts.where(F.col("y") % band == 0).select(*keys, "y", "x0", "x1", F.col("part").alias("pb"), tiles(F.col("x0"), F.col("x1") - 1).alias("t"))
    met = materialize(low.join(high, [*keys, "y", "t"]).where((F.col("x1") > F.col("a0") - d) & (F.col("x0") < F.col("a1") + d)).select(*keys, "pa", "pb").distinct(), "bands")
    names = met.select(*keys, F.col("pa").alias("part")).unionByName(met.select(*keys, F.col("pb").alias("part"))).distinct()
    names = materialize(names.select(*keys, "part", F.monotonically_increasing_id().alias("node")), "band-nodes")
    at = lambda p, n: names.select(*keys, F.col("part").alias(p), F.col("node").alias(n))
    found = components(met.join(at("pa", "a"), [*keys, "pa"]).join(at("pb", "b"), [*keys, "pb"]).select("a", "b"), "band-components")
    told = names.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = told.groupBy("comp").agg(F.min("part").alias("component"))
    table = told.join(least, "comp").select(*keys, "part", "component")
    return parts.join(table, [*keys, "part"], "left").select(*keys, "y", "x0", "x1", F.coalesce("component", "part").alias("component"))


def areas(labels: DataFrame, keys: list[str], shapes: DataFrame) -> DataFrame:
    """keys..., component, area, at_edge of labelled runs."""
    size = labels.groupBy(*keys, "component").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x0").alias("_x0"), F.max("x1").alias("_x1"))
    edge = (F.col("_y0") <= 0) | (F.col("_x0") <= 0) | (F.col("_y1") >= F.col("height") - 1) | (F.col("_x1") >= F.col("width"))
    return size.join(shapes, keys).select(*keys, "component", "area", edge.alias("at_edge"), (F.col("height") * F.col("width")).alias("pixels"))


def field_mask(runs: DataFrame, keys: list[str], shapes: DataFrame, least_share: float = 0.02, most_hole: float = 0.008, of_largest: float = 0.15) -> DataFrame:
    """The analysable field: opened by the ellipse of size 3, small inner holes filled, small components dropped."""
    runs, shapes = materialize(runs, "mask"), materialize(shapes, "shapes")
    tasks = line_tasks(runs, shapes)
    mask = materialize(opened(runs, keys, shapes, ellipse(3), tasks=tasks), "field-mask")
    holes = materialize(labelled(complement(mask, keys, shapes, tasks), keys), "holes")
    small = areas(holes, keys, shapes).where((F.col("area") <= F.floor(F.lit(most_hole) * F.col("pixels"))) & ~F.col("at_edge"))
    filled = merged(mask.unionByName(holes.join(small.select(*keys, "component"), [*keys, "component"], "left_semi").drop("component")), keys, tasks)
    labels = materialize(labelled(filled, keys), "field-parts")
    size = areas(labels, keys, shapes)
    bar = size.groupBy(*keys).agg(F.greatest(F.floor(F.lit(least_share) * F.max("pixels")), F.floor(F.lit(of_largest) * F.max("area"))).alias("bar"))
    kept = size.join(bar, keys).where("area >= bar").select(*keys, "component")
    return labels.join(kept, [*keys, "component"], "left_semi").select(*keys, "y", "x0", "x1")


def thin_once(mask: np.ndarray) -> np.ndarray:
    """One round of Zhang and Suen's two passes; what lies around the array is outside the mask."""
    out = np.pad(mask, 1)
    for order in ((0, 2, 4, 2, 4, 6), (0, 2, 6, 0, 4, 6)):
        p = [out[1 + dy : out.shape[0] - 1 + dy, 1 + dx : out.shape[1] - 1 + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
        count = sum(q.astype(np.int8) for q in p)
        turns = sum((~p[i] & p[(i + 1) % 8]).astype(np.int8) for i in range(8))
        a, b, c, d, e, f = (p[i] for i in order)
        drop = (count >= 2) & (count <= 6) & (turns == 1) & ~(a & b & c) & ~(d & e & f)
        out[1:-1, 1:-1] &= ~drop
    return out[1:-1, 1:-1]


def thinned(runs: DataFrame, keys: list[str], tile: int = 256, rounds: int = 16, most: int = 200) -> DataFrame:
    """Skeletons (runs) after Zhang and Suen, to a fixed point or ``most`` rounds.

    Pictures are cut into tiles that carry a margin of their neighbours' pixels, two for each of ``rounds``; after these, tiles that changed, or
    have a neighbour that did, go on with fresh margins. Every step is written.
    """
    ship(runs.sparkSession)
    kinds = ", ".join(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys)

    def cut(now: DataFrame, margin: int) -> DataFrame:
        """Rows dealt to the tiles whose margin they reach."""
        span = lambda lo, hi: F.explode(F.sequence(F.floor((lo - margin) / tile), F.floor((hi + margin) / tile)))
        return now.select(*keys, "y", "x0", "x1", span(F.col("y"), F.col("y")).alias("ty")).select("*", span(F.col("x0"), F.col("x1") - 1).alias("tx"))

    def step(times: int):  # noqa: ANN202
        margin = 2 * times
        side = tile + 2 * margin

        def run(table: pa.Table) -> pa.Table:
            ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
            oy, ox = ty * tile - margin, tx * tile - margin
            y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
            change = np.zeros((side, side + 1), dtype=np.int32)
            np.add.at(change, (y - oy, np.clip(x0 - ox, 0, side)), 1)
            np.add.at(change, (y - oy, np.clip(x1 - ox, 0, side)), -1)
            before = np.cumsum(change, axis=1)[:, :side] > 0
            after, done = before, False
            for _ in range(times):
                again = thin_once(after)
                done = bool((again == after).all())
                after = again
                if done:
                    break
            inner = np.pad(after[margin : side - margin, margin : side - margin], ((0, 0), (1, 1))).astype(np.int8)
            ys, starts = np.nonzero(np.diff(inner, axis=1) == 1)
            _, ends = np.nonzero(np.diff(inner, axis=1) == -1)
            ys, starts, ends = (np.append(v, 0) for v in (ys, starts, ends))  # the last row, no run, tells of tiles that lose all
            n = len(ys)
            same = np.array_equal(after[margin : side - margin, margin : side - margin], before[margin : side - margin, margin : side - margin])
            columns = [pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys]
            numbers = [pa.array((v + o).astype(np.int32), pa.int32()) for v, o in ((ys, ty * tile), (starts, tx * tile), (ends, tx * tile))]
            return pa.table([*columns, *numbers, pa.array([not same] * n, pa.bool_())], names=[*keys, "y", "x0", "x1", "changed"])

        return run

    now = runs.select(*keys, "y", "x0", "x1")
    left = most
    while left > 0:
        times = min(rounds, left)
        dealt = cut(now, 2 * times)
        made = materialize(dealt.groupBy(*keys, "ty", "tx").applyInArrow(step(times), f"{kinds}, y int, x0 int, x1 int, changed boolean"), "thinned")
        now, left = made.where("x1 > x0").drop("changed"), left - times
        if made.where("changed").isEmpty():
            break
    return merged(now, keys)
