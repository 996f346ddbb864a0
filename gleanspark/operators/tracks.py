"""Tracks over frames and the zones made of them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions import rules
from gleanspark.functions.geometry import clip, place


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def candidates(cells: DataFrame, run: str = "run_id", medium: float = rules.MEDIUM, most: int = 8) -> DataFrame:
    """Per frame the strongest valid cells with base >= .75 medium; ties in row-major order. Bars are the decimal products: 0.75 * 0.38 is 0.285, not the double above it."""
    base = F.greatest("appearance", "structural")
    kept = cells.withColumn("base", base).where("valid").where(F.col("base") >= round(0.75 * medium, 12))
    return top_per_group(kept, [run, "frame"], [F.desc("base"), F.col("row"), F.col("col")], most)


def link(cells: DataFrame, run: str = "run_id", distance: float = 0.14, link_same_frame: bool = True) -> DataFrame:
    """Candidates (run, frame, nth, cx, cy, ...) with ``track``: each takes the nearest last centroid in reach, else opens a track.

    Tracks that were extended in a frame are taken; one opened in it is not, unless link_same_frame is off. Order matters from
    frame to frame, so that one run, at most eight cells a frame, is one group; only the columns needed go to Python.
    """
    kind = cells.schema[run].dataType.simpleString()

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "nth"])
        last: list[tuple[float, float]] = []
        taken: set[int] = set()
        frame, tracks = None, []
        for r in pdf.itertuples():
            if r.frame != frame:
                frame, taken = r.frame, set()
            best, reach = -1, math.inf
            for i, (x, y) in enumerate(last):
                d = math.hypot(r.cx - x, r.cy - y)
                if i not in taken and d < reach:
                    best, reach = i, d
            if best >= 0 and reach <= distance:
                last[best] = (r.cx, r.cy)
                taken.add(best)
            else:
                last.append((r.cx, r.cy))
                best = len(last) - 1
                if not link_same_frame:
                    taken.add(best)
            tracks.append(best + 1)
        return pdf[[run, "frame", "nth"]].assign(track=tracks)

    slim = cells.select(run, F.col("frame").cast("long"), F.col("nth").cast("int"), F.col("cx").cast("double"), F.col("cy").cast("double"))
    found = slim.groupBy(run).applyInPandas(follow, f"{run} {kind}, frame long, nth int, track int")
    return cells.join(found, [run, "frame", "nth"])


def zones(tracked: DataFrame, frames: DataFrame, run: str = "run_id", least_frames: int = 3, medium: float = rules.MEDIUM, high: float = rules.HIGH, most: int = 12) -> DataFrame:
    """Persistent zones of tracked cells. frames: run, frame, quality_weight, registration (null: 1).

    Scores are weighted when they are collected and again when they are averaged; persistence is the track's weight over the run's
    quality weight; high priorities without support by both families of evidence are capped.
    """
    weight = F.col("quality_weight") * (0.5 + 0.5 * F.coalesce("registration", F.lit(1.0)))
    rows = tracked.join(frames.select(run, "frame", "quality_weight", "registration"), [run, "frame"]).withColumn("w", weight)
    floor = F.greatest("w", F.lit(1e-3))
    strongest = F.struct(-F.col("base") * F.col("w"), F.col("frame"), F.col("nth"))
    per = rows.groupBy(run, "track").agg(
        F.count("*").alias("seen"),
        (F.sum(F.col("appearance") * F.col("w") * floor) / F.sum(floor)).alias("appearance"),
        (F.sum(F.col("structural") * F.col("w") * floor) / F.sum(floor)).alias("structural"),
        F.sum(floor).alias("weight"),
        F.avg("cx").alias("cx"),
        F.avg("cy").alias("cy"),
        F.min("ts_sec").alias("first_seen_sec"),
        F.max("ts_sec").alias("last_seen_sec"),
        F.min_by(F.struct("row", "col"), strongest).alias("cell"),
    )
    runs = frames.groupBy(run).agg(F.count("*").alias("total"), F.sum("quality_weight").alias("run_weight"))
    z = per.where(F.col("seen") >= least_frames).join(runs, run).withColumn("anomaly", F.greatest("appearance", "structural")).where(F.col("anomaly") >= round(0.85 * medium, 12))
    z = z.withColumn("persistence", clip(F.col("weight") / F.greatest("run_weight", F.lit(1e-3)), 0.0, 1.0)).withColumn("review", rules.review_score(F.col("anomaly"), F.col("persistence")))
    level = rules.capped_priority(rules.priority(F.col("review"), high, medium), rules.consensus(F.col("appearance"), F.col("structural"), F.col("persistence")))
    z = z.withColumn("priority", level).withColumn("location", place(F.col("cx"), F.col("cy"))).withColumn("observations", F.least("seen", "total"))
    order = [F.desc(rules.priority_rank(F.col("priority"))), F.desc("review"), F.desc("structural"), F.desc("persistence"), F.col("track")]
    return top_per_group(z, [run], order, most).withColumn("zone_id", F.format_string("IZ-%03d", "track")).drop("weight", "run_weight", "seen")


def changes(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """The rows at which state differs from the row before."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_before", before).where(~F.col(state).eqNullSafe(F.col("_before"))).drop("_before")


def motion(df: DataFrame, keys: list[str], order: list[str], value: str, scale: float = 255.0, least: float = 0.35) -> DataFrame:
    """df with ``motion``, the change from the row before over scale (null for the first), and ``moved``: over ``least``."""
    change = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))) / scale
    return df.withColumn("motion", change).withColumn("moved", F.coalesce(F.col("motion") > least, F.lit(False)))


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 20) -> DataFrame:
    """df with ``rolling_mean`` and ``n`` over the last ``rows`` rows, the own included."""
    last = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("rolling_mean", F.avg(value).over(last)).withColumn("n", F.count("*").over(last))


def islands(df: DataFrame, keys: list[str], position: str, gap: float, order: list[str]) -> DataFrame:
    """df with ``island``: a new one wherever the step from the row before exceeds gap."""
    w = Window.partitionBy(*keys).orderBy(position, *order)
    breaks = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_break", breaks).withColumn("island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def circular_median(df: DataFrame, keys: list[str], angle: str, order: str) -> DataFrame:
    """The angle of each group (modulo 180) with the least sum of circular distances to the others; the first by order wins ties, to six places of the sum.

    Rows are counted by angle first. Along the sorted angles, each written down again half a turn later, the sum of distances follows from running counts and sums at the angle, a quarter and a
    half turn on: one ordered pass over a group's distinct angles, none of which meets all others.
    """
    counted = df.where(F.col(angle).isNotNull()).groupBy(*keys, F.col(angle).alias("_angle")).agg(F.count("*").alias("_n"), F.min(order).alias("_first")).withColumn("_p", F.pmod(F.col("_angle").cast("double"), F.lit(180.0)))
    point = lambda at, kind, n, name: F.struct((F.col("_p") + at).alias("at"), F.lit(kind).alias("kind"), n.alias("n"), F.lit(name).alias("name"))
    none = F.lit(0).cast("long")
    # Of what lies at one place, the marks of kind 0 come before the angles themselves (1), those of kind 2 behind.
    points = F.array(point(0.0, 0, none, "start"), point(0.0, 1, F.col("_n"), ""), point(90.0, 2, none, "half"), point(180.0, 0, none, "end"), point(180.0, 1, F.col("_n"), ""))
    line = counted.select(*keys, "_angle", "_first", "_p", F.explode(points).alias("_e"))
    so_far = Window.partitionBy(*keys).orderBy("_e.at", "_e.kind").rowsBetween(Window.unboundedPreceding, 0)
    run = line.withColumn("_c", F.sum("_e.n").over(so_far)).withColumn("_s", F.sum(F.col("_e.n") * F.col("_e.at")).over(so_far)).where("_e.name <> ''")
    at = lambda c, name: F.max(F.when(F.col("_e.name") == name, F.col(c)))
    marks = run.groupBy(*keys, "_angle", "_first", "_p").agg(*[at(c, name).alias(f"{c}_{name}") for c in ("_c", "_s") for name in ("start", "half", "end")])
    ahead = F.col("_s_half") - F.col("_s_start") - F.col("_p") * (F.col("_c_half") - F.col("_c_start"))
    behind = (F.col("_p") + 180.0) * (F.col("_c_end") - F.col("_c_half")) - (F.col("_s_end") - F.col("_s_half"))
    return marks.groupBy(*keys).agg(F.min_by("_angle", F.struct(F.round(ahead + behind, 6).alias("d"), F.col("_first").alias("f"), F.col("_angle").alias("a"))).alias("median_angle"))
