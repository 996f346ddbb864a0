"""Pixels to cells to fields: occupancy, structural scores, local baselines, field summaries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions import rules
from gleanspark.functions.geometry import clip, vari
from gleanspark.operators.grid import cell_of
from gleanspark.operators.pixels import nearest_line

NON_CROP = ("ROAD_PATH", "TREE_VEGETATION", "WATER", "INFRASTRUCTURE")
#: Sentences of the brief.
NOTHING_FOUND = "No significant inspection areas found. The analyzed footage did not show persistent visual differences above the current review threshold."
HIDDEN_FIELD = "The view may include mostly bare ground, trees, or an angle that hides the field. Try a higher pass or a tighter crop."
#: Weights of the structural score.
OCCUPANCY, CONTINUITY, GAP, FRAGMENTS, SOIL = 0.30, 0.25, 0.20, 0.15, 0.10


def with_occupancy(pixels: DataFrame, frame: list[str]) -> DataFrame:
    """pixels (b, g, r, label, in_field) with exg, veg and soft occupancy 0..1: crop label, vegetation and scaled ExG; labels that vegetation contradicts lose."""
    exg = (2 * F.col("g") - F.col("r") - F.col("b")) / 255.0
    p = pixels.withColumn("exg", exg).withColumn("veg", (F.col("exg") > 0.05).cast("double"))
    range_ = p.groupBy(*frame).agg(F.min("exg").alias("_lo"), F.max("exg").alias("_hi"))
    p = p.join(range_, frame).withColumn("_n", clip((F.col("exg") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6), 0.0, 1.0))
    crop = (F.col("label") == "CROP").cast("double")
    soft = 0.25 * crop + 0.45 * F.col("veg") + 0.30 * F.col("_n")
    soft = F.when((crop > 0.4) & (F.col("veg") < 0.35), F.least(soft, 0.6 * F.col("veg") + 0.4 * F.col("_n"))).otherwise(soft)
    soft = F.when(~F.col("in_field") | F.col("label").isin(*NON_CROP), 0.0).otherwise(soft)
    return p.withColumn("occupancy", clip(soft, 0.0, 1.0)).drop("_lo", "_hi", "_n")


def cell_features(pixels: DataFrame, frame: list[str], height: int, width: int, rows: int = 8, cols: int = 8) -> DataFrame:
    """frame..., row, col and features: shares over the cell's field pixels, differences to the field. One pass over pixels, one over cells.

    The field's crop coverage divides by the whole picture, the cells' by their field pixels.
    """
    p = with_occupancy(pixels, frame)
    p = p.withColumn("row", cell_of(F.col("y"), height, rows)).withColumn("col", cell_of(F.col("x"), width, cols))
    inside = lambda c: F.when(F.col("in_field"), c)
    share = lambda name: F.coalesce(F.avg(inside((F.col("label") == name).cast("double"))), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(inside(F.col(c))), F.lit(0.0))
    cells = p.groupBy(*frame, "row", "col").agg(
        F.avg(F.col("in_field").cast("double")).alias("field_fraction"), share("CROP").alias("crop_coverage"), share("BARE_SOIL").alias("bare_soil"), mean("exg").alias("exg_mean"), mean("veg").alias("veg_frac"),
        mean("occupancy").alias("occupancy"), mean("b").alias("b_mean"), mean("g").alias("g_mean"), mean("r").alias("r_mean"),
    )
    whole = p.groupBy(*frame).agg(F.avg((F.col("in_field") & (F.col("label") == "CROP")).cast("double")).alias("_cov"), mean("exg").alias("_exg"), mean("veg").alias("_veg"))
    delta = {"coverage_delta": F.col("crop_coverage") - F.col("_cov"), "vegetation_difference": F.abs(F.col("veg_frac") - F.col("_veg")), "exg_difference": F.abs(F.col("exg_mean") - F.col("_exg"))}
    valid = F.col("field_fraction") >= 0.25
    return cells.join(whole, frame).withColumns(delta).withColumn("valid", valid).drop("_cov", "_exg", "_veg")


def unit_baselines(cells: DataFrame, keys: list[str], least_confidence: float = 0.3, least_peers: int = 3) -> DataFrame:
    """cells (unit, unit_type, unit_confidence, occupancy, valid) with baseline: their active-crop unit's median occupancy, else the frame's, else .5."""
    crop = F.col("valid") & (F.col("unit_type") == "active_crop") & (F.col("unit_confidence") >= least_confidence)
    units = cells.where(crop).groupBy(*keys, "unit").agg(F.median("occupancy").alias("_unit"), F.count("*").alias("_n")).where(F.col("_n") >= least_peers).drop("_n")
    frames = cells.groupBy(*keys).agg(F.median(F.when(F.col("valid"), F.col("occupancy"))).alias("_frame"))
    rows = cells.join(units, [*keys, "unit"], "left").join(frames, keys, "left")
    return rows.withColumn("baseline", F.coalesce(F.when(crop, F.col("_unit")), F.col("_frame"), F.lit(0.5))).drop("_unit", "_frame")


def structural_score(baseline: Column, occupancy: Column, veg: Column, bare: Column, crop: Column, continuity: Column, gap: Column, fragments: Column, soil_delta: Column) -> dict[str, Column]:
    """occupancy_deficit and score. Continuity and gaps count as far as occupancy corroborates them; plain lack of crop sets a floor."""
    scale = F.greatest(baseline, F.lit(0.15))
    short = lambda x: F.greatest(F.lit(0.0), baseline - x) / scale
    deficit = F.greatest(short(occupancy), short(veg))
    sure = clip(deficit / 0.15, 0.0, 1.0)
    extent = F.greatest(gap, continuity)
    total = OCCUPANCY + CONTINUITY + GAP + FRAGMENTS + SOIL
    raw = (OCCUPANCY * clip(deficit, 0.0, 1.0) + CONTINUITY * continuity * sure + GAP * clip(extent, 0.0, 1.0) * sure + FRAGMENTS * clip(fragments * 3, 0.0, 1.0) + SOIL * clip(soil_delta * 2, 0.0, 1.0)) / total
    floor = F.greatest(
        F.when((veg < baseline * 0.55) & (baseline >= 0.35), 0.4 + 0.5 * (1 - veg / scale)).otherwise(0.0),
        F.when((bare >= 0.2) & (baseline >= 0.45) & (crop < 0.5), 0.35 + 0.45 * bare).otherwise(0.0),
        F.when((veg < 0.25) & (baseline >= 0.5), 0.45).otherwise(0.0),
    )
    return {"occupancy_deficit": deficit, "score": clip(F.greatest(raw, floor), 0.0, 1.0)}


def gap_along_row(samples: np.ndarray, run: int = 3) -> tuple[float, float, float]:
    """Score, mean before and mean after of the clearest gap of a 1-D occupancy profile (NaN: outside the picture)."""
    known = samples[~np.isnan(samples)]
    n = len(samples)
    if len(known) < 3 * run or (level := float(np.percentile(known, 75))) < 0.15:
        return 0.0, 0.0, 0.0
    sums = np.concatenate(([0.0], np.cumsum(np.nan_to_num(samples))))
    best = (0.0, 0.0, 0.0)
    for start in range(run, n - 2 * run):
        before = (sums[start] - sums[start - run]) / run
        if before < 0.55 * level:
            continue
        ends = np.arange(start + run, min(n - run, start + n // 3))
        inside = (sums[ends] - sums[start]) / (ends - start)
        after = (sums[ends + run] - sums[ends]) / run
        score = (1 - inside / np.maximum(np.maximum(before, after), 1e-6)) * (0.6 + 0.4 * np.minimum((ends - start) / n * 8, 1))
        score[(inside > 0.65 * level) | (after < 0.55 * level)] = 0
        if len(ends) and score.max() > best[0]:
            best = (float(score.max()), float(before), float(after[score.argmax()]))
    return min(best[0], 1.0), best[1], best[2]


def summarise(frames: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run of frames (frame, in_field, row_visibility and one share column per class): means, flags, detection, visibility."""
    some = lambda c, least: F.coalesce(F.bool_or(F.col(c) > least), F.lit(False))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    rank = F.avg(F.when(F.col("row_visibility") == "HIGH", 3).when(F.col("row_visibility") == "MEDIUM", 2).otherwise(1))
    got = frames.groupBy(run).agg(
        mean("crop").alias("mean_crop"), mean("bare_soil").alias("mean_bare"), mean("in_field").alias("mean_field"),
        some("road_path", 0.01).alias("road"), some("tree_vegetation", 0.01).alias("tree"), some("water", 0.005).alias("water"), some("infrastructure", 0.005).alias("infrastructure"),
        (mean("road_path") + mean("tree_vegetation") + mean("water") + mean("infrastructure")).alias("non_crop"),
        F.when(rank >= 2.5, "HIGH").when(rank >= 1.5, "MEDIUM").otherwise("LOW").alias("row_visibility"),
    )
    return got.withColumn("detected", (F.col("mean_field") >= 0.08) & (F.col("mean_crop") + F.col("mean_bare") >= 0.05))


def only_detected(zones: DataFrame, fields: DataFrame, run: str = "run_id") -> DataFrame:
    """No field, no zones: the semi-join can run before any tracking."""
    return zones.join(fields.where("detected").select(run), run, "left_semi")


def limitations(fallback: Column, heuristic: Column, detected: Column, visibility: Column, registration: Column) -> Column:
    """Names of what limits a run, in order."""
    return F.array_compact(F.array(F.when(fallback, "segmentation_fallback"), F.when(heuristic, "heuristic_embeddings"), F.when(~detected, "no_field"), F.when(visibility == "LOW", "row_visibility_low"), F.when(registration < 0.3, "low_registration")))


def limited(visibility: Column, usable: Column, sampled: Column, notes: Column) -> Column:
    """True if an analysis is limited: low rows, under half the frames usable, or a note says so."""
    told = F.exists(notes, lambda n: n.rlike("(?i)quality|visibility|registration|fallback"))
    return (visibility == "LOW") | (usable / F.greatest(sampled, F.lit(1)) < 0.5) | F.coalesce(told, F.lit(False))


def brief(frames: Column, seconds: Column, crop: Column, detected: Column, zones: Column, high: Column, place: Column, issue: Column) -> Column:
    """A run in two or three sentences. The sentences."""
    share, n, s = F.concat(F.round(crop * 100).cast("int").cast("string"), F.lit("%")), frames.cast("string"), F.round(seconds).cast("int").cast("string")
    opener = F.concat(
        F.lit("After "), n, F.lit(" frames ("), s, F.lit("s of flight), estimated crop coverage is about "), share, F.lit(". "), zones.cast("string"), F.lit(" inspection areas may be worth a closer look"),
        F.when(high > 0, F.concat(F.lit(" — "), high.cast("string"), F.lit(" marked high priority"))).otherwise(""), F.lit(". The most notable is in the "), F.initcap(F.replace(place, F.lit("_"), F.lit(" "))), F.lit(" area ("), issue,
        F.lit("). These are image-based differences for review, not diagnoses of crop health, yield, or planting failure."),
    )
    nothing = F.concat(F.lit(f"{NOTHING_FOUND} Estimated crop coverage in the analyzed area: "), share, F.lit("."))
    unseen = F.concat(F.lit("We reviewed "), n, F.lit(" frames from a "), s, F.lit(f"s clip but could not estimate a clear analysis field boundary. {HIDDEN_FIELD}"))
    return F.when(~detected, unseen).when(zones == 0, nothing).otherwise(opener)


def highest_priority(level: Column) -> Column:
    """The strongest level of a group; null for none."""
    return F.max_by(level, rules.priority_rank(level))


def observation(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys... and a frame's shadow measurement over its field pixels (b, g, r, label, in_field, occupancy); null for frames without field.

    exg_mean, vari_mean, crop_occupancy, soil_fraction, understory_fraction, vegetated_soil_of_field.
    """
    inside = lambda c: F.avg(F.when(F.col("in_field"), c))
    exg = (2 * F.col("g") - F.col("r") - F.col("b")) / 255.0
    means = pixels.groupBy(*keys).agg(
        F.count_if("in_field").alias("_field"), inside(exg).alias("exg_mean"), inside(vari(F.col("b"), F.col("g"), F.col("r"))).alias("vari_mean"), inside(F.col("occupancy")).alias("crop_occupancy")
    )
    rows = means.join(understory(pixels, keys), keys)
    values = [c for c in rows.columns if c not in (*keys, "_field")]
    return rows.select(*keys, *[F.when(F.col("_field") > 0, F.col(c)).alias(c) for c in values])


def inter_row(pixels: DataFrame, lines: DataFrame, keys: list[str], half_width: float = 15.0) -> DataFrame:
    """keys..., shares of row bands and of what lies between rows, vegetation among the latter and over all. Units without lines give no row.

    pixels: keys..., x, y, b, g, r of units; lines: keys..., angle, offset.
    """
    marked = nearest_line(pixels.join(lines.select(*keys).distinct(), keys, "left_semi"), lines, keys, half_width)
    between = F.col("line_offset").isNull()
    green = (2 * F.col("g") - F.col("r") - F.col("b")) / 255.0 > 0.05
    share = lambda c: F.avg(c.cast("double"))
    among = F.coalesce(F.avg(F.when(between, green.cast("double"))), F.lit(0.0))
    return marked.groupBy(*keys).agg(share(~between).alias("row_band_fraction"), share(between).alias("inter_row_fraction"), among.alias("inter_row_vegetation"), share(between & green).alias("visible_inter_row_vegetation"))


def unit_pixels(pixels: DataFrame, cells: DataFrame, keys: list[str], height: int, width: int, rows: int = 8, cols: int = 8) -> DataFrame:
    """The field pixels of units' cells (keys..., row, col, unit), with their unit; crop_pixel marks those of crop."""
    placed = pixels.withColumn("row", cell_of(F.col("y"), height, rows)).withColumn("col", cell_of(F.col("x"), width, cols))
    inside = placed.where("in_field").join(cells.select(*keys, "row", "col", "unit"), [*keys, "row", "col"])
    return inside.withColumn("crop_pixel", F.col("label") == "CROP")


def with_row_angle(cells: DataFrame, units: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """cells with row_angle: their unit's, or where that has none, their frame's. units: keys..., unit, angle; frames: keys..., angle."""
    own = units.select(*keys, "unit", F.col("angle").alias("_unit"))
    whole = frames.select(*keys, F.col("angle").alias("_frame"))
    return cells.join(own, [*keys, "unit"], "left").join(whole, keys, "left").withColumn("row_angle", F.coalesce("_unit", "_frame")).drop("_unit", "_frame")


def understory(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of soil, of vegetated soil in soil, and of vegetated soil in the field."""
    f = F.col("in_field")
    soil = f & (F.col("label") == "BARE_SOIL")
    green = soil & ((2 * F.col("g") - F.col("r") - F.col("b")) / 255.0 > 0.05)
    share = lambda c, among: F.coalesce(F.avg(F.when(among, c.cast("double"))), F.lit(0.0))
    return pixels.groupBy(*keys).agg(share(soil, f).alias("soil_fraction"), share(green, soil).alias("understory_fraction"), share(green, f).alias("vegetated_soil_of_field"))


def area_weighted(value: Column, area: Column) -> Column:
    """Mean over units by area; null values and their areas are left out."""
    known = F.when(value.isNotNull(), area)
    return F.sum(value * known) / F.nullif(F.sum(known), F.lit(0.0))


def middle_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row at place floor(n/2), counted from 0, of each group."""
    w = Window.partitionBy(*keys)
    nth = F.row_number().over(w.orderBy(*order))
    return df.withColumn("_nth", nth).withColumn("_n", F.count("*").over(w)).where(F.col("_nth") == F.floor(F.col("_n") / 2) + 1).drop("_nth", "_n")


def with_default_frames(runs: DataFrame, frames: DataFrame, run: str = "run_id", spacing: float = 0.5) -> DataFrame:
    """Frames, and for runs (run, n_frames) without any, n_frames empty ones at even spacing."""
    missing = runs.join(frames.select(run), run, "left_anti").where("n_frames > 0")
    made = missing.select(run, F.explode(F.sequence(F.lit(0), (F.col("n_frames") - 1).cast("int"))).alias("frame")).withColumn("ts_sec", F.col("frame") * spacing)
    return frames.unionByName(made, allowMissingColumns=True)


def artifact_name(index: Column, kind: str = "frame") -> Column:
    """frame_0007.jpg: a zero-padded index."""
    return F.format_string(f"{kind}_%04d.jpg", index)


def source_rate(fps: Column) -> Column:
    """A source's frame rate; what is missing or next to zero becomes 30."""
    return F.when(F.coalesce(fps, F.lit(0.0)) > 1e-3, fps).otherwise(30.0)


def worth_archiving(original: Column, restored: Column, before: Column, after: Column, least: float = 0.05) -> Column:
    """True if a reversible archive restores the original's digest and saves enough."""
    return (original == restored) & (1 - after / before >= least)


def superpixels(regions: DataFrame, features: list[str], k: int = 6, seed: int = 0) -> DataFrame:
    """regions with their cluster and its centre, by k-means over region means."""
    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(regions)
    model = KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed).fit(vectors)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    return model.transform(vectors).withColumn("centre", F.get(centres, F.col("cluster"))).drop("_v")


def centre_name(saturation: Column, value: Column, exg: Column, variance: Column, gradient: Column, a: Column, b: Column) -> Column:
    """The class of a cluster's centre, by ordered rules."""
    return (
        F.when((exg > 0.06) & (value > 0.15), "CROP")
        .when((exg > 0.02) & (value < 0.35) & (variance > 0.08), "TREE_VEGETATION")
        .when((exg < 0.0) & (b > a) & (value < 0.55) & (saturation > 0.15), "WATER")
        .when((saturation < 0.2) & (gradient > 0.12) & (value > 0.3), "INFRASTRUCTURE")
        .when((exg < 0.04) & (saturation < 0.4), "BARE_SOIL")
        .when(exg > 0.02, "CROP")
        .otherwise("UNKNOWN")
    )
