"""Runs, jobs and their artifacts: counts, queues, listings, guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a job, and the artifacts of a run that are kept, with their storage class.
ACTIVE = ("preparing", "processing", "rendering")
UNFINISHED = ("queued", *ACTIVE)
KEPT_ARTIFACTS = {"results.json": "derived_analysis", "metrics.json": "derived_analysis", "annotated_video": "derived_preview", "heatmap.png": "derived_preview"}
VIDEOS = ("mp4", "mov", "avi", "mkv", "webm", "m4v")


def rank_score(review: Column, anomaly: Column) -> Column:
    """The review score; where that is missing or 0, the anomaly score."""
    return F.when(F.coalesce(review, F.lit(0.0)) != 0, review).otherwise(anomaly)


def run_counts(zones: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """keys..., zones, high, medium, low and the zone that ranks first (ties: the smaller id). zones: priority, review, anomaly."""
    count = lambda level: F.count_if(F.col("priority") == level).alias(level)
    best = F.struct(-rank_score(F.col("review"), F.col("anomaly")), F.col(zone))
    return zones.groupBy(*keys).agg(F.count("*").alias("zones"), count("high"), count("medium"), count("low"), F.min_by(zone, best).alias("top_zone"))


def usable_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., scheduled, usable, limited (those scheduled that are not usable)."""
    usable = F.count_if(F.coalesce("usable", F.lit(False)))
    return frames.groupBy(*keys).agg(F.count("*").alias("scheduled"), usable.alias("usable"), (F.count("*") - usable).alias("limited"))


def key_findings(scheduled: Column, usable: Column, seen: Column, coverage_delta: Column, soil_delta: Column) -> Column:
    """Findings in order; what is unknown or not positive is not mentioned. The sentences are fixed values."""
    percent = lambda c: F.bround(c * 100).cast("int").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda c: c.cast("string")
    return F.array_compact(
        F.array(
            F.when(scheduled > 0, text(number(usable), " of ", number(scheduled), " scheduled observations were usable for analysis.")),
            F.when(seen != "", text("Observed in ", seen, ".")),
            F.when(coverage_delta > 0, text("Crop coverage is lower here by roughly ", percent(coverage_delta), "% relative to nearby field structure.")),
            F.when(soil_delta > 0, text("Visible soil is higher here by roughly ", percent(soil_delta), "% relative to nearby field structure.")),
        )
    )


def newest(jobs: DataFrame, n: int = 100, created: str = "created_at", ident: str = "job_id") -> DataFrame:
    return jobs.orderBy(F.desc(created), F.desc(ident)).limit(n)


def queue_status(jobs: DataFrame, n: int = 100, created: str = "created_at", ident: str = "job_id") -> DataFrame:
    """One row over the newest n jobs: active and queued ones, and the newest active one's id."""
    top = newest(jobs.select(created, ident, "status"), n, created, ident)
    active = F.col("status").isin(*ACTIVE)
    first = F.max_by(F.when(active, F.col(ident)), F.when(active, F.struct(created, ident)))
    return top.agg(F.count_if(active).alias("active"), F.count_if(F.col("status") == "queued").alias("queued"), first.alias("active_job"))


def restarted(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after a restart: what was not finished has failed, with a fixed sentence."""
    cut = F.col("status").isin(*UNFINISHED)
    new = {
        "error": F.lit("Vision service restarted before this analysis completed"),
        "message": F.lit("Analysis interrupted by service restart"),
        "updated_at": now,
        "status": F.lit("failed"),
    }
    return jobs.withColumns({c: F.when(cut, v).otherwise(F.col(c)) for c, v in new.items()})


def totals(df: DataFrame, measures: str) -> DataFrame:
    """(name, total): the sums of a map column's values by key."""
    return df.select(F.explode(measures).alias("name", "value")).groupBy("name").agg(F.sum("value").alias("total"))


def logged(requests: DataFrame, prefixes: tuple[str, ...] = ("/vision/",), health: str = "/vision/health") -> DataFrame:
    """The requests (path, method, health_wanted) that an access log holds: those under the prefixes; health probes only on demand."""
    under = F.lit(False)
    for prefix in prefixes:
        under = under | F.col("path").startswith(prefix)
    probe = (F.col("path") == health) & (F.col("method") == "GET")
    return requests.where(under & (~probe | F.coalesce("health_wanted", F.lit(False))))


def kept_artifacts(files: DataFrame, run: str = "run_id") -> DataFrame:
    """The artifacts of runs that are registered: run, name, sha256 rows of existing files to logical_id, sha256, storage_class."""
    kinds = F.create_map(*[F.lit(x) for item in KEPT_ARTIFACTS.items() for x in item])
    kept = files.where(F.col("name").isin(*KEPT_ARTIFACTS) & F.col("sha256").isNotNull())
    return kept.select(F.concat(F.lit("run:"), F.col(run).cast("string"), F.lit(":"), F.col("name")).alias("logical_id"), "sha256", kinds[F.col("name")].alias("storage_class"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 12) -> DataFrame:
    """Page ``number``, counted from 0, of size rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def listed(df: DataFrame, keys: list[str], order: list[str], place: str = "place") -> DataFrame:
    """df with each row's place, counted from 1, in its group's ascending list."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def orphan_candidates(*tables: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Candidates of all sources as one list, oldest first, at most ``most``: the number a clean-up may take at once."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.orderBy(*order).limit(most)


def valid_only(images: DataFrame, records: DataFrame, on: str) -> DataFrame:
    """Valid images with their record, if any; duplicates and failures are not analysed."""
    return images.where("status = 'valid'").join(records, on, "left")


def source_metadata(files: DataFrame, name: str = "name") -> DataFrame:
    """files (name, codec, fps, frames) of known types, with fps 30 where it is missing or next to zero, and the duration in seconds."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    rate = F.when(F.coalesce(F.col("fps"), F.lit(0.0)) > 1e-3, F.col("fps")).otherwise(30.0)
    known = files.where(suffix.isin(*VIDEOS)).withColumn("fps", rate)
    return known.withColumn("codec", F.coalesce("codec", F.lit("unknown"))).withColumn("duration_sec", F.coalesce(F.col("frames"), F.lit(0)) / F.col("fps"))


def known_id(value: Column, digits: int) -> Column:
    """True for exactly ``digits`` lower-case hexadecimal digits."""
    return F.coalesce(value.rlike(f"^[a-f0-9]{{{digits}}}\\z"), F.lit(False))


#: The zone's fields in camelCase with their kind and what stands for a missing one (None: stays null).
ZONE_FIELDS = {
    "id": ("string", None), "reviewPriority": ("string", None), "anomalyScore": ("double", None), "appearanceAnomalyScore": ("double", 0.0), "structuralAnomalyScore": ("double", 0.0), "reviewScore": ("double", 0.0),
    "persistenceScore": ("double", None), "primaryType": ("string", "general_visual_variation"), "primarySignalLabel": ("string", "General visual variation"), "persistentObservations": ("int", 0), "totalObservations": ("int", 0),
    "relativeLocation": ("string", None), "recommendation": ("string", ""),
}


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def zone_of_json(text: Column) -> list[Column]:
    """A zone's columns from its camelCase JSON, with defaults for what it lacks."""
    parsed = F.from_json(text, ", ".join(f"{n} {kind}" for n, (kind, _) in ZONE_FIELDS.items()))
    columns = []
    for name, (_, default) in ZONE_FIELDS.items():
        value = parsed[name]
        columns.append((value if default is None else F.coalesce(value, F.lit(default))).alias(snake(name)))
    return columns


def largest_masks(masks: DataFrame, keys: list[str], area: str, order: list[str], most: int = 40) -> DataFrame:
    """The ``most`` largest masks of each picture."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(area), *order))
    return masks.withColumn("nth", nth).where(F.col("nth") <= most)


def mask_name(exg: Column, saturation: Column, value: Column, blue: Column, variance: Column, share: Column, long: Column) -> Column:
    """The class of a mask, by ordered rules over its means (8-bit saturation and value); blue: blue less green. Thresholds are fixed values."""
    return (
        F.when((blue > 0.05) & (value < 160), "WATER")
        .when((exg > 0.06) & (value < 95) & (variance > 180), "TREE_VEGETATION")
        .when(exg > 0.04, "CROP")
        .when((saturation < 55) & (variance > 250) & (share < 0.15), "INFRASTRUCTURE")
        .when((saturation < 90) & (value > 40) & (value < 190) & ((share < 0.12) | long), "ROAD_PATH")
        .when(exg < 0.03, "BARE_SOIL")
        .otherwise("CROP")
    )


def long_mask(pixels: Column, wide: Column, tall: Column) -> Column:
    """True for masks of 20 pixels or more whose box is over three times as long as broad."""
    over = lambda a, b: a / F.greatest(b, F.lit(1)) > 3.0
    return (pixels >= 20) & (over(wide, tall) | over(tall, wide))


def skipped_unit(kind: Column, confidence: Column, crop_pixels: Column, least_confidence: float = 0.3, least_pixels: int = 100) -> Column:
    """Why a unit's rows are not looked for, in fixed words; null where they are."""
    return (
        F.when(kind != "active_crop", F.concat(F.lit("unit_type="), kind, F.lit(", not ACTIVE_CROP")))
        .when(confidence < least_confidence, F.concat(F.lit("confidence="), F.format_string("%.2f", confidence), F.lit(f" below min_confidence={least_confidence}")))
        .when(crop_pixels < least_pixels, F.concat(F.lit("only "), crop_pixels.cast("string"), F.lit(f"px of crop-plant area, below the {least_pixels}px floor")))
    )
