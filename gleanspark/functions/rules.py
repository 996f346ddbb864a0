"""Column functions: classifiers as CASE chains, reasons and texts.

The thresholds, labels and sentences are fixed values that results are compared by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.functions.geometry import clip

#: Levels of the review score, and the shares of its parts.
HIGH, MEDIUM = 0.62, 0.38
ANOMALY_SHARE, PERSISTENCE_SHARE = 0.65, 0.35
#: Names of unit and zone types.
WITHOUT_CROP = ("residue_stubble", "bare_soil", "non_crop")
NEED_CROP = ("stand_gap", "sparse_canopy", "row_discontinuity")
#: Phrases that a text must not hold.
FORBIDDEN = (
    "disease", "nitrogen deficien", "nutrient deficien", "water stress", "drought stress", "yield loss",
    "unhealthy crop", "unhealthy plant", "planting failure", "pest damage", "infection", "fungal",
)
#: Titles of signals, by name.
SIGNALS = {
    "stand_gap": "Possible stand gap / crop discontinuity",
    "row_discontinuity": "Possible row discontinuity",
    "sparse_canopy": "Possible fragmented or sparse canopy",
    "exposed_soil": "Increased exposed soil",
    "color_variation": "Unusual crop appearance (color)",
    "texture_variation": "Unusual surface texture",
    "general_visual_variation": "General visual variation",
}
#: Titles of issues, by name.
ISSUES = {
    "stand_gap": "Possible Crop Gap",
    "row_discontinuity": "Possible Crop Gap",
    "sparse_canopy": "Sparse Crop Coverage",
    "exposed_soil": "Exposed Soil",
    "color_variation": "Visual Difference",
    "texture_variation": "Visual Difference",
    "general_visual_variation": "Visual Difference",
}
#: Ordered, case-insensitive replacements in reasons.
COPY_EDITS = (
    (r"DINO visual features differ from field baseline \(distance [\d.]+\)", "Looks different from nearby crop in the image"),
    (r"embedding distance [\d.]+", "looks different from nearby crop"),
    (r"RGB color profile diverges from the field median \(Lab distance [\d.]+[^)]*\)", "Color differs from surrounding crop"),
    (r"Greenness proxy \(ExG\) is off the field baseline by [\d.]+[^—]*", "Greenness differs from the surrounding field"),
    (r"Surface texture / edge pattern differs from neighboring crop \([\d.]+[^)]*\)", "Texture differs from nearby areas"),
    (r"Multivariate fingerprint is an outlier[^.]*\.", "Several image cues differ together in this area."),
    (r"Canopy looks thinner than the field norm \(([^)]+)\)", "Crop coverage is lower here ($1)"),
    (r"Visible vegetation occupancy is (\d+%) below nearby rows", "Crop coverage is about $1 lower than nearby rows"),
    ("Crop-row continuity breaks in this region", "Crop structure appears interrupted in this area"),
    ("Rows/vegetation continue into and out of this region", "Crop structure continues before and after this area"),
    ("Additional exposed soil is visible", "More soil is visible here"),
    (r"Pattern persists across (\d+) of (\d+) usable observations \(persistence [\d.]+%\)", "Seen in $1 of $2 usable observations"),
    (r"Not a one-frame glitch — pattern held for ~[\d.]+% of sampled timestamps[^.]*\.", "The pattern persists across multiple frames."),
    ("No strong row discontinuity detected — primarily appearance-based", "Difference is mainly visual, not a clear crop gap"),
    ("visual anomaly", "visual difference"),
    ("anomaly", "difference"),
    ("structural", "crop structure"),
    ("appearance-only", "visual"),
    ("NDVI", "vegetation index"),
)


def review_score(anomaly: Column, persistence: Column) -> Column:
    return ANOMALY_SHARE * anomaly + PERSISTENCE_SHARE * persistence


def priority(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def priority_rank(level: Column) -> Column:
    return F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def consensus(appearance: Column, structural: Column, persistence: Column) -> Column:
    """True if a high priority is supported: both families, or strong structure seen again and again. Null counts as 0."""
    a, s, p = (F.coalesce(x, F.lit(0.0)) for x in (appearance, structural, persistence))
    return ((s >= 0.15) & (a >= 0.15)) | ((s >= 0.35) & (p >= 0.6))


def capped_priority(level: Column, supported: Column) -> Column:
    return F.when((level == "high") & ~supported, "medium").otherwise(level)


def unit_type(non_crop: Column, vegetation: Column, residue: Column) -> Column:
    return (
        F.when(non_crop >= 0.5, "non_crop")
        .when(vegetation >= 0.20, "active_crop")
        .when(residue == "likely_residue", "residue_stubble")
        .when(residue == "likely_bare_soil", "bare_soil")
        .otherwise("unknown")
    )


def residue_class(living: Column, brown: Column, edges: Column) -> Column:
    """Null shares mean an empty region."""
    return (
        F.when(living.isNull(), "unknown")
        .when(living >= 0.15, "living_vegetation")
        .when(brown < 0.4, "unknown")
        .when(edges >= 0.06, "likely_residue")
        .when(edges <= 0.03, "likely_bare_soil")
        .otherwise("unknown")
    )


def observability(coherence: Column, support: Column, rows: Column, plants: Column, confidence: Column) -> Column:
    by_row = (coherence >= 0.35) & (support >= 60) & (rows >= 2)
    by_plant = by_row & (F.coalesce(plants, F.lit(0)) >= 3) & (F.coalesce(confidence, F.lit(0.0)) >= 0.6)
    return F.when(by_plant, "PLANT_RESOLVABLE").when(by_row, "ROW_RESOLVABLE").otherwise("CANOPY_ONLY")


def row_visibility(coherence: Column) -> Column:
    return F.when(coherence >= 0.216, "HIGH").when(coherence >= 0.12, "MEDIUM").otherwise("LOW")


def boundary_confidence(share: Column, edge_ratio: Column) -> Column:
    return (
        F.when(share.isNull() | (share < 0.05) | (share > 0.98), "Low")
        .when(edge_ratio > 0.35, "Medium")
        .when(edge_ratio >= 0.12, "High")
        .otherwise("Medium")
    )


def raw_zone_type(f: dict[str, Column], visibility: Column) -> Column:
    """Eleven ordered rules over a cell's features; a missing feature counts as 0."""
    zero = lambda name: F.coalesce(f[name], F.lit(0.0)) if name in f else F.lit(0.0)
    structural, appearance, continuity = zero("structural"), zero("appearance"), zero("continuity")
    fragmented, deficit, bare, soil = zero("fragmentation"), zero("occupancy_deficit"), zero("bare_soil"), zero("soil_delta")
    seen = visibility.isin("HIGH", "MEDIUM")
    return (
        F.when((structural < 0.25) & (appearance < 0.25), "general_visual_variation")
        .when((continuity >= 0.45) & seen & (deficit >= 0.15), "stand_gap")
        .when((continuity >= 0.30) & seen & (deficit >= 0.08), "row_discontinuity")
        .when((bare >= 0.25) & (deficit >= 0.2) & (structural >= 0.25), "stand_gap")
        .when((fragmented >= 0.12) & (deficit >= 0.25), "sparse_canopy")
        .when((bare >= 0.2) | (soil >= 0.15), "exposed_soil")
        .when((zero("color") > 0.08) & (structural < 0.35), "color_variation")
        .when((zero("texture") > 0.08) & (structural < 0.35), "texture_variation")
        .when((structural >= 0.4) & (appearance < 0.35), "sparse_canopy")
        .when((appearance >= 0.4) & (structural < 0.35), "color_variation")
        .otherwise("general_visual_variation")
    )


def zone_type(f: dict[str, Column], visibility: Column, unit: Column, unit_confidence: Column) -> Column:
    """raw_zone_type, but a unit that surely holds no crop cannot lack crop."""
    raw = raw_zone_type(f, visibility)
    gated = F.coalesce(unit.isin(*WITHOUT_CROP) & (unit_confidence >= 0.3), F.lit(False)) & raw.isin(*NEED_CROP)
    return F.when(gated, F.when(unit == "non_crop", "general_visual_variation").otherwise("exposed_soil")).otherwise(raw)


def quality_warnings(sharpness: Column, near_black: Column, saturated: Column, luminance: Column, motion: Column) -> Column:
    """Names of the thresholds crossed, in order; null motion means no previous frame."""
    return F.array_compact(
        F.array(
            F.when(sharpness < 0.25, "low_sharpness"),
            F.when(near_black > 0.35, "near_black_clipping"),
            F.when(saturated > 0.25, "highlight_clipping"),
            F.when(luminance < 20.0, "underexposed"),
            F.when(luminance > 235.0, "overexposed"),
            F.when(motion > 0.35, "extreme_interframe_motion"),
        )
    )


def hard_fail(sharpness: Column, luminance: Column, warnings: Column) -> Column:
    return ((sharpness < 0.05) & (luminance < 12)) | (F.array_contains(warnings, "extreme_interframe_motion") & (sharpness < 0.08))


def quality_weight(sharpness: Column, luminance: Column, warnings: Column) -> Column:
    has = lambda *names: F.arrays_overlap(warnings, F.array(*map(F.lit, names)))
    share = lambda cond, x: F.when(cond, x).otherwise(1.0)
    product = share(has("low_sharpness"), 0.65) * share(has("highlight_clipping", "near_black_clipping"), 0.75) * share(has("extreme_interframe_motion"), 0.7)
    return F.when(hard_fail(sharpness, luminance, warnings), 0.15).otherwise(F.greatest(product, F.lit(0.35)))


def percent(x: Column) -> Column:
    """A share of 1 as whole percent, cut to 0..100."""
    return F.format_string("%.0f%%", F.round(clip(x, 0.0, 1.0) * 100, 0))


def place_label(place: Column) -> Column:
    return F.when(F.coalesce(place, F.lit("")) == "", "this patch").otherwise(F.lower(F.replace(F.replace(place, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))))


def lookup(keys: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[keys], F.lit(default))


def issue_label(kind: Column, signal: Column, structural: Column, appearance: Column) -> Column:
    """By type, else by signal text, else by part of it, else by scores."""
    by_signal = {SIGNALS[k]: v for k, v in ISSUES.items()}
    text = F.trim(signal)
    partly = F.coalesce(*[F.when(F.lower(text).contains(k.lower()), v) for k, v in by_signal.items()])
    by_type = F.create_map(*[F.lit(x) for item in ISSUES.items() for x in item])[kind]
    s, a = F.coalesce(structural, F.lit(0.0)), F.coalesce(appearance, F.lit(0.0))
    by_score = F.when((s >= 0.35) & (s > a), "Possible Crop Gap").when(s >= 0.25, "Sparse Crop Coverage").otherwise("Visual Difference")
    return F.coalesce(by_type, partly, by_score)


def reasons(f: dict[str, Column], kind: Column, persistence: Column, seen: Column, total: Column) -> Column:
    """Ordered sentences, never none. Missing features count as 0."""
    zero = lambda name: F.coalesce(f[name], F.lit(0.0)) if name in f else F.lit(0.0)
    gap, deficit, soil = kind.isin("stand_gap", "row_discontinuity"), zero("occupancy_deficit"), zero("bare_soil")
    two = lambda x: F.format_string("%.2f", F.round(x, 2))
    found = F.array_compact(
        F.array(
            F.when(gap & (zero("continuity") >= 0.2), "Crop-row continuity breaks in this region"),
            F.when(gap & (zero("continuity") >= 0.3), "Rows/vegetation continue into and out of this region"),
            F.when(gap & (deficit >= 0.15), F.concat(F.lit("Visible vegetation occupancy is "), percent(deficit), F.lit(" below nearby rows"))),
            F.when(gap & (soil >= 0.1), F.concat(F.lit("Additional exposed soil is visible ("), percent(soil), F.lit(" increase)"))),
            F.when((kind == "sparse_canopy") & (zero("fragmentation") >= 0.08), "Crop canopy appears fragmented compared to surrounding field"),
            F.when((kind == "sparse_canopy") & (deficit >= 0.15), F.concat(F.lit("Local crop occupancy is "), percent(deficit), F.lit(" below field baseline"))),
            F.when(kind == "exposed_soil", F.concat(F.lit("Exposed soil visible ("), percent(soil), F.lit(" of cell) — not automatically a planter skip"))),
            F.when((zero("appearance") >= 0.35) & (zero("structural") < 0.35), F.concat(F.lit("Color differs from surrounding crop (Lab distance "), two(zero("color")), F.lit(" — appearance only)"))),
            F.when((zero("structural") < 0.25) & (zero("appearance") >= 0.35), "No strong row discontinuity detected — primarily appearance-based"),
            F.when(
                persistence.isNotNull() & seen.isNotNull() & total.isNotNull(),
                F.concat(F.lit("Pattern persists across "), seen.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" usable observations (persistence "), percent(persistence), F.lit(")")),
            ).when(persistence >= 0.5, F.concat(F.lit("Not a one-frame glitch — persistence ~"), percent(persistence))),
        )
    )
    flagged = F.array(F.concat(F.lit("Flagged for review: "), lookup(kind, SIGNALS, "Visual variation")))
    return F.when(F.size(found) > 0, found).otherwise(flagged)


def recommendation(level: Column, place: Column, anomaly: Column, persistence: Column, seen: Column, signal: Column, structural: Column, appearance: Column) -> Column:
    where, score = place_label(place), percent(review_score(anomaly, persistence))
    note = F.when(F.coalesce(seen, F.lit(0)) > 0, F.concat(F.lit(" across "), seen.cast("string"), F.lit(" observations"))).otherwise("")
    action = (
        F.when((structural >= 0.5) & (structural > appearance), F.concat(F.lit("Review this area for possible crop discontinuity or sparse canopy — structural signal is stronger than color/texture"), note, F.lit(".")))
        .when(level == "high", F.concat(F.lit("Fly the "), where, F.lit(" sector on your next pass — review score "), score, note, F.lit(". Primary signal: "), signal, F.lit(".")))
        .when(level == "medium", F.concat(F.lit("Bookmark the "), where, F.lit(" area for the next flight (review score "), score, F.lit("). "), signal, F.lit(".")))
        .otherwise(F.concat(F.lit("Low-key variation in the "), where, F.lit(" — optional drive-by.")))
    )
    return F.concat(action, F.lit(" Recommended action: review this area more closely. Not a diagnosis."))


def headline(scheduled: Column, usable: Column, zones: Column, top_signal: Column, top_place: Column) -> Column:
    """top_signal is the strongest high-priority zone's, or null."""
    note = F.concat(usable.cast("string"), F.lit(" of "), scheduled.cast("string"), F.lit(" scheduled observations were usable."))
    return (
        F.when(scheduled == 0, "No observations were scheduled for this run.")
        .when(zones == 0, F.concat(F.lit("No significant inspection areas were found. "), note))
        .when(top_signal.isNotNull(), F.concat(F.lit("The strongest review target is "), F.lower(top_signal), F.lit(" in the "), top_place, F.lit(" of the field. "), note))
        .otherwise(F.concat(zones.cast("string"), F.when(zones == 1, " inspection area").otherwise(" inspection areas"), F.lit(" were flagged for review. "), note))
    )


def forbidden_claim(text: Column) -> Column:
    """The first forbidden phrase that the text holds, or null."""
    return F.coalesce(*[F.when(F.lower(text).contains(p), p) for p in FORBIDDEN])


def copy_edited(text: Column, edits: tuple[tuple[str, str], ...] = COPY_EDITS) -> Column:
    for old, new in edits:
        text = F.regexp_replace(text, f"(?i){old}", new)
    return text


def safe_path(name: Column) -> Column:
    """True for relative paths without parent steps, drive letters or disguised ones."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.coalesce((name != "") & ~path.startswith("/") & ~path.rlike("^.:") & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def path_group(name: Column) -> Column:
    """The top folder of a path, or null."""
    parts = F.split(F.trim(F.replace(name, F.lit("\\"), F.lit("/")), F.lit("/")), "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))


def drift_failures(coverage: Column, soil: Column, agreement: Column, recall: Column) -> Column:
    """Names of the drift gates that fail, in order."""
    return F.array_compact(
        F.array(F.when(coverage > 0.01, "crop_coverage"), F.when(soil > 0.01, "soil_fraction"), F.when(agreement < 0.98, "type_agreement"), F.when(recall < 1.0, "high_priority_recall"))
    )
