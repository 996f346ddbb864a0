"""Fields: features of synthetic pictures, structural scores, gaps, briefs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.functions import rules
from gleanspark.operators import field
from gleanspark.sources.media import synthetic_field


def test_cell_features(spark):
    px = synthetic_field(spark, 1, 64, 64).withColumn("in_field", F.col("label") != "TREE")
    cells = field.cell_features(px, ["frame"], 64, 64).collect()
    assert len(cells) == 64
    top = [c for c in cells if c.row == 0]
    assert not any(c.valid for c in top) and all(c.occupancy == 0 for c in top)
    patch = next(c for c in cells if (c.row, c.col) == (3, 3))
    healthy = next(c for c in cells if (c.row, c.col) == (6, 6))
    assert patch.bare_soil > healthy.bare_soil and healthy.crop_coverage > patch.crop_coverage
    assert healthy.occupancy > patch.occupancy
    soil = field.understory(px, ["frame"]).first()
    assert soil.soil_fraction > 0.2 and soil.understory_fraction < 0.2


def test_gap_along_row():
    profile = np.array([0.9] * 20 + [0.1] * 5 + [0.9] * 20)
    score, before, after = field.gap_along_row(profile)
    assert score > 0.8 and before == pytest.approx(0.9) and after == pytest.approx(0.9)
    assert field.gap_along_row(np.full(40, 0.9))[0] == 0
    assert field.gap_along_row(np.full(5, np.nan)) == (0, 0, 0)


def test_texts(spark):
    lit = F.lit
    told = spark.range(1).select(
        field.brief(lit(8), lit(4.0), lit(0.5), lit(True), lit(2), lit(1), lit("north_west"), lit("Exposed Soil")).alias("b"),
        field.limitations(lit(True), lit(False), lit(False), lit("LOW"), lit(0.9)).alias("l"),
        field.limited(lit("HIGH"), lit(3), lit(8), F.array().cast("array<string>")).alias("x"),
        rules.copy_edited(lit("Pattern persists across 3 of 9 usable observations (persistence 40%)")).alias("c"),
        field.artifact_name(lit(7)).alias("n"), field.source_rate(lit(0.0)).alias("r"), field.worth_archiving(lit("a"), lit("a"), lit(100), lit(96)).alias("w"),
    ).first()
    assert "2 inspection areas" in told.b and "1 marked high priority" in told.b and "North West area (Exposed Soil)" in told.b
    assert told.l == ["segmentation_fallback", "no_field", "row_visibility_low"] and told.x
    assert told.c == "Seen in 3 of 9 usable observations" and told.n == "frame_0007.jpg" and told.r == 30.0 and told.w is False


def test_frames_and_detection(spark):
    runs = spark.createDataFrame([("a", 2), ("b", 3)], "run_id string, n_frames int")
    frames = spark.createDataFrame([("a", 0, 0.0)], "run_id string, frame int, ts_sec double")
    got = field.with_default_frames(runs, frames).orderBy("run_id", "frame").collect()
    assert [(r.run_id, r.ts_sec) for r in got] == [("a", 0.0), ("b", 0.0), ("b", 0.5), ("b", 1.0)]
    seen = spark.createDataFrame([("a", True), ("b", False)], "run_id string, detected boolean")
    assert [r.run_id for r in field.only_detected(runs, seen).collect()] == ["a"]
    areas = spark.createDataFrame([(1.0, 1.0), (4.0, 2.0), (None, 9.0)], "v double, a double")
    assert areas.agg(field.area_weighted(F.col("v"), F.col("a"))).first()[0] == 3.0


def test_superpixels(spark):
    rows = [(i, 0.1 + 0.01 * (i % 3), 0.0) for i in range(10)] + [(10 + i, 0.9, 1.0) for i in range(10)]
    got = field.superpixels(spark.createDataFrame(rows, "id int, exg double, v double"), ["exg", "v"], 2).collect()
    assert len({r.cluster for r in got if r.id < 10}) == 1 and len({r.cluster for r in got}) == 2
    named = spark.range(1).select(field.centre_name(*map(F.lit, (0.5, 0.5, 0.2, 0.0, 0.0, 0.5, 0.5))).alias("n")).first().n
    assert named == "CROP"
