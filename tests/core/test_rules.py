"""Truth tables of the classifiers and geometry."""

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import geometry as g
from gleanspark.functions import rules as r
from gleanspark.sources.config import merged


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_consensus(spark):
    rows = spark.createDataFrame([(0.45, 0.0, 1.0, False), (0.30, 0.25, 0.5, True), (0.0, 0.40, 0.8, True), (0.0, 0.20, 0.3, False), (None, None, None, False)], "a double, s double, p double, want boolean")
    assert rows.where(r.consensus(F.col("a"), F.col("s"), F.col("p")) != F.col("want")).count() == 0


def test_places(spark):
    rows = spark.createDataFrame([(0.1, 0.1, "northwest"), (0.5, 0.5, "center"), (0.9, 0.9, "southeast"), (0.5, 0.9, "south"), (1 / 3, 2 / 3, "center")], "x double, y double, want string")
    assert rows.where(g.place(F.col("x"), F.col("y")) != F.col("want")).count() == 0


@pytest.mark.parametrize(("b", "want"), [((0.4, 0.4, 0.2, 0.2), 1.0), ((0.8, 0.8, 0.1, 0.1), 0.0), ((0.42, 0.42, 0.2, 0.2), None), ((0.4, 0.4, 0.0, 0.0), 0.0)])
def test_iou(spark, b, want):
    got = one(spark, g.iou(*map(F.lit, (0.4, 0.4, 0.2, 0.2)), *map(F.lit, b)))
    assert got == pytest.approx(want) if want is not None else got > 0.3


def test_vari_keeps_a_positive_floor(spark):
    assert one(spark, g.vari(F.lit(100.0), F.lit(50.0), F.lit(50.0))) == 0.0
    assert one(spark, g.vari(F.lit(150.0), F.lit(100.0), F.lit(50.0))) == pytest.approx((50 / 255) / 1e-6)


def test_dms_and_gps(spark):
    assert one(spark, g.dms_degrees(F.lit(40.0), F.lit(30.0), F.lit(36.0), F.lit("S"))) == pytest.approx(-40.51)
    assert one(spark, g.iso6709(F.lit("+40.1-088.5/")))["longitude"] == -88.5
    assert one(spark, g.iso6709(F.lit("40.1"))) is None
    assert one(spark, g.geojson_point(F.lit(1.0), F.lit(None).cast("double"))) is None


@pytest.mark.parametrize(("name", "safe"), [("a/b.jpg", True), ("../a", False), ("/a", False), ("C:/a", False), ("a\\..\\b", False), ("", False), ("a..b/c", True)])
def test_paths(spark, name, safe):
    assert one(spark, r.safe_path(F.lit(name))) is safe


def test_groups(spark):
    assert one(spark, r.path_group(F.lit("variation-a/x.jpg"))) == "variation-a"
    assert one(spark, r.path_group(F.lit("x.jpg"))) is None


def test_reasons_are_never_empty(spark):
    none = F.lit(None)
    got = one(spark, r.reasons({}, F.lit("color_variation"), none.cast("double"), none.cast("int"), none.cast("int")))
    assert got == ["Flagged for review: Unusual crop appearance (color)"]


def test_quality_weight(spark):
    w = r.quality_warnings(*map(F.lit, (0.04, 0.0, 0.0, 11.0)), F.lit(None).cast("double"))
    assert one(spark, w) == ["low_sharpness", "underexposed"]
    assert one(spark, r.quality_weight(F.lit(0.04), F.lit(11.0), w)) == 0.15
    w = r.quality_warnings(*map(F.lit, (0.2, 0.5, 0.0, 100.0, 0.5)))
    assert one(spark, r.quality_weight(F.lit(0.2), F.lit(100.0), w)) == 0.35


def test_drift_gate(spark):
    assert one(spark, r.drift_failures(*map(F.lit, (0.02, 0.0, 0.97, 1.0)))) == ["crop_coverage", "type_agreement"]


def test_config_merge():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert merged(base, {"a": {"b": 5}, "e": 6}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 6}
    assert base["a"]["b"] == 1
