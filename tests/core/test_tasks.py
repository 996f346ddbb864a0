"""Tasks grow in number with the rows, whatever the session's partitions, so that what one of them holds does not."""

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import raster, row_lines, structure


@pytest.fixture()
def pixels(spark):
    grid = spark.range(5 * 40 * 40).select((F.col("id") % 5).cast("int").alias("frame"), (F.floor(F.col("id") / 5) % 40).cast("int").alias("y"), F.floor(F.col("id") / 200).cast("int").alias("x"))
    return grid.where("x % 8 < 5")


@pytest.fixture()
def shapes(spark):
    return spark.range(5).select(F.col("id").cast("int").alias("frame"), F.lit(40).alias("height"), F.lit(40).alias("width"))


def test_votes(pixels, monkeypatch):
    want = {tuple(r) for r in row_lines.votes(pixels, ["frame"]).collect()}
    monkeypatch.setattr(row_lines, "VOTES_PER_TASK", 30_000)
    got = row_lines.votes(pixels, ["frame"])
    assert got.rdd.getNumPartitions() == 30  # 5,000 pixels, 180 votes each
    assert {tuple(r) for r in got.collect()} == want and sum(r[-1] for r in want) == 900_000


def test_lines_of_masks(pixels, shapes, monkeypatch):
    runs = raster.mask_runs(pixels, ["frame"])
    want = {tuple(r) for r in raster.cleaned(runs, ["frame"], shapes).collect()}
    monkeypatch.setattr(raster, "RUNS_PER_TASK", 100)
    got = raster.cleaned(runs, ["frame"], shapes)
    assert got.rdd.getNumPartitions() == 12  # 200 lines and 1,000 runs
    assert {tuple(r) for r in got.collect()} == want


def test_probes(pixels, shapes, monkeypatch):
    values, angles = pixels.withColumn("value", F.lit(0.9)), shapes.select("frame", F.lit(30.0).alias("angle"))
    want = {tuple(r) for r in structure.continuity(values, angles, ["frame"], shapes).collect()}
    monkeypatch.setattr(structure, "ROWS_PER_TASK", 1_000)
    got = structure.continuity(values, angles, ["frame"], shapes)
    assert got.rdd.getNumPartitions() == 11  # 5,000 pixels, about 5 * 64 * 16 probes
    assert {tuple(r) for r in got.collect()} == want and len(want) == 320
