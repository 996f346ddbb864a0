"""Robust statistics and grids on the shapes the reference tests with."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import grid, stats


def cells(spark, f, n=6):
    return spark.createDataFrame([(1, y, x, float(f(y, x))) for y in range(n) for x in range(n)], "run int, row int, col int, value double")


def test_stripes_are_global_but_not_local(spark):
    df = cells(spark, lambda y, x: (1, 1, 5, 5, 9, 9)[x])
    got = stats.local_robust_z(stats.robust_z(df, "value", ["run"]), ["run"], radius=1).collect()
    assert max(r.z for r in got) > 0.3
    spike = cells(spark, lambda y, x: 50 if (y, x) == (2, 2) else 5)
    assert {(r.row, r.col): r.local_z for r in stats.local_robust_z(spike, ["run"]).collect()}[2, 2] > 3
    few = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 9.0), (1, 1, 0, 2.0)], "run int, row int, col int, value double")
    assert {r.local_z for r in stats.local_robust_z(few, ["run"]).collect()} == {0.0}


def test_invalid_rows_are_zero(spark):
    df = spark.createDataFrame([(1, 1.0, True), (1, 2.0, True), (1, 99.0, False), (2, None, False)], "run int, value double, valid boolean")
    got = {(r.run, r.value): r.z for r in stats.robust_z(df, "value", ["run"], valid=F.col("valid")).collect()}
    assert got[1, 99.0] == 0.0 and got[2, None] == 0.0


def test_range_gate(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(1, i, abs(rng.gauss(0, 0.05))) for i in range(36)], "run int, i int, z double")
    quiet = df.select(stats.unit_score(F.col("z"), ["run"], 1.0).alias("s")).agg(F.max("s")).first()[0]
    loud = df.select(stats.unit_score(F.col("z"), ["run"], 0.0).alias("s")).agg(F.max("s")).first()[0]
    assert quiet < 0.05 and loud > 0.3


def test_spacings(spark):
    df = spark.createDataFrame([(1, p) for p in (0.0, 10.0, 20.0, 20.5, 35.0)] + [(2, 1.0)], "row_id int, pos double")
    assert sorted(r.spacing for r in stats.spacings(df, ["row_id"], "pos").collect()) == [0.5, 10.0, 10.0, 14.5]
    s = spark.createDataFrame([(float(x),) for x in (10, 10, 10, 25, 10, 3, 10)], "spacing double")
    got = s.agg(*stats.uniformity(F.col("spacing"), F.lit(10.0))).first()
    assert got.miss_pct == pytest.approx(100 / 7) and got.multiple_pct == pytest.approx(100 / 7)
    edge = spark.createDataFrame([(15.0,), (5.0,)], "spacing double").agg(*stats.uniformity(F.col("spacing"), F.lit(10.0))).first()
    assert edge.miss_pct == 0 and edge.multiple_pct == 50
    assert s.limit(0).agg(*stats.uniformity(F.col("spacing"), F.lit(10.0))).first().miss_pct == 0


def test_median_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],), ([3.0, 4.0],), ([5.0, 4.0],)], "v array<double>")
    got = stats.median_vector(df, "v").first().baseline
    assert got == pytest.approx([3 / 5, 4 / 5])


def test_quartiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), (None, None)], "g string, x double")
    got = {r.grp: r for r in stats.group_quartiles(df, F.col("g"), F.col("x")).collect()}
    q = statistics.quantiles([1, 2, 4], n=4, method="inclusive")
    assert (got["a"].q1, got["a"].median, got["a"].q3) == (q[0], q[1], q[2])
    assert got["ungrouped"].median == 0


def test_isolation_forest_finds_the_outlier(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(40)] + [(1, 99, 12.0, -12.0)] + [(2, i, 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "run int, i int, a double, b double")
    got = stats.isolation_forest(df, ["run"], ["a", "b"], "run int, i int, a double, b double, score double").collect()
    one = [r for r in got if r.run == 1]
    assert max(one, key=lambda r: r.score).i == 99
    assert {r.score for r in got if r.run == 2} == {0.0}


def test_cell_of_inverts_bounds(spark):
    for size in (8, 100, 1081):
        b = {r.row: (r.y0, r.y1) for r in grid.bounds(spark, size, size).collect()}
        px = spark.range(size).select("id", grid.cell_of(F.col("id"), size, 8).alias("c")).collect()
        assert all(b[r.c][0] <= r.id < b[r.c][1] for r in px)


def test_units_and_costs(spark):
    kinds = [(0, 0.8, 0.0, True), (1, 0.0, 0.9, True), (2, 0.0, 0.0, False)]
    rows = [(1, y, x, *kinds[x // 2][1:3], [40.0, 150.0, 40.0], None, kinds[x // 2][3], "residue" if x > 1 else "living", 3) for y in range(3) for x in range(6)]
    df = spark.createDataFrame(rows, "run int, row int, col int, veg double, residue double, color array<double>, angle double, valid boolean, residue_class string, k int")
    edges = grid.edges(df, ["run"], ["valid", "veg", "residue", "color", "angle"]).withColumn("cost", grid.boundary_cost())
    assert edges.where("a_col = 0 AND b_col = 1 AND a_row = b_row").first().cost == 0
    assert edges.where("a_col = 1 AND b_col = 2").first().cost > 0.5
    assert {r.cost for r in edges.where("NOT b_valid").collect()} == {1.0}
    units = grid.units(df, ["run"], edges.where("cost < 0.25"))
    got = {(r.row, r.col): r.unit for r in units.collect()}
    assert len(got) == 12 and {got[y, x] for y in range(3) for x in (0, 1)} == {1} and {got[y, x] for y in range(3) for x in (2, 3)} == {2}
    summary = {r.unit: r for r in grid.unit_summary(df.join(units, ["run", "row", "col"]), ["run"], F.lit(18.0)).collect()}
    assert summary[1].cell_count == 6 and summary[1].dominant_residue == "living" and summary[1].mean_angle is None


def test_robust_z_of_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 9.0), ("a", 5.0)], "k string, v double")
    got = {(r.k, r.v): r.z for r in stats.robust_z(df, "v", ["k"]).collect()}
    assert got[None, 2.0] == got["a", 5.0] == 0 and abs(got[None, 9.0] - 7 / 1.4826) < 1e-9
