"""Registered queries of pictures, fields, runs and catalogs, each beside its SQL. Pixels are made from the rows of lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import geometry, rules
from gleanspark.operators import catalog, field, grid, matching, pixels, runs, stats
from gleanspark.plans import report
from gleanspark.plans.queries import query, r6
from gleanspark.session import table
from gleanspark.sources import media

HEIGHT, WIDTH = 24, 32

PIXELS = """
pixels AS (
  SELECT CAST(l_orderkey // 1000 AS INT) AS frame, CAST(l_partkey % 24 AS INT) AS y, CAST(l_suppkey % 32 AS INT) AS x,
         CAST(8 * floor(arg_min(l_quantity, l_orderkey) * 0.6) AS INT) AS b, CAST(8 * floor(arg_min(l_discount, l_orderkey) * 300) AS INT) AS g, CAST(8 * floor(arg_min(l_tax, l_orderkey) * 250) AS INT) AS r,
         CASE arg_min(l_returnflag, l_orderkey) WHEN 'A' THEN 'CROP' WHEN 'R' THEN 'BARE_SOIL' ELSE (CASE WHEN arg_min(l_quantity, l_orderkey) > 40 THEN 'ROAD_PATH' ELSE 'CROP' END) END AS label,
         (l_partkey % 24 + 2 * (l_suppkey % 32)) % 9 <> 0 AS in_field
  FROM (SELECT DISTINCT ON (l_partkey % 24, l_suppkey % 32, l_orderkey) * FROM lineitem ORDER BY l_partkey % 24, l_suppkey % 32, l_orderkey, l_partkey, l_suppkey, l_linenumber)
  GROUP BY l_orderkey // 1000, l_partkey % 24, l_suppkey % 32)"""
OCCUPANCY = """
px_p AS (SELECT *, (2 * g - r - b) / 255.0 AS exg FROM pixels),
px_q AS (SELECT *, CASE WHEN exg > 0.05 THEN 1.0 ELSE 0.0 END AS veg, CASE WHEN label = 'CROP' THEN 1.0 ELSE 0.0 END AS crop,
  least(greatest((exg - min(exg) OVER f) / (max(exg) OVER f - min(exg) OVER f + 1e-6), 0.0), 1.0) AS n FROM px_p WINDOW f AS (PARTITION BY frame)),
px_s AS (SELECT *, 0.25 * crop + 0.45 * veg + 0.30 * n AS soft FROM px_q),
occ AS (SELECT * EXCLUDE (soft, n, crop), CASE WHEN NOT in_field OR label IN ('ROAD_PATH', 'TREE_VEGETATION', 'WATER', 'INFRASTRUCTURE') THEN 0.0
  ELSE least(greatest(CASE WHEN crop > 0.4 AND veg < 0.35 THEN least(soft, 0.6 * veg + 0.4 * n) ELSE soft END, 0.0), 1.0) END AS occupancy FROM px_s)"""


def pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, y, x, b, g, r, label, in_field: colours that are never halves of gray. A frame is a thousand orders, so that their number grows with the table."""
    keys = [F.floor(F.col("l_orderkey") / 1000).cast("int").alias("frame"), (F.col("l_partkey") % HEIGHT).cast("int").alias("y"), (F.col("l_suppkey") % WIDTH).cast("int").alias("x")]
    first = lambda c: F.min_by(c, F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    colour = lambda c, k: (8 * F.floor(first(c) * k)).cast("int")
    flag = first("l_returnflag")
    label = F.when(flag == "A", "CROP").when(flag == "R", "BARE_SOIL").when(first("l_quantity") > 40, "ROAD_PATH").otherwise("CROP")
    p = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(colour("l_quantity", 0.6).alias("b"), colour("l_discount", 300).alias("g"), colour("l_tax", 250).alias("r"), label.alias("label"))
    return p.withColumn("in_field", (F.col("y") + 2 * F.col("x")) % 9 != 0)


def rounded(df: DataFrame, *plain: str) -> DataFrame:
    """df with every column but ``plain`` to six places."""
    return df.select(*[F.col(c) if c in plain else r6(c).alias(c) for c in df.columns])


def sql_rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


# ---------------------------------------------------------------- pixels and cells


@query(f"""WITH {PIXELS}, e AS (SELECT *, (2 * g - r - b) / 255.0 AS exg FROM pixels)
SELECT frame, {", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("b", "g", "r", "exg"))}, round(avg(CASE WHEN exg > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS veg_fraction FROM e GROUP BY frame""")
def pixel_colour_stats(spark, sf_dir):
    return rounded(pixels.colour_stats(pixel_table(spark, sf_dir), ["frame"]), "frame")


@query(f"WITH {PIXELS} SELECT frame, {', '.join(f'round(avg(CAST(label = {chr(39)}{c}{chr(39)} AS INT)), 6) AS {c.lower()}' for c in ('CROP', 'BARE_SOIL', 'ROAD_PATH', 'WATER'))} FROM pixels GROUP BY frame")
def pixel_class_shares(spark, sf_dir):
    return rounded(pixels.class_shares(pixel_table(spark, sf_dir), ["frame"], "label", ["CROP", "BARE_SOIL", "ROAD_PATH", "WATER"]), "frame")


@query(f"WITH {PIXELS}, {OCCUPANCY} SELECT frame, y, x, {sql_rounded('exg veg occupancy')} FROM occ")
def occupancy_map(spark, sf_dir):
    return rounded(field.with_occupancy(pixel_table(spark, sf_dir), ["frame"]).select("frame", "y", "x", "exg", "veg", "occupancy"), "frame", "y", "x")


_mean = lambda c: f"coalesce(avg({c}) FILTER (in_field), 0.0)"
FEATURES = f"""
cl AS (SELECT *, CAST(least(floor(((y + 1) * 8 - 1) / 24.0), 7) AS INT) AS row, CAST(least(floor(((x + 1) * 8 - 1) / 32.0), 7) AS INT) AS col FROM occ),
cf AS (SELECT frame, row, col, avg(CAST(in_field AS INT)) AS field_fraction, {_mean("CAST(label = 'CROP' AS INT)")} AS crop_coverage, {_mean("CAST(label = 'BARE_SOIL' AS INT)")} AS bare_soil,
  {_mean("exg")} AS exg_mean, {_mean("veg")} AS veg_frac, {_mean("occupancy")} AS occupancy, {_mean("b")} AS b_mean, {_mean("g")} AS g_mean, {_mean("r")} AS r_mean FROM cl GROUP BY ALL),
wf AS (SELECT frame, avg(CAST(in_field AND label = 'CROP' AS INT)) AS cov, {_mean("exg")} AS we, {_mean("veg")} AS wv FROM occ GROUP BY frame),
features AS (SELECT cf.*, crop_coverage - cov AS coverage_delta, abs(veg_frac - wv) AS vegetation_difference, abs(exg_mean - we) AS exg_difference, field_fraction >= 0.25 AS valid FROM cf JOIN wf USING (frame))"""
FEATURE_NAMES = "field_fraction crop_coverage bare_soil exg_mean veg_frac occupancy b_mean g_mean r_mean coverage_delta vegetation_difference exg_difference"


@query(f"WITH {PIXELS}, {OCCUPANCY}, {FEATURES} SELECT frame, row, col, valid, {sql_rounded(FEATURE_NAMES)} FROM features")
def cell_features(spark, sf_dir):
    return rounded(field.cell_features(pixel_table(spark, sf_dir), ["frame"], HEIGHT, WIDTH), "frame", "row", "col", "valid")


UNDERSTORY = """
us AS (SELECT frame, coalesce(avg(CAST(label = 'BARE_SOIL' AS INT)) FILTER (in_field), 0.0) AS soil_fraction,
  coalesce(avg(CAST((2 * g - r - b) / 255.0 > 0.05 AS INT)) FILTER (in_field AND label = 'BARE_SOIL'), 0.0) AS understory_fraction,
  coalesce(avg(CAST(label = 'BARE_SOIL' AND (2 * g - r - b) / 255.0 > 0.05 AS INT)) FILTER (in_field), 0.0) AS vegetated_soil_of_field FROM pixels GROUP BY frame)"""


@query(f"WITH {PIXELS}, {UNDERSTORY} SELECT frame, {sql_rounded('soil_fraction understory_fraction vegetated_soil_of_field')} FROM us")
def understory_shares(spark, sf_dir):
    return rounded(field.understory(pixel_table(spark, sf_dir), ["frame"]), "frame")


@query(f"""WITH {PIXELS}, {OCCUPANCY}, {UNDERSTORY},
v AS (SELECT *, (g - r) / 255.0 / (CASE WHEN abs((g + r - b) / 255.0) <= 1e-6 THEN 1e-6 ELSE (g + r - b) / 255.0 END) AS vari FROM occ),
m AS (SELECT frame, avg(exg) FILTER (in_field) AS exg_mean, avg(vari) FILTER (in_field) AS vari_mean, avg(occupancy) FILTER (in_field) AS crop_occupancy FROM v GROUP BY frame)
SELECT frame, round(exg_mean, 6) AS exg_mean, round(vari_mean, 2) AS vari_mean, {sql_rounded('crop_occupancy soil_fraction understory_fraction vegetated_soil_of_field')} FROM m JOIN us USING (frame)""")
def shadow_observation(spark, sf_dir):
    seen = field.observation(field.with_occupancy(pixel_table(spark, sf_dir), ["frame"]), ["frame"])
    return rounded(seen.withColumn("vari_mean", F.round("vari_mean", 2)), "frame", "vari_mean")


COLOURS = """
cm_v AS (SELECT *, (2 * g - r - b) / 255.0 AS exg, greatest(b, g, r) AS v, CASE WHEN greatest(b, g, r) = 0 THEN 0.0 ELSE (greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r) * 255 END AS s, x % 4 = 0 AS edge, x * 20.0 AS var FROM pixels),
cm_c AS (SELECT *, exg > 0.05 AND g > r AND g > b * 0.9 AND v > 30 AS crop FROM cm_v),
cm_b AS (SELECT *, exg < 0.02 AND s < 80 AND v > 40 AND v < 210 AND NOT crop AS bare, b > r AND b > g AND s > 40 AND v < 160 AND exg < 0.05 AS water FROM cm_c),
named AS (SELECT frame, CASE WHEN s < 40 AND edge AND v > 80 AND NOT crop AND NOT water THEN 'INFRASTRUCTURE' WHEN water THEN 'WATER' WHEN bare AND edge AND v > 50 AND v < 180 THEN 'ROAD_PATH'
  WHEN exg > 0.02 AND v < 90 AND var > 200 AND g > r AND NOT crop THEN 'TREE_VEGETATION' WHEN bare AND NOT (edge AND v > 50 AND v < 180) THEN 'BARE_SOIL' WHEN crop THEN 'CROP' ELSE 'UNKNOWN' END AS class FROM cm_b)"""


@query(f"WITH {PIXELS}, {COLOURS} SELECT frame, class, count(*) AS n FROM named GROUP BY ALL")
def colour_classes(spark, sf_dir):
    p = pixel_table(spark, sf_dir)
    name = pixels.colour_class(F.col("b"), F.col("g"), F.col("r"), F.col("x") % 4 == 0, F.col("x") * 20.0)
    return p.groupBy("frame", name.alias("class")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_linenumber AS frame, l_partkey % 24 AS y, l_suppkey % 32 AS x, l_returnflag AS label, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 AS ord FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY frame, y, x ORDER BY (CASE label WHEN 'A' THEN 1 WHEN 'R' THEN 3 ELSE -1 END) DESC, ord DESC) AS nth FROM m)
SELECT frame, y, x, label FROM k WHERE nth = 1""")
def mask_priority(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % HEIGHT).alias("y"), (F.col("l_suppkey") % WIDTH).alias("x"), F.col("l_returnflag").alias("label"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("ord"),
    )
    return pixels.strongest_label(m, ["frame", "y", "x"], "label", {"A": 1, "R": 3}, "ord")


LINES = """
lines AS (SELECT frame, (frame * 7 + k * 23) % 180 + 1.3 AS angle, k * 9.0 + 0.7 AS ofs FROM (SELECT DISTINCT CAST(l_orderkey // 1000 AS INT) AS frame FROM lineitem), range(3) AS r(k)),
away AS (SELECT p.frame, y, x, g, r, b, ofs, abs(x * cos(radians(angle - 90.0)) + y * sin(radians(angle - 90.0)) - ofs) AS d FROM pixels p JOIN lines USING (frame)),
near AS (SELECT frame, y, x, any_value(g) AS g, any_value(r) AS r, any_value(b) AS b, CASE WHEN min(d) <= 5 THEN arg_min(ofs, d) END AS line_offset FROM away GROUP BY frame, y, x)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines in each picture."""
    frames = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).cast("int").alias("frame")).distinct()
    each = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return each.select("frame", ((F.col("frame") * 7 + F.col("k") * 23) % 180 + 1.3).alias("angle"), (F.col("k") * 9.0 + 0.7).alias("offset"))


@query(f"WITH {PIXELS}, {LINES} SELECT frame, y, x, round(line_offset, 6) AS line_offset FROM near")
def nearest_row_line(spark, sf_dir):
    return pixels.nearest_line(pixel_table(spark, sf_dir), _lines(spark, sf_dir), ["frame"], 5.0).select("frame", "y", "x", r6("line_offset").alias("line_offset"))


@query(f"""WITH {PIXELS}, {LINES}, g AS (SELECT *, line_offset IS NULL AS between_rows, (2 * g - r - b) / 255.0 > 0.05 AS green FROM near)
SELECT frame, round(avg(CAST(NOT between_rows AS INT)), 6) AS row_band_fraction, round(avg(CAST(between_rows AS INT)), 6) AS inter_row_fraction,
  round(coalesce(avg(CAST(green AS INT)) FILTER (between_rows), 0.0), 6) AS inter_row_vegetation, round(avg(CAST(between_rows AND green AS INT)), 6) AS visible_inter_row_vegetation FROM g GROUP BY frame""")
def inter_row_vegetation(spark, sf_dir):
    return rounded(field.inter_row(pixel_table(spark, sf_dir), _lines(spark, sf_dir), ["frame"], 5.0), "frame")


# ---------------------------------------------------------------- pictures

GRAYS = """
fr AS (SELECT DISTINCT frame FROM pixels),
gr AS (SELECT fr.frame, CAST(a.i AS INT) AS y, CAST(c.i AS INT) AS x, round_even(0.114 * coalesce(b, 0) + 0.587 * coalesce(g, 0) + 0.299 * coalesce(r, 0), 0) AS v
  FROM fr CROSS JOIN range(24) a(i) CROSS JOIN range(32) c(i) LEFT JOIN pixels p ON p.frame = fr.frame AND p.y = a.i AND p.x = c.i),
near9 AS (SELECT g.frame, g.y, g.x, any_value(g.v) AS v, sum(n.v * (CASE WHEN d.i = 0 AND e.i = 0 THEN -4 WHEN d.i = 0 OR e.i = 0 THEN 1 ELSE 0 END)) AS laplace,
  sum(n.v * e.i * (CASE d.i WHEN 0 THEN 2 ELSE 1 END)) AS gx, sum(n.v * d.i * (CASE e.i WHEN 0 THEN 2 ELSE 1 END)) AS gy
  FROM gr g CROSS JOIN range(-1, 2) d(i) CROSS JOIN range(-1, 2) e(i)
  JOIN gr n ON n.frame = g.frame AND n.y = (CASE g.y + d.i WHEN -1 THEN 1 WHEN 24 THEN 22 ELSE g.y + d.i END) AND n.x = (CASE g.x + e.i WHEN -1 THEN 1 WHEN 32 THEN 30 ELSE g.x + e.i END)
  GROUP BY g.frame, g.y, g.x)"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, height, width, data of each frame's pixels; places without a pixel are black."""
    p = pixel_table(spark, sf_dir).withColumn("place", F.col("y") * WIDTH + F.col("x"))
    frames = p.select("frame").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT * WIDTH - 1))))
    two = lambda c: F.lpad(F.hex(F.coalesce(c, F.lit(0))), 2, "0")
    every = frames.join(p, ["frame", "place"], "left").select("frame", "place", F.concat(two("b"), two("g"), two("r")).alias("bgr"))
    listed = every.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("place", "bgr"))).alias("all"))
    data = F.unhex(F.array_join(F.transform("all", lambda s: s["bgr"]), ""))
    return listed.select(F.format_string("frame_%d", "frame").alias("path"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), data.alias("data"))


@query(f"""WITH {PIXELS}, {GRAYS}, m AS (SELECT frame, avg(v) AS mean, avg(CAST(v < 15 AS INT)) AS black, avg(CAST(v > 245 AS INT)) AS white, var_pop(laplace) AS lv FROM near9 GROUP BY frame)
SELECT 'frame_' || frame AS path, round(least(greatest(ln(1 + lv) / ln(801), 0.0), 1.0), 6) AS sharpness, round(mean, 6) AS mean_luminance, round(black, 6) AS near_black, round(white, 6) AS saturated,
  round(least(greatest((1 - least(abs(mean - 128) / 128, 1)) * (1 - 0.7 * least(1, black + white)), 0.0), 1.0), 6) AS exposure FROM m""")
def frame_quality(spark, sf_dir):
    return rounded(pixels.quality(_pictures(spark, sf_dir)), "path")


@query(f"""WITH {PIXELS}, {GRAYS}, h AS (SELECT frame, floor(v / 8) AS bin, count(*) / 6144.0 AS d FROM gr GROUP BY ALL), en AS (SELECT frame, -sum(d * log2(d)) / 5 AS e FROM h GROUP BY frame)
SELECT 'frame_' || frame AS path, round(var_pop(v) / 65025.0, 6) AS variance, round(avg(sqrt(gx * gx + gy * gy)) / 255, 6) AS sobel, round(avg(CAST(sqrt(gx * gx + gy * gy) > 150 AS INT)), 6) AS edge_density,
  round(least(greatest(any_value(e), 0.0), 1.0), 6) AS entropy FROM near9 JOIN en USING (frame) GROUP BY frame""")
def picture_texture(spark, sf_dir):
    return rounded(pixels.textures(_pictures(spark, sf_dir)), "path")


@query(f"""WITH {PIXELS}, {GRAYS}, t AS (SELECT frame, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gx * gy) AS xy FROM near9 GROUP BY frame)
SELECT 'frame_' || frame AS path, round((degrees(0.5 * atan2(2 * xy, xx - yy)) + 90) % 180, 6) AS angle, round(sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy), 6) AS coherence FROM t""")
def picture_orientation(spark, sf_dir):
    return rounded(pixels.orientations(_pictures(spark, sf_dir)), "path")


@query(f"WITH {PIXELS}, {GRAYS} SELECT 'frame_' || frame AS path, count(*) AS n, CAST(sum(coalesce(p.b, 0) + 2 * coalesce(p.g, 0) + 3 * coalesce(p.r, 0) + y * x) AS BIGINT) AS check_sum FROM gr LEFT JOIN pixels p USING (frame, y, x) GROUP BY frame")
def picture_pixels(spark, sf_dir):
    rows = pixels.pixel_rows(_pictures(spark, sf_dir))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("b") + 2 * F.col("g") + 3 * F.col("r") + F.col("y") * F.col("x")).alias("check_sum"))


# ---------------------------------------------------------------- units

UNIT_CELLS = f"{PIXELS}, {OCCUPANCY}, {FEATURES}, uc AS (SELECT *, CAST(row // 3 + 3 * (col // 4) AS INT) AS unit, CASE WHEN (row + col) % 3 = 0 THEN 'likely_residue' ELSE 'unknown' END AS residue_class, 10.0 * col + row AS angle FROM features)"


def _unit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = field.cell_features(pixel_table(spark, sf_dir), ["frame"], HEIGHT, WIDTH)
    kind = F.when((F.col("row") + F.col("col")) % 3 == 0, "likely_residue").otherwise("unknown")
    unit = (F.floor(F.col("row") / 3) + 3 * F.floor(F.col("col") / 4)).cast("int")
    return cells.withColumns({"unit": unit, "residue_class": kind, "angle": 10.0 * F.col("col") + F.col("row")})


@query(f"""WITH {UNIT_CELLS}, k AS (SELECT frame, unit, residue_class, count(*) AS n, min(row * 8 + col) AS seen FROM uc GROUP BY ALL),
d AS (SELECT frame, unit, residue_class AS dominant_residue FROM (SELECT *, row_number() OVER (PARTITION BY frame, unit ORDER BY n DESC, seen) AS nth FROM k) WHERE nth = 1)
SELECT frame, unit, dominant_residue, count(*) AS cell_count, round(count(*) / 64.0, 6) AS area_fraction, round(avg(veg_frac), 6) AS mean_veg, round(avg(angle), 6) AS mean_angle FROM uc JOIN d USING (frame, unit) GROUP BY ALL""")
def unit_statistics(spark, sf_dir):
    return rounded(grid.unit_summary(_unit_cells(spark, sf_dir).withColumnRenamed("veg_frac", "veg"), ["frame"], F.lit(64.0)), "frame", "unit", "dominant_residue", "cell_count")


@query(f"""WITH {UNIT_CELLS} SELECT frame, unit, count(*) AS n_pixels, count(*) FILTER (p.label = 'CROP') AS crop_pixels FROM cl p JOIN uc USING (frame, row, col) WHERE p.in_field GROUP BY ALL""")
def unit_footprints(spark, sf_dir):
    inside = field.unit_pixels(pixel_table(spark, sf_dir), _unit_cells(spark, sf_dir), ["frame"], HEIGHT, WIDTH)
    return inside.groupBy("frame", "unit").agg(F.count("*").alias("n_pixels"), F.count_if("crop_pixel").alias("crop_pixels"))


@query(f"""WITH {UNIT_CELLS}, u AS (SELECT frame, unit, CASE WHEN unit % 4 = 0 THEN 'bare_soil' ELSE 'active_crop' END AS kind, unit / 7.0 AS confidence, count(*) FILTER (p.label = 'CROP') AS crop_pixels
  FROM cl p JOIN uc USING (frame, row, col) WHERE p.in_field GROUP BY ALL)
SELECT frame, unit, CASE WHEN kind <> 'active_crop' THEN 'unit_type=' || kind || ', not ACTIVE_CROP' WHEN confidence < 0.3 THEN 'confidence=' || printf('%.2f', confidence) || ' below min_confidence=0.3'
  WHEN crop_pixels < 70 THEN 'only ' || crop_pixels || 'px of crop-plant area, below the 70px floor' END AS skipped FROM u""")
def unit_row_skips(spark, sf_dir):
    inside = field.unit_pixels(pixel_table(spark, sf_dir), _unit_cells(spark, sf_dir), ["frame"], HEIGHT, WIDTH).groupBy("frame", "unit").agg(F.count_if("crop_pixel").alias("crop_pixels"))
    kind, confidence = F.when(F.col("unit") % 4 == 0, "bare_soil").otherwise("active_crop"), F.col("unit") / 7.0
    return inside.select("frame", "unit", runs.skipped_unit(kind, confidence, F.col("crop_pixels"), least_pixels=70).alias("skipped"))


@query(f"""WITH {UNIT_CELLS} SELECT frame, row, col, round(CASE WHEN unit % 2 = 0 THEN unit * 11.0 ELSE frame * 13.0 END, 6) AS row_angle FROM uc""")
def unit_row_angles(spark, sf_dir):
    cells = _unit_cells(spark, sf_dir)
    units = cells.select("frame", "unit").distinct().select("frame", "unit", F.when(F.col("unit") % 2 == 0, F.col("unit") * 11.0).alias("angle"))
    frames = cells.select("frame").distinct().withColumn("angle", F.col("frame") * 13.0)
    return field.with_row_angle(cells.drop("angle"), units, frames, ["frame"]).select("frame", "row", "col", r6("row_angle").alias("row_angle"))


@query(f"WITH {UNIT_CELLS} SELECT frame, round(sum(CASE WHEN unit <> 4 THEN veg_frac * field_fraction END) / nullif(sum(CASE WHEN unit <> 4 THEN field_fraction END), 0), 6) AS weighted_veg FROM uc GROUP BY frame")
def area_weighted_vegetation(spark, sf_dir):
    value = F.when(F.col("unit") != 4, F.col("veg_frac"))
    return _unit_cells(spark, sf_dir).groupBy("frame").agg(r6(field.area_weighted(value, F.col("field_fraction"))).alias("weighted_veg"))


# ---------------------------------------------------------------- rules over rows

SHARES = "l_orderkey, l_linenumber, (l_quantity - 1) / 49.0 AS a, l_discount * 10 AS d, l_tax * 12.5 AS t"


def _with_shares(lines: DataFrame) -> DataFrame:
    """lineitem with shares from 0 to 1: a, d, t."""
    return lines.withColumns({"a": (F.col("l_quantity") - 1) / 49.0, "d": F.col("l_discount") * 10, "t": F.col("l_tax") * 12.5})


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_shares(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "a", "d", "t")


@query(f"""WITH s AS (SELECT {SHARES} FROM lineitem), c AS (SELECT *, a * 0.2 - 0.1 AS exg FROM s)
SELECT CASE WHEN exg > 0.06 AND a > 0.15 THEN 'CROP' WHEN exg > 0.02 AND a < 0.35 AND t > 0.08 THEN 'TREE_VEGETATION' WHEN exg < 0.0 AND t > d AND a < 0.55 AND d > 0.15 THEN 'WATER'
  WHEN d < 0.2 AND t > 0.12 AND a > 0.3 THEN 'INFRASTRUCTURE' WHEN exg < 0.04 AND d < 0.4 THEN 'BARE_SOIL' WHEN exg > 0.02 THEN 'CROP' ELSE 'UNKNOWN' END AS class, count(*) AS n FROM c GROUP BY 1""")
def centre_names(spark, sf_dir):
    name = field.centre_name(F.col("d"), F.col("a"), F.col("a") * 0.2 - 0.1, F.col("t"), F.col("t"), F.col("d"), F.col("t"))
    return _shares(spark, sf_dir).groupBy(name.alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT {SHARES} , l_partkey FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey % 20 ORDER BY a DESC, l_orderkey, l_linenumber) AS nth FROM s)
SELECT l_orderkey, l_linenumber, nth, CASE WHEN t - 0.5 > 0.05 AND a * 255 < 160 THEN 'WATER' WHEN a * 0.2 - 0.1 > 0.06 AND a * 255 < 95 AND t * 500 > 180 THEN 'TREE_VEGETATION' WHEN a * 0.2 - 0.1 > 0.04 THEN 'CROP'
  WHEN d * 255 < 55 AND t * 500 > 250 AND d < 0.15 THEN 'INFRASTRUCTURE' WHEN d * 255 < 90 AND a * 255 > 40 AND a * 255 < 190 AND (d < 0.12 OR (l_partkey % 50 >= 20 AND ((l_partkey % 30) / greatest(l_partkey % 7, 1) > 3.0 OR (l_partkey % 7) / greatest(l_partkey % 30, 1) > 3.0))) THEN 'ROAD_PATH'
  WHEN a * 0.2 - 0.1 < 0.03 THEN 'BARE_SOIL' ELSE 'CROP' END AS name FROM k WHERE nth <= 40""")
def mask_names(spark, sf_dir):
    masks = _shares(spark, sf_dir).withColumn("picture", F.col("l_orderkey") % 20)
    top = runs.largest_masks(masks, ["picture"], "a", ["l_orderkey", "l_linenumber"])
    p = F.col("l_partkey")
    name = runs.mask_name(F.col("a") * 0.2 - 0.1, F.col("d") * 255, F.col("a") * 255, F.col("t") - 0.5, F.col("t") * 500, F.col("d"), runs.long_mask(p % 50, p % 30, p % 7))
    return top.select("l_orderkey", "l_linenumber", F.col("nth").cast("long").alias("nth"), name.alias("name"))


@query(f"""WITH s AS (SELECT {SHARES} FROM lineitem), m AS (SELECT l_orderkey, avg(a) / 40 AS c, avg(d) / 40 AS o, 1 - avg(t) / 20 AS g, CASE WHEN min(t) > 0.2 THEN 0.5 ELSE 1.0 END AS h FROM s GROUP BY 1)
SELECT l_orderkey, concat_ws(',', CASE WHEN c > 0.01 THEN 'crop_coverage' END, CASE WHEN o > 0.01 THEN 'soil_fraction' END, CASE WHEN g < 0.98 THEN 'type_agreement' END, CASE WHEN h < 1 THEN 'high_priority_recall' END) AS failures FROM m""")
def drift_gate(spark, sf_dir):
    """Many means lie exactly on a bar, where the order of adding decides: here always the table's own, as in the SQL on one thread. An order's lines are few."""
    place = table(spark, sf_dir, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    s = _with_shares(place).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("at", "a", "d", "t"))).alias("lines"), F.min("t").alias("least"))
    mean = lambda c: stats.serial_mean(F.col(f"lines.{c}"))
    failures = rules.drift_failures(mean("a") / 40, mean("d") / 40, 1 - mean("t") / 20, F.when(F.col("least") > 0.2, 0.5).otherwise(1.0))
    return s.select("l_orderkey", F.array_join(failures, ",").alias("failures"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus = 'P' AS fallback, o_orderkey % 3 = 0 AS heuristic, o_orderkey % 5 <> 0 AS detected, CASE o_orderkey % 4 WHEN 0 THEN 'LOW' ELSE 'HIGH' END AS visibility, (o_orderkey % 10) / 10.0 AS registration, o_custkey % 12 AS usable FROM orders),
l AS (SELECT *, concat_ws(',', CASE WHEN fallback THEN 'segmentation_fallback' END, CASE WHEN heuristic THEN 'heuristic_embeddings' END, CASE WHEN NOT detected THEN 'no_field' END, CASE WHEN visibility = 'LOW' THEN 'row_visibility_low' END, CASE WHEN registration < 0.3 THEN 'low_registration' END) AS notes FROM o)
SELECT o_orderkey, notes, visibility = 'LOW' OR usable / 12.0 < 0.5 OR regexp_matches(notes, 'quality|visibility|registration|fallback') AS limited FROM l""")
def run_limitations(spark, sf_dir):
    k = F.col("o_orderkey")
    visibility = F.when(k % 4 == 0, "LOW").otherwise("HIGH")
    notes = field.limitations(F.col("o_orderstatus") == "P", k % 3 == 0, k % 5 != 0, visibility, (k % 10) / 10.0)
    o = table(spark, sf_dir, "orders").select("o_orderkey", notes.alias("notes"), visibility.alias("visibility"), (F.col("o_custkey") % 12).alias("usable"))
    return o.select("o_orderkey", F.array_join("notes", ",").alias("notes"), field.limited(F.col("visibility"), F.col("usable"), F.lit(12), F.col("notes")).alias("limited"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'We reviewed ' || o_custkey || ' frames from a ' || (o_orderkey % 60) || 's clip but could not estimate a clear analysis field boundary. {field.HIDDEN_FIELD}'
  WHEN o_orderkey % 4 = 0 THEN '{field.NOTHING_FOUND} Estimated crop coverage in the analyzed area: ' || (o_custkey % 100) || '%.'
  ELSE 'After ' || o_custkey || ' frames (' || (o_orderkey % 60) || 's of flight), estimated crop coverage is about ' || (o_custkey % 100) || '%. ' || (o_orderkey % 4) || ' inspection areas may be worth a closer look'
  || (CASE WHEN o_orderkey % 3 > 0 THEN ' — ' || (o_orderkey % 3) || ' marked high priority' ELSE '' END) || '. The most notable is in the ' || (CASE o_orderstatus WHEN 'O' THEN 'North West' ELSE 'Center' END)
  || ' area (stand gap). These are image-based differences for review, not diagnoses of crop health, yield, or planting failure.' END AS brief FROM orders""")
def field_brief(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = F.when(F.col("o_orderstatus") == "O", "north_west").otherwise("center")
    text = field.brief(c, (k % 60).cast("double"), (c % 100) / 100.0, k % 5 != 0, k % 4, k % 3, place, F.lit("stand gap"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("brief"))


@query("""SELECT p_partkey, round(p_size / 60.0, 6) AS cx, round((p_size + 4) / 2.0 / 40, 6) AS cy, round(p_size * 2 / 60.0 / 2, 6) AS x, round((p_partkey % 7) / 3.0, 6) AS mid_x,
  round(CASE WHEN p_size % 5 = 0 THEN 0 ELSE (640 - (p_size % 5) * 100 * least(640 / ((p_size % 5) * 100.0), 480 / 300.0)) / 2 END + 0.25 * (CASE WHEN p_size % 5 = 0 THEN 640 ELSE (p_size % 5) * 100 * least(640 / ((p_size % 5) * 100.0), 480 / 300.0) END), 6) AS box_x FROM part""")
def box_mapping(spark, sf_dir):
    s = F.col("p_size").cast("double")
    box = geometry.normalised_box(s, s, s, F.lit(4.0), F.lit(60.0), F.lit(40.0))
    frame = geometry.letterbox((F.col("p_size") % 5) * 100.0, F.lit(300.0), F.lit(640.0), F.lit(480.0))
    mapped = geometry.mapped_box({c: F.lit(0.25) for c in "xywh"}, frame)
    mid, _ = geometry.line_midpoint(F.lit(0.0), F.lit(0.0), (F.col("p_partkey") % 7) * 2 / 3.0, F.lit(1.0))
    return table(spark, sf_dir, "part").select("p_partkey", r6(box["cx"]).alias("cx"), r6(box["cy"]).alias("cy"), r6(box["x"]).alias("x"), r6(mid).alias("mid_x"), r6(mapped["x"]).alias("box_x"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings), v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM e)
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x / (n + 1e-8)) * (x / (n + 1e-8))))), 6) AS length, round(embedding[1] / (n + 1e-8), 6) AS first,
  round(sqrt(((embedding[1] - embedding[4]) / 255.0) ** 2 + ((embedding[2] - embedding[5]) / 255.0) ** 2 + ((embedding[3] - embedding[6]) / 255.0) ** 2), 6) AS lab FROM v""")
def unit_vectors(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).select("vec_id", "e", geometry.l2_normalised(F.col("e")).alias("u"))
    at = lambda i: F.get("e", F.lit(i))
    lab = geometry.lab_distance((at(0), at(1), at(2)), (at(3), at(4), at(5)))
    return v.select("vec_id", r6(geometry.norm(F.col("u"))).alias("length"), r6(F.get("u", F.lit(0))).alias("first"), r6(lab).alias("lab"))


@query("""SELECT event_id, concat_ws(' ', CASE WHEN event_id % 4 > 0 THEN (user_id % 4) || ' of ' || (event_id % 4) || ' scheduled observations were usable for analysis.' END, CASE WHEN event_type <> 'click' THEN 'Observed in ' || event_type || '.' END,
  CASE WHEN (event_id % 7) / 10.0 > 0 THEN 'Crop coverage is lower here by roughly ' || ((event_id % 7) * 10) || '% relative to nearby field structure.' END,
  CASE WHEN (event_id % 3) / 10.0 > 0 THEN 'Visible soil is higher here by roughly ' || ((event_id % 3) * 10) || '% relative to nearby field structure.' END) AS findings FROM events""")
def key_findings(spark, sf_dir):
    e, seen = F.col("event_id"), F.when(F.col("event_type") != "click", F.col("event_type")).otherwise("")
    found = runs.key_findings(e % 4, F.col("user_id") % 4, seen, (e % 7) / 10.0, (e % 3) / 10.0)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, " ").alias("findings"))


# ---------------------------------------------------------------- runs, jobs, catalogs

ZONES = """
zones AS (SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS zone_id, l_discount * 10 AS review, l_tax * 12 AS anomaly,
  CASE WHEN l_discount * 10 >= 0.62 THEN 'high' WHEN l_discount * 10 >= 0.38 THEN 'medium' ELSE 'low' END AS priority FROM lineitem)"""


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("zone_id"), (F.col("l_discount") * 10).alias("review"), (F.col("l_tax") * 12).alias("anomaly"))
    return z.withColumn("priority", rules.priority(F.col("review")))


@query(f"""WITH {ZONES}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (CASE WHEN review <> 0 THEN review ELSE anomaly END) DESC, zone_id) AS nth FROM zones)
SELECT run_id, count(*) AS zones, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority = 'low') AS low, any_value(zone_id) FILTER (nth = 1) AS top_zone FROM k GROUP BY run_id""")
def run_counts(spark, sf_dir):
    return runs.run_counts(_zones(spark, sf_dir), ["run_id"], "zone_id")


@query("SELECT user_id, count(*) AS scheduled, count(*) FILTER (value > 50) AS usable, count(*) FILTER (NOT value > 50) AS limited FROM events GROUP BY user_id")
def usable_frames(spark, sf_dir):
    return runs.usable_frames(table(spark, sf_dir, "events").withColumn("usable", F.col("value") > 50), ["user_id"])


JOBS = "jobs AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS created_at, 'none' AS error FROM orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    status = F.when(k == 0, "queued").when(k == 1, "processing").when(k == 2, "failed").otherwise("completed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.lit("none").alias("error"))


@query(f"""WITH {JOBS}, n AS (SELECT * FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 100), a AS (SELECT job_id FROM n WHERE status = 'processing' ORDER BY created_at DESC, job_id DESC LIMIT 1)
SELECT count(*) FILTER (status = 'processing') AS active, count(*) FILTER (status = 'queued') AS queued, (SELECT job_id FROM a) AS active_job FROM n""")
def queue_status(spark, sf_dir):
    return runs.queue_status(_jobs(spark, sf_dir))


@query(f"""WITH {JOBS} SELECT job_id, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'processing') THEN 'Vision service restarted before this analysis completed' ELSE error END AS error,
  CASE WHEN status IN ('queued', 'processing') THEN 'Analysis interrupted by service restart' END AS message FROM jobs""")
def restarted_jobs(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumn("message", F.lit(None).cast("string")).withColumn("updated_at", F.col("created_at"))
    return runs.restarted(jobs, F.current_timestamp()).select("job_id", "status", "error", "message")


@query(f"""WITH {JOBS}, c AS (SELECT job_id, 'completed' AS status FROM jobs WHERE job_id % 3 = 0) SELECT j.job_id, coalesce(c.status, j.status) AS status, j.error FROM jobs j LEFT JOIN c USING (job_id)""")
def allowed_update(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select("job_id", "status", "error")
    changes = jobs.where("job_id % 3 = 0").withColumn("status", F.lit("completed")).withColumn("error", F.lit("not allowed"))
    return catalog.upsert(jobs, changes, ["job_id"], ["status"])


@query(f"WITH {JOBS} SELECT job_id, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 12 OFFSET 24")
def job_page(spark, sf_dir):
    return runs.page(_jobs(spark, sf_dir), [F.desc("created_at"), F.col("job_id")], 2).select("job_id", "status")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def telemetry_list(spark, sf_dir):
    return runs.listed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT 'decode' AS name, round(sum(value), 3) AS total FROM events UNION ALL SELECT event_type, round(sum(value * 2), 3) FROM events GROUP BY 1")
def stage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.create_map(F.lit("decode"), F.col("value"), F.col("event_type"), F.col("value") * 2).alias("stages"))
    return runs.totals(e, "stages").select("name", F.round("total", 3).alias("total"))


@query("""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/vision/health' WHEN 1 THEN '/vision/runs/' || page_id WHEN 2 THEN '/other/' || page_id ELSE '/vision' END AS path, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, page_id % 5 = 0 AS w FROM pages)
SELECT page_id, path, method FROM r WHERE starts_with(path, '/vision/') AND (NOT (path = '/vision/health' AND method = 'GET') OR w)""")
def access_log(spark, sf_dir):
    k = F.col("page_id")
    path = F.when(k % 4 == 0, "/vision/health").when(k % 4 == 1, F.concat(F.lit("/vision/runs/"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("/other/"), k.cast("string"))).otherwise("/vision")
    r = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.when(k % 3 == 0, "POST").otherwise("GET").alias("method"), (k % 5 == 0).alias("health_wanted"))
    return runs.logged(r).select("page_id", "path", "method")


@query("""WITH f AS (SELECT o_orderkey, unnest(['results.json', 'metrics.json', 'annotated_video', 'heatmap.png', 'debug.png']) AS name FROM orders), s AS (SELECT *, CASE WHEN (o_orderkey + length(name)) % 5 <> 0 THEN sha256(o_orderkey || name) END AS sha256 FROM f)
SELECT 'run:' || o_orderkey || ':' || name AS logical_id, sha256, CASE WHEN name IN ('results.json', 'metrics.json') THEN 'derived_analysis' ELSE 'derived_preview' END AS storage_class FROM s WHERE name <> 'debug.png' AND sha256 IS NOT NULL""")
def artifact_registration(spark, sf_dir):
    names = F.explode(F.array(*[F.lit(n) for n in (*runs.KEPT_ARTIFACTS, "debug.png")]))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), names.alias("name"))
    digest = F.when((F.col("run_id") + F.char_length("name")) % 5 != 0, F.sha2(F.concat(F.col("run_id").cast("string"), F.col("name")), 256))
    return runs.kept_artifacts(f.withColumn("sha256", digest))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS age FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000 ORDER BY age DESC, kind, id LIMIT 25")
def orphan_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("age"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("age"))
    return runs.orphan_candidates(c, s, order=[F.desc("age"), F.col("kind"), F.col("id")], most=25)


@query("""WITH i AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'duplicate' ELSE 'failed' END AS status FROM documents) SELECT i.doc_id, l.quality FROM i LEFT JOIN labels l USING (doc_id) WHERE status = 'valid'""")
def valid_images_only(spark, sf_dir):
    k = F.col("doc_id") % 3
    images = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "valid").when(k == 1, "duplicate").otherwise("failed").alias("status"))
    return runs.valid_only(images, table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a.MP4' WHEN 1 THEN 'b.c.mov' ELSE 'd.txt' END AS name, CASE WHEN p_size % 7 > 0 THEN 'h264' END AS codec, CASE WHEN p_size % 5 > 0 THEN p_size / 2.0 ELSE 0.0 END AS fps, p_size * 3 AS frames FROM part)
SELECT p_partkey, coalesce(codec, 'unknown') AS codec, round(CASE WHEN fps > 0.001 THEN fps ELSE 30 END, 6) AS fps, round(frames / (CASE WHEN fps > 0.001 THEN fps ELSE 30 END), 6) AS duration_sec FROM f WHERE name <> 'd.txt'""")
def video_metadata(spark, sf_dir):
    k, s = F.col("p_partkey") % 3, F.col("p_size")
    f = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k == 0, "a.MP4").when(k == 1, "b.c.mov").otherwise("d.txt").alias("name"), F.when(s % 7 > 0, "h264").alias("codec"),
        F.when(s % 5 > 0, s / 2.0).otherwise(0.0).alias("fps"), (s * 3).alias("frames"),
    )
    return runs.source_metadata(f).select("p_partkey", "codec", r6("fps").alias("fps"), r6("duration_sec").alias("duration_sec"))


@query("""WITH h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(doc_id::VARCHAR) WHEN 1 THEN upper(md5(doc_id::VARCHAR)) WHEN 2 THEN md5(doc_id::VARCHAR)[1:12] ELSE md5(doc_id::VARCHAR) || chr(10) END AS id FROM documents)
SELECT doc_id, regexp_full_match(id, '[a-f0-9]{32}') AS upload, regexp_full_match(id, '[a-f0-9]{12}') AS job FROM h""")
def id_validators(spark, sf_dir):
    k, h = F.col("doc_id") % 4, F.md5(F.col("doc_id").cast("string"))
    ident = F.when(k == 0, h).when(k == 1, F.upper(h)).when(k == 2, F.substring(h, 1, 12)).otherwise(F.concat(h, F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", runs.known_id(ident, 32).alias("upload"), runs.known_id(ident, 12).alias("job"))


@query("""SELECT event_id, 'z' || event_id AS id, event_type AS review_priority, round((event_id % 100) / 100.0, 6) AS anomaly_score, 0.0 AS appearance_anomaly_score, round(CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.0 END, 6) AS structural_anomaly_score, 0.0 AS review_score,
  round((event_id % 10) / 10.0, 6) AS persistence_score, CASE WHEN event_id % 3 = 0 THEN 'stand_gap' ELSE 'general_visual_variation' END AS primary_type, 'General visual variation' AS primary_signal_label, 0 AS persistent_observations, CAST(event_id % 9 AS INT) AS total_observations,
  NULL AS relative_location, '' AS recommendation FROM events""")
def zone_from_json(spark, sf_dir):
    e = F.col("event_id")
    fields = F.struct(
        F.concat(F.lit("z"), e.cast("string")).alias("id"), F.col("event_type").alias("reviewPriority"), ((e % 100) / 100.0).alias("anomalyScore"), F.when(e % 2 == 0, 0.5).alias("structuralAnomalyScore"),
        ((e % 10) / 10.0).alias("persistenceScore"), F.when(e % 3 == 0, "stand_gap").alias("primaryType"), (e % 9).alias("totalObservations"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(fields).alias("zone"))
    return rows.select("event_id", *runs.zone_of_json(F.col("zone")))


@query("SELECT user_id, concat_ws(',', kinds[1], kinds[2]) AS first_reasons FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY user_id)")
def first_reasons(spark, sf_dir):
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(report.first_reasons(kinds).alias("first_reasons"))


@query("""WITH p AS (SELECT n_nationkey, r_regionkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT '{"nationKey":' || n_nationkey || ',"homeRegion":' || (CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE '{"regionKey":' || r_regionkey || ',"regionName":"' || r_name || '"}' END) || ',"allNames":["' || n_name || '"]}' AS report FROM p""")
def json_reports(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    home = F.when(F.col("n_nationkey") % 4 != 0, F.struct(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region_name")))
    return report.json_report(both.select(F.col("n_nationkey").alias("nation_key"), home.alias("home_region"), F.array("n_name").alias("all_names")))


@query("SELECT o_orderkey, 'clip' || o_orderkey AS name, o_orderkey || '.json' AS artifact, false AS has_path FROM orders")
def redacted_reports(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    source = F.struct(F.concat(F.lit("/uploads/"), k).alias("path"), F.concat(F.lit("clip"), k).alias("name"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", source.alias("source"), F.create_map(F.lit("results"), F.concat(F.lit("/data/out/"), k, F.lit(".json"))).alias("files"))
    out = report.redacted(rows, artifacts="files")
    return out.select("o_orderkey", F.col("source.name").alias("name"), F.col("files")["results"].alias("artifact"), F.lit("path" in out.schema["source"].dataType.names).alias("has_path"))


@query("""SELECT n_regionkey, '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","geometry":' || (CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE '{"type":"Point","coordinates":[' || n_nationkey || '.0,' || (n_nationkey * 2) || '.0]}' END)
  || ',"properties":{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}}', ',' ORDER BY n_nationkey) || ']}' AS geojson FROM nation GROUP BY n_regionkey""")
def saved_area_export(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    areas = table(spark, sf_dir, "nation").withColumn("geometry", F.when(F.col("n_nationkey") % 4 != 0, geometry.geojson_point(k, k * 2)))
    return report.feature_collection(areas, "n_regionkey", "geometry", ["n_nationkey", "n_name"])


@query("""SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}')[1:16] AS cache_key FROM nation""")
def cache_keys(spark, sf_dir):
    key = report.canonical_hash({"name": F.col("n_name"), "key": F.col("n_nationkey")}, 16)
    return table(spark, sf_dir, "nation").select("n_nationkey", key.alias("cache_key"))


MEMBERS = """
m AS (SELECT p_partkey // 100 AS archive_id, p_partkey AS ord, CASE p_partkey % 11 WHEN 0 THEN '../up.png' WHEN 1 THEN '/abs.jpg' WHEN 2 THEN 'C:/x.jpg' WHEN 3 THEN 'a/in.zip' WHEN 4 THEN 'a/pic.tiff' WHEN 5 THEN 'dir/' WHEN 6 THEN 'top.jpg' ELSE 'grp' || (p_partkey % 3) || '/' || p_partkey || '.jpg' END AS name,
  CASE p_partkey % 13 WHEN 0 THEN 40960 ELSE 33188 END AS mode, CASE p_partkey % 17 WHEN 0 THEN 30000000 ELSE p_size * 1000 END AS size, CASE p_partkey % 19 WHEN 0 THEN 1 ELSE p_size * 100 + 1 END AS packed FROM part)"""


@query(f"""WITH {MEMBERS} SELECT archive_id, ord, CASE WHEN p.name LIKE '%/%' AND length(trim(p.name, '/')) > 0 AND trim(p.name, '/') LIKE '%/%' THEN split_part(trim(p.name, '/'), '/', 1) END AS grp,
  CASE WHEN p.name IN ('../up.png', '/abs.jpg', 'C:/x.jpg') THEN 'unsafe path' WHEN mode = 40960 THEN 'symlink' WHEN p.name = 'a/in.zip' THEN 'nested archive' WHEN p.name = 'a/pic.tiff' THEN 'unsupported type' WHEN size > 25000000 THEN 'member too large' WHEN size / greatest(packed, 1) > 100 THEN 'compression ratio' END AS reason
FROM m p WHERE p.name <> 'dir/'""")
def archive_inspection(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 11 == 0, "../up.png").when(k % 11 == 1, "/abs.jpg").when(k % 11 == 2, "C:/x.jpg").when(k % 11 == 3, "a/in.zip").when(k % 11 == 4, "a/pic.tiff").when(k % 11 == 5, "dir/").when(k % 11 == 6, "top.jpg")
    name = name.otherwise(F.concat(F.lit("grp"), (k % 3).cast("string"), F.lit("/"), k.cast("string"), F.lit(".jpg")))
    m = table(spark, sf_dir, "part").select(
        F.floor(k / 100).alias("archive_id"), k.alias("ord"), name.alias("name"), F.lit(False).alias("is_dir"), F.when(k % 13 == 0, 40960).otherwise(33188).alias("unix_mode"),
        F.when(k % 17 == 0, 30000000).otherwise(s * 1000).alias("file_size"), F.when(k % 19 == 0, 1).otherwise(s * 100 + 1).alias("compress_size"),
    )
    return catalog.inspect_members(m).select("archive_id", "ord", "grp", "reason")


@query("""SELECT event_id, round((1000000 + event_id) / 1000.0, 6) AS ts, round(value, 6) AS latitude, CASE WHEN event_id % 3 <> 0 THEN round(event_id / 10.0, 6) ELSE round(event_id / 20.0, 6) END AS altitude, round((event_id % 360) * 1.0, 6) AS heading, CAST(NULL AS DOUBLE) AS gimbal_pitch FROM events""")
def telemetry_poses(spark, sf_dir):
    e = F.col("event_id")
    data = F.struct(F.col("value").alias("latitude"), e.cast("double").alias("longitude"), F.when(e % 3 != 0, e / 10.0).alias("height"), (e / 20.0).alias("elevation"), ((e % 360) * 1.0).alias("attitude_head"))
    raw = table(spark, sf_dir, "events").select(F.to_json(F.struct((1000000 + e).alias("timestamp"), data.alias("data"))).alias("value"))
    poses = media.pose(media.telemetry(raw))
    return poses.select(F.col("longitude").cast("long").alias("event_id"), *[r6(c).alias(c) for c in ("ts", "latitude", "altitude", "heading", "gimbal_pitch")])


@query("""WITH f AS (SELECT o_custkey AS run_id, o_orderkey AS frame, o_totalprice AS ts_sec FROM orders WHERE o_custkey % 5 = 0), r AS (SELECT c_custkey AS run_id, c_nationkey % 4 AS n FROM customer),
d AS (SELECT run_id, unnest(range(n)) AS frame FROM r WHERE n > 0 AND run_id NOT IN (SELECT run_id FROM f))
SELECT run_id, frame, round(ts_sec, 6) AS ts_sec, printf('frame_%04d.jpg', frame) AS artifact FROM f UNION ALL SELECT run_id, frame, round(frame * 0.5, 6), printf('frame_%04d.jpg', frame) FROM d""")
def default_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("ts_sec"))
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_nationkey") % 4).alias("n_frames"))
    return field.with_default_frames(every, frames).select("run_id", "frame", r6("ts_sec").alias("ts_sec"), field.artifact_name(F.col("frame")).alias("artifact"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, date_diff('hour', o_orderdate, TIMESTAMP '1997-01-01') AS h FROM orders)
SELECT o_orderkey, h AS age_hours, CASE status WHEN 'completed' THEN 'anomaly' WHEN 'failed' THEN 'delete' ELSE 'keep' END AS verdict FROM t WHERE h > 24""")
def expired_records(spark, sf_dir):
    s = F.col("o_orderstatus")
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "F", "completed").when(s == "O", "running").otherwise("failed").alias("status"), F.date_trunc("hour", "o_orderdate").alias("updated_at"))
    return catalog.expired(r, F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", F.col("age_hours").cast("long").alias("age_hours"), "verdict")


@query("""WITH p AS (SELECT l_suppkey AS sample, l_returnflag AS gt, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE 'N' END AS pred FROM lineitem)
SELECT sample, count(*) AS n, round(avg(CAST(gt = pred AS INT)), 6) AS accuracy FROM p GROUP BY sample""")
def sample_reports(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").withColumn("guess", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise("N"))
    matrix = matching.confusion(p, F.col("l_returnflag"), F.col("guess"), [F.col("l_suppkey").alias("sample")])
    scores = matching.summary(matching.class_scores(matrix, ["sample"]), matrix, ["sample"])
    return scores.join(matrix.groupBy("sample").agg(F.sum("n").alias("n")), "sample").select("sample", "n", r6("accuracy").alias("accuracy"))
