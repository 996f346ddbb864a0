"""Registered queries of masks and rows in pictures, each beside its SQL. Pictures are made from lineitem, one per thousand orders, so that their number grows with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import geometry
from gleanspark.operators import raster, row_lines, structure
from gleanspark.plans.queries import query, r6
from gleanspark.session import dealt, materialize, table
from gleanspark.sources import containers

ORDERS = 1000
HEIGHT, WIDTH = 24, 32
ROWS_HEIGHT, ROWS_WIDTH = 60, 100
PIXELS_PER_TASK = 300_000

MASK = f"""
shapes AS (SELECT DISTINCT CAST(l_orderkey // {ORDERS} AS INT) AS frame, {HEIGHT} AS height, {WIDTH} AS width FROM lineitem),
grid AS (SELECT frame, CAST(ys.y AS INT) AS y, CAST(xs.x AS INT) AS x FROM shapes, range({HEIGHT}) AS ys(y), range({WIDTH}) AS xs(x)),
mask AS (SELECT DISTINCT CAST(l_orderkey // {ORDERS} AS INT) AS frame, CAST(l_partkey % {HEIGHT} AS INT) AS y, CAST(l_suppkey % {WIDTH} AS INT) AS x FROM lineitem
  WHERE l_quantity < 30 AND ((l_partkey % {HEIGHT}) // 7 + (l_suppkey % {WIDTH}) // 9 + l_orderkey // {ORDERS}) % 3 <> 0)"""


def _shapes(spark: SparkSession, sf_dir: str, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    frame = F.floor(F.col("l_orderkey") / ORDERS).cast("int").alias("frame")
    return table(spark, sf_dir, "lineitem").select(frame).distinct().withColumn("height", F.lit(height)).withColumn("width", F.lit(width))


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask's pixels, blocks with holes: frame, y, x."""
    keys = [F.floor(F.col("l_orderkey") / ORDERS).cast("int").alias("frame"), (F.col("l_partkey") % HEIGHT).cast("int").alias("y"), (F.col("l_suppkey") % WIDTH).cast("int").alias("x")]
    block = F.floor(F.col("l_partkey") % HEIGHT / 7) + F.floor(F.col("l_suppkey") % WIDTH / 9) + F.floor(F.col("l_orderkey") / ORDERS)
    lines = table(spark, sf_dir, "lineitem")
    return dealt(lines.where((F.col("l_quantity") < 30) & (block % 3 != 0)).select(*keys), lines.count(), PIXELS_PER_TASK, "frame", "y").distinct()


def _element(size: int) -> str:
    return ", ".join(f"({dy}, {dx})" for dy, w in raster.ellipse(size) for dx in range(-w, w + 1))


def _grown(name: str, of: str, size: int) -> str:
    return f"{name} AS (SELECT DISTINCT g.* FROM {of} AS m CROSS JOIN (VALUES {_element(size)}) AS e(dy, dx) JOIN grid AS g ON g.frame = m.frame AND g.y = m.y + e.dy AND g.x = m.x + e.dx)"


def _shrunk(name: str, of: str, size: int) -> str:
    return f"{name}_out AS (SELECT * FROM grid EXCEPT SELECT * FROM {of}), {_grown(f'{name}_grown', f'{name}_out', size)}, {name} AS (SELECT * FROM grid EXCEPT SELECT * FROM {name}_grown)"


CLEANED = ",\n".join([_shrunk("o1", "mask", 5), _grown("o2", "o1", 5), _grown("c1", "o2", 5), _grown("c2", "c1", 5), _shrunk("c3", "c2", 5), _shrunk("cleaned", "c3", 5)])


@query(f"WITH {MASK}, {CLEANED} SELECT * FROM cleaned")
def cleaned_mask(spark, sf_dir):
    runs = raster.mask_runs(_mask(spark, sf_dir), ["frame"])
    return raster.run_pixels(raster.cleaned(runs, ["frame"], _shapes(spark, sf_dir)), ["frame"])


def _labelled(name: str, of: str) -> str:
    """Runs of a mask's pixels with the first run (2^32 y + x0) that each is connected with: labels flow along edges until none is new."""
    return f"""
{name}_i AS (SELECT *, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS g FROM {of}),
{name}_r AS (SELECT frame, y, min(x) AS x0, max(x) + 1 AS x1, CAST(y AS BIGINT) * 4294967296 + min(x) AS id FROM {name}_i GROUP BY frame, y, g),
{name}_e AS (SELECT a.frame, a.id AS a, b.id AS b FROM {name}_r AS a JOIN {name}_r AS b ON a.frame = b.frame AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
{name}_l(frame, id, label) AS (SELECT frame, id, id FROM {name}_r UNION SELECT l.frame, e.b, l.label FROM {name}_l AS l JOIN {name}_e AS e ON l.frame = e.frame AND l.id = e.a WHERE l.label < e.b),
{name} AS (SELECT r.frame, y, x0, x1, component FROM {name}_r AS r JOIN (SELECT frame, id, min(label) AS component FROM {name}_l GROUP BY ALL) USING (frame, id))"""


@query(f"WITH RECURSIVE {MASK}, {_labelled('parts', 'mask')} SELECT frame, component, count(*) AS runs, CAST(sum(x1 - x0) AS BIGINT) AS area FROM parts GROUP BY ALL")
def mask_components(spark, sf_dir):
    labels = raster.labelled(raster.mask_runs(_mask(spark, sf_dir), ["frame"]), ["frame"], band=8)
    return labels.groupBy("frame", "component").agg(F.count("*").alias("runs"), F.sum(F.col("x1") - F.col("x0")).alias("area"))


FIELD = f"""
{_shrunk('f1', 'mask', 3)}, {_grown('f2', 'f1', 3)}, inv AS (SELECT * FROM grid EXCEPT SELECT * FROM f2), {_labelled('holes', 'inv')},
small AS (SELECT frame, component FROM holes GROUP BY ALL HAVING sum(x1 - x0) <= floor(0.008 * {HEIGHT * WIDTH}) AND min(y) > 0 AND max(y) < {HEIGHT - 1} AND min(x0) > 0 AND max(x1) < {WIDTH}),
filled AS (SELECT frame, y, x FROM f2 UNION SELECT g.* FROM holes JOIN small USING (frame, component) JOIN grid AS g ON g.frame = holes.frame AND g.y = holes.y AND g.x >= x0 AND g.x < x1),
{_labelled('whole', 'filled')},
sizes AS (SELECT frame, component, sum(x1 - x0) AS area FROM whole GROUP BY ALL),
big AS (SELECT frame, component FROM sizes QUALIFY area >= greatest(floor(0.02 * {HEIGHT * WIDTH}), floor(0.15 * max(area) OVER (PARTITION BY frame))))"""


@query(f"WITH RECURSIVE {MASK}, {FIELD} SELECT frame, y, x0, x1 FROM whole JOIN big USING (frame, component)")
def field_masks(spark, sf_dir):
    return raster.field_mask(raster.mask_runs(_mask(spark, sf_dir), ["frame"]), ["frame"], _shapes(spark, sf_dir))


def _pass(name: str, of: str, first: str, second: str) -> str:
    """One of Zhang and Suen's passes over the pixels ``of``: bits 0 to 7 are the neighbours from above, clockwise."""
    around = "(-1, 0, 0), (-1, 1, 1), (0, 1, 2), (1, 1, 3), (1, 0, 4), (1, -1, 5), (0, -1, 6), (-1, -1, 7)"
    turns = " + ".join(f"CAST((bits >> {i}) & 1 = 0 AND (bits >> {(i + 1) % 8}) & 1 = 1 AS INT)" for i in range(8))
    mask = lambda p: sum(1 << int(i) for i in p)
    return f"""
{name}_n AS (SELECT m.frame, m.y, m.x, CAST(coalesce(sum(1 << k) FILTER (n.frame IS NOT NULL), 0) AS INT) AS bits FROM {of} AS m CROSS JOIN (VALUES {around}) AS a(dy, dx, k)
  LEFT JOIN {of} AS n ON n.frame = m.frame AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY ALL),
{name} AS (SELECT frame, y, x FROM {name}_n WHERE NOT (bit_count(bits) BETWEEN 2 AND 6 AND {turns} = 1 AND bits & {mask(first)} <> {mask(first)} AND bits & {mask(second)} <> {mask(second)}))"""


THIN_ROUNDS = 12
THINNED = ",".join(_pass(f"t{i}a", "mask" if i == 0 else f"t{i - 1}b", "024", "246") + "," + _pass(f"t{i}b", f"t{i}a", "026", "046") for i in range(THIN_ROUNDS))


@query(f"WITH {MASK}, {THINNED} SELECT * FROM t{THIN_ROUNDS - 1}b")
def skeletons(spark, sf_dir):
    """To a fixed point; masks of this density are thin after fewer rounds than the SQL writes down."""
    return raster.run_pixels(raster.thinned(raster.mask_runs(_mask(spark, sf_dir), ["frame"]), ["frame"], tile=16, rounds=2), ["frame"])


# ---------------------------------------------------------------- rows

STRIPES = f"""
stripes AS (SELECT DISTINCT CAST(l_orderkey // {ORDERS} AS INT) AS frame, CAST(l_partkey % 2 AS INT) AS unit, CAST(l_partkey % {ROWS_HEIGHT} AS INT) AS y,
  CAST(20 * (l_suppkey % 5) + CAST(l_quantity AS INT) % 2 + (l_partkey % {ROWS_HEIGHT}) // CASE WHEN l_orderkey // {ORDERS} % 2 = 0 THEN 6 ELSE 3 END AS INT) AS x FROM lineitem WHERE l_quantity < 45)"""
VOTES = f"""
turns AS (SELECT CAST(a AS INT) AS angle, CAST(floor(cos(radians(a)) * 1000000 + 0.5) AS BIGINT) AS c, CAST(floor(sin(radians(a)) * 1000000 + 0.5) AS BIGINT) AS s FROM range(180) AS r(a)),
voted AS (SELECT KEYS, angle, CAST(floor((x * c + y * s + 500000) / 1000000) AS BIGINT) AS rho, count(*) AS n FROM (SELECT DISTINCT KEYS, y, x FROM stripes) CROSS JOIN turns GROUP BY ALL)"""
PEAKS = f"""
strong AS (SELECT * FROM voted WHERE n >= {row_lines.VOTES}),
peaks AS (SELECT p.* FROM strong AS p WHERE NOT EXISTS (SELECT 1 FROM strong AS q JOIN (VALUES (-1), (0), (1)) AS t(turn) ON TRUE WHERE SAME
  AND abs(q.angle + 180 * turn - p.angle) <= {row_lines.NEAR_ANGLE} AND abs(CASE WHEN turn = 0 THEN q.rho ELSE -q.rho END - p.rho) <= {row_lines.NEAR_RHO}
  AND (q.n > p.n OR q.n = p.n AND (q.angle < p.angle OR q.angle = p.angle AND q.rho < p.rho))))"""
SEGMENTS = f"""
lit AS (SELECT KEYS, x, y, p.angle, p.rho, CAST(floor((y * c - x * s) / 1000000) AS BIGINT) AS t
  FROM (SELECT DISTINCT KEYS, y, x FROM stripes) AS d JOIN peaks AS p USING (KEYS) JOIN turns USING (angle) WHERE abs(CAST(floor((x * c + y * s + 500000) / 1000000) AS BIGINT) - p.rho) <= 1
  QUALIFY row_number() OVER (PARTITION BY KEYS, x, y ORDER BY p.n DESC, p.angle, p.rho) = 1),
broken AS (SELECT *, CASE WHEN t - lag(t) OVER w > {row_lines.GAP} THEN 1 ELSE 0 END AS fresh FROM lit WINDOW w AS (PARTITION BY KEYS, angle, rho ORDER BY t, y, x)),
isles AS (SELECT *, sum(fresh) OVER (PARTITION BY KEYS, angle, rho ORDER BY t, y, x ROWS UNBOUNDED PRECEDING) AS isle FROM broken),
ended AS (SELECT KEYS, angle AS line_angle, rho, min((t, y, x)) AS a, max((t, y, x)) AS b FROM isles GROUP BY KEYS, angle, rho, isle),
sticks AS (SELECT KEYS, line_angle, rho, a[3] AS x1, a[2] AS y1, b[3] AS x2, b[2] AS y2, sqrt((b[3] - a[3]) ** 2 + (b[2] - a[2]) ** 2) AS length FROM ended WHERE sqrt((b[3] - a[3]) ** 2 + (b[2] - a[2]) ** 2) >= {row_lines.LENGTH})"""


def _circular(name: str, of: str, keys: str) -> str:
    """The circular median of column angle by keys."""
    same = " AND ".join(f"p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_d AS (SELECT {own}, p.angle, round(sum(least(abs(p.angle - q.angle) % 180.0, 180.0 - abs(p.angle - q.angle) % 180.0)), 6) AS d
  FROM (SELECT DISTINCT {keys}, angle FROM {of}) AS p JOIN {of} AS q ON {same} GROUP BY ALL),
{name} AS (SELECT {keys}, angle AS median_angle FROM {name}_d QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY d, angle) = 1)"""


def _near(a: str, b: str) -> str:
    return f"least(abs({a} - {b}) % 180.0, 180.0 - abs({a} - {b}) % 180.0) <= {row_lines.ANGLE}"


def _rows_sql(keys: str) -> str:
    return f"""
angled AS (SELECT *, (round(degrees(atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))), 3) + 180.0) % 180.0 AS angle FROM sticks), {_circular('m1', 'angled', keys)},
close AS (SELECT angled.* FROM angled JOIN m1 USING ({keys}) WHERE {_near('angle', 'median_angle')}), {_circular('m2', 'close', keys)},
kept AS (SELECT angled.*, median_angle AS dominant_angle, round((y1 + y2) / 2.0 * cos(radians(median_angle)) - (x1 + x2) / 2.0 * sin(radians(median_angle)), 6) AS o
  FROM angled JOIN m2 USING ({keys}) WHERE {_near('angle', 'median_angle')}),
split AS (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY {keys} ORDER BY o, x1, y1, x2, y2) > {row_lines.POSITION} THEN 1 ELSE 0 END AS fresh FROM kept),
banks AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY o, x1, y1, x2, y2 ROWS UNBOUNDED PRECEDING) AS bank FROM split), {_circular('m3', 'banks', keys + ', bank')},
rows_found AS (SELECT {keys}, dominant_angle, bank, median(o) AS o, sum(length) AS support, count(*) AS lines FROM banks GROUP BY ALL),
found AS (SELECT {keys}, dominant_angle, CAST(bank AS BIGINT) AS row, median_angle AS angle, o AS "offset", support, lines, support >= {row_lines.SUPPORT} AS consistent FROM rows_found JOIN m3 USING ({keys}, bank))"""


ROUNDED_ROWS = 'round(dominant_angle, 6) AS dominant_angle, row, round(angle, 6) AS angle, round("offset", 6) AS "offset", round(support, 6) AS support, lines, consistent'


def _sql(parts: str, keys: str) -> str:
    return parts.replace("KEYS", keys).replace("SAME", " AND ".join(f"q.{k.strip()} = p.{k.strip()}" for k in keys.split(",")))


def _stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of slanted crop rows: frame, unit, y, x."""
    frame, y = F.floor(F.col("l_orderkey") / ORDERS), F.col("l_partkey") % ROWS_HEIGHT
    x = 20 * (F.col("l_suppkey") % 5) + F.col("l_quantity").cast("int") % 2 + F.floor(y / F.when(frame % 2 == 0, 6).otherwise(3))
    lines = table(spark, sf_dir, "lineitem")
    pixels = lines.where("l_quantity < 45").select(frame.cast("int").alias("frame"), (F.col("l_partkey") % 2).cast("int").alias("unit"), y.cast("int").alias("y"), x.cast("int").alias("x"))
    return dealt(pixels, lines.count(), PIXELS_PER_TASK, "frame").distinct()


def _found_rows(pixels: DataFrame, keys: list[str]) -> DataFrame:
    lines = materialize(row_lines.peaks(materialize(row_lines.votes(pixels, keys), "votes"), keys), "peaks")
    return row_lines.rows_of(materialize(row_lines.segments(pixels, lines, keys), "segments"), keys)


def _rounded_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, *[r6(c).alias(c) if c in ("dominant_angle", "angle", "offset", "support") else F.col(c) for c in ("dominant_angle", "row", "angle", "offset", "support", "lines", "consistent")])


@query(f"WITH {STRIPES}, {_sql(VOTES + ',' + PEAKS, 'frame')} SELECT * FROM peaks")
def line_peaks(spark, sf_dir):
    pixels = _stripes(spark, sf_dir).select("frame", "y", "x").distinct()
    return row_lines.peaks(materialize(row_lines.votes(pixels, ["frame"]), "votes"), ["frame"])


@query(f"WITH {STRIPES}, {_sql(','.join((VOTES, PEAKS, SEGMENTS)), 'frame')}, {_rows_sql('frame')} SELECT frame, {ROUNDED_ROWS} FROM found")
def crop_rows(spark, sf_dir):
    pixels = _stripes(spark, sf_dir).select("frame", "y", "x").distinct()
    return _rounded_rows(_found_rows(pixels, ["frame"]), ["frame"])


@query(f"WITH {STRIPES}, {_sql(','.join((VOTES, PEAKS, SEGMENTS)), 'frame, unit')}, {_rows_sql('frame, unit')} SELECT frame, unit, {ROUNDED_ROWS} FROM found")
def unit_crop_rows(spark, sf_dir):
    return _rounded_rows(_found_rows(_stripes(spark, sf_dir), ["frame", "unit"]), ["frame", "unit"])


# ---------------------------------------------------------------- structural evidence

SIXTEENTH = max(ROWS_HEIGHT, ROWS_WIDTH) // 16
PROFILES = f"""
middles AS (SELECT r.i AS row, c.i AS col, (floor(r.i * {ROWS_HEIGHT} / 8.0) + floor((r.i + 1) * {ROWS_HEIGHT} / 8.0)) / 2.0 AS cy, (floor(c.i * {ROWS_WIDTH} / 8.0) + floor((c.i + 1) * {ROWS_WIDTH} / 8.0)) / 2.0 AS cx
  FROM range(8) AS r(i), range(8) AS c(i)),
probes AS (SELECT a.frame, a.angle, row, col, k.i, CAST(trunc(cx + k.i * cos(radians(angle))) AS INT) AS x, CAST(trunc(cy + k.i * sin(radians(angle))) AS INT) AS y
  FROM (SELECT DISTINCT frame, dominant_angle AS angle FROM found) AS a, middles, range({-SIXTEENTH}, {SIXTEENTH + 1}) AS k(i)),
sampled AS (SELECT p.*, CASE WHEN p.x >= 0 AND p.x < {ROWS_WIDTH} AND p.y >= 0 AND p.y < {ROWS_HEIGHT} THEN CASE WHEN m.frame IS NULL THEN 0.0 ELSE 0.9 END END AS v
  FROM probes AS p LEFT JOIN (SELECT DISTINCT frame, y, x FROM stripes) AS m ON m.frame = p.frame AND m.y = p.y AND m.x = p.x),
profiles AS (SELECT frame, row, col, angle, list(coalesce(v, 0.0) ORDER BY i) AS s, count(v) AS known, quantile_cont(v, 0.75) AS level FROM sampled GROUP BY ALL),
cuts AS (SELECT *, len(s) AS n, b.i AS first, e.i AS last FROM profiles, range({2 * SIXTEENTH + 1}) AS b(i), range({2 * SIXTEENTH + 1}) AS e(i)
  WHERE known >= 9 AND level >= 0.15 AND b.i >= 3 AND b.i < len(s) - 6 AND e.i >= b.i + 3 AND e.i < least(len(s) - 3, b.i + len(s) // 3)),
means AS (SELECT *, list_avg(s[first + 1 : last]) AS inside, list_avg(s[first - 2 : first]) AS before, list_avg(s[last + 1 : last + 3]) AS after FROM cuts),
gaps AS (SELECT frame, row, col, max((1 - inside / greatest(before, after, 1e-6)) * (0.6 + 0.4 * least((last - first) / n * 8, 1.0))) AS best FROM means
  WHERE inside <= 0.65 * level AND before >= 0.55 * level AND after >= 0.55 * level GROUP BY ALL)"""


@query(
    f"WITH {STRIPES}, {_sql(','.join((VOTES, PEAKS, SEGMENTS)), 'frame')}, {_rows_sql('frame')}, {PROFILES} "
    "SELECT frame, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(angle, 6) AS angle, round(least(coalesce(best, 0.0), 1.0), 6) AS continuity FROM profiles LEFT JOIN gaps USING (frame, row, col)"
)
def row_continuity(spark, sf_dir):
    """Gap evidence of every cell, along the angle of the rows found in its picture."""
    pixels = materialize(_stripes(spark, sf_dir).select("frame", "y", "x").distinct(), "stripes")
    angles = _found_rows(pixels, ["frame"]).select("frame", F.col("dominant_angle").alias("angle")).distinct()
    found = structure.continuity(pixels.withColumn("value", F.lit(0.9)), angles, ["frame"], _shapes(spark, sf_dir, ROWS_HEIGHT, ROWS_WIDTH))
    return found.select("frame", "row", "col", r6("angle").alias("angle"), r6("continuity").alias("continuity"))


def _mirrored(name: str, of: str, along: str, across: str, side: int, rest: str) -> str:
    return f"""
{name}_m AS (SELECT *, unnest([{along}, CASE WHEN {along} BETWEEN 1 AND 7 THEN -{along} END, CASE WHEN {along} BETWEEN {side - 8} AND {side - 2} THEN {2 * (side - 1)} - {along} END]) AS pos FROM {of}),
{name}_s AS (SELECT {rest}, pos, {along} AS own, sum(s) OVER w AS s, sum(q) OVER w AS q FROM {name}_m WHERE pos IS NOT NULL WINDOW w AS (PARTITION BY frame, {across} ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
{name} AS (SELECT {rest}, own AS {along}, s, q FROM {name}_s WHERE pos = own)"""


FRAGMENTS = f"""
shapes AS (SELECT DISTINCT CAST(l_orderkey // {ORDERS} AS INT) AS frame FROM lineitem),
known AS (SELECT CAST(l_orderkey // {ORDERS} AS INT) AS frame, CAST(l_partkey % {HEIGHT} AS INT) AS y, CAST(l_suppkey % {WIDTH} AS INT) AS x, min(l_quantity) / 50.0 AS value FROM lineitem GROUP BY ALL),
full_grid AS (SELECT frame, CAST(ys.y AS INT) AS y, CAST(xs.x AS INT) AS x, CASE WHEN value IS NOT NULL AND (ys.y + 2 * xs.x) % 9 <> 0 THEN value ELSE 0.0 END AS v, value IS NOT NULL AND (ys.y + 2 * xs.x) % 9 <> 0 AS in_field
  FROM shapes CROSS JOIN range({HEIGHT}) AS ys(y) CROSS JOIN range({WIDTH}) AS xs(x) LEFT JOIN known USING (frame, y, x)),
squares AS (SELECT *, v AS s, v * v AS q FROM full_grid), {_mirrored('wide', 'squares', 'x', 'y', WIDTH, 'frame, y, v, in_field')}, {_mirrored('boxed', 'wide', 'y', 'x', HEIGHT, 'frame, x, v, in_field')},
fragments AS (SELECT frame, y, x, in_field, CASE WHEN in_field THEN least(greatest(s / 225 - v, 0.0), 1.0) * least(20 * greatest(q / 225 - (s / 225) ** 2, 0.0), 1.0) ELSE 0.0 END AS f FROM boxed)"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.floor(F.col("l_orderkey") / ORDERS).cast("int").alias("frame"), (F.col("l_partkey") % HEIGHT).cast("int").alias("y"), (F.col("l_suppkey") % WIDTH).cast("int").alias("x")]
    known = table(spark, sf_dir, "lineitem").groupBy(*keys).agg((F.min("l_quantity") / 50.0).alias("value")).withColumn("in_field", (F.col("y") + 2 * F.col("x")) % 9 != 0)
    return structure.fragmentation(known, ["frame"], _shapes(spark, sf_dir))


@query(f"WITH {FRAGMENTS} SELECT frame, y, x, round(f, 6) AS fragments FROM fragments")
def fragmentation_map(spark, sf_dir):
    return _fragments(spark, sf_dir).select("frame", "y", "x", r6("fragments").alias("fragments"))


@query(f"""WITH {FRAGMENTS} SELECT frame, CAST(least(floor(((y + 1) * 8 - 1) / {HEIGHT}.0), 7) AS INT) AS row, CAST(least(floor(((x + 1) * 8 - 1) / {WIDTH}.0), 7) AS INT) AS col,
  round(coalesce(avg(f) FILTER (in_field), 0.0), 6) AS fragments FROM fragments GROUP BY ALL""")
def cell_fragments(spark, sf_dir):
    return structure.cell_fragments(_fragments(spark, sf_dir), ["frame"]).withColumn("fragments", r6("fragments"))


# ---------------------------------------------------------------- files and positions


def _box(kind: str, *parts: Column) -> Column:
    """A box of an MP4 file around binary columns."""
    body = F.concat(*parts)
    return F.concat(F.unhex(F.lpad(F.hex((F.octet_length(body) + 8).cast("long")), 8, "0")), F.lit(kind.encode("latin-1")), body)


def _u32(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


@query("""SELECT event_id AS id, CAST(640 + event_id % 7 * 16 AS INT) AS width, CAST(360 + event_id % 5 * 8 AS INT) AS height, round((24 + event_id % 3) * (event_id % 40 + 1) / (event_id % 40 + 1.0), 6) AS fps,
  CAST((24 + event_id % 3) * (event_id % 40 + 1) AS BIGINT) AS frame_count, round(event_id % 40 + 1.0, 6) AS duration_sec, CASE WHEN event_id % 2 = 0 THEN 'h264' ELSE 'hevc' END AS codec,
  CAST(event_id % 4 * 90 AS INT) AS orientation, CASE WHEN event_id % 6 <> 0 THEN round(event_id % 90 + 0.5, 6) END AS latitude, CASE WHEN event_id % 6 <> 0 THEN round(-(event_id % 180) - 0.25, 6) END AS longitude FROM events""")
def container_metadata(spark, sf_dir):
    """Films of a few hundred bytes, one per event, written and read in the engine."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("i"))
    i = F.col("i")
    zeros = lambda n: F.lit(bytes(n))
    seconds, rate = i % 40 + 1, 24 + i % 3
    turn = lambda *four: F.concat(*[F.unhex(F.lit({1: "00010000", 0: "00000000", -1: "FFFF0000"}[v])) for v in four])
    corner = lambda a, b, c, d: F.concat(turn(a, b, 0, c, d, 0, 0, 0), F.unhex(F.lit("40000000")))
    matrix = F.when(i % 4 == 0, corner(1, 0, 0, 1)).when(i % 4 == 1, corner(0, 1, -1, 0)).when(i % 4 == 2, corner(-1, 0, 0, -1)).otherwise(corner(0, -1, 1, 0))
    tkhd = _box("tkhd", zeros(40), matrix, _u32((640 + i % 7 * 16) * 65536), _u32((360 + i % 5 * 8) * 65536))
    entry = F.when(i % 2 == 0, F.lit(b"avc1")).otherwise(F.lit(b"hvc1"))
    stsd = _box("stsd", zeros(4), _u32(F.lit(1)), _u32(F.lit(16)), entry, zeros(8))
    stts = _box("stts", zeros(4), _u32(F.lit(1)), _u32(rate * seconds), _u32(F.lit(1)))
    media = _box("mdia", _box("mdhd", zeros(12), _u32(rate), _u32(rate * seconds), zeros(4)), _box("hdlr", zeros(8), F.lit(b"vide"), zeros(12)), _box("minf", _box("stbl", stsd, stts)))
    place = F.format_string("+%d.5-%d.25/", i % 90, i % 180).cast("binary")
    place = F.when(i % 6 == 0, F.lit(b"nowhere")).otherwise(place)
    film = F.concat(_box("ftyp", F.lit(b"isom")), _box("moov", _box("trak", tkhd, media), _box("udta", _box("\xa9xyz", zeros(4), place))))
    found = containers.media_metadata(e.select(i.alias("path"), film.alias("content")))
    return found.select(F.col("path").alias("id"), "width", "height", r6("fps").alias("fps"), "frame_count", r6("duration_sec").alias("duration_sec"), "codec", "orientation", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"))


@query(f"""WITH s AS (SELECT CAST(l_orderkey // {ORDERS} AS INT) AS frame, CAST(600 + max(l_partkey) % 500 AS INT) AS h, CAST(900 + max(l_suppkey) % 700 AS INT) AS w FROM lineitem GROUP BY ALL)
SELECT frame, CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col, CAST(r.i * h // 8 AS INT) AS y0, CAST((r.i + 1) * h // 8 AS INT) AS y1, CAST(c.i * w // 8 AS INT) AS x0, CAST((c.i + 1) * w // 8 AS INT) AS x1 FROM s, range(8) AS r(i), range(8) AS c(i)""")
def grid_bounds(spark, sf_dir):
    """The cells' pixels of pictures of many sizes."""
    frame = F.floor(F.col("l_orderkey") / ORDERS).cast("int").alias("frame")
    sizes = table(spark, sf_dir, "lineitem").groupBy(frame).agg((600 + F.max("l_partkey") % 500).cast("int").alias("height"), (900 + F.max("l_suppkey") % 700).cast("int").alias("width"))
    return structure.cell_bounds(sizes, ["frame"]).select("frame", "row", "col", "y0", "y1", "x0", "x1")


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 < 3 THEN CAST(event_id % 90 AS DOUBLE) + 0.25 END AS latitude, CASE WHEN event_id % 5 < 3 THEN -(CAST(event_id % 180 AS DOUBLE) + 0.5) END AS longitude,
  CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 300 AS DOUBLE) END AS altitude FROM events""")
def gps_parse(spark, sf_dir):
    """Location tags with and without a height and a closing stroke, broken ones and none."""
    i = F.col("event_id").cast("long")
    tag = (
        F.when(i % 5 == 0, F.format_string("+%02d.25-%03d.5+%d/", i % 90, i % 180, i % 300))
        .when(i % 5 == 1, F.format_string(" +%d.25-%d.50", i % 90, i % 180))
        .when(i % 5 == 2, F.format_string("+%d.250-%d.5/", i % 90, i % 180))
        .when(i % 5 == 3, F.format_string("%d.25-%d.5/", i % 90, i % 180))
    )
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), geometry.iso6709(tag).alias("g"))
    return e.select("id", "g.latitude", "g.longitude", "g.altitude")
