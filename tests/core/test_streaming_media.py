"""Streams equal tables; pictures, archives, EXIF and reports."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanspark.operators import pixels
from gleanspark.plans import report
from gleanspark.sources import media
from gleanspark.streaming import live

EVENTS = "/root/testdata/sf0.001/events.parquet"


def streamed(spark, tmp_path, df, files, make, mode="append"):
    """make(stream) over df fed file by file; the rows it gave."""
    path = str(tmp_path / "in")
    df.repartitionByRange(files, "event_id").write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    name = "out_" + tmp_path.name.replace("-", "_")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


@pytest.fixture
def events(spark):
    e = spark.read.parquet(EVENTS).where("user_id < 30").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", "value", "ts").coalesce(1)


def test_rolling_equals_window(spark, tmp_path, events):
    got = {(r.user_id, r.event_id): r for r in streamed(spark, tmp_path, events, 1, lambda s: live.rolling(s, "user_id", "event_id", "value"))}
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-19, 0)
    want = events.select("user_id", "event_id", F.avg("value").over(w).alias("m"), F.count("*").over(w).alias("n")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.user_id, r.event_id].rolling_mean == pytest.approx(r.m) and got[r.user_id, r.event_id].n == r.n


def test_state_changes_over_batches(spark, tmp_path):
    rows = [(i, 1, s) for i, s in enumerate(["connecting", "live", "live", "stream_lost", "reconnecting", "live", "live"])]
    df = spark.createDataFrame(rows, "event_id long, session_id long, status string")
    got = streamed(spark, tmp_path, df, 1, lambda s: live.state_changes(s, "session_id", "event_id"))
    assert [r.status for r in sorted(got, key=lambda r: r.event_id)] == ["connecting", "live", "stream_lost", "reconnecting", "live"]


def test_watermarked_windows(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, 1, lambda s: live.hourly(s, "ts", ["event_type"], "value"), "complete")
    want = live.hourly(events, "ts", ["event_type"], "value").collect()
    key = lambda r: (r["window"].start, r.event_type)
    assert sorted((key(r), r.n) for r in got) == sorted((key(r), r.n) for r in want)


def test_newest_and_latest(spark, events):
    got = live.newest_per_tick(events, "user_id", "ts", 0.1)
    assert got.groupBy("user_id", "tick").count().where("count > 1").isEmpty()
    assert got.count() == events.groupBy("user_id", F.window("ts", "10 seconds")).count().count()
    last = live.latest_state(events, "user_id", "event_type", "value", "event_id")
    assert last.count() == events.select("user_id", "event_type").distinct().count()


def test_telemetry_and_status(spark):
    raw = spark.createDataFrame([('{"timestamp": 1000, "data": {"latitude": 40.0, "elevation": 7.5}}',), ("junk",)], "value string")
    (row,) = media.telemetry(raw).collect()
    assert row.latitude == 40.0 and row.altitude_m == 7.5 and row.longitude is None
    frames = spark.createDataFrame([("s", "f", 1100)], "session_id string, frame string, ms long")
    got = live.with_telemetry(frames, media.telemetry(raw).withColumn("session_id", F.lit("s")), "session_id", "ms", "frame").first()
    assert got.availability == "exact" and media.pose(media.telemetry(raw)).first().ts == 1.0
    s = spark.createDataFrame([(None, True, False), (1.0, True, False), (9.0, False, False), (9.0, True, False), (1.0, True, True)], "t double, c boolean, e boolean")
    assert [r[0] for r in s.select(live.session_status(F.col("t"), F.col("c"), F.col("e"))).collect()] == ["connecting", "live", "stream_lost", "reconnecting", "ended"]


def test_pixels(spark):
    px = media.synthetic_field(spark, 1, 64, 48)
    shares = pixels.class_shares(px, ["frame"], "label", ["CROP", "BARE_SOIL", "WATER"]).first()
    assert shares.crop > 0.4 and shares.water == 0
    guess = px.withColumn("pred", pixels.colour_class(F.col("b"), F.col("g"), F.col("r")))
    assert guess.where("label = 'CROP' AND pred = 'CROP'").count() > 0.9 * px.where("label = 'CROP'").count()
    picture = np.full((40, 40, 3), 128, np.uint8)
    striped = picture.copy()
    striped[:, ::2] = (40, 40, 40)
    striped[:, 1::2] = (200, 200, 200)
    df = spark.createDataFrame([("flat", 40, 40, picture.tobytes()), ("striped", 40, 40, striped.tobytes())], "path string, height int, width int, data binary")
    q = {r.path: r for r in pixels.quality(df).collect()}
    assert q["flat"].sharpness < 0.3 < 0.9 < q["striped"].sharpness and q["flat"].exposure > 0.9
    o = {r.path: r for r in pixels.orientations(spark.createDataFrame([("wide", 40, 40, np.repeat(striped[:, ::4], 4, 1)[:, :40].tobytes()), ("flat", 40, 40, picture.tobytes())], df.schema)).collect()}
    assert np.isnan(o["flat"].angle or np.nan) and o["flat"].coherence == 0
    assert pixels.pixel_rows(df).count() == 3200
    assert pixels.textures(df).count() == 2
    cells = pixels.descriptors(df).collect()
    assert len(cells) == 128 and all(abs(sum(x * x for x in c.embedding) - 1) < 1e-3 and len(c.embedding) == 32 for c in cells)
    assert guess.where("label = 'BARE_SOIL' AND pred = 'BARE_SOIL'").count() > 0.7 * px.where("label = 'BARE_SOIL'").count()
    stats = pixels.colour_stats(pixels.pixel_rows(df), ["path"]).collect()
    assert {r.veg_fraction for r in stats} == {0.0}


def test_kernels():
    bgr = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [255, 255, 255], [0, 0, 0]]], np.uint8)
    assert pixels.hsv(bgr)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0]]
    assert np.allclose(pixels.lab(bgr)[0][0], [136, 208, 195], atol=1) and np.allclose(pixels.lab(bgr)[0][3], [255, 128, 128], atol=1)
    line = np.zeros((80, 80), bool)
    line[38:43, 4:76] = True
    angle, coherence = pixels.structure_tensor(np.where(line, 255.0, 0.0))
    assert min(angle, 180 - angle) < 5 and coherence > 0.5


def test_lines_and_labels(spark):
    px = spark.createDataFrame([("p", 0, 5), ("p", 100, 5)], "path string, x int, y int")
    lines = spark.createDataFrame([("p", 90.0, 10.0)], "path string, angle double, offset double")
    assert [r.line_offset for r in pixels.nearest_line(px, lines, ["path"]).orderBy("x").collect()] == [10.0, None]
    m = spark.createDataFrame([(1, "CROP", 0), (1, "TREE", 1), (2, "A", 0), (2, "B", 1)], "px int, label string, ord int")
    got = {r.px: r.label for r in pixels.strongest_label(m, ["px"], "label", {"CROP": 1, "TREE": 5}, "ord").collect()}
    assert got == {1: "TREE", 2: "B"}


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/x.jpg", b"12345")
        z.writestr("y.txt", b"1")
    (tmp_path / "ok.zip").write_bytes(buffer.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    got = media.zip_members(media.binaries(spark, str(tmp_path), "*.zip")).collect()
    assert sorted(r.name for r in got) == ["a/x.jpg", "y.txt"]
    assert media.read_member(buffer.getvalue(), "a/x.jpg", 5) == b"12345"
    assert media.read_member(buffer.getvalue(), "a/x.jpg", 4) is None and media.read_member(buffer.getvalue(), "q", 4) is None


def test_exif():
    def ratio(*values):
        return b"".join(struct.pack("<II", int(v * 100), 100) for v in values)

    gps = [(1, 2, 2, b"S\0\0\0"), (2, 5, 3, struct.pack("<I", 100)), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, struct.pack("<I", 124)), (5, 1, 1, b"\1\0\0\0"), (6, 5, 1, struct.pack("<I", 148))]
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 0x8825, 4, 1, 26) + struct.pack("<I", 0)
    block = head + struct.pack("<H", 6) + b"".join(struct.pack("<HHI", a, b, c) + d for a, b, c, d in gps)
    block = block.ljust(100, b"\0") + ratio(40, 30, 36) + ratio(7, 30, 0) + ratio(12.5)
    got = media.exif_gps(b"\xff\xd8\xff\xe1xxExif\0\0" + block)
    assert got == pytest.approx({"latitude": -40.51, "longitude": 7.5, "altitude": -12.5})
    assert media.exif_gps(b"") is None and media.exif_gps(b"II*\0") is None


def test_reports(spark):
    df = spark.createDataFrame([("r", ("/a/b.mp4", 2.0), [(1, None)], {"heat": "/x/y/heat.png"})], "run_id string, source struct<path:string,duration_sec:double>, zones array<struct<zone_no:int,first_seen:double>>, artifacts map<string,string>")
    got = json.loads(report.json_report(report.redacted(df, artifacts="artifacts")).first().report)
    assert got == {"runId": "r", "source": {"durationSec": 2.0}, "zones": [{"zoneNo": 1, "firstSeen": None}], "artifacts": {"heat": "heat.png"}}
    areas = spark.createDataFrame([("s", 1, '{"type":"Point","coordinates":[1.0,2.0]}'), ("s", 2, None)], "session string, area int, geometry string")
    fc = json.loads(report.feature_collection(areas, "session", "geometry", ["area"]).first().geojson)
    assert [f["geometry"] is None for f in fc["features"]] == [False, True]
    h = spark.range(1).select(report.canonical_hash({"b": F.lit(1), "a": F.lit("x")}, 16).alias("h"), report.canonical_hash({"a": F.lit("x"), "b": F.lit(1)}, 16).alias("k")).first()
    assert h.h == h.k and len(h.h) == 16


def test_sampling(spark):
    frames = spark.range(100).select(F.lit("r").alias("run_id"), F.col("id").alias("idx"))
    assert [r.idx for r in media.sampled(frames, F.lit(25.0), 10.0, 5).orderBy("idx").collect()] == [0, 2, 4, 6, 8]
    assert media.replicated(spark.range(1), 1).count() == 3 and media.replicated(spark.range(1), 99).count() == 8
