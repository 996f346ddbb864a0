"""As-of joins, tracks, matching, evaluation, catalogs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import asof, catalog, matching, tracks


def test_asof_tiers(spark):
    frames = spark.createDataFrame([("s", 1, 1000), ("s", 2, 5000), ("t", 3, 1000), ("s", 4, 100_000)], "session string, frame int, ts long")
    readings = spark.createDataFrame([("s", 1100, 1.0), ("s", 900, 2.0), ("s", 5500, 3.0), ("s", 9000, None)], "session string, rt long, lat double")
    got = {r.frame: r for r in asof.nearest_within(frames, readings, ["session"], "ts", "rt", "frame", [], 2000).withColumn("tier", asof.tier(F.col("delta"))).collect()}
    assert (got[1].rt, got[1].tier) == (900, "exact")  # of two as near, the earlier
    assert got[2].tier == "nearby" and got[3].tier == "unavailable" and got[3].lat is None and got[4].rt is None


def test_asof_equals_brute_force(spark):
    rng = random.Random(5)
    left = [("k%d" % rng.randrange(3), i, rng.randrange(200)) for i in range(80)]
    right = [("k%d" % rng.randrange(3), i, rng.randrange(200)) for i in range(90)]
    got = asof.nearest(spark.createDataFrame(left, "k string, id int, t long"), spark.createDataFrame(right, "k string, rid int, rt long"), ["k"], "t", "rt", "id", "rid").collect()
    for r in got:
        k, _, t = left[r.id]
        assert (r.delta, r.rid) == min((abs(rt - t), rid) for kk, rid, rt in right if kk == k)


def hot(spark, appearance, structural, frames=3):
    rows = [(1, f, float(f), 3, 3, appearance, structural, True, 0.4375, 0.4375) for f in range(frames)]
    rows += [(1, f, float(f), 0, 0, 0.05, 0.0, True, 0.06, 0.06) for f in range(frames)]
    c = spark.createDataFrame(rows, "run_id int, frame int, ts_sec double, row int, col int, appearance double, structural double, valid boolean, cx double, cy double")
    f = spark.createDataFrame([(1, i, 1.0, None) for i in range(frames)], "run_id int, frame int, quality_weight double, registration double")
    return tracks.zones(tracks.link(tracks.candidates(c, medium=0.3), distance=0.5), f, medium=0.3, high=0.55, least_frames=2).collect()


def test_zone_priorities(spark):
    (alone,) = hot(spark, 0.70, 0.0)
    assert alone.priority == "medium" and alone.zone_id == "IZ-001" and alone.persistence == 1.0
    (both,) = hot(spark, 0.70, 0.40)
    assert both.priority == "high" and both.observations == both.total == 3


def test_same_frame_link(spark):
    rows = [(1, f, n, 0.3125, y) for f in range(20) for n, y in ((1, 0.4375), (2, 0.3125)) if n == 1 or f == 0]
    df = spark.createDataFrame(rows, "run_id int, frame int, nth int, cx double, cy double")
    loose = tracks.link(df).groupBy("track").count().collect()
    strict = tracks.link(df, link_same_frame=False).groupBy("track").count().collect()
    assert [r["count"] for r in loose] == [21] and sorted(r["count"] for r in strict) == [1, 20]


def plain_link(rows, distance):
    last, out = [], []
    frame, taken = None, set()
    for f, _, x, y in rows:
        if f != frame:
            frame, taken = f, set()
        best = min(((math.hypot(x - a, y - b), i) for i, (a, b) in enumerate(last) if i not in taken), default=(9, -1))
        if best[0] <= distance:
            last[best[1]] = (x, y)
            taken.add(best[1])
            out.append(best[1] + 1)
        else:
            last.append((x, y))
            out.append(len(last))
    return out


def test_link_equals_plain(spark):
    rng = random.Random(8)
    rows = [(f, n, rng.random(), rng.random()) for f in range(12) for n in range(1, 6)]
    df = spark.createDataFrame([(1, *r) for r in rows], "run_id int, frame int, nth int, cx double, cy double")
    got = {(r.frame, r.nth): r.track for r in tracks.link(df).collect()}
    assert [got[f, n] for f, n, _, _ in rows] == plain_link(rows, 0.14)


def test_circular_median(spark):
    df = spark.createDataFrame([(1, 0, 178.0), (1, 1, 2.0), (1, 2, 0.0)], "g int, i int, a double")
    assert tracks.circular_median(df, ["g"], "a", "i").first().median_angle == 0.0


def boxes(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "run int, id string, ord int, x double, y double, w double, h double")


def test_greedy_match_equals_plain(spark):
    rng = random.Random(2)
    make = lambda p: [(f"{p}{i}", i, rng.random() * 0.6, rng.random() * 0.6, 0.3, 0.3) for i in range(25)]
    a, b = make("a"), make("b")

    def iou(p, q):
        w = max(0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]))
        h = max(0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3]))
        return w * h / (0.18 - w * h)

    left, want = list(b), {}
    for p in a:
        best, score = None, 0.0
        for q in left:
            if iou(p, q) > score:
                best, score = q, iou(p, q)
        want[p[0]] = best[0] if best and score >= 0.3 else None
        if want[p[0]]:
            left.remove(best)
    got = matching.greedy_match(boxes(spark, a), boxes(spark, b), ["run"]).collect()
    assert {r.a_id: r.b_id for r in got} == want
    none = matching.greedy_match(boxes(spark, a), boxes(spark, b).limit(0), ["run"]).collect()
    assert len(none) == 25 and {r.b_id for r in none} == {None} and {r.iou for r in none} == {0.0}


def test_greedy_match_of_a_hot_key(spark):
    """Equal and crowded boxes of one key, in salted tiles, without a group in one Python task."""
    rng = random.Random(5)
    make = lambda p: [(f"{p}{i:03}", rng.randrange(200), rng.randrange(8) / 20, rng.randrange(8) / 20, 0.2 + rng.randrange(2) / 10, 0.3) for i in range(250)]
    a, b = make("a"), make("b")

    def iou(p, q):
        w = max(0.0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]))
        h = max(0.0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3]))
        return w * h / (p[4] * p[5] + q[4] * q[5] - w * h)

    pairs = {(p[0], q[0]): iou(p, q) for p in a for q in b if iou(p, q) >= 0.3}
    found = matching.box_pairs(boxes(spark, a), boxes(spark, b), ["run"], hot=20)
    assert {(r.a_id, r.b_id): r.iou for r in found.collect()} == pairs and found.count() == len(pairs)
    free, want = set(q[0] for q in b), {}
    order = {q[0]: q[1] for q in b}
    for p in sorted(a, key=lambda p: (p[1], p[0])):
        options = [(-v, order[j], j) for (i, j), v in pairs.items() if i == p[0] and j in free]
        want[p[0]] = min(options)[2] if options else None
        free.discard(want[p[0]])
    matched = matching.greedy_match(boxes(spark, a), boxes(spark, b), ["run"])
    assert {r.a_id: r.b_id for r in matched.collect()} == want
    assert "FlatMapGroupsInPandas" not in matched._jdf.queryExecution().toString()


def test_evaluation(spark):
    df = spark.createDataFrame([("CROP", "CROP")] * 3 + [("SOIL", "CROP"), ("FIELD", "SOIL")], "gt string, pred string")
    m = matching.confusion(df, F.col("gt"), F.col("pred"), known=["CROP", "SOIL"])
    s = {r.label: r for r in matching.class_scores(m).collect()}
    assert s["CROP"].recall == 1 and s["CROP"].precision == 0.75 and s["UNKNOWN"].precision is None
    total = matching.summary(matching.class_scores(m), m).first()
    assert total.accuracy == pytest.approx(0.6) and total.miou == pytest.approx(0.75 / 3)


def test_catalog(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "id int, sha256 string")
    got = {r.id: (r.status, r.duplicate_of) for r in catalog.duplicates(rows, "sha256", ["id"], spark.createDataFrame([("z",)], "sha256 string")).collect()}
    assert got == {1: ("valid", None), 2: ("duplicate", 1), 3: ("valid", None), 4: ("duplicate", None)}
    refs = spark.createDataFrame([("a", "x"), ("b", "x")], "logical_id string, sha256 string")
    blobs = rows.select("sha256").distinct()
    assert {r.sha256: r.refs for r in catalog.reference_counts(blobs, refs).collect()} == {"x": 2, "y": 0, "z": 0}
    assert {r.sha256 for r in catalog.orphans(blobs, refs).collect()} == {"y", "z"}


def test_upsert(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, s string, v int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 30)], "k int, s string, v int")
    assert sorted(map(tuple, catalog.upsert(table, new, ["k"]).collect())) == [(1, "a", 10), (2, "c", None), (3, "d", 30)]
    assert sorted(map(tuple, catalog.upsert(table, new, ["k"], only=["s"]).collect())) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]


def test_archive_rules(spark):
    m = [("ok/a.jpg", 0, 10), ("../a.jpg", 0, 10), ("/a.jpg", 0, 10), ("C:/a.jpg", 0, 10), ("a.zip", 0, 10), ("a.tiff", 0, 10), ("l.jpg", 0o120777, 10), ("big.jpg", 0, 30_000_000), ("noext", 0, 1), ("dir/", 0, 0)]
    rows = [("z", i, n, n.endswith("/"), mode, size, max(size // 2, 1)) for i, (n, mode, size) in enumerate(m)] + [("bomb", 0, "b.png", False, 0, 5000, 10)]
    df = spark.createDataFrame(rows, "archive_id string, ord int, name string, is_dir boolean, unix_mode int, file_size long, compress_size long")
    got = {r.name: r.reason for r in catalog.inspect_members(df).collect()}
    assert got == {"ok/a.jpg": None, "../a.jpg": "unsafe path", "/a.jpg": "unsafe path", "C:/a.jpg": "unsafe path", "a.zip": "nested archive", "a.tiff": "unsupported type", "l.jpg": "symlink", "big.jpg": "member too large", "noext": "unsupported type", "b.png": "compression ratio"}
    assert {r.reason for r in catalog.inspect_members(df, most_members=5).where("archive_id = 'z'").collect()} == {"archive: too many members"}
    assert {r.reason for r in catalog.inspect_members(df, most_total=5).where("name = 'ok/a.jpg'").collect()} == {"archive: total size"}
