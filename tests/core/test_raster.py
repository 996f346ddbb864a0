"""Masks as runs, rows of crops and structural evidence, against plain versions on arrays."""

import numpy as np
import pytest

from gleanspark.operators import asof, pixels, raster, row_lines, structure, tracks

KEYS = ["p"]


def _noise(rng, h, w, least):
    a = rng.random((h, w))
    return (a + np.roll(a, 1, 0) + np.roll(a, 1, 1) + np.roll(a, (1, 1), (0, 1))) / 4 > least


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(2)
    found = {1: _noise(rng, 40, 50, 0.5), 2: _noise(rng, 33, 70, 0.45), 3: np.zeros((5, 6), bool) | (np.arange(6) > 2), 4: _noise(rng, 90, 40, 0.42), 5: np.zeros((4, 4), bool)}
    pixels = [(k, int(y), int(x)) for k, m in found.items() for y, x in zip(*np.nonzero(m), strict=True)]
    shapes = spark.createDataFrame([(k, *m.shape) for k, m in found.items()], "p int, height int, width int")
    runs = raster.mask_runs(spark.createDataFrame(pixels + pixels[:50], "p int, y int, x int"), KEYS)
    return found, runs, shapes


def _back(runs, pictures):
    out = {k: np.zeros_like(m) for k, m in pictures.items()}
    for r in raster.run_pixels(runs, KEYS).collect():
        out[r.p][r.y, r.x] = True
    return out


def _element(size):
    r = size // 2
    out = np.zeros((size, size), bool)
    for dy, w in raster.ellipse(size):
        out[dy + r, r - w : r + w + 1] = True
    return out


def _dilated(mask, size):
    element, r, out = _element(size), size // 2, np.zeros_like(mask)
    padded = np.pad(mask, r)
    for i, j in zip(*np.nonzero(element), strict=True):
        out |= padded[i : i + mask.shape[0], j : j + mask.shape[1]]
    return out


def _eroded(mask, size):
    return ~_dilated(~mask, size)


def _flood(mask, diagonal):
    out = np.full(mask.shape, -1, np.int64)
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x] >= 0:
            continue
        stack = [(y, x)]
        out[y, x] = (int(y) << 32) + int(x)
        while stack:
            a, b = stack.pop()
            for c in (-1, 0, 1):
                for d in (-1, 0, 1):
                    i, j = a + c, b + d
                    if (diagonal or not (c and d)) and 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and out[i, j] < 0:
                        out[i, j] = out[y, x]
                        stack.append((i, j))
    return out


def test_ellipse():
    assert _element(3).astype(int).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
    assert _element(5).sum(axis=1).tolist() == [1, 5, 5, 5, 1]


def test_cleaning(pictures):
    found, runs, shapes = pictures
    got = _back(raster.cleaned(runs, KEYS, shapes), found)
    for k, m in found.items():
        want = _dilated(_eroded(m, 5), 5)
        want = _eroded(_eroded(_dilated(_dilated(want, 5), 5), 5), 5)
        assert (got[k] == want).all()


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(pictures, diagonal):
    found, runs, _ = pictures
    want = {k: _flood(m, diagonal) for k, m in found.items()}
    got = raster.labelled(runs, KEYS, diagonal, band=7).collect()
    assert sum(r.x1 - r.x0 for r in got) == sum(m.sum() for m in found.values())
    assert all((want[r.p][r.y, r.x0 : r.x1] == r.component).all() for r in got)


def test_field_mask(pictures):
    found, runs, shapes = pictures
    got = _back(raster.field_mask(runs, KEYS, shapes, most_hole=0.02), found)
    for k, m in found.items():
        h, w = m.shape
        want = _dilated(_eroded(m, 3), 3)
        holes = _flood(~want, True)
        for c in np.unique(holes[holes >= 0]):
            ys, xs = np.nonzero(holes == c)
            if len(ys) <= int(0.02 * h * w) and ys.min() > 0 and xs.min() > 0 and ys.max() < h - 1 and xs.max() < w - 1:
                want[ys, xs] = True
        parts = _flood(want, True)
        sizes = {c: int((parts == c).sum()) for c in np.unique(parts[parts >= 0])}
        bar = max(int(0.02 * h * w), int(0.15 * max(sizes.values(), default=0)))
        assert (got[k] == np.isin(parts, [c for c, n in sizes.items() if n >= bar])).all()


@pytest.mark.parametrize(("tile", "rounds"), [(16, 2), (256, 16)])
def test_thinning(pictures, tile, rounds):
    found, runs, shapes = pictures
    thick = raster.closed(runs, KEYS, shapes, raster.ellipse(3))
    got = _back(raster.thinned(thick, KEYS, tile, rounds), found)
    for k, m in _back(thick, found).items():
        while True:
            after = _zhang_suen(m)
            if (after == m).all():
                break
            m = after
        assert (got[k] == m).all()


def _zhang_suen(mask):
    """Both passes, pixel by pixel."""
    now = {(y, x) for y, x in zip(*np.nonzero(mask), strict=True)}
    for first, second in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
        gone = set()
        for y, x in now:
            p = [(y + dy, x + dx) in now for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            turns = sum(not p[i] and p[(i + 1) % 8] for i in range(8))
            if 2 <= sum(p) <= 6 and turns == 1 and not all(p[i] for i in first) and not all(p[i] for i in second):
                gone.add((y, x))
        now -= gone
    out = np.zeros_like(mask)
    for y, x in now:
        out[y, x] = True
    return out


def test_empty_masks(spark):
    none = spark.createDataFrame([], "p int, y int, x0 int, x1 int")
    shapes = spark.createDataFrame([(1, 3, 4)], "p int, height int, width int")
    assert raster.run_pixels(raster.complement(none, KEYS, shapes), KEYS).count() == 12
    for made in (raster.cleaned(none, KEYS, shapes), raster.labelled(none, KEYS), raster.field_mask(none, KEYS, shapes), raster.thinned(none, KEYS)):
        assert made.count() == 0


def test_rows_of_planted_lines(spark):
    """Three rows 40 pixels apart at 30 degrees, one of them broken, and some noise."""
    points = {(1, int(round(60 + 40 * k + t * 0.5)), int(round(10 + t * 0.866))) for k in range(3) for t in range(150) if not (k == 1 and 60 < t < 100)}
    rng = np.random.default_rng(1)
    points |= {(1, int(y), int(x)) for y, x in rng.integers(0, 250, (40, 2))}
    pixels = spark.createDataFrame(sorted(points), "p int, y int, x int")
    lines = row_lines.peaks(row_lines.votes(pixels, KEYS), KEYS)
    found = row_lines.rows_of(row_lines.segments(pixels, lines, KEYS), KEYS)
    rows = found.where("consistent").orderBy("offset").collect()
    assert len(rows) == 3 and all(abs(r.dominant_angle - 30) < 1.5 and r.support > 90 for r in rows)
    assert all(abs(b.offset - a.offset - 40 * np.cos(np.radians(30))) < 2 for a, b in zip(rows, rows[1:]))
    summary = row_lines.row_summary(found, KEYS).first()
    assert summary.consistent_rows == 3 and summary.strongest == max(r.support for r in rows)
    assert row_lines.rows_of(row_lines.segments(pixels.limit(0), lines.limit(0), KEYS), KEYS).count() == 0


def test_scaling_takes_nearest_pixels(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((23, 57)) > 0.5
    pixels = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "p int, y int, x int")
    shapes = spark.createDataFrame([(1, 23, 57)], "p int, height int, width int")
    got = row_lines.scaled(pixels, KEYS, shapes, 20).collect()
    h, w = round(23 * 20 / 57), 20
    small = mask[np.arange(h) * 23 // h][:, np.arange(w) * 57 // w]
    assert {(r.y, r.x) for r in got} == {(int(y), int(x)) for y, x in zip(*np.nonzero(small), strict=True)} and {r.scale for r in got} == {20 / 57}
    same = row_lines.scaled(pixels, KEYS, shapes, 800)
    assert same.count() == mask.sum() and same.first().scale == 1.0


def test_continuity_finds_a_gap(spark):
    occ = np.zeros((160, 160))
    occ[30:32, :] = occ[90:92, :] = 0.9
    occ[90:92, 86:93] = 0
    pixels = spark.createDataFrame([(1, int(y), int(x), float(occ[y, x])) for y, x in zip(*np.nonzero(occ), strict=True)], "p int, y int, x int, value double")
    shapes = spark.createDataFrame([(1, 160, 160), (2, 160, 160)], "p int, height int, width int")
    angles = spark.createDataFrame([(1, 0.0), (2, None)], "p int, angle double")
    got = {(r.row, r.col): r.continuity for r in structure.continuity(pixels, angles, KEYS, shapes).collect()}
    assert len(got) == 64 and got[4, 4] > 0.5 and got[1, 4] == 0


def test_fragmentation(spark):
    rng = np.random.default_rng(3)
    occ, field = rng.random((20, 26)), rng.random((20, 26)) > 0.2
    rows = [(1, y, x, float(occ[y, x]), bool(field[y, x])) for y in range(20) for x in range(26)]
    got = structure.fragmentation(spark.createDataFrame(rows, "p int, y int, x int, value double, in_field boolean"), KEYS, spark.createDataFrame([(1, 20, 26)], "p int, height int, width int"))
    v = np.where(field, occ, 0)
    boxes = np.lib.stride_tricks.sliding_window_view(np.pad(v, 7, mode="reflect"), (15, 15))
    want = np.where(field, np.clip(boxes.mean((2, 3)) - v, 0, 1) * np.clip(20 * boxes.var((2, 3)), 0, 1), 0)
    found = {(r.y, r.x): r.fragments for r in got.collect()}
    assert len(found) == 520 and all(abs(want[k] - f) < 1e-9 for k, f in found.items())
    cells = {(r.row, r.col): r.fragments for r in structure.cell_fragments(got, KEYS, 2, 2).collect()}
    assert abs(cells[0, 1] - want[:10, 13:][field[:10, 13:]].mean()) < 1e-9


def test_circular_median_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(g, i, float(a)) for g in range(30) for i, a in enumerate(np.round(rng.uniform(0, 180, rng.integers(1, 40)) if g % 2 else rng.normal(0, 9, 20) % 180, int(rng.integers(0, 3))))]
    got = {r.g: r.median_angle for r in tracks.circular_median(spark.createDataFrame(rows, "g int, i int, a double"), ["g"], "a", "i").collect()}
    for g in range(30):
        mine = [(i, a) for k, i, a in rows if k == g]
        cost = lambda a: round(sum(min(abs(a - b) % 180, 180 - abs(a - b) % 180) for _, b in mine), 6)  # noqa: B023, E731
        assert got[g] == min((cost(a), i, a) for i, a in mine)[2]


def test_dense_descriptors(spark):
    rng = np.random.default_rng(8)
    data = [("a", 40, 48, rng.integers(0, 256, (40, 48, 3)).astype(np.uint8)), ("b", 3, 3, rng.integers(0, 256, (3, 3, 3)).astype(np.uint8))]
    df = spark.createDataFrame([(p, h, w, d.tobytes()) for p, h, w, d in data], "path string, height int, width int, data binary")
    raw = pixels.dense_descriptors(df)
    cells = raw.where("path = 'a'").collect()
    assert len(cells) == 64 and {len(r.raw) for r in cells} == {54} and raw.where("path = 'b'").count() == 9
    got = pixels.whitened_cells(raw, ["path"]).where("path = 'a'").collect()
    x = np.array([r.raw for r in cells])
    u, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    n = int((np.linalg.svd(x - x.mean(0), compute_uv=False) > 1e-8).sum())
    z = u[:, :n] * np.sqrt(63) * np.where(vt[:n, :][np.arange(n), np.abs(vt[:n]).argmax(1)] < 0, -1, 1)
    want = {(r.row, r.col): v / np.linalg.norm(v) for r, v in zip(cells, z, strict=True)}
    for r in got:
        assert len(r.embedding) == 64 and abs(np.linalg.norm(r.embedding) - 1) < 1e-5
        assert np.allclose(r.embedding[:20], want[r.row, r.col][:20], atol=1e-4) and np.allclose(r.embedding[n:], 0)
    one = spark.createDataFrame([("c", 0, 0, [1.0, 2.0])], "path string, row int, col int, raw array<double>")
    assert pixels.whitened_cells(one, ["path"]).first().embedding == [0.0] * 64


def test_nearest_over_many_buckets(spark):
    rng = np.random.default_rng(5)
    left = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 5000, 300), strict=True))] + [(None, 40, 900), (9, 1, 901)]
    right = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 5000, 40) // 100 * 100, strict=True))] + [(None, 70, 500)]
    sides = spark.createDataFrame(left, "k int, t int, a int"), spark.createDataFrame(right, "k int, rt int, b int")
    for most in (1, 7, 100_000):
        got = {r.a: (r.b, r.delta) for r in asof.nearest(*sides, ["k"], "t", "rt", "a", "b", rows_per_bucket=most).collect()}
        for k, t, a in left:
            want = min(((abs(t - rt), b) for k2, rt, b in right if k2 == k), default=(None, None))
            assert got[a] == want[::-1]
