"""Whitening against numpy's eigensolver and plain Python sums."""

import math

import numpy as np
from pyspark.sql import functions as F

from gleanspark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>"
SMALL = "/root/testdata/sf0.001"


def _plain(vectors, scale=64, offset=1_000_000):
    x = [[math.floor(scale * c) + offset for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    y = np.array([[a - s / n for a, s in zip(r, sums, strict=True)] for r in x])
    values = np.linalg.eigvalsh(y.T @ y / n)[::-1]
    return x, n, sums, y, values


def test_jacobi_small_eigenvalues():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 16, 33):
        graded = np.diag(10.0 ** -np.arange(d)) if d < 12 else np.diag(np.geomspace(1, 1e-9, d))
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        values, vectors = whitening.cyclic_jacobi(turn @ graded @ turn.T)
        assert np.allclose(values, np.diag(graded), rtol=1e-6, atol=1e-16)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    scales = np.geomspace(1, 1e-12, 6)  # badly scaled rows: small eigenvalues keep their digits
    near = np.outer(scales, scales) * (np.eye(6) + 0.1)
    values, _ = whitening.cyclic_jacobi(near)
    assert abs(np.prod(values) / np.prod(scales**2) / (1.6) - 1) < 1e-10


def test_query_against_plain(spark):
    rows = queries.op11_whitening(spark, SMALL).collect()
    source = [r for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x, n, sums, y, values = _plain([r.embedding for r in source])
    assert len(rows) == 32 * n and {r.n for r in rows} == {n}
    exact = {r.vec_id: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for r, v in zip(source, x, strict=True)}
    assert all(exact[r.vec_id] == r.deviation for r in rows)
    order = {r.vec_id: i for i, r in enumerate(source)}
    z = np.zeros((n, 32))
    for r in rows:
        z[order[r.vec_id], r.component - 1] = r.whitened
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        assert 0 <= r.identity_error < 1e-9
    assert np.abs(z.T @ z / n - np.eye(32)).max() < 1e-9 and np.abs(z.mean(axis=0)).max() < 1e-9
    back = np.linalg.lstsq(y, z, rcond=None)[0]  # z is a projection of y on eigenvectors
    assert np.allclose(back.T @ back * values[:32], np.eye(32), atol=1e-8)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [3.0, -2.0]), (8, [-4.0, 0.5]), (8, [-4.0, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("whitening", F.lit("x")).withColumn("n", F.lit(5)).withColumn("v", F.lit(6)).withColumn("row", F.lit(7))
    got = whitening.whiten(df).orderBy("vec_id")
    assert got.columns == ["vec_id", "embedding", "n", "v", "row", "whitening"]
    assert [(r.vec_id, r.whitening.n, len(r.whitening["values"])) for r in got.collect()] == [(None, 4, 2), (1, 4, 2), (8, 4, 2), (8, 4, 2)]
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [len(r.whitening["values"]) for r in whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect()] == [0, 0, 0]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(9)], SCHEMA)).collect()
    assert {len(r.whitening["values"]) for r in flat} == {1}  # one direction has variance


def test_large_entries_stay_exact(spark):
    vectors = [[1e14, 1.0], [-1e14, 2.0], [3e13, -5.0]]
    x, n, sums, _, _ = _plain(vectors)
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).orderBy("vec_id").collect()
    assert [int(r.whitening.deviation) for r in got] == [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 1.0])], SCHEMA)).count() == 2
