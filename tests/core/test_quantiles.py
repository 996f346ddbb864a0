"""Exact quantiles against sorted values, with groups above and below the bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.operators import quantiles as q

FRACTIONS = [0.0, 0.25, 0.5, 0.9, 1.0]


def made(kind: str) -> dict:
    rng = np.random.default_rng(7)
    if kind == "smooth":
        return {"hot": rng.normal(size=5001), "warm": rng.normal(size=300) * 1e9, "small": rng.normal(size=4)}
    if kind == "ties":
        return {"hot": np.concatenate([np.full(2500, 3.0), np.full(2500, 4.0), rng.normal(size=40)]), "same": np.full(700, -1.5), "small": np.array([2.0])}
    return {"hot": np.exp(rng.normal(size=3000) * 40), None: np.concatenate([rng.integers(0, 3, 900).astype(float), [-np.inf, np.inf]])}


def plain(values: np.ndarray) -> list[float]:
    """By ranks: numpy's own quantile gives NaN beside infinities."""
    values, found = np.sort(values), []
    for fraction in FRACTIONS:
        place = (len(values) - 1) * fraction
        low, high = values[int(np.floor(place))], values[int(np.ceil(place))]
        found.append(low if low == high else low + (high - low) * (place - np.floor(place)))
    return found


@pytest.mark.parametrize("kind", ["smooth", "ties", "wild"])
def test_equals_sorted_values(spark, kind):
    groups = made(kind)
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("empty", None), ("hot", None)]
    df = spark.createDataFrame(rows, "grp string, v double").repartition(5)
    found = {r.grp: r.q for r in q.exact_quantiles(df, ["grp"], F.col("v"), FRACTIONS, most=50).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        np.testing.assert_allclose(found[k], plain(values), rtol=1e-9)


def test_medians_alike_at_every_size(spark):
    df = spark.range(3000).select((F.col("id") % 3 % 2).alias("g"), F.sin("id").alias("a"), F.when(F.col("id") % 5 > 0, F.cos("id")).alias("b"))
    columns = {"ma": F.col("a"), "mb": F.col("b")}
    few, many = (sorted(map(tuple, q.medians(df, ["g"], columns, most).collect())) for most in (100, 10_000))
    np.testing.assert_allclose(few, many, rtol=1e-12)
    assert q.medians(df.limit(0), ["g"], columns).count() == 0
    assert q.exact_quantiles(df.limit(0), ["g"], F.col("a"), [0.5]).count() == 0
