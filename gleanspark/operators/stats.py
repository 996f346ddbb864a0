"""Robust statistics per group, per neighbourhood and over vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.geometry import clip
from gleanspark.operators.quantiles import exact_quantiles, medians

MAD_SCALE = 1.4826


def serial_mean(values: Column) -> Column:
    """The mean of an array of doubles without its nulls (none: null), added from first to last."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size(known), F.lit(0))


def _with(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of table, one row per group; null keys are groups too."""
    named = table.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return df.join(named, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def robust_zs(df: DataFrame, values: dict[str, float], keys: list[str], valid: Column | None = None, prefix: str = "z_") -> DataFrame:
    """df with z_<value>: |x - median| / (1.4826 max(MAD, floor)) within keys for each value and its floor; 0 for invalid rows.

    All values share two small aggregates, joined back.
    """
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    x = {c: F.when(ok, F.col(c)) for c in values}
    centred = _with(df, medians(df, keys, {f"_med_{c}": x[c] for c in values}), keys)
    mads = medians(centred, keys, {f"_mad_{c}": F.abs(x[c] - F.col(f"_med_{c}")) for c in values})
    scores = {}
    for c, floor in values.items():
        scale = MAD_SCALE * F.greatest(F.col(f"_mad_{c}"), F.lit(floor))
        scores[f"{prefix}{c}"] = F.when(ok & F.col(f"_med_{c}").isNotNull(), F.abs(F.col(c) - F.col(f"_med_{c}")) / scale).otherwise(0.0)
    return _with(centred, mads, keys).withColumns(scores).drop(*[f"_med_{c}" for c in values], *[f"_mad_{c}" for c in values])


def robust_z(df: DataFrame, value: str, keys: list[str], floor: float = 0.01, valid: Column | None = None, out: str = "z") -> DataFrame:
    """df with the robust z of one value."""
    return robust_zs(df, {value: floor}, keys, valid, "_robust_").withColumnRenamed(f"_robust_{value}", out)


def neighbours(df: DataFrame, keys: list[str], radius: int = 2, columns: tuple[str, ...] = ("value",), prefix: str = "n_") -> DataFrame:
    """Each cell (row, col) with the cells within Chebyshev distance radius, itself excluded: an equi-join on exploded offsets."""
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    probes = df.withColumn("_dr", steps).withColumn("_dc", steps).where("_dr <> 0 OR _dc <> 0")
    other = df.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), *[F.col(c).alias(prefix + c) for c in columns])
    return probes.withColumn("_r", F.col("row") + F.col("_dr")).withColumn("_c", F.col("col") + F.col("_dc")).join(other, [*keys, "_r", "_c"]).drop("_r", "_c", "_dr", "_dc")


def local_robust_z(df: DataFrame, keys: list[str], value: str = "value", radius: int = 2, floor: float = 0.01, least: int = 4, out: str = "local_z") -> DataFrame:
    """Robust z of each cell against its neighbours; 0 with fewer than ``least`` of them. Cells are unique per keys, row, col."""
    cell = [*keys, "row", "col"]
    near = neighbours(df.select(*cell, value), keys, radius, (value,))
    med = near.groupBy(*cell).agg(F.median("n_" + value).alias("_med"), F.count("*").alias("_n"))
    mad = near.join(med, cell).groupBy(*cell).agg(F.median(F.abs(F.col("n_" + value) - F.col("_med"))).alias("_mad"))
    z = F.abs(F.col(value) - F.col("_med")) / (MAD_SCALE * F.greatest(F.col("_mad"), F.lit(floor)))
    found = df.join(med, cell, "left").join(mad, cell, "left")
    return found.withColumn(out, F.when(F.coalesce("_n", F.lit(0)) >= least, z).otherwise(0.0)).drop("_med", "_mad", "_n")


def unit_score(z: Column, keys: list[str], least_range: float = 1.0) -> Column:
    """clip(z/4); where z ranges over 1 or more within keys, .55 of it plus .45 of the min-max scaled one."""
    w = Window.partitionBy(*keys)
    scaled = clip(z / 4.0, 0.0, 1.0)
    low, high = F.min(scaled).over(w), F.max(scaled).over(w)
    minmax = F.when(high - low < 1e-9, 0.0).otherwise((scaled - low) / (high - low))
    return F.when(F.max(z).over(w) - F.min(z).over(w) >= least_range, 0.55 * scaled + 0.45 * minmax).otherwise(scaled)


def fused_score(parts: dict[str, tuple[Column, float]], forest: Column | None = None, forest_weight: float = 0.18) -> Column:
    """Weighted mean of unit scores, cut to 0..1. With a forest score the others give it room."""
    scale = max(1.0 - forest_weight, 0.5) if forest is not None else 1.0
    terms = [(c, w * scale) for c, w in parts.values()] + ([(forest, forest_weight)] if forest is not None else [])
    total = sum(w for _, w in terms)
    return clip(sum((c * w for c, w in terms), F.lit(0.0)) / total, 0.0, 1.0)


def median_vector(df: DataFrame, vector: str, keys: list[str] | None = None) -> DataFrame:
    """The component-wise median of non-zero vectors, at unit length: keys..., baseline array<double>."""
    keys = keys or []
    values = df.select(*keys, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("_i", "_x"), F.exists(vector, lambda x: x != 0).alias("_any"))
    middle = medians(values.where("_any"), [*keys, "_i"], {"_x": F.col("_x")})
    packed = middle.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_v"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)) + 1e-8
    return packed.withColumn("_l", length).select(*keys, F.transform("_v", lambda x: x / F.col("_l")).alias("baseline"))


def group_quartiles(df: DataFrame, group: Column, value: Column, name: str = "grp") -> DataFrame:
    """Count, median and interpolated quartiles per group; a null group is 'ungrouped'."""
    x = F.coalesce(value, F.lit(0.0))
    rows = df.select(F.coalesce(group, F.lit("ungrouped")).alias(name), x.alias("x"))
    found = rows.groupBy(name).agg(F.count("*").alias("n")).join(exact_quantiles(rows, [name], F.col("x"), [0.5, 0.25, 0.75]), name)
    return found.select(name, "n", *[F.col("q")[i].alias(part) for i, part in enumerate(("median", "q1", "q3"))])


def spacings(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys..., spacing: differences of consecutive sorted positions."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.select(*keys, (F.col(position) - F.lag(position).over(w)).alias("spacing")).where("spacing IS NOT NULL")


def uniformity(spacing: Column, nominal: Column) -> list[Column]:
    """Shares of misses (> 1.5 nominal) and multiples (<= .5 nominal), and what is left of 100."""
    miss = F.coalesce(100 * F.avg((spacing > 1.5 * nominal).cast("double")), F.lit(0.0))
    multiple = F.coalesce(100 * F.avg((spacing <= 0.5 * nominal).cast("double")), F.lit(0.0))
    return [miss.alias("miss_pct"), multiple.alias("multiple_pct"), (100 - miss - multiple).alias("quality_index")]


def irregularity(df: DataFrame, keys: list[str], spacing: str = "spacing") -> DataFrame:
    """Median spacing, shares far above and below it, and population deviation over the median."""
    med = df.groupBy(*keys).agg(F.median(spacing).alias("median_spacing"))
    rows = df.join(med, keys)
    m = F.col("median_spacing")
    return rows.groupBy(*keys, "median_spacing").agg(
        F.count("*").alias("n"),
        (100 * F.avg((F.col(spacing) > 1.5 * m).cast("double"))).alias("large_pct"),
        (100 * F.avg((F.col(spacing) <= 0.5 * m).cast("double"))).alias("tight_pct"),
        F.when(F.first(m) > 0, F.stddev_pop(spacing) / F.first(m)).otherwise(0.0).alias("cv"),
    )


def isolation_forest(df: DataFrame, keys: list[str], features: list[str], schema: str, trees: int = 100, seed: int = 0, least: int = 8) -> DataFrame:
    """keys..., id columns of ``schema`` and score (0 to 1, higher: more isolated) per group, in grouped pandas.

    A group is one frame's cells, bounded by the grid. Groups under ``least`` rows score 0. Ties share their score.
    """

    def depth_norm(n: int) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def path(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, depth: int, limit: int, out: np.ndarray, of: np.ndarray) -> None:
        sample = x[of]
        spread = np.flatnonzero(sample.max(axis=0) > sample.min(axis=0)) if len(of) > 1 else []
        if depth >= limit or len(spread) == 0:
            out[rows] += depth + depth_norm(len(of))
            return
        f = rng.choice(spread)
        cut = rng.uniform(sample[:, f].min(), sample[:, f].max())
        path(x, rows[x[rows, f] < cut], rng, depth + 1, limit, out, of[sample[:, f] < cut])
        path(x, rows[x[rows, f] >= cut], rng, depth + 1, limit, out, of[sample[:, f] >= cut])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(pdf.columns)).reset_index(drop=True)
        n = len(pdf)
        if n < least:
            return pdf.assign(score=0.0)
        x = pdf[features].to_numpy(float)
        x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
        rng, depths, size = np.random.default_rng(seed), np.zeros(n), min(256, n)
        for _ in range(trees):
            of = rng.choice(n, size, replace=False)
            path(x, np.arange(n), rng, 0, math.ceil(math.log2(size)), depths, of)
        return pdf.assign(score=2.0 ** (-depths / trees / depth_norm(size)))

    return df.groupBy(*keys).applyInPandas(score, schema)

