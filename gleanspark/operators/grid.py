"""Grids: bins, smoothing, boundaries, connected units."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.geometry import angle_difference


def bounds(spark, height: int, width: int, rows: int = 8, cols: int = 8) -> DataFrame:  # noqa: ANN001
    """row, col, y0, y1, x0, x1 of each cell: truncated starts, the last row and column reach the edge."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    edge = lambda i, n, size: F.when(i == n, F.lit(size)).otherwise(F.floor(i * size / n)).cast("int")
    return cells.select("row", "col", edge(F.col("row"), rows, height).alias("y0"), edge(F.col("row") + 1, rows, height).alias("y1"), edge(F.col("col"), cols, width).alias("x0"), edge(F.col("col") + 1, cols, width).alias("x1"))


def cell_of(i: Column, size: int, cells: int) -> Column:
    """The cell whose truncated bounds hold pixel i: the largest c with floor(c size / cells) <= i."""
    return F.least(F.floor(((i + 1) * cells - 1) / size), F.lit(cells - 1)).cast("int")


def smoothed(df: DataFrame, keys: list[str], value: str = "value", rows: int = 8, cols: int = 8, share: float = 0.35, out: str = "smooth") -> DataFrame:
    """(1-share) x + share of the 3x3 kernel [1 2 1; 2 4 2; 1 2 1]/16, edges repeated. Missing cells count as 0."""
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    probes = df.select(*keys, "row", "col").withColumn("_dr", steps).withColumn("_dc", steps)
    probes = probes.withColumn("_r", inside(F.col("row") + F.col("_dr"), rows)).withColumn("_c", inside(F.col("col") + F.col("_dc"), cols))
    probes = probes.withColumn("_w", F.element_at(F.array(*map(F.lit, (4, 2, 1))), (F.abs("_dr") + F.abs("_dc") + 1).cast("int")) / 16.0)
    other = df.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    kernel = probes.join(other, [*keys, "_r", "_c"], "left").groupBy(*keys, "row", "col").agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))).alias("_k"))
    return df.join(kernel, [*keys, "row", "col"]).withColumn(out, (1 - share) * F.col(value) + share * F.col("_k")).drop("_k")


def weighted_heat(df: DataFrame, keys: list[str], heat: Column, weight: Column) -> DataFrame:
    """keys..., heat: sum(heat weight) / sum(weight); 0 without weight."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(F.when(total > 0, F.sum(heat * weight) / total).otherwise(0.0).alias("heat"))


def edges(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """4-adjacent pairs: each cell with its right and lower neighbour; columns prefixed a_ and b_."""
    a = cells.select(*keys, F.col("row").alias("a_row"), F.col("col").alias("a_col"), *[F.col(c).alias(f"a_{c}") for c in columns])
    a = a.withColumn("_d", F.explode(F.array(*map(F.lit, (0, 1))))).withColumn("b_row", F.col("a_row") + F.col("_d")).withColumn("b_col", F.col("a_col") + 1 - F.col("_d")).drop("_d")
    b = cells.select(*keys, F.col("row").alias("b_row"), F.col("col").alias("b_col"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, [*keys, "b_row", "b_col"])


def boundary_cost(vegetation: float = 0.35, residue: float = 0.25, colour: float = 0.25, angle: float = 0.15) -> Column:
    """Weighted difference of the cells of an edge (columns of :func:`edges`); 1 if either is invalid."""
    a, b = (lambda p: lambda c: F.col(f"{p}_{c}"))("a"), (lambda p: lambda c: F.col(f"{p}_{c}"))("b")
    colours = F.sqrt(F.aggregate(F.zip_with(a("color"), b("color"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) / 255.0
    turn = F.coalesce(angle_difference(a("angle"), b("angle")) / 90.0, F.lit(0.0))
    cost = vegetation * F.abs(a("veg") - b("veg")) + residue * F.abs(a("residue") - b("residue")) + colour * colours + angle * turn
    return F.when(a("valid") & b("valid"), cost).otherwise(1.0)


def units(cells: DataFrame, keys: list[str], links: DataFrame, cols: int = 8) -> DataFrame:
    """keys..., row, col, unit: connected units of valid cells, numbered by first appearance in row-major order.

    links: keys..., a_row, a_col, b_row, b_col of the pairs that belong together. One frame's grid is one bounded group.
    """
    left = cells.where("valid").select(*keys, "row", "col", F.lit(None).cast("int").alias("to_row"), F.lit(None).cast("int").alias("to_col"))
    right = links.select(*keys, F.col("a_row").alias("row"), F.col("a_col").alias("col"), F.col("b_row").alias("to_row"), F.col("b_col").alias("to_col"))
    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.to_row.isna()].sort_values(["row", "col"])
        parent = {(r, c): (r, c) for r, c in zip(own.row, own.col, strict=True)}

        def root(x: tuple[int, int]) -> tuple[int, int]:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for p in pdf[pdf.to_row.notna()].itertuples():
            a, b = (p.row, p.col), (int(p.to_row), int(p.to_col))
            if a in parent and b in parent:
                first, second = sorted((root(a), root(b)))
                parent[second] = first
        number: dict[tuple[int, int], int] = {}
        ids = [number.setdefault(root((r, c)), len(number) + 1) for r, c in zip(own.row, own.col, strict=True)]
        return own[[*keys, "row", "col"]].assign(unit=ids)

    return left.unionByName(right).groupBy(*keys).applyInPandas(join_up, f"{kinds}, row int, col int, unit int")


def unit_summary(cells: DataFrame, keys: list[str], area: Column) -> DataFrame:
    """Per unit: cells, area share, mean vegetation, most frequent residue (first seen wins ties), mean angle."""
    by = [*keys, "unit"]
    base = cells.groupBy(*by).agg(F.count("*").alias("cell_count"), (F.count("*") / area).alias("area_fraction"), F.avg("veg").alias("mean_veg"), F.avg("angle").alias("mean_angle"))
    kinds = cells.groupBy(*by, "residue_class").agg(F.count("*").alias("n"), F.min(F.struct("row", "col")).alias("seen"))
    mode = kinds.groupBy(*by).agg(F.min_by("residue_class", F.struct(-F.col("n"), "seen")).alias("dominant_residue"))
    return base.join(mode, by)
