"""Exact quantiles of groups of any size.

Groups of up to ``most`` rows (or 1/100,000 of all rows, if that is more) are answered by Spark's own exact aggregate. In larger ones, at most 100,000 groups,
each wanted rank is bracketed between two values of an approximate quantile sketch, rows below and inside are counted, and the bracket shrinks until
its values are few enough for one task. The counts make the result exact; the sketch only speeds it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.session import materialize

MOST = 1_000_000
HOT_GROUPS = 100_000
GRID = 500


def _bound(sizes: DataFrame, most: int) -> tuple[int, bool]:
    """The largest group for one task, and whether any group is larger."""
    total, widest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bound = max(most, total // HOT_GROUPS)
    return bound, widest > bound


def _inside(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Each row of a bracket's group that lies inside it. Brackets are a few per hot group, so that they are broadcast."""
    return rows.join(F.broadcast(brackets), "k").where("(low IS NULL OR x > low) AND (high IS NULL OR x < high)")


def _narrowed(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """The brackets after one round: a value where the rank met a probe, else the part between probes that holds the rank."""
    grid = [i / GRID for i in range(GRID + 1)]
    slot = F.floor((F.col("rank") - F.col("below")) / F.col("m") * GRID).cast("int")
    state = ["k", "rank", "low", "high", "below", "m"]
    sketch = _inside(rows, brackets).groupBy(*state).agg(F.percentile_approx("x", grid, 20 * GRID).alias("s"))
    probes = sketch.select(*state, F.get("s", F.greatest(slot - 1, F.lit(0))).alias("a"), F.get("s", F.least(slot + 2, F.lit(GRID))).alias("b"))
    probes = materialize(probes, "quantile-probes")
    tallies = {"lt_a": "x < a", "le_a": "x <= a", "lt_b": "x < b", "le_b": "x <= b"}
    counted = _inside(rows, probes).groupBy(*state, "a", "b").agg(*[F.count_if(F.expr(test)).alias(name) for name, test in tallies.items()])
    at = F.col("rank") - F.col("below")
    met_a, met_b = (at >= F.col("lt_a")) & (at < F.col("le_a")), (at >= F.col("lt_b")) & (at < F.col("le_b"))
    under, over = at < F.col("lt_a"), at >= F.col("le_b")
    return counted.select(
        "k",
        "rank",
        F.when(under, F.col("low")).when(over, F.col("b")).otherwise(F.col("a")).alias("low"),
        F.when(under, F.col("a")).when(over, F.col("high")).otherwise(F.col("b")).alias("high"),
        (F.col("below") + F.when(under, F.lit(0)).when(over, F.col("le_b")).otherwise(F.col("le_a"))).alias("below"),
        F.when(under, F.col("lt_a")).when(over, F.col("m") - F.col("le_b")).otherwise(F.col("lt_b") - F.col("le_a")).alias("m"),
        F.when(met_a, F.col("a")).when(met_b, F.col("b")).alias("value"),
    )


def _ranked(rows: DataFrame, wanted: DataFrame, bound: int) -> DataFrame:
    """k, rank, value for the ranks ``wanted`` (k, n, rank, counted from 0)."""
    none = F.lit(None).cast("double")
    brackets = materialize(wanted.select("k", "rank", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), none.alias("value")), "quantile-brackets")
    done = brackets.where("value IS NOT NULL OR m <= 0").limit(0)
    while True:
        wide = brackets.where(f"value IS NULL AND m > {bound}")
        done = done.unionAll(brackets.where(f"value IS NOT NULL OR m <= {bound}"))
        if wide.isEmpty():
            break
        brackets = materialize(_narrowed(rows, wide.drop("value")), "quantile-brackets")
    narrow = _inside(rows, done.where("value IS NULL").drop("value"))
    found = narrow.groupBy("k", "rank", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return done.where("value IS NOT NULL").select("k", "rank", "value").unionAll(found.select("k", "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("value")))


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, fractions: list[float], most: int = MOST, out: str = "q") -> DataFrame:
    """keys..., out array<double>: interpolated quantiles of value per group; nulls don't count, a group without values has no row."""
    rows = df.select(F.struct(*keys).alias("k"), value.cast("double").alias("x")).where("x IS NOT NULL")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    bound, hot_ones = _bound(sizes, most)
    direct = lambda part: part.groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, fractions))).alias(out))
    unpacked = lambda found: found.select("k.*", out)
    if not hot_ones:
        return unpacked(direct(rows))
    hot = materialize(sizes.where(F.col("n") > bound), "quantile-groups")
    place = [(F.col("n") - 1) * F.lit(f) for f in fractions]
    ranks = F.array_distinct(F.array(*[r.cast("long") for p in place for r in (F.floor(p), F.ceil(p))]))
    found = _ranked(rows, hot.select("k", "n", F.explode(ranks).alias("rank")), bound)
    values = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v")).join(hot, "k")
    at = lambda p, side: F.element_at("v", side(p).cast("long"))
    quantiles = [F.when(F.floor(p) == F.ceil(p), at(p, F.floor)).otherwise((F.ceil(p) - p) * at(p, F.floor) + (p - F.floor(p)) * at(p, F.ceil)) for p in place]
    rest = rows.join(F.broadcast(hot.select("k")), "k", "left_anti")
    return unpacked(values.select("k", F.array(*quantiles).alias(out)).unionAll(direct(rest)))


def medians(df: DataFrame, keys: list[str], columns: dict[str, Column], most: int = MOST) -> DataFrame:
    """keys..., and the exact median of each column under its name."""
    _, hot_ones = _bound(df.groupBy(*keys).agg(F.count("*").alias("n")), most)
    if not hot_ones:
        return df.groupBy(*keys).agg(*[F.median(c).alias(name) for name, c in columns.items()])
    found = df.select(*keys).distinct()
    for name, column in columns.items():
        found = found.join(exact_quantiles(df, keys, column, [0.5], most).select(*keys, F.col("q")[0].alias(name)), keys, "left")
    return found
