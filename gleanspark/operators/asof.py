"""As-of joins: the nearest reading in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, left_id: str, order: list[str], tolerance: int) -> DataFrame:
    """Each left row with its nearest right row within tolerance (or nulls), and ``delta``.

    Times are whole numbers. Readings are dealt into buckets as wide as the tolerance and a row asks its own bucket and both beside it,
    so that a session's rows never meet all of its readings. Ties go to the earlier reading, then by ``order``. left_id is unique per keys.
    """
    width = max(1, tolerance)
    asks = left.select(*keys, left_id, left_time).withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(left_time) / width) + d for d in (-1, 0, 1)])))
    held = right.withColumn("_bucket", F.floor(F.col(right_time) / width))
    pairs = asks.join(held, [*keys, "_bucket"]).withColumn("delta", F.abs(F.col(left_time) - F.col(right_time))).where(F.col("delta") <= tolerance)
    nth = F.row_number().over(Window.partitionBy(*keys, left_id).orderBy("delta", right_time, *order))
    best = pairs.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_bucket", left_time)
    return left.join(best, [*keys, left_id], "left")


def tier(delta: Column, exact: int = 250, nearby: int = 2000) -> Column:
    return F.when(delta <= exact, "exact").when(delta <= nearby, "nearby").otherwise("unavailable")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, left_id: str, right_id: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """Each left row with the id of the nearest right row, however far; the smaller id wins ties.

    Both tables are dealt into buckets of time, so many that one holds rows_per_bucket rows if they lie evenly; the last reading at or before and the first at or after each row come from one sorted pass over its
    bucket. What a bucket lacks on either side is carried over from the nearest bucket with readings: a pass over one row per bucket, not over a key's history.
    """
    rows = left.select(*keys, F.col(left_time).alias("_t"), F.col(left_id).alias("_left"), F.lit(None).cast(right.schema[right_id].dataType).alias("_right"))
    rows = rows.unionByName(right.select(*keys, F.col(right_time).alias("_t"), F.lit(None).cast(left.schema[left_id].dataType).alias("_left"), F.col(right_id).alias("_right")))
    span = rows.agg(F.min("_t").cast("double").alias("lo"), F.max("_t").cast("double").alias("hi"), F.count("*").alias("n")).first()
    width = max(1.0, (span.hi - span.lo) * rows_per_bucket / span.n) if span.lo is not None else 1.0
    rows = rows.withColumn("_bucket", F.floor((F.col("_t").cast("double") - (span.lo or 0.0)) / width))
    at = F.when(F.col("_right").isNotNull(), F.struct(F.col("_t"), F.col("_right")))
    # Of equal times the smallest id counts on both sides.
    moments = rows.groupBy(*keys, "_bucket", "_t").agg(F.min("_right").alias("_right"))
    ends = moments.groupBy(*keys, "_bucket").agg(F.max(at).alias("_last"), F.min(at).alias("_first"))
    line = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = F.last("_last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("_first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), earlier.alias("_earlier"), later.alias("_later"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    back = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_t"), F.col("_right").desc_nulls_last(), F.col("_left")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_t"), F.col("_left").asc_nulls_last(), F.col("_right")).rowsBetween(0, Window.unboundedFollowing)
    own = rows.withColumn("_before", F.last(at, ignorenulls=True).over(back)).withColumn("_after", F.first(at, ignorenulls=True).over(ahead)).where("_left IS NOT NULL")
    both = own.join(carried, same).withColumn("_before", F.coalesce("_before", "_earlier")).withColumn("_after", F.coalesce("_after", "_later"))
    gap = lambda c: F.abs(F.col(c)["_t"] - F.col("_t"))
    first = (
        F.when(F.col("_before").isNull(), F.col("_after"))
        .when(F.col("_after").isNull() | (gap("_before") < gap("_after")), F.col("_before"))
        .when(gap("_after") < gap("_before"), F.col("_after"))
        .otherwise(F.when(F.col("_before")["_right"] <= F.col("_after")["_right"], F.col("_before")).otherwise(F.col("_after")))
    )
    return both.select(*keys, F.col("_left").alias(left_id), first["_right"].alias(right_id), F.abs(first["_t"] - F.col("_t")).alias("delta"))
