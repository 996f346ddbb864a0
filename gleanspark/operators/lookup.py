"""Lookups that no hot key can bring into one task, and connected components by star rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.session import materialize


def spread_lookup(rows: DataFrame, table: DataFrame, key: str, count: str, most_hot: int = 100_000, least: int = 1_000) -> DataFrame:
    """rows left-joined with table (a written table, one row per key) on ``key``, without table's column ``count``.

    ``count`` is how many of the rows have the key. Keys with at least ``1 / most_hot`` of all counted rows number at most ``most_hot``; that is the proven bound of the broadcast by which their rows are answered
    where they lie. All other keys meet their rows by shuffle, in groups of fewer rows than that. rows whose key is null, and those
    answered, are dealt by a hash of their number. A key that is in ``rows`` often but not in the table is met in one task: give such tables all keys.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    bar = max(least, -(-total // most_hot))
    values = [c for c in table.columns if c not in (key, count)]
    tag = uuid.uuid4().hex[:8]
    pack = F.struct(*[F.col(c).alias(c) for c in values])
    hot = table.where(F.col(count) >= bar).select(F.col(key).alias(f"k{tag}"), pack.alias(f"hot{tag}"))
    rest = table.where(F.col(count) < bar).select(F.col(key).alias(f"k{tag}"), pack.alias(f"found{tag}"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col(f"k{tag}"), "left").drop(f"k{tag}")
    # Rows that have no key to look up, or have their answer, are spread by a hash; whatever that meets is not read.
    sought = F.col(f"hot{tag}").isNull() & F.col(key).isNotNull()
    marked = marked.withColumn(f"s{tag}", F.when(sought, F.col(key)).otherwise(_filler(rows, key)))
    joined = marked.join(rest, F.col(f"s{tag}") == F.col(f"k{tag}"), "left")
    picked = lambda c: F.when(sought, F.col(f"found{tag}")[c]).otherwise(F.col(f"hot{tag}")[c]).alias(c)
    return joined.select(*[F.col(c) for c in rows.columns], *[picked(c) for c in values])


def _filler(rows: DataFrame, key: str) -> Column:
    """A value of the key's type that spreads rows evenly, equal ones too."""
    spread = F.xxhash64(F.monotonically_increasing_id())
    kind = rows.schema[key].dataType.simpleString()
    return {"string": F.hex(spread), "array<bigint>": F.array(spread), "binary": F.unhex(F.md5(spread.cast("string")))}.get(kind, spread.cast(kind))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp) for the nodes of edges(a, b): comp is the smallest node that can be reached. Large and small stars in turn, each written."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    size = edges.count()
    least_of = lambda e: e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    while size:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(least_of(both).withColumn("m", F.least("m", "a")), f"{label}-least")
        large = spread_lookup(both, least, "a", "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, f"{label}-large")
        least = materialize(least_of(large), f"{label}-least")
        small = spread_lookup(large, least, "a", "n").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        after = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)
        if after.count() == size and after.exceptAll(edges).isEmpty():
            break
        edges, size = after, after.count()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
