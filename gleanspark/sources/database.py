"""Tables of databases by JDBC: reads in parallel ranges of a key, filters and columns pushed down, rows appended.

Defined cases: an empty table, or one whose keys are all null, is read by one task; rows without key are read by the first; one row per range at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _options(url: str, driver: str | None, properties: dict[str, str] | None) -> dict[str, str]:
    return {"url": url, **({"driver": driver} if driver else {}), **(properties or {})}


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, driver: str | None = None, properties: dict[str, str] | None = None, quote: str = "") -> DataFrame:
    """The table ``name``, read in ``parts`` ranges of its whole-number column ``key``; without one, by one task.

    The key's bounds are asked of the database itself; ``quote`` is put around the key there, for databases that fold the case of plain names. Filters, columns and aggregates of what follows go down to it too, as Spark's source does it.
    """
    reader = lambda **more: spark.read.format("jdbc").options(**_options(url, driver, properties), **more)
    if key is None:
        return reader(dbtable=name).load()
    low, high = reader(query= f"SELECT min({quote}{key}{quote}) AS low_key, max({quote}{key}{quote}) AS high_key FROM {name}").load().first()
    if low is None:
        return reader(dbtable=name).load()
    ranges = {"partitionColumn": key, "lowerBound": str(int(low)), "upperBound": str(int(high) + 1), "numPartitions": str(max(1, min(parts, int(high) - int(low) + 1)))}
    return reader(dbtable=name, **ranges).load()


def append_rows(rows: DataFrame, url: str, name: str, driver: str | None = None, properties: dict[str, str] | None = None, batch: int = 1000) -> None:
    """Append rows to the table ``name``, which is made if it is missing; a task writes its rows in one transaction."""
    rows.write.format("jdbc").options(**_options(url, driver, properties), dbtable=name, batchsize=str(batch)).mode("append").save()
