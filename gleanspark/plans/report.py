"""Reports: JSON documents, redaction, record tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def camelised(kind: T.DataType, column: Column) -> Column:
    """The column with all struct fields, at any depth, in camelCase; null structs stay null."""
    if isinstance(kind, T.StructType):
        fields = [camelised(f.dataType, column[f.name]).alias(camel(f.name)) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: camelised(kind.elementType, x))
    return column


def json_report(df: DataFrame, out: str = "report") -> DataFrame:
    """Each row as one nested camelCase JSON text; nulls are written."""
    row = F.struct(*[camelised(f.dataType, F.col(f.name)).alias(camel(f.name)) for f in df.schema.fields])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(out))


def redacted(df: DataFrame, source: str = "source", path: str = "path", artifacts: str | None = None) -> DataFrame:
    """Reports without the source's path, and with artifact paths cut to their names."""
    out = df.withColumn(source, F.col(source).dropFields(path))
    if artifacts:
        out = out.withColumn(artifacts, F.transform_values(artifacts, lambda _, v: F.element_at(F.split(v, "/"), -1)))
    return out


def feature_collection(areas: DataFrame, session: str, geometry: str, properties: list[str]) -> DataFrame:
    """Per session a GeoJSON FeatureCollection; areas without a position have a null geometry."""
    feature = F.struct(F.lit("Feature").alias("type"), F.from_json(geometry, "type string, coordinates array<double>").alias("geometry"), F.struct(*properties).alias("properties"))
    listed = areas.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(*properties, feature.alias("feature")))).alias("fs"))
    body = F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["feature"]).alias("features"))
    return listed.select(session, F.to_json(body, {"ignoreNullFields": "false"}).alias("geojson"))


def canonical_hash(fields: dict[str, Column], digits: int = 64) -> Column:
    """SHA-256 of the JSON of the fields in the order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256), 1, digits)


def write_once(df: DataFrame, path: str, keys: list[str]) -> None:
    """Report rows as Parquet by key, replaced as a whole folder at a time."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def first_reasons(reasons: Column, most: int = 2) -> Column:
    """The first reasons of a list, as one line."""
    return F.array_join(F.slice(reasons, 1, most), ",")
