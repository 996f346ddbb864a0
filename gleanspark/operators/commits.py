"""Tables that grow by committed batches: each batch is written beside the others, then named by a manifest that is moved into place.

A batch counts once, whoever writes it and however often: a manifest is moved to the name of its batch, which fails where one lies. What was written without being
named (a lost driver, a replay) is never read.

Defined cases: an empty batch is committed without rows; batches of different columns are not checked against each other, the schema is the reader's; a table without batches has no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The path as Hadoop knows it, and its file context."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where)
    return where, jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())


def committed_batches(spark: SparkSession, path: str) -> dict[str, str]:
    """The folders of the committed batches by their names."""
    root, files = _files(spark, f"{path}/manifests")
    if not files.util().exists(root):
        return {}
    found = {}
    listed = files.util().listStatus(root)
    for status in listed:
        name = status.getPath().getName()
        if name.endswith(".json"):
            found[name.removesuffix(".json")] = json.loads(spark.sparkContext.wholeTextFiles(status.getPath().toString()).values().first())["folder"]
    return found


def commit_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Write df as a batch of the table at path; False, and nothing changed, if that batch is committed already."""
    spark = df.sparkSession
    target, files = _files(spark, f"{path}/manifests/{batch}.json")
    if files.util().exists(target):
        return False
    folder = f"data/{batch}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    draft, _ = _files(spark, f"{path}/drafts/{batch}-{uuid.uuid4().hex}")
    jvm = spark._jvm
    system = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    for parent in (draft.getParent(), target.getParent()):
        system.mkdirs(parent)
    out = system.create(draft, True)
    out.write(bytearray(json.dumps({"folder": folder}).encode()))
    out.close()
    plainly = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    plainly[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(draft, target, plainly)
    except Exception as error:  # another writer of this batch came first
        if "FileAlreadyExists" not in str(error):
            raise
        return False
    return True


def committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all committed batches."""
    folders = [f"{path}/{folder}" for folder in sorted(committed_batches(spark, path).values())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
