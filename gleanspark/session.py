"""Session set-up, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "gleanspark", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; TIMESTAMP_NTZ columns become TIMESTAMP (session zone UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent (local tests) a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-gleanspark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, once per application: it travels as a zip file with the job."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-gleanspark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


_scratches: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared one; Hadoop deletes it when the driver's JVM ends in good order."""
    context = spark.sparkContext
    if context.applicationId not in _scratches:
        folder = f"{shared_dir(spark)}/gleanspark/{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratches[context.applicationId] = folder
    return _scratches[context.applicationId]


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder (compressed by ``codec``, or as the session has it) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing will read any more."""
    context = written.sparkSession.sparkContext
    for file in written.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def dealt(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as its about ``rows`` rows need at ``per_task`` each: what a task holds does not grow with the table, whatever the session's partitions."""
    return df.repartition(max(1, -(-rows // per_task)), *keys)
