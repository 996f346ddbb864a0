"""Content catalogs: deduplication, references, upserts, budgets, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions import rules

IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
ARCHIVES = (".zip", ".tar", ".gz", ".tgz", ".7z", ".rar", ".bz2", ".xz")


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicates(df: DataFrame, digest: str, order: list[str], catalog: DataFrame | None = None) -> DataFrame:
    """df with status (valid or duplicate) and duplicate_of: the first row of the same content; null if a catalog (digest) holds it already."""
    first = df.groupBy(digest).agg(F.min(F.struct(*order)).alias("_first"))
    rows = df.join(first, digest).withColumn("_is_first", F.struct(*order) == F.col("_first"))
    known = F.lit(False)
    if catalog is not None:
        rows = rows.join(catalog.select(digest).distinct().withColumn("_known", F.lit(True)), digest, "left")
        known = F.coalesce("_known", F.lit(False))
    status = F.when(known | ~F.col("_is_first"), "duplicate").otherwise("valid")
    of = F.when(~known & ~F.col("_is_first"), F.col("_first")[order[0]])
    return rows.withColumn("status", status).withColumn("duplicate_of", of).drop("_first", "_is_first", "_known")


def put(blobs: DataFrame, catalog: DataFrame, digest: str = "sha256") -> DataFrame:
    """The blobs that a content-addressed store must add: new digests, once each."""
    return blobs.dropDuplicates([digest]).join(catalog.select(digest), digest, "left_anti")


def reference_counts(blobs: DataFrame, references: DataFrame, digest: str = "sha256") -> DataFrame:
    counts = references.groupBy(digest).agg(F.count("*").alias("refs"))
    return blobs.join(counts, digest, "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


def orphans(blobs: DataFrame, references: DataFrame, digest: str = "sha256") -> DataFrame:
    return blobs.join(references.select(digest), digest, "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row per key: the state that upserts leave behind."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """table with changes (at most one per key) merged in by keys, nulls being equal: all columns replaced, or, for keys that exist, those in ``only``."""
    columns = [c for c in table.columns if c not in keys]
    old = table.select(*[F.col(c).alias(f"_old_{c}") for c in table.columns], F.lit(True).alias("_had"))
    new = changes.select(*[F.col(c).alias(f"_new_{c}") for c in table.columns], F.lit(True).alias("_has"))
    same = [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    both = old.join(new, same, "full").select("*", *[F.when(F.col("_had").isNotNull(), F.col(f"_old_{k}")).otherwise(F.col(f"_new_{k}")).alias(k) for k in keys])
    pick = lambda c: F.when(F.col("_has").isNull() | (F.col("_had").isNotNull() & F.lit(only is not None and c not in only)), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}"))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in table.columns])


def within_budget(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """df with the running total of size and whether it is still within budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).withColumn("accepted", F.col("running") <= budget)


def inspect_members(members: DataFrame, archive: str = "archive_id", most_member: int = 25_000_000, most_ratio: float = 100.0, most_total: int = 500_000_000, most_members: int = 500) -> DataFrame:
    """Archive members (archive, ord, name, is_dir, unix_mode, file_size, compress_size) with group and reason (null: accepted); folders are left out.

    Checks in order: path, symbolic link, nested archive, file type, size, ratio, then the archive's running total and member count.
    """
    path = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    suffix = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))
    ratio = F.col("file_size") / F.greatest("compress_size", F.lit(1))
    reason = (
        F.when(~rules.safe_path(F.col("name")), "unsafe path")
        .when(F.coalesce("unix_mode", F.lit(0)).bitwiseAND(0o170000) == 0o120000, "symlink")
        .when(suffix.isin(*ARCHIVES), "nested archive")
        .when(~suffix.isin(*IMAGES), "unsupported type")
        .when(F.col("file_size") > most_member, "member too large")
        .when(ratio > most_ratio, "compression ratio")
    )
    folder = F.col("is_dir") | F.col("name").endswith("/") | (F.coalesce("unix_mode", F.lit(0)).bitwiseAND(0o170000) == 0o040000)
    counted = members.withColumn("_members", F.count("*").over(Window.partitionBy(archive)))
    checked = counted.where(~F.coalesce(folder, F.lit(False))).withColumn("reason", reason)
    w = Window.partitionBy(archive)
    total = F.sum(F.when(F.col("reason").isNull(), F.col("file_size")).otherwise(0)).over(w)
    whole = F.when(F.col("_members") > most_members, "archive: too many members").when(total > most_total, "archive: total size")
    return checked.withColumn("reason", F.coalesce(whole, F.col("reason"))).withColumn("grp", rules.path_group(F.col("name"))).drop("_members")


def collection_counts(images: DataFrame, keys: list[str], group: str = "grp") -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return images.groupBy(*keys).agg(F.count("*").alias("images"), count("valid").alias("valid"), count("duplicate").alias("duplicates"), count("failed").alias("failed"), F.array_sort(F.collect_set(group)).alias("groups"))


def with_failures(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Analysed rows and failed ones in one table; missing columns are null."""
    return results.unionByName(failures, allowMissingColumns=True)


def cache_hits(requests: DataFrame, cache: DataFrame, jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Requests (key) that a completed job (job_id) with an existing artifact already answers."""
    alive = cache.join(jobs.where("status = 'completed'").select("job_id"), "job_id", "left_semi").join(artifacts.select("job_id"), "job_id", "left_semi")
    return requests.join(alive.select("key", "job_id"), "key")


def expired(records: DataFrame, now: Column, updated: str = "updated_at", hours: float = 24.0) -> DataFrame:
    """Records past their time, with the verdict: completed ones that still lie about are anomalies and are never deleted."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col(updated))) / 3600.0
    verdict = F.when(F.col("status") == "completed", "anomaly").when(F.col("status").isin("failed", "cancelled") | F.col("status").isNull(), "delete").otherwise("keep")
    return records.withColumn("age_hours", age).where(F.col("age_hours") > hours).withColumn("verdict", verdict)
