"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` became one space; a null text
counts as empty. Three combines follow each other, and each groups by digest *and* the full
normalised text, so that a digest collision can never merge two texts:

1. partial aggregation inside a task (one row per text and task leaves it),
2. salted groups ``(digest, text, salt)``, the salt being the task's number modulo ``salts``,
3. the salts' winners, combined per ``(digest, text)``.

A text that fills a third of the table therefore sends at most one row per task to its salts and
``salts`` rows to its last reducer. Documents then fetch their group by digest alone, with slim rows: those of hot texts from
a broadcast of a proven size (see :mod:`gleanspark.llm.skew`), the others by shuffle; digests that hold several texts (collisions)
are joined by full content instead.

Defined cases: null and empty texts are one group; repeated doc_ids are separate rows, each row
counts in ``group_size``; if several rows of a group share the smallest doc_id, all of them are ``kept``; a
null doc_id never wins while a non-null one exists; an empty table gives an empty result; very long texts are compared whole;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.lookup import spread_lookup
from gleanspark.session import materialize

#: Whitespace that counts as one space: fixed values of the task.
WHITESPACE = r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    """The text with each whitespace run as one space; single spaces are left alone, which is cheaper."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """(digest, norm, keep_id, group_size): one row per distinct normalised text, dealt by digest."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("id", "norm", F.sha2("norm", 256).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = rows.groupBy("digest", "norm", "salt").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # Dealt by digest alone, the winners of one digest meet in one task, whatever their texts.
    winners = salted.repartition(F.col("digest"))
    return winners.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    texts = F.collect_list(F.struct("norm", "keep_id", "group_size"))
    digests = text_groups(docs, id_col, text_col, salts).groupBy("digest").agg(
        F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), texts.alias("texts")
    )
    # The texts stay in the table only where several share a digest.
    digests = materialize(digests.withColumn("texts", F.when(F.size("texts") > 1, F.col("texts"))), "exact-dedup")
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(norm, 256).alias("digest"))
    alone = digests.where("texts IS NULL").drop("texts").withColumn("rows", F.col("group_size"))
    found = spread_lookup(rows, alone, "digest", "rows").where("group_size IS NOT NULL")
    collided = digests.where("texts IS NOT NULL").select("digest", F.inline("texts"))
    if not collided.isEmpty():
        full = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), F.sha2(norm, 256).alias("digest"))
        found = found.unionByName(full.join(collided, ["digest", "norm"]).drop("norm"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
