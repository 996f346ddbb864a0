"""The corpus pipeline: quality, line dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet in the shared folder and read again.

Defined cases: a null text is scored as the empty one, becomes the empty text at line dedup, has no near copies and no personal data, and packs as the
end id; very long texts are worked on whole; repeated rows are near copies of each other, of which one stays; of equally good rows of a class
the smallest id stays; empty tables give empty results; extra columns pass through to the packing stage, which leaves them out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import line_dedup, near_dedup, packing, pii, quality
from gleanspark.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. It learns from ``labels`` of rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = quality.fit(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("body"))
    kept = quality.score(rows, model, text_col="body").where("predicted = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten documents or more; a text that changed gets its new n_chars."""
    out = next(n for n in ("line_dedup", "line_dedup_", "line_dedup__") if n not in [c.lower() for c in docs.columns])
    kept = line_dedup.line_dedup(docs, out=out)
    changed = F.col(out)["n_dropped"] > 0
    columns = [F.when(changed, F.char_length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.near_dedup(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; a text that changed gets its new n_chars."""
    found = pii.find_pii(docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("body")), "body")
    clean = found.select("row", "body", pii.redact(F.col("body"), F.col("pii")).alias("clean"))
    changed = F.col("clean") != F.col("body")
    values = {
        "text": F.when(changed, F.col("clean")).otherwise(F.col("row.text")),
        **({"n_chars": F.when(changed, F.char_length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}),
    }
    return clean.select(*[values.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 4096, each with its ids as they lie in its sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned rules, hashed signatures and packing are beyond SQL; README says what the stages are tested against.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
