"""Importance resampling towards a target corpus, on an integer word dictionary.

Words of documents and target are split once, into blocks (``word_blocks``). The distinct words of all blocks get ids; n-grams are tuples of ids, made
distinct in their block and then over all blocks; each distinct tuple's bytes are put together again from the dictionary and hashed once. Its counts
go to its bucket, the buckets' gains (how much likelier the bucket is in the target, in 1/1000 of a natural logarithm) come back to the tuple, from there to the
(block, tuple) pairs, and so to the documents of each block, whose weight is the floored mean of their features' gains. Gumbel noise of a hash of the id turns weights into
scores, of which the highest are drawn without replacement.

Lookups by word and by tuple go through ``lookup.spread_lookup``: a word found in every block is no hot key. Buckets are broadcast
(``buckets`` is a parameter, at most ``BROADCAST_BUCKETS``). Ranks come from a range exchange of slim rows whose parts are numbered apart.

Defined cases: null and empty texts have no features and weight 0; null targets add nothing, an empty target leaves every t at 0; repeated rows and
equal ids count as documents of their own, and ties of score and id are drawn in any order; a null id is hashed as ``null`` and comes last among equal scores;
very long texts are worked on whole; an empty table gives an empty result; other columns pass through, whatever their names, but
one named as ``out`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm import word_blocks as wb
from gleanspark.operators.lookup import spread_lookup
from gleanspark.session import materialize

BROADCAST_BUCKETS = 1_000_000
#: A-Z become a-z; of ASCII only 0-9 and a-z belong to words, all other code points do.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_ids(tables: list[DataFrame]) -> DataFrame:
    """(id, word, blocks): the distinct words of block tables, in how many blocks each lies."""
    words = wb.words_of(tables[0]).select("word")
    for table in tables[1:]:
        words = words.unionAll(wb.words_of(table).select("word"))
    found = words.groupBy("word").agg(F.count("*").alias("blocks"))
    return materialize(found.select(F.monotonically_increasing_id().alias("id"), "word", "blocks"), "word-ids")


def gram_table(blocks: DataFrame, dictionary: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Documents (block, row, n_words, places) whose places are of tuples, and the tuples (block, local, n, tuple of ids) of each block."""
    known = spread_lookup(wb.words_of(blocks), dictionary, "word", "blocks").select("block", "local", "n", "id")
    if most == 1:  # a word's place is its tuple's
        return wb.documents_of(blocks), materialize(known.select("block", "local", "n", F.array("id").alias("tuple")), "block-tuples")
    kind = blocks.schema["row"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").to_numpy()
        places, borders = wb.flat_places(left.column("places"))
        flat = ids[places] if len(places) else np.zeros(0, dtype=np.int64)
        left_in = np.repeat(borders[1:], np.diff(borders)) - np.arange(len(flat))  # words left in the document, the own included
        owner = np.repeat(np.arange(len(left)), np.diff(borders))
        made, owners, tuples, counts = [], [], [], []
        for n in range(least, most + 1):
            at = np.flatnonzero(left_in >= n)
            rows, inverse, number = np.unique(np.stack([flat[at + k] for k in range(n)], axis=1), axis=0, return_inverse=True, return_counts=True)
            made.append(inverse.reshape(-1) + len(counts))
            owners.append(owner[at])
            tuples += rows.tolist()
            counts += number.tolist()
        order = np.argsort(np.concatenate(owners), kind="stable")
        ends = np.cumsum(np.bincount(np.concatenate(owners), minlength=len(left)))
        packed = wb.packed_places(np.concatenate(made)[order], np.concatenate(([0], ends)))
        block, m, d = left.column("block")[0].as_py(), len(left), len(counts)
        documents = [left.column("block"), left.column("row"), left.column("n_words"), packed, pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))]
        grams = [pa.array(np.full(d, block)), pa.nulls(d, left.schema.field("row").type), pa.nulls(d, pa.int64()), pa.nulls(d, pa.binary()), pa.array(np.arange(d, dtype=np.int32)), pa.array(counts, pa.int64()), pa.array(tuples, pa.list_(pa.int64()))]
        names = ["block", "row", "n_words", "places", "local", "n", "tuple"]
        return pa.concat_tables([pa.table(documents, names=names), pa.table(grams, names=names)])

    made = materialize(wb.meet(wb.documents_of(blocks), known, run, f"block long, row {kind}, n_words long, places binary, local int, n long, tuple array<long>"), "block-tuples")
    return wb.documents_of(made), made.where("local IS NOT NULL").select("block", "local", "n", "tuple")


def hashed_tuples(counted: DataFrame, dictionary: DataFrame, buckets: int) -> DataFrame:
    """counted(tuple, ...) with bucket: crc32 of the tuple's words joined by one space, modulo buckets; each tuple is hashed once."""
    counted = materialize(counted.withColumn("tid", F.monotonically_increasing_id()), "tuples")
    parts = counted.select("tid", F.posexplode("tuple").alias("pos", "id"))
    uses = parts.groupBy("id").agg(F.count("*").alias("uses"))
    named = spread_lookup(parts, materialize(dictionary.select("id", "word").join(uses, "id"), "words-in-tuples"), "id", "uses")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    hashed = named.groupBy("tid").agg(F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))
    return counted.join(hashed, "tid").drop("tid")


def bucket_gains(tuples: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that hold tuples(bucket, n_docs, n_target)."""
    per = materialize(tuples.groupBy("bucket").agg(F.sum("n_docs").alias("s"), F.sum("n_target").alias("t")), "bucket-counts")
    total = per.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    number = lambda c: c.cast("double")
    likelier = number(F.col("t") + 1) * F.lit(float(total.s + buckets)) / (number(F.col("s") + 1) * F.lit(float(total.t + buckets)))
    return per.select("bucket", F.floor(F.lit(1000.0) * F.log(likelier)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, block_bytes: int = wb.BLOCK_BYTES) -> DataFrame:
    """docs(row, text) as row, n_words, n_features, weight. target: text."""
    own = wb.word_blocks(docs, LETTERS, "document-words", block_bytes)
    wanted = wb.word_blocks(target.select(F.struct(F.lit(0).alias("zero")).alias("row"), "text"), LETTERS, "target-words", block_bytes)
    dictionary = word_ids([own, wanted])
    documents, grams = gram_table(own, dictionary, least, most)
    _, target_grams = gram_table(wanted, dictionary, least, most)
    both = grams.select("tuple", "n", F.lit(0).cast("long").alias("t"), F.lit(1).alias("here")).unionAll(target_grams.select("tuple", F.lit(0).cast("long"), "n", F.lit(0)))
    counted = both.groupBy("tuple").agg(F.sum("n").alias("n_docs"), F.sum("t").alias("n_target"), F.sum("here").alias("blocks"))
    tuples = materialize(hashed_tuples(counted, dictionary, buckets), "hashed-tuples")
    gains = bucket_gains(tuples, buckets)
    if buckets <= BROADCAST_BUCKETS:
        gains = F.broadcast(gains)
    joined = materialize(tuples.where("blocks > 0").join(gains, "bucket").select("tuple", "gain", "blocks"), "tuple-gains")
    answered = spread_lookup(grams.select("block", "local", "tuple"), joined, "tuple", "blocks").select("block", "local", "gain")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        places, borders = wb.flat_places(left.column("places"))
        found = right.column("gain").to_numpy()[places] if len(places) else np.zeros(0, dtype=np.int64)
        until = np.concatenate(([0], np.cumsum(found)))
        size = np.diff(borders)
        weight = (until[borders[1:]] - until[borders[:-1]]) // np.maximum(size, 1)  # floors go down
        return pa.table([left.column("row"), left.column("n_words"), pa.array(size.astype(np.int64)), pa.array(weight.astype(np.int64))], names=["row", "n_words", "n_features", "weight"])

    return wb.meet(documents, answered, run, f"row {docs.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, out: str) -> DataFrame:
    """The rows of a written table with out: 1, 2, 3... in the order. A range exchange sorts them; parts are numbered apart, and the parts before are added."""
    placed = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [*order, F.col("tie")]  # equal rows may be cut apart
    spread = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    written = materialize(spread.select("*", F.monotonically_increasing_id().alias("place")), "ranked")
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, starts = 0, {}
    for r in written.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per partition of the exchange
        starts[r.part], before = before, before + r["count"]
    table = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]) if starts else F.create_map().cast("map<bigint,bigint>")
    return written.select(*rows.columns, (F.element_at(table, part) + nth + 1).cast("long").alias(out))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, least: int = 1, most: int = 1, buckets: int = 10_000,
    min_words: int = 20, percent: int = 10, seed: int = 2024, out: str = "importance", block_bytes: int = wb.BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` (all) of docs, and struct ``out``: n_features, weight, score, rank (null: not drawn). percent of the documents with min_words words are drawn."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    row = F.struct(F.struct(F.col(id_col).alias("id")).alias("by"), F.struct(*kept).alias("kept"))
    weighed = weights(docs.select(row.alias("row"), F.col(text_col).alias("text")), target, least, most, buckets, block_bytes)
    ident = F.col("row.by.id")
    drawn_hash = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn_hash + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weighed.select("row", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") >= min_words).alias("able")), "importance-scores")
    draws = percent * scored.where("able").count() // 100
    placed = ranked(scored, [F.col("able").desc(), F.col("score").desc(), ident.asc_nulls_last()], "nth")
    rank = F.when(F.col("able") & (F.col("nth") <= draws), F.col("nth")).alias("rank")
    return placed.select(*[F.col("row.kept").getField(c).alias(c) for c in kept], F.struct("n_features", "weight", "score", rank).alias(out))
