"""Rows that repeat, and rows without id: right results, and no task that gathers them."""

from collections import Counter
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import functions as F

from gleanspark.llm import line_dedup, near_dedup, packing, sharding
from gleanspark.session import materialize

SAME, MANY = "the same words in each of these rows\nand a second line", 20_000


@contextmanager
def plainly(spark):
    """Neither adaptive execution nor broadcasts that are not asked for."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    kept = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def even(df, rows):
    """Whether no partition of df has over twice the median's rows."""
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(sizes) == rows
    return sizes[-1] <= 2 * sizes[len(sizes) // 2]


def repeated(spark, many=MANY):
    """One row many times, as many without id, and as many different ones."""
    n = spark.range(many)
    same = n.select(F.lit(7).cast("long").alias("doc_id"), F.lit(SAME).alias("text"))
    lost = n.select(F.lit(None).cast("long").alias("doc_id"), F.lit(SAME).alias("text"))
    other = n.select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit("\nits own line "), F.col("id").cast("string")).alias("text"))
    return materialize(same.unionAll(lost).unionAll(other), "repeated-rows")


def test_sharding_cuts_repeated_rows(spark):
    rows = spark.range(5_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 30).alias("text"))
    docs = rows.unionAll(spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t" * 25), F.format_string("%05d", "id")).alias("text")))
    got = sharding.shard_documents(docs).collect()
    sizes, counts = Counter(), Counter()
    slots = {}
    for r in got:
        sizes[r.shard] += r.size
        counts[r.shard] += 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 10_000 and len(sizes) == 16
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 31 + 2 * 0.001 * sum(sizes.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_line_dedup_spreads_repeated_rows(spark):
    docs = repeated(spark)
    with plainly(spark):
        found = line_dedup.line_dedup(docs)
        assert even(found, 3 * MANY)
    lost = found.where("text <> '' AND text NOT LIKE 'text %'").count()  # rows without id count one each: both lines are frequent
    assert lost == 0 and found.where("line_dedup.n_dropped = 2").count() == 2 * MANY


def test_packing_spreads_repeated_rows(spark):
    docs = repeated(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    tokens = packing.tokenize(docs, tokenizer, "doc_id", "text", 2, 4096, "<u2").withColumn("piece", F.monotonically_increasing_id())
    tokens = materialize(tokens, "tokens")
    with plainly(spark):
        assert even(packing.pack(tokens.select("piece", "length"), ["piece"], wide=tokens), 3 * MANY)
    got = packing.pack_documents(docs, tokenizer)
    by = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("pieces"), F.count_distinct("offset").alias("offsets"))
    assert by.where("n <> end OR n > 4096 OR pieces <> offsets").count() == 0 and got.count() == 3 * MANY


def test_near_dedup_of_repeated_rows(spark):
    docs = repeated(spark, 2_000)
    got = near_dedup.near_dedup(docs)
    assert got.where(F.col("text") == SAME).collect() == [(7, SAME)] and got.count() <= 2_001


def test_hub_pairs_are_spread(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS", 100)
    base = list(range(50))
    nodes = spark.createDataFrame([(0, base)] + [(i, [*base, 1000 + i]) for i in range(1, 4_001)], "node long, shingles array<long>")
    pairs = spark.createDataFrame([(0, i, 0, i) for i in range(1, 4_001)], "a long, b long, ca long, cb long")
    search = near_dedup._Search(materialize(nodes, "nodes"), 0.8, 32)
    with plainly(spark):
        assert even(search.decided(pairs), 4_000)


def test_components_of_a_star(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 3_000)] + [(5_000 + i, 5_001 + i) for i in range(40)], "a long, b long")
    found = {r.node: r.comp for r in near_dedup.components(edges).collect()}
    assert all(found[i] == 0 for i in range(1, 3_000)) and all(found[5_001 + i] == 5_000 for i in range(40))
