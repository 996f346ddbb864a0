"""op5: balance, gapless slots, neighbours, hot groups."""

import zlib
from collections import defaultdict

import pytest

from gleanspark.llm import sharding


def check(rows, n_docs, n_shards, slack):
    assert len(rows) == n_docs
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    sizes = [sum(r.size for r in shards.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= slack + 2 * 0.001 * sum(sizes) / n_shards
    return shards


@pytest.mark.parametrize("hot", [0, 800])
def test_balance(spark, hot):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 500), 1) for i in range(1600)] + [(10_000 + i, "hot " * 20, 2) for i in range(hot)] + [(None, None, 3), (5, "", 4), (5, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.shard_documents(docs).collect()
    shards = check(got, len(rows), 16, 2 * 512)
    assert {r.size for r in got if r.doc_id is None} == {1}
    order = [r.text_crc32 for s in sorted(shards) for r in sorted(shards[s], key=lambda r: r.slot)]
    if hot:
        at = [i for i, c in enumerate(order) if c == next(r.text_crc32 for r in got if r.doc_id == 10_000)]
        assert at == list(range(at[0], at[0] + hot))


def test_small_tables(spark):
    docs = spark.createDataFrame([(i, "a" * i) for i in range(3)], "doc_id long, text string")
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    got = sharding.shard_documents(docs).collect()
    assert len(got) == 3 and all(0 <= r.shard < 16 for r in got)


def test_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    sharded = sharding.shard_documents(docs, n_shards=4)
    sharding.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_shards_hold_the_texts(spark, tmp_path):
    texts = {i: f"t{i} é " + "x" * (i % 90) for i in range(300)} | {1000: None, 1001: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sharding.write_shards(sharding.shard_documents(docs, n_shards=4), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: r.text for r in got} == texts
    assert all(r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    check(got, len(texts), 4, 2 * 100)
