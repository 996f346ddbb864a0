"""Every operator on long texts, ids of strings with newlines, and columns with clashing names."""

import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleanspark.llm import bpe, exact_dedup, language_id, line_dedup, mpeg_audio, near_dedup, packing, pii, quality, sharding
from gleanspark.operators import lookup as skew
from tests.llm.test_exact_line import plain_lines

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 9973} v{i % 17}" for i in range(120_000))  # over 1 MB
IDS = {"a": "b\nhot\nc", "a\nb": "hot\nc", "x": "hot", "y\n": "HOT ", "null": None, "long": LONG}


def model():
    return quality.RuleModel(0.25, (((("digits", False, 0.5),), 2.0),))


OPERATORS = {
    "bpe": lambda docs: bpe.decode(bpe.encode(docs, BYTES), BYTES),
    "near_classes": lambda docs: near_dedup.near_classes(docs),
    "near_dedup": lambda docs: near_dedup.near_dedup(docs),
    "pii": lambda docs: pii.find_pii(docs).withColumn("clean", pii.redact(F.coalesce("text", F.lit("")), F.col("pii"))),
    "mpeg": lambda docs: mpeg_audio.parse_media(mpeg_audio.encode_media(docs)),
    "sharding": lambda docs: sharding.shard_documents(docs),
    "exact": lambda docs: exact_dedup.exact_dedup(docs),
    "lines": lambda docs: line_dedup.line_dedup(docs, min_docs=3),
    "language": lambda docs: language_id.predict(docs, *language_id.train(docs.withColumn("lang", F.lit("en")))),
    "packing": lambda docs: packing.sequences(docs, WORDS),
    "quality": lambda docs: quality.score(docs, model()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_string_ids_long_texts_and_clashing_names(spark, name):
    names = "ids words pii spans kind media audio shard slot size digest norm rows count line_dedup drops k score predicted lang_pred node class first bucket hash row length start offset word body text_sha256"
    docs = spark.createDataFrame([(i, t) for i, t in IDS.items()] * 2, "doc_id string, text string").repartition(3)
    plain = docs.withColumns({c: F.lit("mine") for c in names.split()})
    got = OPERATORS[name](plain)
    assert len(set(c.lower() for c in got.columns)) == len(got.columns)
    assert len(got.collect()) == {"packing": got.count(), "near_dedup": 6}.get(name, 12)
    assert OPERATORS[name](plain.limit(0)).count() == 0


def test_string_ids_keep_their_own_lines(spark):
    docs = spark.createDataFrame(list(IDS.items()), "doc_id string, text string").withColumn("line_dedup", F.lit("old"))
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_docs=3).select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_dropped").collect()}
    for i, (n, dropped, kept) in zip(IDS, plain_lines(IDS.values(), 3), strict=True):
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (n, dropped, kept)


def test_rows_of_one_id_count_once(spark):
    docs = spark.createDataFrame([(1, "same")] * 12 + [(None, "other")] * 3, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in line_dedup.line_dedup(docs, min_docs=3).collect()} == {(1, "same"), (None, "")}


def test_long_ideographs_in_bounded_memory():
    rng = np.random.default_rng(1)
    text = "".join(map(chr, 0x4E00 + rng.integers(0, 3000, 300_000)))
    assert np.array_equal(language_id.document_vectors([text, "the cat"], 32, most=1000)[1], language_id.document_vectors(["the cat"], 32)[0])
    assert np.abs(language_id.document_vectors([text], 32)[0]).sum() > 0
    mixed = "le chat noir. " * 5000
    assert np.array_equal(language_id.document_vectors([mixed], 32, most=999), language_id.document_vectors([mixed], 32))


def test_a_hundred_thousand_spans(spark):
    text = " ".join(f"u{i}@ex{i % 7}.org" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    row = pii.find_pii(docs).select(F.col("pii.email")[99_999].alias("last"), F.size("pii.email").alias("n")).first()
    clean = pii.find_pii(docs).select(pii.redact(F.col("text"), F.col("pii")).alias("clean")).first().clean
    assert row.n == 100_000 and (row.last.start, row.last.end) == (text.rindex("u99999@"), len(text))
    assert clean == " ".join(["[EMAIL]"] * 100_000)
    assert time.monotonic() - began < 120


def test_context_across_neighbours(spark):
    text = "contact: 1.2.3.4 +491234567890 a@b.c 5.6.7.8 " + "x" * 50 + " 9.9.9.9 server"
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().pii
    for kind, word in (("ip", r"\bip\b|host|server|address"), ("email", "mail|contact|write|address"), ("phone", "phone|call|tel|mobile|fax")):
        import re

        for s in got[kind]:
            near = text[max(s.start - 40, 0) : s.start] + "|" + text[s.end : s.end + 40]
            assert (s.score > pii.PRIOR[kind]) == bool(re.search(word, near.lower()))


def test_lookup_spreads_hot_keys(spark):
    rows = [(i, "hot" if i % 10 else f"k{i}") for i in range(20_000)] + [(-1, None), (-2, "unknown")]
    table = spark.createDataFrame([("hot", 18_000, 1)] + [(f"k{i}", 1, 2) for i in range(0, 20_000, 10)], "k string, rows long, v int")
    docs = spark.createDataFrame(rows, "id long, k string")
    kept = {name: spark.conf.get(name, None) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = skew.spread_lookup(docs, table, "k", "rows")
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        found = {r.id: r.v for r in got.collect()}
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(found) == len(rows) and found[-1] is found[-2] is None
    assert all(found[i] == (1 if i % 10 else 2) for i in range(20_000))


def test_exact_dedup_of_a_hot_text(spark):
    docs = spark.createDataFrame([(i, "hot text" if i % 10 else f"text {i}") for i in range(5_000)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 5_000
    assert all((r.keep_id, r.group_size, r.kept) == ((1, 4_500, r.doc_id == 1) if r.doc_id % 10 else (r.doc_id, 1, True)) for r in got)
