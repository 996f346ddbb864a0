"""Importance resampling against a plain version, with single words and with word pairs, over many small blocks."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanspark.llm import importance, queries
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def _features(text, least, most):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def _plain(docs, target, least, most, buckets, min_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    features = [_features(t, least, most) for _, t in docs]
    s, t = Counter(bucket(f) for _, fs in features for f in fs), Counter(bucket(f) for x in target for f in _features(x, least, most)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out, able = [], []
    for (ident, _), (words, fs) in zip(docs, features, strict=True):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'null' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([ident, len(fs), weight, score, None])
        if words >= min_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


TEXTS = [
    "Zebra zebra, the ZEBRA runs far over the quiet field and sleeps beneath old trees while rain falls on stone walls again",
    "the cat sat on the mat " * 9,
    "Ünïcode wörds ÀÉ stay as they are 42 times; naïve café x1 y2 z3 " * 4,
    "", None, "?!\t", "one", "a b " * 30, "the quiet field " * 4000,
]


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 2), (2, 3)])
def test_against_plain(spark, least, most):
    docs = [(i, f"{t} {i % 3} extra" if t else t) for i, t in enumerate(TEXTS * 6)] + [(None, TEXTS[1]), (3, TEXTS[0]), (3, TEXTS[0])]
    target = ["the quiet field and the cat", None, "", "café wörds on the mat"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), least=least, most=most, buckets=50, min_words=5, percent=30, keep=["doc_id"], block_bytes=2000)
    assert sorted((tuple(r) for r in got.select("doc_id", "importance.*").collect()), key=repr) == _plain(docs, target, least, most, 50, 5, 30)


def test_against_sql(spark):
    compare(spark, connect(SMALL), queries.op13_importance, queries.OP13_SQL, SMALL)


def test_edges(spark):
    target = spark.createDataFrame([("x",)], "text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, target).count() == 0
    rows = importance.resample(spark.createDataFrame([("a\nb", "x y"), ("c", None)], "doc_id string, text string"), empty.select("text"), min_words=1, percent=100).orderBy("doc_id").collect()
    assert [(r.doc_id, r.importance.n_features, r.importance["rank"]) for r in rows] == [("a\nb", 2, 1), ("c", 0, None)]
    clash = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    for name in ("row", "block", "score", "importance", "place", "word", "n_words"):
        clash = clash.withColumn(name, F.lit(7))
    got = importance.resample(clash, target).first()
    assert got.block == 7 and got.place == 7 and got.importance.n_features == 3


def test_many_equal_rows(spark):
    docs = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same words in every row " * 5).alias("text"))
    got = importance.resample(docs, docs.select("text").limit(3), keep=["doc_id"]).select("importance.*")
    assert got.where("rank IS NOT NULL").agg(F.count("*"), F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (2000, 1, 2000, 2000)
