"""Substring deduplication against a plain version; the index against counting."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.llm import queries, substring_dedup
from gleanspark.llm.fm_index import Bits, FmIndex, WaveletTree
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_bits_and_wavelet_tree():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        bits = rng.integers(0, 2, size)
        assert Bits(bits).rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
    for symbols in (1, 2, 3, 40, 400):
        sequence = np.concatenate((np.arange(symbols), rng.zipf(1.5, 3000) % symbols))
        rng.shuffle(sequence)
        tree = WaveletTree(sequence, symbols)
        for c in {0, symbols // 2, symbols - 1}:
            at = rng.integers(0, len(sequence) + 1, 50)
            assert tree.rank(np.full(50, c), at).tolist() == [int((sequence[:i] == c).sum()) for i in at]


def test_matching_statistics_find_repeated_windows():
    random.seed(5)
    for _ in range(60):
        depth = random.choice([2, 3, 8, 35])
        sequences = [[random.randint(1, random.choice([2, 5, 30])) for _ in range(random.randint(depth, 3 * depth))] for _ in range(6)]
        sequences += [sequences[0][:], sequences[1][-depth:]]
        _, flat = np.unique(np.concatenate(sequences), return_inverse=True)
        flat, lengths = flat + 1, np.array([len(s) for s in sequences])
        weights = np.array([random.choice([1, 1, 2]) for _ in sequences])
        got = FmIndex(flat, lengths, weights, depth).matching_statistics(flat, lengths) == depth
        counts, at = Counter(), 0
        for s, n in zip(sequences, weights, strict=True):
            counts.update({w: 0 for w in ()})
            for i in range(len(s) - depth + 1):
                counts[tuple(s[i : i + depth])] += int(n)
        for s in sequences:
            want = [i + depth <= len(s) and counts[tuple(s[i : i + depth])] > 1 for i in range(len(s))]
            assert got[at : at + len(s)].tolist() == want
            at += len(s)


def _plain(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (ident, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((ident, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def _got(df, window, **how):
    found = substring_dedup.substring_dedup(df, window=window, **how)
    return sorted(((r.doc_id, r.substring_dedup.n_words, r.substring_dedup.n_removed, r.text) for r in found.collect()), key=repr)


def _corpus(seed=7):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "δέλτα", "e5", "x"]) + str(rng.randint(0, 400))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(n) for n in (35, 50, 90, 34)]
    rows = []
    for i in range(60):
        body = prose(rng.randint(0, 120))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body = body[:at] + p + body[at:]
        rows.append((i, rng.choice([" ", "\t", "\n ", "\x0b"]).join(body)))
    rows += [(60, rows[3][1]), (60, rows[3][1]), (None, "same " * 80), (None, None), (61, ""), (62, " \n"), (63, "a b c\x1fd " * 40), (64, "x y " * 30 + "z")]
    return rows


@pytest.mark.parametrize(("window", "how"), [(35, {}), (35, {"hot_segments": 1, "words_per_shard": 300}), (2, {"words_per_shard": 500}), (7, {"hot_segments": 0})])
def test_against_plain(spark, window, how):
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _got(df, window, **how) == _plain(rows, window)


def test_against_sql(spark):
    compare(spark, connect(SMALL), queries.op12_substring_dedup, queries.OP12_SQL, SMALL)


def test_edges(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([("a\n", "k " * 40)], "doc_id string, text string")
    for name in ("rn", "row", "body", "_", "substring_dedup", "n_words"):
        clash = clash.withColumn(name, F.lit(7))
    got = substring_dedup.substring_dedup(clash)
    assert got.columns == ["doc_id", "text", "rn", "row", "body", "_", "n_words", "substring_dedup"]
    row = got.first()
    assert (row.rn, row.text, row.substring_dedup.n_removed) == (7, "", 40)


def test_hot_passage_and_equal_rows(spark):
    """A passage in all of 4,000 documents with other words around it, and 4,000 equal rows."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(4_000).select("id", F.concat_ws(" ", F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id"), F.lit(passage), F.concat(F.lit("c"), "id")).alias("text"))
    equal = spark.range(4_000).select(F.lit(1).cast("long").alias("id"), F.lit(" ".join(f"q{i}" for i in range(40))).alias("text"))
    found = substring_dedup.substring_dedup(docs.unionAll(equal)).groupBy("substring_dedup").agg(F.count("*").alias("n"), F.min(F.size(F.split("text", " "))).alias("words"))
    assert {(r.substring_dedup.n_words, r.substring_dedup.n_removed, r.n) for r in found.collect()} == {(63, 60, 4000), (40, 40, 4000)}
