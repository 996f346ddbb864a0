"""op8: against a plain implementation, and held-out accuracy."""

import numpy as np

from gleanspark.llm import language_id as h
from gleanspark.llm import queries

TEXTS = ["The cat sat on the mat.", "", "123 !?", "Ünïcode straße 日本 x", "a", "the THE the"]


def plain(text, d, seed):
    symbols, last = [0], 0
    for c in text.lower():
        s = ord(c) if c.isalpha() else 0
        if s or last:
            symbols.append(s)
        last = s
    symbols += [0] * (symbols[-1] != 0)
    v = {s: h.letter_vectors(np.array([s]), d, seed)[0].astype(int) for s in set(symbols)}
    out = np.zeros(d, int)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        if b:
            out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


def test_vectors_equal_plain():
    got = h.document_vectors(TEXTS, 64, 7)
    assert np.array_equal(got, np.array([plain(t, 64, 7) for t in TEXTS]))
    assert np.array_equal(h.document_vectors([TEXTS[3]], 64, 7)[0], got[3])


def test_edges(spark):
    rows = [(1, "le chat et la table", "fr", "a"), (2, "the cat and the table", "en", "b"), (3, None, "en", "c"), (4, "..", None, "d"), (None, "the cat", None, "e")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels, prototypes = h.train(docs)
    assert labels == ["en", "fr"]
    got = {r.doc_id: r for r in h.predict(docs, labels, prototypes).collect()}
    assert got[1].lang_pred == "fr" and got[2].lang_pred == got[None].lang_pred == "en"
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0.0
    none, empty = h.train(docs.limit(0))
    assert none == [] and {r.lang_pred for r in h.predict(docs, none, empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
