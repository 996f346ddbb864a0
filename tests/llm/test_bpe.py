"""op1 against the tokenizers library."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " ",
    "it's  we're\n\n 'tis ''s 12 3.4\t\tx  <|endoftext|>  y<|endoftext|>",
    "naïve Ça ÀÉ ß 日本語 é   x \u0085 　 ½ ² \U0001f600 \U0001e030 \U00011f02 z",
    "a" * 5000 + " " * 300 + "b",
    "word " * 400,
    "<|endoftext|",
]


@pytest.mark.parametrize("table_words", [3, 400_000])
def test_equals_library(spark, table_words):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = bpe.decode(bpe.encode(docs, PATH, table_words=table_words), PATH).collect()
    whole = Tokenizer.from_file(PATH)
    assert len(got) == len(rows)
    for row in got:
        text = TEXTS[row.doc_id] or ""
        assert row.ids == whole.encode(text, add_special_tokens=False).ids
        assert row.decoded == whole.decode(row.ids, skip_special_tokens=False) == text
    assert sorted(r.words for r in got) == ["again"] + ["x"] * len(TEXTS)


def test_packed_and_invalid_bytes(spark):
    whole = Tokenizer.from_file(PATH)
    lists = [[0, 50256, 19743], [], [whole.encode("é").ids[0], 447], None]
    ids = spark.createDataFrame(list(enumerate(lists)), "k long, ids array<int>")
    for row in bpe.decode(ids, PATH).collect():
        assert row.decoded == whole.decode(row.ids or [], skip_special_tokens=False)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    packed = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH, keep=["doc_id"], packed=True), PATH).collect()}
    for i, text in enumerate(TEXTS):
        assert bytes(packed[i].ids) == np.array(whole.encode(text or "").ids, "<u4").tobytes()
        assert packed[i].decoded == (text or "")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == 0
