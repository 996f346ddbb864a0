"""op9, op10 and the pipeline's stages."""

import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gleanspark.llm import packing, quality, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def test_word_bpe_equals_library():
    rng = random.Random(0)
    texts = ["", " ", "it's we're 'tis ''s !s'x's't 5's 12 3.4 's' d'", "a b\x85c\x1cd e", "İstanbul Σ ΑΣ", "<|endoftext|> hi <|startoftext|>", "naïve Ça ÀÉ ß ÿ ª º ² ½ ŉ", "日本 é", "\x00a\x00", "it’s"]
    texts += ["".join(rng.choice("ab 's'tre1²½!É ßd\n") for _ in range(70)) for _ in range(500)]
    texts += ["".join(chr(rng.randrange(1, 0x180)) for _ in range(70)) for _ in range(500)]
    whole = Tokenizer.from_file(WORDS)
    for got, want in zip(packing.word_bpe(WORDS).encode(texts), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


@pytest.mark.parametrize("seed", range(6))
def test_shortest_pack_first(seed):
    rng = random.Random(seed)
    histogram = {length: rng.randrange(1, 60) for length in rng.sample(range(1, 65), 20)}
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(length * times for length, times in pattern) <= 64
        for length, times in pattern:
            placed[length] += times * count
    assert placed == histogram
    assert packing.shortest_pack_first({}, 64) == []


def check_pieces(rows, texts, capacity=4096):
    whole = Tokenizer.from_file(WORDS)
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(documents[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packs_documents(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["ab", "the", "xyzzy", "É1"]) for _ in range(rng.choice([0, 3, 900, 9000]))) for i in range(40)} | {100: None}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length int").repartition(4)
    check_pieces(packing.pack_documents(docs, WORDS).collect(), texts)
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0
    twice = packing.pack_documents(docs.where("doc_id < 3").unionAll(docs.where("doc_id < 3")), WORDS)
    assert twice.count() == 2 * packing.pack_documents(docs.where("doc_id < 3"), WORDS).count()


def test_sequences_hold_the_ids(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["ab", "the", "xyzzy", "É1", "日"]) for _ in range(rng.choice([0, 0, 5, 900, 9000]))) for i in range(60)} | {100: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    whole = Tokenizer.from_file(WORDS)
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    made = packing.sequences(docs, WORDS, pad_id=49405).collect()
    assert sorted(s.sequence_id for s in made) == list(range(len(made)))
    found = defaultdict(dict)
    for s in made:
        ids = np.frombuffer(s.ids, "<u4")
        assert len(ids) == 4096 and set(ids[s.n_tokens :].tolist()) <= {49405} and sum(p.length for p in s.pieces) == s.n_tokens
        for p in s.pieces:
            found[p.id][p.start] = ids[p.offset : p.offset + p.length].tolist()
    assert {i: [x for _, part in sorted(parts.items()) for x in part] for i, parts in found.items()} == want
    for r in packing.pack_documents(docs, WORDS, keep_ids=True).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(r.ids)


def test_pipeline_ends_in_tokens(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    whole = Tokenizer.from_file(WORDS)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.packing_stage(spark, docs, SF).collect()}
    assert got == {i: [*whole.encode(t, add_special_tokens=False).ids, 2] for i, t in ((1, "one two"), (2, "three"))}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op10_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "### $$$ ###", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 3 and {r.predicted for r in got} == {1}
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs, labels.limit(0))).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, before, SF), f"test-{name}")
        assert docs.columns == columns and docs.count() <= before.count()
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_pieces(pieces, {r.doc_id: r.text for r in docs.collect()})
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(pieces)


def test_pii_stage_redacts(spark):
    docs = spark.createDataFrame([(1, "write me@ex.org", "en", "s", 15), (2, None, "en", "s", 0), (3, "clean", "en", "s", 99)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.pii_stage(spark, docs, SF).collect()}
    assert got[1].text == "write [EMAIL]" and got[1].n_chars == 13 and got[2].text is None and got[3].n_chars == 99


def plain_statistics(text):
    """The classifier's statistics in plain Python."""
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", text), text.split("\n")
    tokens = [w for w in words if w]
    n = max(len(text), 1)
    share = lambda marks: sum(c in marks for c in text) / n
    stutter = sum(a == b for a, b in zip(tokens, tokens[1:]))
    return {
        "log_chars": math.log1p(len(text)),
        "symbols": share("#$%&*|<>{}~^\\"),
        "marks": share("!?"),
        "stops": share(".,;:"),
        "upper": share(string.ascii_uppercase),
        "digits": share(string.digits),
        "word_chars": len(text) / len(words),
        "line_chars": len(text) / len(lines),
        "stutter": stutter / len(words),
        "distinct_lines": len(set(lines)) / len(lines),
    }


def plain_score(model, text):
    """The rules' weights and the logistic function in plain Python."""
    stats, total = plain_statistics(text), model.intercept
    for conditions, weight in model.rules:
        if all((stats[name] <= threshold) == below for name, below, threshold in conditions):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_statistics_equal_plain_version(spark):
    rng = random.Random(8)
    texts = ["", " ", "a", "a a", "A A a a", "x  x\nx", "#!?.,9", "日本 日本\n\n", "\n\n", "a a" * 3, "word " * 300_000]
    texts += ["".join(rng.choice("aB  \n\t#9.!日") for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in docs.select("text", *[c.alias(k) for k, c in quality.statistics(docs.text).items()]).collect():
        for name, want in plain_statistics(row.text).items():
            assert row[name] == pytest.approx(want, abs=1e-12), (name, row.text[:60])


def test_paths_are_those_of_a_tree():
    class Node:
        def __init__(self, split=None, left=None, right=None):
            self._split, self._left, self._right = split, left, right

        def subtreeDepth(self):  # noqa: N802
            return 0 if self._split is None else 1 + max(self._left.subtreeDepth(), self._right.subtreeDepth())

        def split(self):
            return self

        def featureIndex(self):  # noqa: N802
            return self._split[0]

        def threshold(self):
            return self._split[1]

        def leftChild(self):  # noqa: N802
            return self._left

        def rightChild(self):  # noqa: N802
            return self._right

    tree = Node((0, 5.0), Node((0, 2.0), Node(), Node()), Node((1, 1.0), Node(), Node()))
    want = [
        (("a", True, 5.0),),
        (("a", True, 2.0),),  # the tighter of two bounds on one side stays
        (("a", False, 2.0), ("a", True, 5.0)),
        (("a", False, 5.0),),
        (("a", False, 5.0), ("b", True, 1.0)),
        (("a", False, 5.0), ("b", False, 1.0)),
    ]
    assert sorted(quality._paths(tree, ["a", "b"])) == sorted(want)


def test_scores_and_quality_stage_equal_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    learnt = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = quality.fit(docs, spark.createDataFrame(learnt))
    assert model.rules
    want = {r.doc_id: plain_score(model, r.text or "") for r in docs.collect()}
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-9)
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    assert kept == {i for i, s in want.items() if s >= 0.5}
