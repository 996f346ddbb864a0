"""run() against every stage written plainly, one after the other, on all documents of the smallest table and planted ones."""

import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleanspark.llm import packing, pii, quality
from tests.llm.test_exact_line import plain_lines
from tests.llm.test_near_dedup import classes
from tests.llm.test_packing_quality_pipeline import SF, check_pieces, plain_score

WORDS = public_tokenizers.path("word_bpe_49k.json")


def redacted(text, spans):
    """Overlapping spans go together, named by the first and longest."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def plain_run(spark, docs, labels):
    """The texts that reach the packing stage, by id; ids are unique."""
    learnt = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = quality.fit(docs, spark.createDataFrame(learnt, labels.schema))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rows = [(i, t) for i, t in rows if plain_score(model, t or "") >= 0.5]
    rows = [(i, kept) for (i, _), (_, _, kept) in zip(rows, plain_lines([t for _, t in rows], 10), strict=True)]
    rows.sort()
    first = classes([t for _, t in rows])
    rows = [row for at, row in enumerate(rows) if first[at] == at]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "pii").collect()
    spans = {r.doc_id: [(s.start, s.end, s.kind) for kind in r.pii for s in kind] for r in found}
    return {i: redacted(t, spans[i]) for i, t in rows}


def test_run_equals_plain_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    base = docs.where("text IS NOT NULL AND size(split(text, ' ')) > 60").orderBy("doc_id").first()
    words = base.text.split(" ")
    planted = [(900_001, base.text), (900_002, " ".join(words[:-1] + ["changed"])), (900_003, "mail me at one@example.org or +49 30 1234567, card 4111 1111 1111 1111, " + " ".join(reversed(words))), (900_004, None), (900_005, "")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "xx", "planted", len(t or "")) for i, t in planted], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    want = plain_run(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got} ^ set(want)) == []
    assert 900_001 not in want and 900_002 not in want
    check_pieces(got, want)
    whole = Tokenizer.from_file(WORDS)
    lengths = Counter()
    for t in want.values():
        n = len(whole.encode(t, add_special_tokens=False).ids) + 1
        lengths.update([4096] * (n // 4096) + [n % 4096] * bool(n % 4096))
    assert len({r.sequence_id for r in got}) == sum(count for _, count in packing.shortest_pack_first(lengths, 4096))


def test_run_on_an_empty_table_and_null_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, rows in (("none", docs.limit(0)), ("lost", docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "lost")).collect()} == {None}
