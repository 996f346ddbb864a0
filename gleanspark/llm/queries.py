"""Queries of this subpackage, as they are registered in __spark_entry__.py, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import bpe, exact_dedup, importance, language_id, line_dedup, mpeg_audio, near_dedup, packing, pii, quality, sharding, substring_dedup, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(_documents(spark, sf_dir), tokenizer, keep=["doc_id"], packed=True)
    decoded = bpe.decode(encoded, tokenizer)
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", F.col("first").alias("kept"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir)).select("doc_id", "pii")
    counts = [F.size(F.col("pii")[k]).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.spans_text(F.col("pii"), pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.spans_text(F.col("pii"), (*pii.BASE_KINDS, *pii.EXTRA_KINDS)).alias("spans"),
    )


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = mpeg_audio.parse_media(mpeg_audio.encode_media(_documents(spark, sf_dir)))
    a = F.col("audio")
    feature = F.format_string(
        "frames=%d;samples=%d;rate=%d;duration_us=%d;crc_ok=%d;crc_bad=%d;resyncs=%d;bitrates=%s;seek=%s",
        a["frames"], a["samples"], a["rate"], F.floor(a["samples"] * 1000000 / a["rate"]), a["crc_ok"], a["crc_bad"], a["resyncs"], a["bitrates"],
        F.md5(F.array_join(a["offsets"], ",")),
    )
    return parsed.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length(a["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(a["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(a["payload"], -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(_documents(spark, sf_dir))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_documents(spark, sf_dir))
    return kept.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS nth, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, nth, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (
  SELECT doc_id, nth, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key
      HAVING count(DISTINCT doc_id) + count(DISTINCT nth) FILTER (doc_id IS NULL) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id, nth
"""


def _fold(modulus: int):  # noqa: ANN202
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"))
    labels, prototypes = language_id.train(docs.where(_fold(4) != 2))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), labels, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)



def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(3) != 1)
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = whitening.whiten(vectors).select("vec_id", F.col("whitening").alias("w")).select("vec_id", "w", F.posexplode("w.values").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "w.n",
        F.col("w.deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.col("w.explained")[F.col("at")].alias("explained"),
        "w.identity_error",
    )


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(_documents(spark, sf_dir))
    return kept.select("doc_id", "substring_dedup.*", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS nth, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT nth, unnest(range(1, len(w) - 33)) AS beg FROM d WHERE len(w) >= 35),
keyed AS (SELECT nth, beg, array_to_string(w[beg : beg + 34], ' ') AS body FROM windows JOIN d USING (nth)),
repeated AS (SELECT nth, beg FROM keyed QUALIFY count(*) OVER (PARTITION BY body) > 1),
gone AS (SELECT DISTINCT nth, unnest(range(beg, beg + 35)) AS pos FROM repeated),
words AS (SELECT doc_id, nth, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (
  SELECT nth, count(*) AS n_words, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY words.pos) FILTER (g.pos IS NULL) AS body
  FROM words LEFT JOIN gone AS g USING (nth, pos) GROUP BY nth)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (nth)
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance.resample(_documents(spark, sf_dir), target, keep=["doc_id"]).select("doc_id", "importance.*")


OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT 0 AS side, nth, unnest(w) AS word FROM (SELECT row_number() OVER () AS nth, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
  UNION ALL
  SELECT 1, 0, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
steps AS (  -- the table of the reflected polynomial
  SELECT i, i AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
distinct_words AS (SELECT word, hex(encode(word)) AS h, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words GROUP BY word),
hashed AS (
  SELECT word, w.s, w.t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM distinct_words AS w, crc),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM hashed),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((sums.t + 1)::DOUBLE * (totals.s + 10000)::DOUBLE / ((sums.s + 1)::DOUBLE * (totals.t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, totals),
weighed AS (SELECT nth, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY nth),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln(
    (('0x' || sha256('2024:' || coalesce(d.doc_id::VARCHAR, 'null'))[1:8])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM (SELECT doc_id, row_number() OVER () AS nth FROM documents) d LEFT JOIN weighed USING (nth)),
placed AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_mpeg_audio": op4_mpeg_audio,
    "op5_sharding": op5_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_importance": op13_importance,
}
ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op12_substring_dedup": OP12_SQL, "op13_importance": OP13_SQL}
