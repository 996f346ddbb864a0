"""op6 and op7 equal DuckDB; the contracts' columns are there."""

import pytest

from gleanspark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_near_dedup": "doc_id class_id",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_mpeg_audio": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op7_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_quality": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    compare(spark, connect(SF), QUERIES[name], ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    got = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.select("doc_id").distinct().count() == docs.count()
