"""The registered queries against their SQL, on the smallest tables."""

import glob
import math
import os

import pytest

from corpusloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")

COLUMNS = {
    "op1_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_token_files": "doc_id start n_tokens ids_crc32",
    "op7_html_extraction": "page_id url text n_chars",
    "op8_ngram_jaccard": "doc_id n_shingles component_id",
    "op9_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_packing": "doc_id source start length ids_crc32 doc_tokens sequence_id offset",
    "op11_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


def rows_of(frame):
    def cell(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) or str(v) == "<NA>" else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    assert sorted(out.columns) == sorted(COLUMNS[name].split())
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert rows_of(queries.QUERIES[name](spark, DATA).toPandas()) == rows_of(con.execute(queries.SQL[name]).df())
