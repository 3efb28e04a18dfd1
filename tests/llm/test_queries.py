import os

import duckdb
import pandas as pd
import pytest

from conftest import SF001
from routelytics.llm.queries import ORACLE, QUERIES


def _values(df):
    return sorted((tuple("null" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool)
                         else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF001):
        if t.endswith(".parquet"):
            con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{SF001}/{t}')")
    assert _values(QUERIES[name](spark, SF001).toPandas()) == _values(con.execute(ORACLE[name]).df())


CONTRACT = {
    "op1_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3_": ["doc_id", "held_out", "lang_pred", "score"], "op4_": ["doc_id", "held_out", "score", "predicted"],
    "op5_": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_": ["doc_id", "fingerprint", "component_id"],
    "op9_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op11_": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op13_": ["item_id", "rank", "doc_id", "score"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, SF001)
    wanted = CONTRACT[name.split("_")[0] + "_"]
    assert set(wanted) <= set(got.columns)
    types = dict(got.dtypes)
    for c in wanted:
        if c in ("start", "length", "group_size", "size", "taken", "n_words", "n_email", "n_hex", "payload_bytes"):
            assert types[c] == "bigint", c
    if name.split("_")[0] not in ("op1", "op11", "op13"):
        table = "pages" if name.startswith("op10_") else "documents"
        assert got.count() == spark.read.parquet(f"{SF001}/{table}.parquet").count()
