"""The registered queries on the smallest tables: against DuckDB where there is SQL, else for their columns."""

import os
import zlib

import pytest

from loam.llm import queries as q
from tests.test_queries import DATA, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracle(spark, duck, name):  # noqa: F811
    df = q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    r = duck.execute(q.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(row[names.index(c)]) for c in columns) for row in r.fetchall())


def test_contract_columns(spark):
    want = {
        "op1_exact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op6_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op7_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op9_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
        "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    }
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, columns in want.items():
        df = q.queries()[name](spark, DATA)
        kinds = dict(df.dtypes)
        assert {c: kinds[c] for c in columns} == columns, name
        if name != "op1_exact_topk":
            assert df.count() == n, name
    for r in q.op10_language_id(spark, DATA).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert all(len(r.fingerprint) == 16 for r in q.op4_simhash(spark, DATA).collect())
