"""Queries against their SQL."""

import duckdb
import pytest

from spectraloom.llm import queries
from tests.test_oracles import rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf_dir):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = connection.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


ODD = [
    "", None, "token=abcdefgh1 AKIAABCDEFGHIJKL wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY x@y.zz 1.2.3.4 4111 1111 1111 1111 +49 30 1234567",
    "user: bob\n \t\nhttps://db.example.com password: hunter2hunter2\n\n\nuser: eve, 0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a http://e.com",
    "iban DE89 3704 0044 0532 0130 00 GB82WEST12345698765433 ssn 123-45-6789 𝔘 pin 123-45-6789 256.1.1.1 a@b.c_d@e.f",
    "https://a.example " + "word " * 90 + "login=abc secret=12345678", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY= AKIAABCDEFGHIJKL",
]


@pytest.mark.parametrize("name", ["op1_pii", "op5_secrets"])
def test_spans_of_odd_texts_equal_sql(name, spark, tmp_path):
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(ODD + ODD[2:3])], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = queries.QUERIES[name](spark, str(tmp_path))
    cursor = connection.execute(queries.SQL[name])
    assert rows(found.columns, found.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())
