"""Every query of the subpackage runs over whole small tables and gives the columns it is to give; those with SQL give the SQL's rows."""

import os

import duckdb
import pytest

from rollcall.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": ["group_id", "field_name", "canonical_entity_id"], "p2_found": ["record_a", "record_b"], "p3_found": ["record_a", "record_b"], "p4_found": ["record_a", "record_b"], "p5_found": ["record_id", "field_name"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = df.collect()
    if df.columns == ["record_a", "record_b"]:
        assert all(a < b for a, b in rows) and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())
