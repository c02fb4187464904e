"""Every registered query with an oracle equals its DuckDB SQL (sf0.001 tables).

Set CLAUSEWISE_ORACLE_SF to another table folder to check a larger scale."""

import hashlib
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("CLAUSEWISE_ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["report_id", "sent_no", "clause_no", "clause_id", "doc", "trigger_clause_id",
                          "precursor_distance"]
    triggers = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    rows = df.collect()
    assert rows and triggers and all(1 <= r.precursor_distance <= 7 and r.clause_id != r.trigger_clause_id for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.sql(oracle_sql()[name])
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(res.columns, drows)
