"""Every asset query with a DuckDB counterpart gives its rows."""

import duckdb
import pandas as pd
import pytest

from packloom import queries

FOLDER = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, float) else v)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(found)
    if name in queries.ORACLES:
        pd.testing.assert_frame_equal(rows(found), rows(duck.sql(queries.ORACLES[name]).df()))
    for flag in ("same", "ok"):
        if flag in found and name not in queries.ORACLES:
            assert found[flag].all()


def test_extract_of_a_document_that_is_not_there(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id <> 21")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    name = "b3_b4_b5_d9_extract_file"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(rows(found), rows(c.sql(queries.ORACLES[name]).df()))
    assert not len(found)
