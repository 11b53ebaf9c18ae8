"""Delta coding of whole contents."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from packloom import queries
from packloom.functions import delta

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", "abc", "abcd", "x" * 255, "0123456789" * 700 + "äß", "".join(chr(33 + k * k % 90) for k in range(9001))]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(k, t, "en", "src1", len(t)) for k, t in enumerate(TEXTS)], COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_of_whole_texts(spark, folder):
    coded = {r["doc_id"]: r for r in queries.QUERIES["c8_delta_words"](spark, folder).collect()}
    back = {r["doc_id"]: r for r in queries.QUERIES["c9_delta_decode_words"](spark, folder).collect()}
    for k, text in enumerate(TEXTS):
        data = text.encode()
        words = np.frombuffer(data, "<u4", len(data) // 4).astype(np.int64)
        assert coded[k]["deltas"] == ",".join(map(str, np.diff(words, prepend=0) % 2**32))
        assert back[k]["words"] == ",".join(map(str, words))
        assert coded[k]["tail"] == back[k]["tail"] == data[len(words) * 4 :].hex().upper()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    for name, found in (("c8_delta_words", coded), ("c9_delta_decode_words", back)):
        assert sorted(con.sql(queries.ORACLES[name]).fetchall()) == sorted(map(tuple, found.values()))


def test_decode_words_nulls(spark):
    df = spark.createDataFrame([(0, [1, 2**32 - 1, 5]), (1, None), (2, []), (3, [4, None, 1]), (4, [7])], "k int, c array<bigint>")
    found = dict(df.select("k", delta.decode_words(F.col("c"))).collect())
    assert found == {0: [1, 0, 5], 1: None, 2: [], 3: [4, None, None], 4: [7]}
