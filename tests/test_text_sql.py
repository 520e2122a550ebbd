"""Token estimates against their SQL on texts that the test tables lack."""

import duckdb

from loomframe.plans import QUERIES, SQL

TEXTS = [None, "", " ", "\n\t\r\x0c", "\x0b", "a\x0bb", "one \x0b two\x0b\x0b", "　 ", " \x85\x1c", "x\x00y", "日本 A_1é!", "word " * 10]


def test_estimated_tokens_of_null_empty_and_blank_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(SQL["h19_estimated_tokens"]).fetchall())
    got = QUERIES["h19_estimated_tokens"](spark, f"file://{tmp_path}")
    assert got.dtypes == [("doc_id", "bigint"), ("tokens", "int")]
    assert {r.doc_id: r.tokens for r in got.collect()} == want
    assert [want[i] for i in range(7)] == [1, 1, 1, 1, 1, 3, 5]
