"""Cleaning against its SQL where a text's last digit meets the Japanese that follows it on a line of its own."""

from collections import Counter

import duckdb
import pytest

from loomframe.plans import QUERIES, SQL

TEXTS = ["call +1 (545) 555-9193", "ends with a digit 7 \n\n", "one 手 賀\n沼 2\t3 の line 4", "a line\nwith no digit", "12", "", "手 賀 8 ", "x 1\n2 手\n3"]


@pytest.mark.parametrize("name", ["j1b_inline_nfkc", "j11_clean_corpus", "d20_cleaning_report"])
def test_a_digit_before_japanese(spark, tmp_path, name):
    rows = [(3 * k + shift, text) for shift in (0, 1, 2) for k, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    got = [tuple(r) for r in QUERIES[name](spark, f"file://{tmp_path}").select(*columns).collect()]
    assert Counter(got) == Counter(cursor.fetchall())
