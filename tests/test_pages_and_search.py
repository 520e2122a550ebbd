"""Pages from stored orders, exact search that skips clusters, logs by month, metadata with page ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import chunks as K, vectors as V
from loomframe.operators.pages import Order
from loomframe.operators.pruned import pruned_search
from loomframe.sources import jsonl as J


@pytest.mark.parametrize("range_rows", [3, 17, 1000])
def test_every_page_is_that_of_the_whole_order(spark, range_rows):
    rnd = random.Random(range_rows)
    made = [(i, rnd.choice([None, 1, 2, 2, 3]), rnd.choice(["a", "b", None])) for i in range(60)]
    df = spark.createDataFrame(made, "id long, n long, s string")
    order = Order(df, {"n": F.col("n"), "s": F.col("s"), "id": F.col("id")}, ("n",), range_rows)
    want = sorted(made, key=lambda r: ((r[1] is None, -(r[1] or 0)), (r[2] is None, r[2] or ""), r[0]))
    assert order.total == 60 and order.pages(7) == 9
    seen, key = [], None
    for number in range(1, 10):
        assert [tuple(r) for r in order.page(number, 7).collect()] == want[7 * (number - 1) : 7 * number]
        rows, key = order.after(key, 7)
        seen += [tuple(r) for r in rows.collect()]
    assert seen == want and key is None and order.page(10, 7).count() == 0
    assert max(len(order.ranges_of(k, 7)[0]) for k in range(1, 10)) <= (4 if range_rows == 3 else 2)


def test_an_order_without_rows(spark):
    order = Order(spark.createDataFrame([], "id long"), {"id": F.col("id")})
    assert order.pages(5) == 1 and order.page(1, 5).count() == 0 and order.after(None, 5)[0].count() == 0


def test_clusters_are_skipped_and_results_are_those_of_the_whole_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((24, 16))
    x = centres[rng.integers(0, 24, 6_000)] + 0.05 * rng.standard_normal((6_000, 16))
    x[5], x[17] = 0, 0
    x[40:60] = x[39]
    v = spark.createDataFrame([(str(i % 3), i // 3, r.tolist()) for i, r in enumerate(x)], "shard_id string, vector_index long, embedding array<double>")
    asks = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 6_000, 60) if x[i].any()], "query_id long, embedding array<double>")
    hits, visits = pruned_search(v, asks, 6)
    key = lambda df: {tuple(r) for r in df.collect()}
    assert key(hits) == key(V.search(v, asks, 6))
    share = visits.agg((F.sum("visited") / F.sum("clusters")).alias("s")).first().s
    assert share < 0.35 and visits.count() == asks.count()
    assert key(pruned_search(v, asks, 6, ["1"])[0]) == key(V.search(v, asks, 6, ["1"]))


def test_search_of_vectors_without_clusters_few_rows_and_bad_queries(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (700, 5)).astype(float)
    v = spark.createDataFrame([(str(i % 2), i, r.tolist()) for i, r in enumerate(x)], "shard_id string, vector_index long, embedding array<double>")
    asks = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 700, 9) if x[i].any()], "query_id long, embedding array<double>")
    key = lambda df: {tuple(r) for r in df.collect()}
    assert key(pruned_search(v, asks, 5)[0]) == key(V.search(v, asks, 5))
    few = v.limit(3)
    assert key(pruned_search(few, asks, 5)[0]) == key(V.search(few, asks, 5))
    assert pruned_search(v.limit(0), asks, 5)[0].count() == 0
    for bad in ([0.0] * 5, [1.0, 2.0]):
        with pytest.raises(Exception):
            pruned_search(v, spark.createDataFrame([(1, bad)], "query_id long, embedding array<double>"), 5)[0].count()


def test_logs_of_some_months_and_keys_of_a_log(spark, tmp_path, monkeypatch):
    for month in ("2024-01", "2024-02", "2024-03"):
        for folder in ("a", "b"):
            (tmp_path / folder).mkdir(exist_ok=True)
            (tmp_path / folder / f"app_{month}.jsonl").write_text(f'{{"m": "{month}", "f": "{folder}"}}\n')
    (tmp_path / "b" / "other_2024-02.jsonl").write_text("{}\n")
    got = J.rows(J.read_log(spark, str(tmp_path), "app", "2024-02"), "m string, f string").collect()
    assert sorted((r.m, r.f, r.month) for r in got) == [("2024-02", "b", "2024-02"), ("2024-03", "b", "2024-03")]
    assert len(J.read_log(spark, str(tmp_path), "app", "2024-02", "2024-02").inputFiles()) == 1
    assert J.read_log(spark, str(tmp_path), "app", "2025-01").count() == 0 and J.read_log(spark, str(tmp_path / "no"), "app").count() == 0
    lines = spark.createDataFrame([(f'{{"k{i}": 1}}',) for i in range(9)], "line string")
    assert len(J.all_rows(lines).columns) == 9
    monkeypatch.setattr(J, "MAX_KEYS", 8)
    with pytest.raises(ValueError, match="more than 8"):
        J.all_rows(lines)


def test_statistics_of_files_and_months(spark, tmp_path):
    (tmp_path / "my logs").mkdir()
    (tmp_path / "my logs" / "app_2024-01.jsonl").write_bytes(b'{"a": 1}\n\n[1]\n{bad\n 7 \n')
    (tmp_path / "my logs" / "app_2024-02.jsonl").write_bytes(b'{"a": 1}\n\xff{"a": 2}\n{"a": 3}')
    (tmp_path / "my logs" / "app_2024-03.jsonl").write_bytes(b"")
    folder, row = str(tmp_path / "my logs"), lambda *paths: tuple(J.read_stats(spark, list(paths)).first())
    assert row(folder) == (3, 8, 3, 3, 1)
    assert row(folder + "/*-01.jsonl", str(tmp_path / "none")) == (1, 5, 1, 3, 0)
    assert row(folder + "/app_2024-03.jsonl") == (1, 0, 0, 0, 0)
    assert row(str(tmp_path / "none")) == row() == (0, 0, 0, 0, 0)
    assert {tuple(r) for r in J.log_stats(spark, folder, "app", "2024-02").collect()} == {("2024-02", 3, 2, 0, 1)}


def test_months_of_a_written_log_are_pruned(spark, tmp_path):
    rows = [(f"2024-0{m}-01 00:00:00", "u", "view") for m in (1, 2, 2, 3)]
    J.write_log(spark.createDataFrame(rows, "ts string, user string, action string"), str(tmp_path / "log"), "app")
    own = J.month_stats(spark, str(tmp_path / "log"), "2024-02", "2024-02")
    assert [tuple(r) for r in own.collect()] == [("2024-02", 2, 2, 0, 0)]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "DataFilters: []" in plan


def test_what_stands_behind_an_audit(spark):
    vectors = spark.createDataFrame([("s", i, [1.0]) for i in range(4)] + [("t", 0, [1.0])], "shard_id string, vector_index int, embedding array<double>")
    meta = spark.createDataFrame([("s", 0, "a"), ("s", 0, "b"), ("s", -1, "b"), ("s", 4, "c"), ("s", 1, None), ("u", 0, "a")], "shard_id string, vector_index int, doc_id string")
    manifest = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("s", "z"), ("t", None)], "shard_id string, doc_id string")
    got = {tuple(r) for r in V.audit_details(vectors, meta, manifest, 2).collect()}
    assert got == {
        ("s", "negative", "b", -1, 1), ("s", "out_of_range", "c", 4, 1), ("u", "out_of_range", "a", 0, 1),
        ("s", "duplicate_index", None, 0, 2), ("s", "orphan", None, 2, 1), ("s", "orphan", None, 3, 1), ("t", "orphan", None, 0, 1),
        ("s", "meta_only", "c", None, 1), ("s", "meta_only", None, None, 1), ("u", "meta_only", "a", None, 1),
        ("s", "processed_only", "z", None, 1), ("t", "processed_only", None, None, 1), ("s", "duplicate_processed", "a", None, 2),
        ("s", "top_doc", "b", -1, 2), ("s", "top_doc", "a", 0, 1), ("u", "top_doc", "a", 0, 1),
    }
    counts = {r.shard_id: r for r in V.audit(vectors, meta.filter("shard_id <> 'u'"), manifest).collect()}
    assert counts["s"].misaligned == sum(r[4] if r[1] != "duplicate_index" else 1 for r in got if r[0] == "s" and r[1] in ("negative", "out_of_range", "duplicate_index"))
    none = V.audit_details(vectors.limit(0), meta.limit(0), manifest.limit(0))
    assert none.count() == 0 and none.columns == ["shard_id", "issue", "doc_id", "vector_index", "n"]


def test_chunks_and_page_ranges_must_agree(spark):
    chunks = spark.createDataFrame([("d", 0, "x", 0, 1, 1), ("d", 1, " \n", 1, 2, 0), ("d", 2, "y", 2, 3, 1)], "doc_id string, chunk_index int, text string, span_start int, span_end int, chunk_len_tokens int")
    sources = spark.createDataFrame([("c", "s", "d", "in/a.txt")], "collection_id string, shard_id string, doc_id string, file string")
    base = spark.createDataFrame([("s", 7)], "shard_id string, base long")
    ranges = spark.createDataFrame([("d", k, k + 1, -2) for k in range(3)], "doc_id string, chunk_index int, page_start int, page_end int")
    rows = K.meta_rows(chunks, sources, base, "now", ranges)
    assert tuple(rows.columns) == K.META and len(K.META) == 22
    assert sorted((r.chunk_id, r.vector_index, r.page_start, r.page_end, r.source_text_kind, r.attrs, r.file_name) for r in rows.collect()) == [("d#c000001", 7, 1, 0, "other", "{}", "a.txt"), ("d#c000003", 8, 3, 0, "other", "{}", "a.txt")]
    for wrong in (ranges.filter("chunk_index < 2"), ranges.union(ranges.limit(1).withColumn("chunk_index", F.lit(9)))):
        with pytest.raises(Exception, match="page ranges"):
            K.meta_rows(chunks, sources, base, "now", wrong).collect()
    plain = K.meta_rows(chunks, sources, base, "now").collect()
    assert {(r.page_start, r.page_end) for r in plain} == {(0, 0)}
    assert [tuple(r) for r in K.manifest_rows(rows, sources, "now").select("doc_id", "ingested_at", "attrs").collect()] == [("d", "now", "{}")]


def test_ranges_of_an_order_are_bounded(spark):
    """However small the ranges asked for and many the rows: the driver hears of RANGES at most, and pages are whole."""
    from loomframe.operators import pages as P

    rows = spark.range(20_000).select(F.pmod(F.col("id") * 7_919, F.lit(20_000)).alias("k"))
    order = P.Order(rows, {"k": F.col("k")}, range_rows=10)
    assert len(order.counts) <= P.RANGES and order.total == 20_000
    assert [r.k for r in order.page(401, 25).collect()] == list(range(10_000, 10_025))
    found, key = order.after(None, 25)
    assert [r.k for r in order.after(key, 25)[0].collect()] == list(range(25, 50))


def test_metadata_is_numbered_without_texts(spark, monkeypatch):
    """Texts pass no join or window but the last; a row keeps its own text, also beside a row of the same key."""
    seen, real = [], V.dense_index
    monkeypatch.setattr(V, "dense_index", lambda rows, base: seen.append(rows.columns) or real(rows, base))
    chunks = spark.createDataFrame([("d", 0, "one", 0, 3, 1), ("d", 1, " ", 3, 4, 1), ("d", 2, "three", 4, 9, 1), ("d", 2, "four", 9, 13, 1), ("e", 0, None, 0, 0, 0)], "doc_id string, chunk_index int, text string, span_start int, span_end int, chunk_len_tokens int")
    sources = spark.createDataFrame([("s", "d"), ("s", "e")], "shard_id string, doc_id string")
    base = spark.createDataFrame([("s", 5)], "shard_id string, base int")
    got = sorted((r.text, r.span_start) for r in K.meta_rows(chunks, sources, base, "now").collect())
    assert got == [("four", 9), ("one", 0), ("three", 4)]
    assert seen and "text" not in seen[0]
