"""Versions of a store: what readers see after failures, empty shards, restores and clearing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomframe.operators import store as S

KEY = "collection_id string, shard_id string"


def tables(spark, rows):
    """rows: (shard, index, doc)."""
    vectors = spark.createDataFrame([("m", s, i, [1.0, float(i)]) for s, i, _ in rows], f"{KEY}, vector_index long, embedding array<float>")
    meta = spark.createDataFrame([("m", s, i, d, 5) for s, i, d in rows], f"{KEY}, vector_index long, doc_id string, chunk_len_tokens int")
    manifest = spark.createDataFrame(sorted({("m", s, d) for s, _, d in rows}), f"{KEY}, doc_id string")
    return {"vectors": vectors, "meta": meta, "manifest": manifest}


def docs(spark, path, version=None, **keys):
    own = S.read_snapshot(spark, path, version, **keys)
    return {part: sorted((r.shard_id, r.doc_id) for r in own[part].select("shard_id", "doc_id").collect()) for part in ("meta", "manifest")}


ROWS = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("s/1 =%", 0, "w")]


def test_a_failure_between_tables_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "s")
    assert S.write_snapshot(tables(spark, ROWS), path) == 1
    bad = tables(spark, [("a", 0, "new")])
    bad["manifest"] = bad["manifest"].withColumn("doc_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        S.write_snapshot(bad, path)
    assert list(Path(path, "meta").glob("version=2"))  # what the failed version had written already
    want = [("a", "x"), ("a", "y"), ("b", "z"), ("s/1 =%", "w")]
    assert docs(spark, path) == {"meta": want, "manifest": want}
    assert S.write_snapshot(tables(spark, [("a", 0, "newer")]), path) == 2
    assert docs(spark, path)["meta"] == [("a", "newer"), ("b", "z"), ("s/1 =%", "w")] == docs(spark, path)["manifest"]
    assert docs(spark, path, 1)["meta"] == want


def test_shards_that_lose_everything(spark, tmp_path):
    path = str(tmp_path / "s")
    S.write_snapshot(tables(spark, ROWS), path)
    gone = spark.createDataFrame([("a", "x"), ("a", "y")], "shard_id string, doc_id string")
    result, resets = S.deregistered(spark, path, gone, "now", shard_id="a")
    assert result.first().status == "success" and resets.count() == 2
    assert docs(spark, path, shard_id="a") == {"meta": [], "manifest": []} and len(docs(spark, path)["meta"]) == 2
    assert S.read_snapshot(spark, path, shard_id="a")["vectors"].count() == 2  # orphans
    assert docs(spark, f"{path}/_backups/ts=now")["meta"] == [("a", "x"), ("a", "y")]
    every = S.versions(spark, path).groups()
    empty = {part: df.limit(0) for part, df in tables(spark, ROWS).items()}
    S.write_snapshot(empty, path, every)
    assert all(df.count() == 0 for df in S.read_snapshot(spark, path).values())
    assert S.versions(spark, path).restore(1, shard_id="b") == 4
    assert docs(spark, path)["meta"] == [("b", "z")]
    with pytest.raises(Exception, match="shard_id is missing"):
        S.write_snapshot(tables(spark, [(None, 0, "x")]), path)


def test_old_versions_are_cleared_and_those_in_use_stay(spark, tmp_path):
    path = str(tmp_path / "s")
    S.write_snapshot(tables(spark, ROWS), path)
    for k in range(6):
        S.write_snapshot(tables(spark, [("a", 0, f"v{k}")]), path)
    store = S.versions(spark, path)
    before = docs(spark, path)
    assert store.clear() == 6  # three tables of two versions of shard a; b still reads version 1
    assert store.numbers() == [3, 4, 5, 6, 7] and docs(spark, path) == before
    assert docs(spark, path, 3)["meta"] == [("a", "v1"), ("b", "z"), ("s/1 =%", "w")] and store.clear() == 0
    assert store.restore(3) == 8 and docs(spark, path)["meta"][0] == ("a", "v1")
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, str(tmp_path / "none"))


def test_only_named_shards_are_read(spark, tmp_path):
    path = str(tmp_path / "s")
    S.write_snapshot(tables(spark, ROWS), path)
    plan = S.read_snapshot(spark, path, shard_id="a")["meta"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shard_id" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
