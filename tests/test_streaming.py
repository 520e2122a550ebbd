"""Streams against the same functions over batches."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from loomframe.operators import runs as R
from loomframe.operators.chunks import chunk_documents
from loomframe.operators.sessions import folded_heartbeats, latest_sessions
from loomframe.plans.views import view
from loomframe.streaming import ingest, runs, sessions

SF = "/root/testdata/sf0.001"


def stream(spark, df, path):
    df.repartition(3).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def rows(df):
    return Counter(map(str, map(tuple, df.select(sorted(df.columns)).collect())))


def in_order(spark, df, path, parts=5):
    """Files in order of time, one a batch, and an event a day later that closes what is open."""
    own = df.select("event_id", "session_id", "user_sub", "app_name", "kind", "ts").withColumn("part", F.ntile(parts).over(W.orderBy("ts"))).cache()
    for k in range(1, parts + 1):
        own.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(path))
    end = [(-1, "end", "end", "end", "heartbeat", df.agg(F.max("ts")).first()[0] + timedelta(days=1))]
    spark.createDataFrame(end, ingest.EVENTS).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ingest.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_minutes_and_sessions(spark, tmp_path):
    batch = view(spark, SF, "ses")
    live = in_order(spark, batch, tmp_path / "ses")
    assert rows(drained(sessions.minute_activity(live, "0 seconds"), "minutes").filter("app_name <> 'end'")) == rows(sessions.minute_activity(batch))
    live = stream(spark, batch, tmp_path / "ses2")
    assert rows(drained(sessions.ttl_sessions(live, late="60 days"), "ttl", "complete")) == rows(sessions.ttl_sessions(batch))


def test_thinning_a_stream_is_exact_in_any_order(spark, tmp_path):
    """Heartbeats at all distances, mixed within the lateness: what the fold over the table keeps."""
    rnd, start = random.Random(3), datetime(2024, 5, 1)
    made = [(n, f"s{n % 6}", "u", "a", "heartbeat" if n % 9 else "login", start + timedelta(seconds=n // 3 + rnd.randrange(-40, 40), microseconds=rnd.choice([0, 1, 500_000]))) for n in range(1200)]
    out = tmp_path / "in"
    for k in range(0, 1200, 200):
        spark.createDataFrame(made[k : k + 200], ingest.EVENTS).coalesce(1).write.mode("append").parquet(str(out))
    spark.createDataFrame([(-1, "end", "u", "a", "heartbeat", start + timedelta(days=1))], ingest.EVENTS).coalesce(1).write.mode("append").parquet(str(out))
    spark.createDataFrame([(-2, "end", "u", "a", "heartbeat", start + timedelta(days=2))], ingest.EVENTS).coalesce(1).write.mode("append").parquet(str(out))
    live = spark.readStream.schema(ingest.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(out))
    got = drained(sessions.thinned_stream(live, late="5 minutes"), "thin").filter("session_id <> 'end'").select("session_id", "event_id")
    want = folded_heartbeats(spark.createDataFrame(made, ingest.EVENTS)).select("session_id", "event_id")
    assert rows(got) == rows(want) and got.count() > 50


def test_runs_join(spark, tmp_path):
    own = view(spark, SF, "run")
    starts, finishes = R.start_events(own), R.finish_events(own)
    got = drained(runs.joined_runs(stream(spark, starts, tmp_path / "s"), stream(spark, finishes, tmp_path / "f"), "60 days"), "runs")
    done = rows(got.filter("status <> 'running'"))
    assert done == rows(runs.joined_runs(starts, finishes).filter("status <> 'running'"))


def test_ingest_takes_each_document_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    manifest, chunks = str(tmp_path / "m"), str(tmp_path / "c")
    live = stream(spark, docs, tmp_path / "docs")
    ingest.ingest_stream(live, manifest, chunks, str(tmp_path / "ck")).awaitTermination()
    ingest.ingest_batch(docs, manifest, chunks, 99)
    assert spark.read.parquet(manifest).count() == 40
    assert rows(spark.read.parquet(chunks).drop("batch")) == rows(chunk_documents(docs))


def test_a_batch_that_fails_after_its_chunks_and_comes_again(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 30")
    docs = docs.union(docs.filter("doc_id = 3").withColumn("text", F.lit("~ a later text of the same id"))).cache()
    manifest, chunks = str(tmp_path / "m"), str(tmp_path / "c")
    ingest.ingest_batch(docs.filter("doc_id < 10"), manifest, chunks, 0)
    with monkeypatch.context() as m:
        m.setattr(ingest.F, "sha2", lambda *a: F.raise_error(F.lit("lost before the manifest")))
        with pytest.raises(Exception, match="lost before"):
            ingest.ingest_batch(docs, manifest, chunks, 1)
    assert spark.read.parquet(chunks).filter("batch = 1").count() > 0  # its chunks are there, its manifest is not
    for _ in range(2):  # again after the failure, and once more after all went well
        ingest.ingest_batch(docs.repartition(7), manifest, chunks, 1)
        want = chunk_documents(docs.groupBy("doc_id").agg(F.min("text").alias("text")))
        assert rows(spark.read.parquet(chunks).drop("batch")) == rows(want)
        assert sorted(r.doc_id for r in ingest.manifest(spark, manifest).collect()) == list(range(30))
    plan = ingest.manifest(spark, manifest).filter("bucket in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    ingest.ingest_batch(docs.limit(0), manifest, chunks, 2)


def test_session_states_follow_their_events_and_expire(spark, tmp_path):
    batch = view(spark, SF, "ses")
    live = stream(spark, batch, tmp_path / "e")
    seen = drained(sessions.session_states(live, ttl=10**8, late="60 days"), "states", "update")
    last = seen.groupBy("session_id").agg(F.max_by(F.struct("user_sub", "app_name", "login_at", "logout_at"), "last_seen").alias("s"), F.max("last_seen").alias("last_seen"))
    got = last.select("session_id", "s.*", F.col("last_seen"))
    want = latest_sessions(batch)
    both = got.join(want.select("session_id", *[F.col(c).cast("timestamp").alias(f"w_{c}") for c in ("login_at", "last_seen")]), "session_id")
    assert got.count() == want.count() == both.filter("login_at = w_login_at and last_seen = w_last_seen").count()
    assert not seen.filter("expired").count()


def test_a_silent_session_expires_and_may_begin_anew(spark, tmp_path):
    rows_ = [(1, "a", "login", 0), (2, "a", "heartbeat", 30), (3, "b", "heartbeat", 5000), (4, "a", "heartbeat", 10_000), (5, "b", "logout", 10_001)]
    out = tmp_path / "in"
    for k, (n, session, kind, at) in enumerate(rows_):  # a file and so a batch for each event
        df = spark.createDataFrame([(n, session, "u", "app", kind, datetime(2024, 1, 1) + timedelta(seconds=at))], ingest.EVENTS)
        df.coalesce(1).write.mode("append").parquet(str(out))
    live = spark.readStream.schema(ingest.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(out))
    found = drained(sessions.session_states(live, ttl=120, late="0 seconds"), "expiry", "update").collect()
    times = lambda r: (r.last_seen - datetime(2024, 1, 1)).total_seconds()
    gone = sorted((r.session_id, times(r)) for r in found if r.expired)
    assert ("a", 30.0) in gone and ("b", 5000.0) in gone
    anew = [r for r in found if r.session_id == "a" and times(r) == 10_000]
    assert anew and all((r.login_at - datetime(2024, 1, 1)).total_seconds() == 10_000 for r in anew)


def test_a_fold_goes_on_from_batch_to_batch(spark):
    """Sessions longer than an Arrow batch: what a plain fold keeps, without a group of pandas for each session."""
    key, rnd, start = "spark.sql.execution.arrow.maxRecordsPerBatch", random.Random(5), datetime(2024, 5, 1)
    made = [(n, f"s{n % 3}", "u", "a", "heartbeat", start + timedelta(seconds=rnd.randrange(900))) for n in range(900)]
    want, last = set(), {}
    for n, session, *_, ts in sorted(made, key=lambda r: (r[5], r[0])):
        if session not in last or (ts - last[session]).total_seconds() >= 30:
            want.add(n)
            last[session] = ts
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        out = folded_heartbeats(spark.createDataFrame(made, ingest.EVENTS))
        assert {r.event_id for r in out.collect()} == want
    finally:
        spark.conf.set(key, before)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_an_ingest_works_texts_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.udf(counted)(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    ingest.ingest_batch(docs, str(tmp_path / "m"), str(tmp_path / "c"), 0)
    assert seen.value == 20 and ingest.manifest(spark, str(tmp_path / "m")).count() == 20
