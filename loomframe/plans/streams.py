"""Streaming operators over the test tables: in their batch form, or as a stream of the table's rows that ends with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import runs as R
from loomframe.plans.sessions import _FOLDED
from loomframe.plans.views import query, table, view
from loomframe.sources.shared import new_path
from loomframe.streaming import ingest, runs, sessions


def _live(spark, sf_dir, hours: int):
    """The session events as a stream of files in order of time, and behind them one event so many hours later that closes them."""
    path = new_path(spark, "events")
    own = view(spark, sf_dir, "ses")
    end = own.agg((F.max("ts") + F.expr(f"INTERVAL {hours} HOUR")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), *[F.lit("end").alias(c) for c in ("session_id", "user_sub", "app_name")], F.lit("heartbeat").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    rows = own.select("event_id", "session_id", "user_sub", "app_name", "kind", "ts").repartitionByRange(4, "ts")
    for name, part in (("0", rows), ("1", end)):
        part.write.parquet(f"{path}/in/{name}")
    return path, spark.readStream.schema(ingest.EVENTS).parquet(f"{path}/in/*")


def _drained(live, path, schema):
    """All rows of an appending stream."""
    live.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live.sparkSession.read.schema(schema).parquet(f"{path}/out")


@query("SELECT date_trunc('minute', ts) AS start, app_name, count(DISTINCT user_sub) AS users, count(DISTINCT session_id) AS sessions FROM ses GROUP BY ALL", "ses")
def s1_minute_activity(spark, sf_dir):
    """From a stream of the events."""
    path, live = _live(spark, sf_dir, 2)
    out = _drained(sessions.minute_activity(live), path, "start timestamp, app_name string, users long, sessions long")
    return out.filter("app_name <> 'end'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_FOLDED, "ses")
def s6c_thinned_stream(spark, sf_dir):
    """From a stream of the events."""
    path, live = _live(spark, sf_dir, 2)
    out = _drained(sessions.thinned_stream(live, 600), path, sessions.THINNED)
    ts = F.col("ts").cast("timestamp_ntz").alias("ts")
    return out.filter("session_id <> 'end'").select("event_id", "session_id", "user_sub", "app_name", F.lit("heartbeat").alias("kind"), ts)


@query("""SELECT run_id, app_name, started_at, CASE WHEN status <> 'running' AND elapsed_ms <= 4000 THEN started_at + elapsed_ms * INTERVAL 1 MILLISECOND END AS finished_at,
CASE WHEN elapsed_ms <= 4000 THEN status ELSE 'running' END AS status FROM run""", "run")
def s4_joined_runs(spark, sf_dir):
    own = view(spark, sf_dir, "run")
    out = runs.joined_runs(R.start_events(own), R.finish_events(own), longest="4 seconds")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("run_id", "app_name", ntz("started_at"), ntz("finished_at"), "status")


@query("SELECT doc_id, sha256(text) AS sha256, 1 AS times, regexp_matches(text, '[^\\s　 ]') AS has_chunks FROM documents")
def s5_incremental_ingest(spark, sf_dir):
    """Two thirds of the documents, then all of them, twice: each is taken in once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest, chunks = new_path(spark, "manifest"), new_path(spark, "chunks")
    ingest.ingest_batch(docs.filter("doc_id % 3 > 0"), manifest, chunks, 0)
    for _ in range(2):  # a batch that comes again replaces itself
        ingest.ingest_batch(docs, manifest, chunks, 1)
    own = ingest.manifest(spark, manifest).groupBy("doc_id", "sha256").agg(F.count("*").cast("int").alias("times"))
    cut = spark.read.parquet(chunks).groupBy("doc_id").agg((F.count("*") == F.countDistinct("chunk_index")).alias("once"))
    return own.join(cut, "doc_id", "left").select("doc_id", "sha256", "times", F.coalesce("once", F.lit(False)).alias("has_chunks"))


@query("""SELECT session_id, arg_max(user_sub, event_id) AS user_sub, arg_max(app_name, event_id) AS app_name, coalesce(max(ts) FILTER (WHERE kind = 'login'), min(ts)) AS login_at, max(ts) AS last_seen,
CASE WHEN arg_max(kind, event_id) = 'logout' THEN max(ts) END AS logout_at FROM ses GROUP BY session_id""", "ses")
def s3_session_states(spark, sf_dir):
    """The events as a stream of one batch with a time to live that none outlasts: the last state of each session."""
    path, out = new_path(spark, "events"), new_path(spark, "states")
    view(spark, sf_dir, "ses").write.parquet(f"{path}/in")
    live = spark.readStream.schema(ingest.EVENTS).parquet(f"{path}/in")
    states = sessions.session_states(live, ttl=10**8)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    own = spark.read.schema(sessions.SEEN + ", batch int").parquet(out)
    last = own.groupBy("session_id").agg(F.max_by(F.struct("user_sub", "app_name", "login_at", "last_seen", "logout_at"), "batch").alias("s"))
    ntz = lambda c: F.col(f"s.{c}").cast("timestamp_ntz").alias(c)
    return last.select("session_id", "s.user_sub", "s.app_name", ntz("login_at"), ntz("last_seen"), ntz("logout_at"))
