"""Incremental ingest, batch by batch, and the schema of session events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.operators.chunks import chunk_documents
from loomframe.sources.shared import stored


#: Buckets of a manifest by document.
BUCKETS = 64
MANIFEST = "doc_id long, sha256 string, batch long, bucket int"


def _bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, sha256, batch, bucket) of all batches at path; none where there is no manifest yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(MANIFEST).parquet(path) if there else spark.createDataFrame([], MANIFEST)


def ingest_batch(docs: DataFrame, manifest_path: str, chunks_path: str, batch: int, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Chunks the documents (doc_id, text) that no other batch has taken in, once each (of several texts of one id the least), and
    writes chunks and manifest rows under the batch's number.

    A batch that failed anywhere and comes again replaces what it had written, and one that had been finished writes the same again:
    each chunk is there once, whoever reads. Of the manifest only the buckets of the batch's documents are read.
    """
    spark = docs.sparkSession
    named = docs.filter("doc_id IS NOT NULL")
    buckets = [r.bucket for r in named.select(_bucket().alias("bucket")).distinct().collect()]  # BUCKETS rows at most
    known = manifest(spark, manifest_path).filter(F.col("bucket").isin(buckets) & (F.col("batch") != batch)).select("doc_id")
    # texts are shuffled once, by document for both, and read from a table by what follows
    fresh = named.select("doc_id", "text").join(known, "doc_id", "left_anti").groupBy("doc_id").agg(F.min("text").alias("text"))
    fresh = stored(fresh.withColumn("bucket", _bucket()), "fresh")
    chunks = chunk_documents(fresh.select("doc_id", "text"))
    (embed(chunks) if embed else chunks).write.mode("overwrite").parquet(f"{chunks_path}/batch={batch}")
    rows = fresh.select("doc_id", F.sha2("text", 256).alias("sha256"), "bucket")
    rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{manifest_path}/batch={batch}")


def ingest_stream(docs: DataFrame, manifest_path: str, chunks_path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None):
    """A started query that ingests each batch of a stream of documents under the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, manifest_path, chunks_path, number, embed)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENTS = "event_id long, session_id string, user_sub string, app_name string, kind string, ts timestamp_ntz"
