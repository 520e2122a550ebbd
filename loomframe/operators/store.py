"""The vector store as three tables: snapshots, appends with checks, ingest, rebuild and removal of documents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.functions import text as T
from loomframe.operators import chunks as K, vectors as V
from loomframe.sources.shared import small_batches, stored
from loomframe.sources.versions import Versions

PARTS = ("vectors", "meta", "manifest")
KEYS = ["collection_id", "shard_id"]


def versions(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, path, PARTS, KEYS)


def write_snapshot(tables: dict[str, DataFrame], path: str, shards_: DataFrame | None = None) -> int:
    """A new version of the shards shards_ (collection_id, shard_id; those of the tables' rows, if not named), also of such as are left
    without rows, and of no others. Its number; a failure in between leaves the version before as it was."""
    return versions(tables["vectors"].sparkSession, path).write(tables, shards_)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, **keys: str) -> dict[str, DataFrame]:
    """The tables as of a version (the newest, if not named), of one collection or shard if named (only their folders are read)."""
    return versions(spark, path).read(version, **keys)


def backup(spark: SparkSession, path: str, stamp: str, **keys: str) -> str:
    """Copies shards to a store of their own, _backups/ts=<stamp>, before they are rewritten."""
    to = f"{path}/_backups/ts={stamp}"
    write_snapshot(read_snapshot(spark, path, **keys), to)
    return to


def empty_store(spark: SparkSession, shards_: list[str], dim: int) -> dict[str, DataFrame]:
    """A store without rows whose shards have a declared dimension, which the first rows appended are held to."""
    out = {"vectors": "shard_id string, vector_index long, embedding array<float>", "meta": "shard_id string, vector_index long, doc_id string, chunk_len_tokens int", "manifest": "shard_id string, doc_id string"}
    empty = lambda schema: spark.range(0).limit(0).selectExpr(*[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")])  # noqa: E731 - Spark knows that it has no rows
    return {part: empty(schema) for part, schema in out.items()} | {"dims": spark.range(1).select(F.explode(F.lit(shards_).cast("array<string>")).alias("shard_id"), F.lit(dim).alias("dim"))}


def shards(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys in order; names that begin with _ are hidden."""
    return rows.select(*keys).distinct().filter(~F.col(keys[-1]).startswith("_")).orderBy(*keys)


def appended(vectors: DataFrame, more: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """Union of vectors; a row of another dimension than its shard's (as declared in dims, else that of its vectors) is an error."""
    sizes = vectors.groupBy("shard_id").agg(F.max(F.size("embedding")).alias("dim")) if dims is None else dims
    wrong = F.col("dim").isNotNull() & (F.size("embedding") != F.col("dim"))
    checked = more.join(F.broadcast(sizes), "shard_id", "left").withColumn("embedding", F.when(wrong, F.raise_error(F.lit("another dimension")).cast("array<float>")).otherwise(F.col("embedding")))
    return vectors.unionByName(checked.select(*vectors.columns))


def first_by_id(sources: DataFrame) -> DataFrame:
    """Sources with their ids trimmed: blank ones go, of equal ids the first by pos stays."""
    own = sources.withColumn("doc_id", F.trim("doc_id")).filter("doc_id <> ''")
    return own.join(own.groupBy("doc_id").agg(F.min("pos").alias("pos")), ["doc_id", "pos"], "left_semi")


def ingest(sources: DataFrame, manifest: DataFrame, base: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """New metadata (with vector_index and embed's columns) and a result (shard_id, doc_id, status) for all sources.

    sources (shard_id, doc_id, text), base (shard_id, base): sources of the manifest are skipped, those without text an error.
    embed is the caller's: it takes the chunks and adds their vectors (it may leave out columns that nobody needs). Texts are cut once:
    chunks with vectors are stored and numbered afterwards, and statuses come from the sources' keys without their texts.
    """
    blank = T.is_blank(F.col("text"))
    known = V.with_ingested(sources.select("shard_id", "doc_id", blank.alias("blank")), manifest)
    status = F.when(F.col("ingested"), "skip").when(F.col("blank"), "error").otherwise("ok")
    # texts meet the manifest in one shuffle at every size: a broadcast of small ones would end where the store grows
    fresh = V.without_docs(sources.filter(~blank), manifest.hint("merge"))
    cut = K.chunk_documents(fresh.select(F.struct("shard_id", "doc_id").alias("doc_id"), "text"))
    rows = cut.select("doc_id.shard_id", "doc_id.doc_id", "chunk_index", "text", "chunk_len_tokens", "span_start", "span_end")
    return V.dense_index(stored(embed(rows), "embedded"), base), known.select("shard_id", "doc_id", status.alias("status"))


def embedded(rows: DataFrame, fn: Callable[[pd.Series], pd.Series], text_col: str = "text", out: str = "embedding") -> DataFrame:
    """rows that have more than blanks in their text, with the caller's vectors of it (a function of Arrow batches)."""
    small_batches(rows.sparkSession)
    own = rows.filter(~T.is_blank(F.col(text_col)))
    return own.withColumn(out, F.pandas_udf(fn, "array<float>")(text_col))


def grown(store: dict[str, DataFrame], sources: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The store with what is new in sources, and each source's status: chunks are numbered after each shard's vectors and stored
    without their texts; vectors, metadata and manifest get their rows from them."""
    base = store["vectors"].groupBy("shard_id").agg(F.count("*").alias("base"))
    needed = lambda chunks: embed(chunks).select("shard_id", "doc_id", "chunk_index", "chunk_len_tokens", "embedding")
    rows, result = ingest(sources, store["manifest"], base, needed)
    rows, result = stored(rows, "ingested"), stored(result, "results")
    out = {
        "vectors": appended(store["vectors"], rows.select("shard_id", "vector_index", "embedding"), store.get("dims")),
        "meta": store["meta"].unionByName(rows.select("shard_id", "vector_index", "doc_id", "chunk_len_tokens"), allowMissingColumns=True),
        "manifest": store["manifest"].unionByName(result.filter("status = 'ok'").select("shard_id", "doc_id"), allowMissingColumns=True),
    }
    return {**store, **out}, result


def rebuilt(store: dict[str, DataFrame], sources: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The store with the sources' documents taken in anew: their metadata and manifest rows go, their old vectors stay as orphans."""
    keys = sources.select("shard_id", "doc_id").distinct()
    less = {**store, "meta": V.without_docs(store["meta"], keys), "manifest": V.without_docs(store["manifest"], keys)}
    return grown(less, sources, embed)


def totals(result: DataFrame) -> DataFrame:
    """One row: total, ok, skip, error (whatever else is an error)."""
    s = F.col("status")
    return result.agg(F.count("*").alias("total"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "skip").alias("skip"), F.count_if(~F.coalesce(s.isin("ok", "skip"), F.lit(False))).alias("error"))


def removal_plan(meta: DataFrame, manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: selected documents, those found in metadata and in the manifest, and the metadata rows that go."""
    own = gone.select("shard_id", "doc_id").distinct()
    hit = meta.join(own, ["shard_id", "doc_id"], "left_semi").agg(F.count("*").alias("rows"), F.countDistinct("shard_id", "doc_id").alias("in_meta"))
    known = manifest.join(own, ["shard_id", "doc_id"], "left_semi").agg(F.count("*").alias("in_manifest"))
    return own.agg(F.count("*").alias("selected")).crossJoin(hit).crossJoin(known)  # three single rows


def removed(vectors: DataFrame, meta: DataFrame, manifest: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata and manifest without the documents; the vectors stay as orphans. Misaligned metadata is refused."""
    if not V.misaligned(vectors, meta).isEmpty():
        raise ValueError("metadata is misaligned; rebuild first")
    return V.without_docs(meta, gone), V.without_docs(manifest, gone)


def deregistered(spark: SparkSession, path: str, gone: DataFrame, stamp: str, **keys: str) -> tuple[DataFrame, DataFrame]:
    """Takes documents out of the snapshot's shards that the keys name: refused if metadata is misaligned, after a backup, as a new
    version of those shards in which the vectors are left as orphans; a shard may be left without any document. (result, resets): one
    row with the plan and status (success, partial if a document was not there, failed if none was), and an event for each removed
    document that resets its status."""
    own = read_snapshot(spark, path, **keys)
    plan = stored(removal_plan(own["meta"], own["manifest"], gone), "plan")
    resets = own["meta"].select("shard_id", "doc_id").unionByName(own["manifest"].select("shard_id", "doc_id")).distinct()
    resets = stored(resets.join(gone, ["shard_id", "doc_id"], "left_semi").select("shard_id", "doc_id", F.lit("reset").alias("stage"), F.lit(stamp).alias("ts")), "resets")
    meta, manifest = removed(own["vectors"], own["meta"], own["manifest"], gone)  # refuses before anything is written
    backup(spark, path, stamp, **keys)
    groups = versions(spark, path).groups()
    for k, v in keys.items():
        groups = groups.filter(F.col(k) == v)
    write_snapshot({"vectors": own["vectors"], "meta": meta, "manifest": manifest}, path, groups)
    found = resets.agg(F.count("*").alias("removed"))
    status = F.when(F.col("removed") == 0, "failed").when(F.col("removed") < F.col("selected"), "partial").otherwise("success")
    return plan.crossJoin(found).withColumn("status", status), resets  # two single rows


def models(manifest: DataFrame, meta: DataFrame) -> DataFrame:
    """(shard_id, doc_id, model): the manifest's, else the first of the metadata's that is not blank."""
    m = lambda df, name: df.filter("trim(coalesce(embed_model, '')) <> ''").groupBy("shard_id", "doc_id").agg(F.min("embed_model").alias(name))
    out = m(manifest, "a").join(m(meta, "b"), ["shard_id", "doc_id"], "full_outer")
    return out.select("shard_id", "doc_id", F.coalesce("a", "b").alias("model"))


def same_processed(sources: DataFrame, manifest: DataFrame, *also: str) -> DataFrame:
    """sources with same: whether the manifest has the document with the same values of also (sha256, embed_model, kind)."""
    keys = ["shard_id", "doc_id", *also]
    known = manifest.select(*keys).distinct().withColumn("__known", F.lit(True))
    return sources.join(known, keys, "left").withColumn("same", F.coalesce("__known", F.lit(False))).drop("__known")
