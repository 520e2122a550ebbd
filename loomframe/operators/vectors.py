"""Vector tables: exact cosine search over shards, audits, incremental maintenance and compaction.

A vector table has shard_id, vector_index and embedding; its metadata has a row for each live vector, its manifest one for
each document taken in. A vector without metadata is an orphan and can't be found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from loomframe.sources.shared import new_path, stored

#: Vectors of a block, and the fewest where there are fewer blocks than cores.
BLOCK_ROWS, FEW_ROWS = 16_384, 1_024
#: Rows of a group that one task packs.
PACK_ROWS = 65_536
OUTLIER = 8_192


def live(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """Vectors that have metadata, with it."""
    return vectors.join(meta, ["shard_id", "vector_index"])


def block_hits(k: int) -> Callable:
    """The k best rows of each block for each of its queries, from (block, asks, shard_id, vector_index, query_id, embedding) in order of
    block and asks: a block's rows are held, its queries pass. A column least, where there is one, leaves out what scores below it."""

    def unit(embeddings: pd.Series, name: str | None = None) -> np.ndarray:
        v = np.stack(embeddings.to_list())
        norm = np.linalg.norm(v, axis=1)
        if name and (norm == 0).any():
            raise ValueError(f"{name} has norm zero")
        return v / np.where(norm > 0, norm, 1)[:, None]

    def best(x: pd.DataFrame, v: np.ndarray, q: pd.DataFrame) -> pd.DataFrame:
        at_query, at_row, scores = [], [], []
        w = unit(q["embedding"], "a query")
        for at in range(0, len(q), 128):
            score = np.round(w[at : at + 128] @ v.T, 6) + 0.0
            least = np.partition(score, -k, axis=1)[:, -k] if len(x) > k else np.full(len(score), -np.inf)
            if "least" in q:
                least = np.maximum(least, q["least"].to_numpy()[at : at + 128])
            for n, (own_score, bound) in enumerate(zip(score, least)):
                found = np.nonzero(own_score >= bound)[0]
                found = found[np.argsort(-own_score[found], kind="stable")[:k]]
                at_query.append(np.full(len(found), at + n))
                at_row.append(found)
                scores.append(own_score[found])
        i, j = np.concatenate(at_query), np.concatenate(at_row)
        shard = pd.Series(x["shard_id"].to_numpy(dtype=object)[j], dtype=object)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[i].astype("int64"), "shard_id": shard, "vector_index": x["vector_index"].to_numpy()[j].astype("int64"), "score": np.concatenate(scores)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, block = None, [], None
        for frame in frames:
            for (number, asking), part in frame.groupby(["block", "asks"], sort=False):
                if number != now:
                    now, held, block = number, [], None
                if not asking:
                    held.append(part[["shard_id", "vector_index", "embedding"]])
                elif held:
                    if block is None:
                        x = pd.concat(held, ignore_index=True)
                        block = x, unit(x["embedding"])
                    yield best(*block, part)

    return run


def search(vectors: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int = 5, shards: list[str] | None = None) -> DataFrame:
    """(query_id, rank, shard_id, vector_index, score): the k nearest by cosine, rounded to six digits, ties to the smaller shard
    and index, for every row of queries (query_id, embedding), however many. A vector of norm zero scores 0; a query of norm
    zero or of another length than the vectors is an error, which for a DataFrame of queries is raised by its task.

    Vectors are dealt to blocks; a task holds one block and lets all queries pass as a stream, so only queries are copied, once for
    each block, and the k best of each block are ranked at the end. Named shards are filtered before the scan is read.
    """
    if isinstance(queries, list):
        if any(not any(v) for _, v in queries):
            raise ValueError("a query has norm zero")
        queries = vectors.sparkSession.createDataFrame(queries, "query_id long, embedding array<double>")
    own = vectors.filter(F.col("shard_id").isin(*shards)) if shards is not None else vectors
    own = own.select("shard_id", F.col("vector_index").cast("long").alias("vector_index"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, cores = own.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / BLOCK_ROWS), min(cores, n // FEW_ROWS))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    deal = F.pmod(F.xxhash64("shard_id", "vector_index"), F.lit(blocks)).cast("int")
    rows = own.select(deal.alias("block"), F.lit(False).alias("asks"), "shard_id", "vector_index", none("long", "query_id"), "embedding")
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), none("string", "shard_id"), none("long", "vector_index"), "query_id", "embedding")

    met = rows.unionByName(asks).repartition(blocks, "block").sortWithinPartitions("block", "asks", "shard_id", "vector_index")
    found = met.mapInPandas(block_hits(k), "query_id long, shard_id string, vector_index long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "shard_id", "vector_index")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "shard_id", "vector_index", "score")


def unprocessed(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    return sources.join(manifest, ["shard_id", "doc_id"], "left_anti")


def with_ingested(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    known = manifest.select("shard_id", "doc_id").distinct().withColumn("known", F.lit(True))
    return docs.join(known, ["shard_id", "doc_id"], "left").withColumn("ingested", F.coalesce("known", F.lit(False))).drop("known")


def doc_summary(meta: DataFrame) -> DataFrame:
    return meta.groupBy("shard_id", "doc_id").agg(F.count("*").alias("chunks"), F.min("vector_index").alias("first"), F.max("vector_index").alias("last"))


def reconciled(meta: DataFrame, manifest: DataFrame) -> DataFrame:
    """(shard_id, doc_id, chunks, note): both, meta only or processed only."""
    a, b = doc_summary(meta), manifest.select("shard_id", "doc_id").distinct().withColumn("known", F.lit(True))
    out = a.join(b, ["shard_id", "doc_id"], "full_outer")
    note = F.when(F.col("known").isNull(), "meta only").when(F.col("chunks").isNull(), "processed only").otherwise("both")
    return out.select("shard_id", "doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), note.alias("note"))


def orphans(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    return vectors.select("shard_id", "vector_index").join(meta, ["shard_id", "vector_index"], "left_anti")


def duplicates(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).count().filter("count > 1")


def misaligned(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """(shard_id, vector_index, issue): negative, out_of_range (for its shard's vectors) and duplicate indices of metadata."""
    sizes = vectors.groupBy("shard_id").agg(F.count("*").alias("n"))
    own = meta.join(sizes, "shard_id", "left")
    issue = F.when(F.col("vector_index") < 0, "negative").when(F.col("vector_index") >= F.coalesce("n", F.lit(0)), "out_of_range")
    bad = own.select("shard_id", "vector_index", issue.alias("issue")).filter("issue is not null")
    return bad.unionByName(duplicates(meta, "shard_id", "vector_index").select("shard_id", "vector_index", F.lit("duplicate").alias("issue")))


def audit(vectors: DataFrame, meta: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row for each shard: counts, orphans, documents on one side only, misaligned rows, and health: error if any row is
    misaligned, warn if anything is left over, else ok. One grouping by index, one by document, one by shard."""
    one, none = F.lit(1), F.lit(0)
    rows = vectors.select("shard_id", "vector_index", one.alias("v"), none.alias("m")).unionAll(meta.select("shard_id", "vector_index", none.alias("v"), one.alias("m")))
    at = rows.groupBy("shard_id", "vector_index").agg(F.sum("v").alias("v"), F.sum("m").alias("m"))
    sizes = vectors.groupBy("shard_id").agg(F.count("*").alias("size"))
    at = at.join(sizes, "shard_id", "left")
    outside = (F.col("vector_index") < 0) | (F.col("vector_index") >= F.coalesce("size", F.lit(0)))
    bad = F.when(outside, F.col("m")).otherwise(0) + F.when(F.col("m") > 1, 1).otherwise(0)
    at = at.select("shard_id", F.col("v").alias("vectors"), F.col("m").alias("meta"), F.when(F.col("m") == 0, F.col("v")).otherwise(0).alias("orphans"), bad.alias("misaligned"), *[none.alias(c) for c in ("processed", "meta_only", "processed_only")])
    docs = meta.select("shard_id", "doc_id", one.alias("m"), none.alias("p")).unionAll(manifest.select("shard_id", "doc_id", none.alias("m"), one.alias("p")))
    docs = docs.groupBy("shard_id", "doc_id").agg(F.max("m").alias("m"), F.sum("p").alias("p"))
    lone = lambda here, there: (F.col(here) * (F.col(there) == 0).cast("int"))
    docs = docs.select("shard_id", *[none.alias(c) for c in ("vectors", "meta", "orphans", "misaligned")], F.col("p").alias("processed"), lone("m", "p").alias("meta_only"), F.when((F.col("m") == 0) & (F.col("p") > 0), 1).otherwise(0).alias("processed_only"))
    names = ("vectors", "meta", "processed", "orphans", "meta_only", "processed_only", "misaligned")
    out = at.unionByName(docs).groupBy("shard_id").agg(*[F.sum(c).cast("long").alias(c) for c in names])
    left = F.col("orphans") + F.col("meta_only") + F.col("processed_only")
    return out.withColumn("health", F.when(F.col("misaligned") > 0, "error").when(left > 0, "warn").otherwise("ok"))


#: Documents of a shard that an audit lists with their chunks.
TOP_DOCS = 30


def audit_details(vectors: DataFrame, meta: DataFrame, manifest: DataFrame, top: int = TOP_DOCS) -> DataFrame:
    """(shard_id, issue, doc_id, vector_index, n): what stands behind an audit's counts, for all shards in one table.

    negative and out_of_range: a row of metadata, n 1. duplicate_index: an index with n rows of metadata. orphan: a vector without
    any. meta_only and processed_only: a document of one side only, with its n rows there. duplicate_processed: a document with n
    manifest rows. top_doc: the top documents of a shard by chunks, n chunks, ties to the smaller first index; vector_index is
    their first one. Columns that an issue does not have are null; null documents and indices are a document and an index of their own.

    One grouping by index and one by document; the rows found are exploded where they lie, and only the greatest documents of each
    task meet in a shard's window.
    """
    one, none = F.lit(1), F.lit(0)
    found = lambda name, when, n: F.when(when, F.struct(F.lit(name).alias("issue"), n.cast("long").alias("n")))
    each = lambda df, *issues: df.withColumn("i", F.explode(F.array_compact(F.array(*issues))))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    index = F.col("vector_index").cast("long").alias("vector_index")
    sizes = vectors.groupBy("shard_id").agg(F.count("*").alias("size"))

    outside = meta.select("shard_id", "doc_id", index).join(sizes, "shard_id", "left")
    outside = each(outside, found("negative", F.col("vector_index") < 0, one), found("out_of_range", F.col("vector_index") >= F.coalesce("size", none), one))

    rows = vectors.select("shard_id", index, one.alias("v"), none.alias("m")).unionAll(meta.select("shard_id", index, none.alias("v"), one.alias("m")))
    at = rows.groupBy("shard_id", "vector_index").agg(F.sum("v").alias("v"), F.sum("m").alias("m"))
    at = each(at, found("duplicate_index", F.col("m") > 1, F.col("m")), found("orphan", F.col("m") == 0, F.col("v")))

    docs = meta.select("shard_id", "doc_id", index, one.alias("m"), none.alias("p")).unionAll(manifest.select("shard_id", "doc_id", number.alias("vector_index"), none.alias("m"), one.alias("p")))
    docs = docs.groupBy("shard_id", "doc_id").agg(F.min("vector_index").alias("first"), F.sum("m").alias("m"), F.sum("p").alias("p"))
    lone = each(docs, found("meta_only", F.col("p") == 0, F.col("m")), found("processed_only", F.col("m") == 0, F.col("p")), found("duplicate_processed", F.col("p") > 1, F.col("p")))
    order = W.partitionBy("shard_id").orderBy(F.desc("m"), "first", "doc_id")
    best = docs.filter("m > 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)

    row = lambda df, doc, at, issue, n: df.select("shard_id", issue.alias("issue"), doc.alias("doc_id"), at.alias("vector_index"), n.cast("long").alias("n"))
    kind, count = F.col("i.issue"), F.col("i.n")
    parts = [row(outside, F.col("doc_id"), F.col("vector_index"), kind, count), row(at, text, F.col("vector_index"), kind, count), row(lone, F.col("doc_id"), number, kind, count), row(best, F.col("doc_id"), F.col("first"), F.lit("top_doc"), F.col("m"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def rebuild_need(summary: DataFrame) -> DataFrame:
    """An audit's shards with need: error if misaligned, info if every vector has metadata, else warning."""
    need = F.when(F.col("misaligned") > 0, "error").when(F.col("vectors") == F.col("meta"), "info").otherwise("warning")
    return summary.select("shard_id", (F.col("vectors") - F.col("meta")).alias("diff"), need.alias("need"))


def store_summary(vectors: DataFrame, meta: DataFrame, manifest: DataFrame) -> DataFrame:
    v = vectors.groupBy("shard_id").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dim"))
    m = meta.groupBy("shard_id").agg(F.count("*").alias("meta"))
    p = manifest.groupBy("shard_id").agg(F.count("*").alias("processed"))
    return v.join(m, "shard_id", "left").join(p, "shard_id", "left").na.fill(0)


def dense_index(rows: DataFrame, base: DataFrame) -> DataFrame:
    """rows (shard_id, doc_id, chunk_index) with vector_index: dense per shard in order of doc_id and chunk, from the shard's base.

    Documents with their counts are dealt to ranges of (shard_id, doc_id) and stored; ranges are summed up by their few totals,
    documents within their range, and a row's place within its document comes from a window of that document. No window holds a
    shard.
    """
    per_doc = rows.groupBy("shard_id", "doc_id").agg(F.count("*").alias("n"))
    dealt = stored(per_doc.repartitionByRange("shard_id", "doc_id").withColumn("part", F.spark_partition_id()), "numbered")
    parts = dealt.groupBy("shard_id", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("shard_id", "part", F.coalesce(F.sum("n").over(W.partitionBy("shard_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("n").over(W.partitionBy("shard_id", "part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, ["shard_id", "part"]).select("shard_id", "doc_id", (F.col("before") + F.col("within")).alias("start"))
    place = F.row_number().over(W.partitionBy("shard_id", "doc_id").orderBy("chunk_index")) - 1
    out = rows.withColumn("place", place).join(starts, ["shard_id", "doc_id"]).join(base, "shard_id", "left")
    return out.withColumn("vector_index", F.coalesce("base", F.lit(0)) + F.col("start") + F.col("place")).drop("place", "start", "base")


def compacted(vectors: DataFrame, meta: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(shard_id, doc_id, old_index, vector_index): live rows renumbered from 0 in each shard; orphans go. Refused if the metadata
    names a document that sources, where given, do not have."""
    if sources is not None and not meta.join(sources, ["shard_id", "doc_id"], "left_anti").isEmpty():
        raise ValueError("metadata names documents without a source; resolve or deregister them first")
    rows = live(vectors.select("shard_id", "vector_index"), meta).select("shard_id", "doc_id", F.col("vector_index").alias("chunk_index"))
    base = rows.select("shard_id").distinct().withColumn("base", F.lit(0))
    return dense_index(rows, base).withColumnRenamed("chunk_index", "old_index")


def without_docs(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["shard_id", "doc_id"], "left_anti")


def in_scope(meta: DataFrame, files: list[str], since: str | None = None, file: str = "file", created: str = "created_at") -> DataFrame:
    """Metadata of the named files (equal, or ending so; all without names), not made before since as text; rows without a time stay."""
    if files:
        named = F.lit(False)
        for name in files:
            named = named | (F.col(file) == name) | F.col(file).endswith(name)
        meta = meta.filter(named)
    return meta.filter(F.col(created).isNull() | (F.col(created) >= since)) if since else meta


def embedding_costs(meta: DataFrame, usd_per_million: float, rate: float = 150.0) -> DataFrame:
    """One row: tokens of chunks but negative ones and outliers, which are counted, with their mean, 95th percentile (nearest
    rank), greatest and cost."""
    t = F.col("chunk_len_tokens")
    good = F.when((t >= 0) & (t <= OUTLIER), t)
    out = meta.agg(F.sum(good).alias("total"), F.count(good).alias("n"), F.round(F.avg(good), 6).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN chunk_len_tokens BETWEEN 0 AND {OUTLIER} THEN chunk_len_tokens END)").cast("long").alias("p95"), F.max(good).alias("most"), F.count_if(t > OUTLIER).alias("outliers"))
    usd = F.col("total") / 1e6 * usd_per_million
    return out.withColumn("usd", F.round(usd, 9)).withColumn("jpy", F.round(usd * rate, 6))


def key_values(summary: DataFrame, *by: str) -> DataFrame:
    """A summary as (by.., key, value) rows."""
    values = [c for c in summary.columns if c not in by]
    return summary.select(*by, *[F.col(c).cast("string") for c in values]).unpivot(list(by), values, "key", "value")


def _request_ends(tokens: np.ndarray, most_tokens: int, most_items: int) -> np.ndarray:
    """For each row, the row after the last one of a request that begins there (by tokens at hand)."""
    n = len(tokens)
    total = np.concatenate([[0], np.cumsum(tokens)])
    ends = np.minimum(np.arange(n) + most_items, n)
    for k in range(most_items - 1, 0, -1):  # the first row above the bound decides
        i = np.arange(max(0, n - k))
        over = total[i + k + 1] - total[i] > most_tokens
        ends[i[over]] = i[over] + k
    return ends


def packed(rows: DataFrame, tokens: str, order: str, most_tokens: int = 120_000, most_items: int = 48, *by: str) -> DataFrame:
    """rows of each group with batch_no: requests filled in order until the next row would pass either bound; a row above the
    token bound stands alone, and null tokens count as none.

    Rows are sorted as a whole and cut into ranges of PACK_ROWS of a group, each with the first rows of the next. A range is
    folded in its own task for every row at which its first request may begin (most_items at most); the small tables from first
    row to the next range's first row are then chained, and each range is numbered from where the chain enters it.
    """
    spark, size = rows.sparkSession, max(PACK_ROWS, most_items)
    path = new_path(spark, "packed")
    own = rows.select(*by, F.col(order), F.col(tokens).cast("long").alias(tokens)).orderBy(*by, order, tokens)
    own.withColumn("pos", F.monotonically_increasing_id()).write.parquet(path)
    own = spark.read.parquet(path).withColumn("piece", F.floor(F.col("pos") / F.lit(size)).cast("long"))
    # places of pieces in their group: one small row for each piece
    group = W.partitionBy(*by)
    pieces = own.groupBy(*by, "piece").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(group.orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("piece").alias("piece_of"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.min("first").over(group).alias("gid"))
    same = own["piece"] == pieces["piece_of"]
    for c in by:
        same = same & own[c].eqNullSafe(pieces[f"{c}_of"])
    ranked = own.join(pieces, same).select("gid", (F.col("before") + F.col("pos") - F.col("first")).alias("rank"), "pos", F.coalesce(tokens, F.lit(0)).alias("w"))
    chunk = F.floor(F.col("rank") / F.lit(size)).cast("long")
    met = F.when((F.col("rank") % size < most_items) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    ranges = ranked.withColumn("chunk", F.explode(met))

    def table(key, frame: pd.DataFrame) -> pd.DataFrame:
        ends = _request_ends(frame.sort_values("rank")["w"].to_numpy(), most_tokens, most_items)
        n = len(ends)
        last, count = np.arange(n + 1), np.zeros(n + 1, np.int64)
        for i in range(min(n, size) - 1, -1, -1):
            last[i], count[i] = last[ends[i]], count[ends[i]] + 1
        m = min(most_items, n)
        return pd.DataFrame({"gid": [key[0]], "chunk": [key[1]], "enters": [(last[:m] - size).tolist()], "requests": [count[:m].tolist()]})

    def chain(key, frame: pd.DataFrame) -> pd.DataFrame:
        at, base, out = 0, 0, []
        for c, enters, requests in frame.sort_values("chunk")[["chunk", "enters", "requests"]].itertuples(index=False):
            out.append((key[0], c, at, base))
            if c + 1 < len(frame):
                at, base = int(enters[at]), base + int(requests[at])
        return pd.DataFrame(out, columns=["gid", "chunk", "at", "base"])

    def numbered(key, frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        ends = _request_ends(frame["w"].to_numpy(), most_tokens, most_items)
        n, at = min(len(ends), size), int(entry["at"].iloc[0])
        begins = np.zeros(n, np.int64)
        while at < n:
            begins[at] = 1
            at = ends[at]
        return pd.DataFrame({"at_pos": frame["pos"].to_numpy()[:n], "batch_no": int(entry["base"].iloc[0]) - 1 + np.cumsum(begins)})

    tables = ranges.groupBy("gid", "chunk").applyInPandas(table, "gid long, chunk long, enters array<long>, requests array<long>")
    entries = tables.groupBy("gid").applyInPandas(chain, "gid long, chunk long, at long, base long")
    numbers = ranges.groupBy("gid", "chunk").cogroup(entries.groupBy("gid", "chunk")).applyInPandas(numbered, "at_pos long, batch_no int")
    return own.join(numbers, own["pos"] == numbers["at_pos"]).select(*by, order, tokens, "batch_no")
