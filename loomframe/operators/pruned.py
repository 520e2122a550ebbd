"""Exact cosine search that leaves out what can't be among the nearest.

Vectors are dealt to clusters about centres of a sample. A cluster's radius is the greatest angle between its centre and a member, so
no member is nearer to a query than the angle to the centre less the radius. A query first visits the clusters of the best bounds that
hold k rows; its k-th best score there shuts out every cluster whose bound is below it, and it then visits what is left, of which only rows from that score on leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loomframe.operators.vectors import BLOCK_ROWS, block_hits
from loomframe.sources.shared import stored

#: Clusters at most, rows that one is meant for, bytes of all centres, rows of the sample for each centre.
CLUSTERS, MEMBERS, CENTRE_BYTES, PER_CENTRE = 1_024, 512, 8 << 20, 16
SLOTS = 1 << 30
#: What rounding to six digits and the errors of sums may add to a bound.
SLACK = 6e-7
#: The cluster of vectors of norm zero: they score 0 for any query.
ZERO = -1
FOUND = "query_id long, shard_id string, vector_index long, score double"


def _unit(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def centres_of(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centres by k-means of directions."""
    rng = np.random.default_rng(5)
    centres = sample[np.sort(rng.choice(len(sample), min(clusters, len(sample)), replace=False))]
    for _ in range(6):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres = (sums / np.where(norm > 0, norm, 1)[:, None])[norm > 0]
    return centres


def _dealt(centres: np.ndarray, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norm = _unit(batch.column(2), d)
            near = x @ centres.T
            cluster = np.where(norm > 0, near.argmax(1), ZERO).astype(np.int64)
            cos = near.max(1, initial=-1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(cos)], ["shard_id", "vector_index", "embedding", "cluster", "cos"])

    return run


class Bounds:
    """For each cluster that has rows: the best score that a member can have."""

    def __init__(self, centres: np.ndarray, rows: dict[int, tuple[float, int]]):
        names = sorted(c for c in rows if c != ZERO)
        self.names = np.array([*names, *([ZERO] if ZERO in rows else [])], np.int64)
        self.centres = centres[names]
        self.radius = np.arccos(np.clip([rows[c][0] for c in names], -1, 1))
        self.sizes = np.array([rows[c][1] for c in self.names])

    def best(self, q: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip(q @ self.centres.T, -1, 1))
        out = np.cos(np.maximum(0, angle - self.radius))
        return np.append(out, 0.0) if len(self.names) > len(out) else out

    def visited(self, q: np.ndarray, k: int, least: float | None) -> np.ndarray:
        """Clusters of the first visit (least None), or those of the second: with a bound from least on, without the first."""
        bound = self.best(q)
        order = np.argsort(-bound, kind="stable")
        first = int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1
        if least is None:
            return self.names[order[:first]]
        rest = order[first:]
        return self.names[rest[bound[rest] + SLACK >= least]]


def _routes(bounds: Bounds, d: int, k: int, second: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, embedding, cluster, least) of (query_id, embedding, least)."""
        for batch in batches if len(bounds.names) else ():
            if any(n != d for n in batch.column(1).value_lengths().to_pylist()):
                raise ValueError("a query of another length than the vectors")
            q, norm = _unit(batch.column(1), d)
            if (norm == 0).any():
                raise ValueError("a query has norm zero")
            lists = [bounds.visited(x, k, least if second else None) for x, least in zip(q, batch.column(2).to_pylist())]
            rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            clusters = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            for at in range(0, len(rows), 4_096):
                some = pa.array(rows[at : at + 4_096])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(clusters[at : at + 4_096]), batch.column(2).take(some)], ["query_id", "embedding", "cluster", "least"])

    return run


def pruned_search(vectors: DataFrame, queries: DataFrame, k: int = 5, shards: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, visits): hits as operators.vectors.search returns them, and (query_id, clusters, visited) for each query that met any.

    Exact for any vectors; how much is left out depends on how they cluster. All vectors have one length; a query of norm zero or of
    another length is an error.
    """
    spark = vectors.sparkSession
    own = vectors.filter(F.col("shard_id").isin(*shards)) if shards is not None else vectors
    own = own.select("shard_id", F.col("vector_index").cast("long").alias("vector_index"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = own.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n, d = size.n, max(1, size.d or 1)
    clusters = max(1, min(CLUSTERS, CENTRE_BYTES // (8 * d), math.ceil(n / MEMBERS)))
    some = own if n <= PER_CENTRE * clusters else own.filter(F.pmod(F.xxhash64("shard_id", "vector_index"), F.lit(SLOTS)) < F.lit(SLOTS * PER_CENTRE * clusters // n))
    sample = some.select("embedding").toArrow().column(0).combine_chunks()
    unit, norm = _unit(sample, d) if len(sample) else (np.zeros((0, d)), np.zeros(0))
    centres = centres_of(unit[norm > 0], clusters) if (norm > 0).any() else np.eye(1, d)
    rows = stored(own.mapInArrow(_dealt(centres, d), "shard_id string, vector_index long, embedding array<double>, cluster long, cos double"), "clusters")
    held = rows.groupBy("cluster").agg(F.min("cos").alias("cos"), F.count("*").alias("n")).collect()  # CLUSTERS + 1 rows at most
    bounds = Bounds(centres, {r.cluster: (r.cos - 1e-12, r.n) for r in held})
    blocks = rows.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    block = lambda chunk: (F.col("cluster") * (1 << 32) + chunk).alias("block")
    members = rows.join(blocks, "cluster").select(block(F.pmod(F.xxhash64("shard_id", "vector_index"), F.col("blocks"))), F.lit(False).alias("asks"), "shard_id", "vector_index", none("long", "query_id"), "embedding", none("double", "least"))

    def met(routes: DataFrame) -> DataFrame:
        asks = routes.join(blocks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asks = asks.select(block(F.col("chunk")), F.lit(True).alias("asks"), none("string", "shard_id"), none("long", "vector_index"), "query_id", "embedding", "least")
        needed = members.join(asks.select("block").distinct(), "block", "left_semi")
        dealt = needed.unionByName(asks).repartition("block").sortWithinPartitions("block", "asks", "shard_id", "vector_index")
        return dealt.mapInPandas(block_hits(k), FOUND)

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "shard_id", "vector_index")
    best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    kinds = "query_id long, embedding array<double>, cluster long, least double"
    first_routes = stored(asked.withColumn("least", F.lit(-2.0)).mapInArrow(_routes(bounds, d, k, False), kinds), "routes")
    first = stored(best(met(first_routes)).drop("rank"), "first-hits")
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("least"))
    second_routes = stored(asked.join(least, "query_id").select("query_id", "embedding", "least").mapInArrow(_routes(bounds, d, k, True), kinds), "routes")
    hits = best(first.unionByName(met(second_routes)).distinct()).select("query_id", "rank", "shard_id", "vector_index", "score")
    visits = first_routes.select("query_id").unionByName(second_routes.select("query_id")).groupBy("query_id").agg(F.count("*").alias("visited"))
    return hits, visits.select("query_id", F.lit(len(held)).alias("clusters"), "visited")
