"""Operator 7: exact top-k inner products by no-random-access aggregation (NRA).

Rows are dealt to blocks; in a block each dimension is a list sorted by value, read downwards for a positive query component
and upwards for a negative one. After each depth every row has a lower bound (unread components at their list's far end)
and an upper bound (unread components at the reading front). The k-th best lower bound shuts out all rows whose upper bound
is below it, and later depths look only at rows that are open for some query; once the best possible unread row is out too, no
list is read further for that query and the rows that are left get their final scores. A task sorts a block's lists once and
lets all queries pass as a stream; only queries are copied. The blocks' lists are merged by a ranked window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomframe.llm.common import durable, read, small_batches

K, EVERY, SCALE = 20, 20, 64
#: Candidates of a block at most, on average, and at least where there are fewer blocks than cores; queries of one step.
ROWS, FEW, QUERIES = 32_768, 4_096, 128
#: Sums of products below these are exact in float32 and float64.
EXACT32, EXACT64 = 1 << 24, 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)


class Lists:
    """The sorted lists of a block of vectors."""

    def __init__(self, x: np.ndarray):
        self.x, (n, d) = x, x.shape
        down = np.argsort(-x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, down, axis=0)
        self.place = np.empty((n, d), np.int32)
        np.put_along_axis(self.place, down, np.arange(n, dtype=np.int32)[:, None].repeat(d, 1), axis=0)

    def read(self, depth: int, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Components of rows as known after depth entries: (for lower, upper bound with positive weights; the same for
        negative), and the two reading fronts."""
        n, x, place = len(self.x), self.x[rows], self.place[rows]
        top, bottom = place < depth, place >= n - depth
        high, low = self.sorted[0], self.sorted[-1]
        front, back = self.sorted[depth - 1], self.sorted[n - depth]
        return np.where(top, x, low), np.where(top, x, front), np.where(bottom, x, high), np.where(bottom, x, back), front, back


def nra(lists: Lists, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best rows other than its own, ties to the smaller id."""
    n = len(ids)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), QUERIES):
        left, names, rows = queries[at : at + QUERIES], query_ids[at : at + QUERIES], np.arange(n)
        depth = max(1, min(n, max(4 * k, n // 4)))
        while len(left):
            plus, minus = np.maximum(left, 0), np.minimum(left, 0)
            pl, pu, ml, mu, front, back = lists.read(depth, rows)
            own = names[:, None] == ids[rows][None, :]
            lower = plus @ pl.T + minus @ ml.T
            upper = plus @ pu.T + minus @ mu.T
            lower[own] = -np.inf
            bound = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) >= k else np.full(len(left), -np.inf)
            unread = plus @ front + minus @ back
            open_ = (upper >= bound[:, None]) & ~own
            done = (depth == n) | ((unread < bound) & (open_.sum(1) <= max(8 * k, n // 16)))
            for q in np.nonzero(done)[0]:
                some = rows[open_[q]]
                score = lists.x[some] @ left[q]
                if len(some) > 4 * k:  # what is below the k-th best is out before the sort
                    high = score >= np.partition(score, len(some) - k)[len(some) - k]
                    some, score = some[high], score[high]
                best = np.lexsort((ids[some], -score))[:k]
                out.append((np.full(len(best), names[q]), ids[some[best]], score[best]))
            left, names = left[~done], names[~done]
            still = open_[~done].any(0)
            # where bounds shut out little, rounds in between would too
            depth = min(n, depth * 2) if still.mean() < 0.9 else n
            rows = rows[still]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def whole_numbers(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as nra by exact integers of any size, for the few vectors whose sums floats can't hold. Scores outside a long
    count as its nearest value."""
    x, out = x.astype(object), ([], [], [])
    for name, own in zip(query_ids.tolist(), q.astype(object)):
        best = sorted((-min(max(s, LONG[0]), LONG[1]), i) for s, i in zip((x @ own).tolist(), ids.tolist()) if i != name)[:k]
        for part, values in zip(out, ([name] * len(best), [i for _, i in best], [-s for s, _ in best])):
            part.extend(values)
    return tuple(np.array(part, np.int64) for part in out)


class Block:
    """One block of candidates: lists of the vectors that floats can take, and the others."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.k, self.ids, self.x = k, ids, x
        self.limit = math.isqrt(EXACT64 // max(1, x.shape[1])) - 1
        self.large = (x > self.limit).any(1) | (x < -self.limit).any(1)
        fine = x[~self.large]
        self.most = int(np.abs(fine).max(initial=0))
        self.lists = {np.float64: None, np.float32: None}

    def _lists(self, kind: type) -> Lists:
        if self.lists[kind] is None:
            self.lists[kind] = Lists(self.x[~self.large].astype(kind))
        return self.lists[kind]

    def best(self, query_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        large = (q > self.limit).any(1) | (q < -self.limit).any(1)
        out = [whole_numbers(self.x, self.ids, q[large], query_ids[large], self.k)] if large.any() else []
        q, query_ids = q[~large], query_ids[~large]
        if len(q) and self.large.any():
            out.append(whole_numbers(self.x[self.large], self.ids[self.large], q, query_ids, self.k))
        if len(q) and not self.large.all():
            kind = np.float32 if self.most * int(np.abs(q).max(initial=0)) * q.shape[1] < EXACT32 else np.float64
            out.append(nra(self._lists(kind), self.ids[~self.large], q.astype(kind), query_ids, self.k))
        return tuple(np.concatenate(parts) for parts in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _blocks(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(d, block, query, id, v) in order of d, block and query: a block's candidates come first and are held, its queries pass."""
        now, held, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 2)], axis=1)
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            values, starts = batch.column(4).flatten().to_numpy(zero_copy_only=False), batch.column(4).value_lengths().to_numpy().cumsum()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                d, number, asks = key[lo].tolist()
                if (d, number) != now:
                    now, held, block = (d, number), [], None
                x = values[starts[lo] - d : starts[hi - 1]].reshape(hi - lo, d)
                if not asks:
                    held.append((ids[lo:hi], x))
                elif held:
                    block = block or Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                    found = block.best(ids[lo:hi], x)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    return run


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(64 * x) of vectors whose components are all there and finite, at the ends of a long where it is beyond them;
    rows without an id or components are left out."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k best of all rows of other ids.

    Vectors that are null or empty or hold a null or non-finite component, and rows without an id, take no part. Vectors of
    different lengths don't meet. Repeated rows are candidates, and queries, once for each id and vector.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = durable(quantised(vectors, id_col, vector_col).distinct().withColumn("d", F.size("v")), "vectors")
    asks = F.col("id") % every == 0
    cores = spark.sparkContext.defaultParallelism
    sizes = v.groupBy("d").agg(F.count("*").alias("n"))
    sizes = sizes.select("d", F.greatest(F.ceil(F.col("n") / ROWS), F.least(F.lit(cores), F.ceil(F.col("n") / FEW))).cast("int").alias("blocks"))
    parts = sizes.agg(F.sum("blocks").alias("n")).first().n or 1
    own = v.join(sizes, "d")
    candidates = own.select("d", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("block"), F.lit(0).alias("query"), "id", "v")
    queries = own.filter(asks).select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "id", "v")
    met = candidates.union(queries).repartition(parts, "d", "block").sortWithinPartitions("d", "block", "query")
    met = met.mapInArrow(_blocks(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
