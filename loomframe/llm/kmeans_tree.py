"""Operator 13: approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

A tree of k-means splits is fitted to a sample; every row then goes down to its leaf. A query descends to its nearest leaf and keeps
the branches it passed in a priority queue by the distance of their centres, so the next leaf is always below the nearest
branch not yet entered. How many leaves a query visits is calibrated: the exact neighbours of some queries are found by one
pass over all rows, each neighbour's leaf has a place in the query's order of leaves, and visits are widened until they hold
the recall asked for. Leaves are dealt as blocks of rows, a block is held by one task and the queries that visit it pass.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomframe.llm.common import durable, read, small_batches

K, EVERY, RECALL = 10, 100, 0.95
#: Rows that the tree is fitted to, about, and at most so many bytes of them; queries that calibrate the visits, about.
SAMPLE, SAMPLE_BYTES, ASKED = 65_536, 64 << 20, 128
#: Branches of a node; rows of the table that a leaf is meant for; rows of the sample below which a node is not split; bytes of all centres.
BRANCHES, LEAF, LEAST, CENTRE_BYTES = 16, 256, 8, 8 << 20
#: Candidates of a block at most, on average; queries of one step; greatest component of which squares and their sums are sound.
ROWS, STEP, SOUND = 16_384, 256, 1e140
#: Parts of the hash that samples rows.
SLOTS = 1 << 30


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to a term that each row of x has alike."""
    return (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)


class Tree:
    """nodes[i] is (centres, children); a child below zero is leaf ~child. Without nodes there is one leaf."""

    def __init__(self, nodes: list[tuple[np.ndarray, list[int]]], leaves: int):
        self.nodes, self.leaves = nodes, leaves

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, left, x = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))] if self.nodes else [], np.clip(x, -SOUND, SOUND)
        while left:
            node, rows = left.pop()
            centres, children = self.nodes[node]
            nearest = _far(x[rows], centres).argmin(1)
            for i in np.unique(nearest).tolist():
                if children[i] < 0:
                    out[rows[nearest == i]] = ~children[i]
                else:
                    left.append((children[i], rows[nearest == i]))
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue, q = [(0.0, 0 if self.nodes else -1)], np.clip(q, -SOUND, SOUND)
        while queue:
            node = heapq.heappop(queue)[1]
            while node >= 0:
                centres, children = self.nodes[node]
                far = ((centres - q) ** 2).sum(1)
                best = int(far.argmin())
                for i, child in enumerate(children):
                    if i != best:
                        heapq.heappush(queue, (float(far[i]), child))
                node = children[best]
            yield ~node


def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest of each row) of k-means; centres without rows are left out."""
    centres = np.unique(x[rng.choice(len(x), k, replace=False)], axis=0)
    nearest = _far(x, centres).argmin(1)
    for _ in range(10):
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, x)
        centres = sums[counts > 0] / counts[counts > 0][:, None]
        was, nearest = nearest, _far(x, centres).argmin(1)
        if len(counts) == len(centres) and (was == nearest).all():
            break
    used, nearest = np.unique(nearest, return_inverse=True)
    return centres[used], nearest


def fit(sample: np.ndarray, rows: int) -> Tree:
    """A tree for a table of so many rows, fitted to a sample of it: the part with most rows is split first, until parts are as
    small as leaves, too small to split, or the centres as many as CENTRE_BYTES holds."""
    rng, x = np.random.default_rng(13), np.clip(sample, -SOUND, SOUND)
    each, most = rows / max(1, len(x)), max(2, CENTRE_BYTES // (8 * max(1, x.shape[1])))
    nodes: list[tuple[np.ndarray, list[int]]] = []
    parts: list[tuple] = [(-len(x), 0, None, 0, np.arange(len(x)))]  # by size: (rows, order, parent, place there, members)
    leaves, made = 1, 1
    done = []
    while parts:
        size, _, parent, place, members = heapq.heappop(parts)
        k = min(BRANCHES, math.ceil(-size * each / LEAF), -size // LEAST, most - leaves + 1)
        centres, nearest = _split(x[members], k, rng) if k > 1 else (None, None)
        if centres is None or len(centres) < 2:
            done.append((parent, place))
            continue
        nodes.append((centres, [0] * len(centres)))
        if parent is not None:
            nodes[parent][1][place] = len(nodes) - 1
        leaves += len(centres) - 1
        for i in range(len(centres)):
            own = members[nearest == i]
            heapq.heappush(parts, (-len(own), made, len(nodes) - 1, i, own))
            made += 1
    for leaf, (parent, place) in enumerate(done):
        if parent is not None:
            nodes[parent][1][place] = ~leaf
    return Tree(nodes, len(done))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, rows, distances) of each query's k nearest rows of other ids, ties to the smaller id. A product of matrices leaves
    out what is beyond the k-th by more than its error; distances are sums of squared differences."""
    sound = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < SOUND
    own = (x * x).sum(1) if sound else None
    for at in range(0, len(q), STEP):
        part = q[at : at + STEP]
        if sound:
            rough = own[None, :] - 2 * (part @ x.T)
            error = 4e-16 * (x.shape[1] + 4) * (own.max() + (part * part).sum(1))
        for i in range(len(part)):
            near = np.flatnonzero(ids != query_ids[at + i])
            if sound and len(near) > 4 * k:
                r = rough[i, near]
                near = near[r <= np.partition(r, k - 1)[k - 1] + 4 * error[i]]
            with np.errstate(over="ignore"):
                far = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
            order = np.lexsort((ids[near], far))[:k]
            yield at + i, near[order], far[order]


def _placed(tree: Tree, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.place(_matrix(batch.column(1), d))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves)], ["id", "v", "leaf"])

    return run


def _exact(query_ids: np.ndarray, q: np.ndarray, d: int, k: int):
    """The k nearest rows to each of a bounded set of queries among a task's rows, kept from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in query_ids]
        for batch in batches:
            ids, leaves = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for i, rows, far in best_of(ids, _matrix(batch.column(1), d), query_ids, q, k):
                held[i] = sorted([*held[i], *zip(far.tolist(), ids[rows].tolist(), leaves[rows].tolist())])[:k]
        flat = [(i, *h) for i, own in enumerate(held) for h in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*flat), (pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["query", "far", "id", "leaf"])

    return run


def calibrated_visits(tree: Tree, placed: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that these queries' visits hold the share recall of their exact nearest rows. No queries or rows: one."""
    if not len(query_ids):
        return 1
    found = placed.mapInArrow(_exact(query_ids, q, q.shape[1], k), "query int, far double, id long, leaf int")
    rank = F.row_number().over(W.partitionBy("query").orderBy("far", "id"))
    rows = found.withColumn("r", rank).filter(F.col("r") <= k).select("query", "leaf").collect()  # at most k for each of ASKED queries
    order = {}
    for query in {r.query for r in rows}:
        order[query] = {leaf: n for n, leaf in enumerate(tree.visits(q[query]), 1)}
    at = np.sort([order[r.query][r.leaf] for r in rows])
    return int(at[math.ceil(recall * len(at)) - 1]) if len(at) else 1


def _routes(tree: Tree, d: int, visits: int, sizes: dict[int, int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, v, leaf): the leaves that a query visits, so many and until they hold k rows besides those of its own id."""
        for batch in batches:
            rows, leaves = [], []
            for i, (q, own) in enumerate(zip(_matrix(batch.column(1), d), batch.column(2).to_pylist())):
                seen, n = 0, 0
                for leaf in tree.visits(q):
                    if n >= visits and seen >= k + own:
                        break
                    seen, n = seen + sizes.get(leaf, 0), n + 1
                    if sizes.get(leaf):
                        rows.append(i)
                        leaves.append(leaf)
            for at in range(0, len(rows), 4_096):
                some = pa.array(rows[at : at + 4_096], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(leaves[at : at + 4_096], pa.int32())], ["id", "v", "leaf"])

    return run


def _nearest(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(leaf, block, query, id, v) in order of leaf, block and query: a block's candidates come first and are held, its queries pass."""
        now, held, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 2)], axis=1)
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            lengths = batch.column(4).value_lengths().to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                leaf, number, asks = key[lo].tolist()
                if (leaf, number) != now:
                    now, held, block = (leaf, number), [], None
                x = _matrix(batch.column(4).slice(lo, hi - lo), int(lengths[lo]))
                if not asks:
                    held.append((ids[lo:hi], x))
                elif held:
                    block = block or (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    found = [(np.full(len(rows), ids[lo + i]), block[0][rows], far) for i, rows, far in best_of(*block, ids[lo:hi], x, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names)

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, d) of vectors whose components are all there and finite and not all zero."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    own = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole & F.exists(vector_col, lambda x: x != 0))
    return own.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("d"))


def _some(rows: DataFrame, wanted: int, of: int) -> DataFrame:
    """About so many of a table's rows, by their hash: always the same."""
    return rows if of <= wanted else rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(SLOTS)) < F.lit(SLOTS * wanted // of))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, k near rows of other ids by Euclidean distance.

    All k are found (fewer only if there are fewer candidates); they are the nearest with the recall asked for, as calibrated on about
    ASKED of the queries against all rows. recall 1: visits hold all neighbours of the calibration. Vectors that are null, empty, zero
    or hold a null or non-finite component, and rows without an id, take no part. Vectors of different lengths don't meet: the tree is
    that of the commonest length, rows of any other length are searched whole. Repeated rows count once for each id and vector.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = durable(_usable(vectors, id_col, vector_col).distinct(), "vectors")
    kind = v.schema["v"].dataType.simpleString()
    common = v.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = (common.d, common.n) if common else (1, 0)
    own = v.filter(F.col("d") == d).select("id", "v")
    sample = _some(own, min(SAMPLE, SAMPLE_BYTES // (8 * d)), n).select("v").toArrow()
    tree = fit(_matrix(sample.column(0).combine_chunks(), d) if len(sample) else np.zeros((0, d)), n)
    placed = durable(own.mapInArrow(_placed(tree, d), f"id long, v {kind}, leaf int"), "placed")
    sizes = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one for each leaf: bounded by the tree
    asks = F.col("id") % every == 0
    asked = _some(own.filter(asks), ASKED, own.filter(asks).count()).toArrow()
    asked_v = _matrix(asked.column(1).combine_chunks(), d) if len(asked) else np.zeros((0, d))
    visits = calibrated_visits(tree, placed, asked.column(0).to_numpy(), asked_v, k, recall)

    copies = v.groupBy("id", "d").agg(F.count("*").alias("own")).filter(asks)
    queries = v.filter(asks).join(copies, ["id", "d"])
    routed = queries.filter(F.col("d") == d).select("id", "v", "own").mapInArrow(_routes(tree, d, visits, sizes, k), f"id long, v {kind}, leaf int")
    others = v.filter(F.col("d") != d)
    rows = placed.union(others.select("id", "v", (-F.col("d")).alias("leaf")))
    routed = routed.union(others.filter(asks).select("id", "v", (-F.col("d")).alias("leaf")))
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    candidates = rows.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("block"), F.lit(0).alias("query"), "id", "v")
    passing = routed.join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "id", "v")
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / ROWS))
    met = candidates.union(passing).repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "query")
    met = met.mapInArrow(_nearest(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
