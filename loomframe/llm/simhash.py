"""Operator 5: near-duplicate classes of SimHash fingerprints, found by Golay-code fuzzy hashing.

A fingerprint's segments decode to nearby codewords of the perfect Golay code; the indices, with exact pieces of the other
segments, are its keys (golay.keys). Any two fingerprints with at most four differing bits share a key, whatever the bits.
Keys are shuffled once and each bucket is looked at where it lies: its classes are joined in place, members of the greatest
class are never compared with each other, and only joins of classes leave the task. So no pairs and no groups are written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from loomframe.llm import golay
from loomframe.llm.common import drop, durable, read, small_batches
from loomframe.llm.graph import components

MAX_BITS = 4
#: Fingerprints that one task makes keys of; comparisons in one step; nodes of a task's forest before it starts anew.
ROWS, SPLIT, FOREST = 10_000, 1 << 22, 500_000


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((golay.fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))


def _keyed(make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, classes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(whole), 2_000):
                fp = whole[at : at + 2_000]
                rows, keys = make(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows]), pa.array(classes[at : at + 2_000][rows])], ["key", "fp", "class"])

    return run


class Forest:
    """Classes that one task has joined; new holds the joins not yet handed on."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.new: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.parent.get(x, x)
        while up != x:
            above = self.parent.get(up, up)
            self.parent[x] = above
            x, up = up, above
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[a] = b
            self.new.append((a, b))


def join_near(fp: np.ndarray, classes: np.ndarray, forest: Forest, split: bool = True) -> None:
    """Joins the classes of one bucket that have members within MAX_BITS bits of each other.

    Only members outside the bucket's greatest class are compared with all, a block at a time; what a block joins is out of the
    next. Where that is still much, five pieces of the bits part the bucket first: four errors leave one of them exact.
    """

    def labels(of: np.ndarray) -> np.ndarray:
        ids, back = np.unique(of, return_inverse=True)
        return np.array([forest.find(int(x)) for x in ids], np.int64)[back]

    own = labels(classes)
    open_ = np.ones(len(fp), bool)
    while True:
        ids, back, sizes = np.unique(own, return_inverse=True, return_counts=True)
        minor = np.flatnonzero((back != sizes.argmax()) & open_)
        if not len(minor):
            return
        if split and len(minor) * len(fp) > SPLIT:
            for shift in range(0, 64, 13):
                piece = (fp >> np.uint64(shift)) & np.uint64((1 << 13) - 1)
                order = np.argsort(piece, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
                    if len(part) > 1:
                        join_near(fp[part], classes[part], forest, split=False)
            return
        block = minor[: max(1, SPLIT // len(fp))]
        r, c = np.nonzero((np.bitwise_count(fp[block][:, None] ^ fp[None, :]) <= MAX_BITS) & (own[block][:, None] != own[None, :]))
        for x, y in set(zip(own[block][r].tolist(), own[c].tolist())):
            forest.join(x, y)
        open_[block] = False
        own = labels(own)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) classes from (key, fp, class) rows in order of key; what a task holds is one bucket and its forest."""
    forest, held, key = Forest(), [], None

    def links() -> Iterator[pa.RecordBatch]:
        if held:
            join_near(np.concatenate([h[0] for h in held]).view(np.uint64), np.concatenate([h[1] for h in held]), forest)
            held.clear()
        if len(forest.new) >= 10_000 or key is None:
            if forest.new:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*forest.new)], ["a", "b"])
            forest.new = []
            if len(forest.parent) > FOREST:
                forest.parent = {}

    for batch in batches:
        keys, fp, classes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                if int(keys[lo]) != key:
                    yield from links()
                    key = int(keys[lo])
                held.append((fp[lo:hi], classes[lo:hi]))
    key = None
    yield from links()


def _class_links(placed: DataFrame, make: Callable) -> DataFrame:
    """(a, b): enough joins of classes to connect all that share a key and a link. placed: (fp, class).

    One shuffle, by key. Buckets of one class end in the JVM; the others go to _joined in order of key."""
    parts = max(1, math.ceil(placed.count() / ROWS))  # files of the table are few, and each row makes about 122
    keyed = placed.select("fp", "class").repartition(parts).mapInArrow(_keyed(make), "key long, fp long, class long")
    bucket = Window.partitionBy("key")
    mixed = keyed.select("*", F.min("class").over(bucket).alias("lo"), F.max("class").over(bucket).alias("hi")).filter("lo <> hi")
    return mixed.select("key", "fp", "class").sortWithinPartitions("key").mapInArrow(_joined, "a long, b long")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, class) of distinct fingerprints: class is the least fingerprint reachable over links of at most MAX_BITS bits.

    A first pass over six keys a fingerprint joins most of each group; the second, over all keys, then only has to look at buckets
    that hold several classes."""
    placed, before = fps.select("fp", F.col("fp").alias("class")), []
    for make in (golay.few_keys, golay.keys):
        label = components(_class_links(placed, make).distinct())
        found = placed.join(label, placed["class"] == label.node, "left").select("fp", F.coalesce("label", "class").alias("class"))
        placed = durable(found, "classes")
        drop(*before)
        before = [placed]
    return placed


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id): the smallest id that each row's fingerprint can reach over links of at most four bits.

    Null text: as without a word, fingerprint zero. Rows without an id get a class but never name one (a class of such rows
    only has component_id null). Repeated rows come back as often as they came. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = durable(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col).cast("binary")).alias("fp")), "fingerprints")
    fps = durable(docs.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    placed = fps.join(classes(fps), "fp")
    reach = placed.groupBy("class").agg(F.min("least").alias("component_id"))
    named = placed.join(reach, "class").select("fp", "component_id")
    return docs.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
