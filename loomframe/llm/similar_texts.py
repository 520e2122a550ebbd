"""Operator 5 for a required similarity: near copies by shingle similarity, found through Golay keys of SimHash sketches and verified on the texts.

Two texts of whose five-word shingles 0.8 are common (Jaccard of the sets) still differ in 10 of 64 bits of a SimHash of those
shingles, too many for keys. Of their words far more agree, so a sketch is SKETCHES short fingerprints (two Golay
segments each) of words; a pair shares a key if any fingerprint differs by one bit at most. A first pass over a few keys makes rough
classes, of which each member is verified on the texts against its class's centre: that joins a large group of near copies in one
comparison a member. In the second pass, over all keys, a bucket's texts of different verified classes are compared by all bits of
their sketches and by their marks, which prove of most that their texts aren't similar; each is paired with its nearest of every
other class, and the pairs are verified. Where that nearest one fails on its text, a last pass tries the text with all others of
its class that are as near. No text stands for others, so strangers that share a key or a class hide nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType
from xxhash import xxh64_intdigest

from loomframe.llm import golay
from loomframe.llm.common import drop, durable, small_batches
from loomframe.llm.graph import components

WIDTH, SIMILAR = 5, 0.8
#: Fingerprints of a sketch, and those of the first pass; bytes of a sketch.
SKETCHES, FIRST = 12, 3
BYTES = (SKETCHES * 2 * golay.LENGTH + 7) // 8
#: Greatest share of a sketch's bits in which a pair to verify differs: 0.067 is the most expected at similarity 0.8, standard deviation 0.01.
APART = 0.125
#: Texts that one task makes keys of; members of a bucket that a task compares with, and comparisons in one step; pairs of a text that a task verifies.
ROWS, CHUNK, STEP, GROUP = 10_000, 50_000, 1 << 17, 2_000
#: Bits of a text's marks; a multiple of 64.
MARKS = 1_024
_TABLE = np.random.default_rng(11).integers(0, 256, (8, 256, BYTES), dtype=np.uint8)


def normal(text: str) -> Column:
    """A text's words, A-Z in lower case, with single spaces between them."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "), "^ | $", "")


def sketch(words: bytes) -> bytes:
    """A bit is 1 if it is set in over half of the weight of the words' hashes (tabulated from XXH64). A word that occurs n times
    weighs the root of n: so no distribution of words makes a changed word weigh more than its share of the text."""
    counts = Counter(words.split(b" ")) if words else Counter()
    distinct, votes, whole = list(counts), np.zeros(BYTES * 8), 0.0
    for at in range(0, len(distinct), 4_096):
        part = distinct[at : at + 4_096]
        hashes = np.array([xxh64_intdigest(w) for w in part], np.uint64).view(np.uint8).reshape(-1, 8)
        bits = _TABLE[0, hashes[:, 0]]
        for k in range(1, 8):
            bits = bits ^ _TABLE[k, hashes[:, k]]
        weight = np.rint(16 * np.sqrt([counts[w] for w in part]))  # whole numbers: sums don't depend on the order
        votes += weight @ np.unpackbits(bits, axis=1)
        whole += weight.sum()
    return np.packbits(votes * 2 > whole).tobytes()


@F.pandas_udf(BinaryType())
def sketches(words: pd.Series) -> pd.Series:
    return pd.Series([sketch(w) for w in words])


_ODD = np.random.default_rng(12).integers(0, 1 << 63, WIDTH, dtype=np.uint64) * 2 + 1


def marks(words: bytes) -> bytes:
    """A bit is the parity of the distinct shingles whose hash falls on it; then their number (8 bytes). Each shingle of one text alone
    turns one bit at most, so two texts have at least as many such shingles as bits of their marks that differ."""
    parts, places = words.split(b" "), {}
    at = [places.setdefault(w, len(places)) for w in parts]
    hashes = np.array([xxh64_intdigest(w) for w in places], np.uint64)[at]
    n = max(1, len(parts) - WIDTH + 1)
    own = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(parts))):
        own += hashes[k : k + n] * _ODD[k]
    own = np.unique(own)
    bits = np.bincount((own >> np.uint64(32)).astype(np.int64) % MARKS, minlength=MARKS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes() + len(own).to_bytes(8, "little")


@F.pandas_udf(BinaryType())
def marks_of(words: pd.Series) -> pd.Series:
    return pd.Series([marks(w) for w in words])


def may_be_similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows of marks (as 64-bit words): False proves a similarity below SIMILAR, at which (1 - s) / (1 + s) of both texts'
    shingles are of one text alone."""
    alone = np.bitwise_count(x[:, :-1] ^ y[:, :-1]).sum(1, dtype=np.int64)
    return alone * (1 + SIMILAR) <= (x[:, -1] + y[:, -1]).astype(np.int64) * (1 - SIMILAR) + 1e-6


def shingles(words: str) -> set[str]:
    parts = words.split(" ")
    return {" ".join(parts[k : k + WIDTH]) for k in range(max(1, len(parts) - WIDTH + 1))}


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


@F.pandas_udf(DoubleType())
def apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of bits in which two sketches differ."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BYTES) for s in (a, b))
    return pd.Series(np.bitwise_count(x ^ y).sum(1) / (BYTES * 8.0))


def _keyed(names: range) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.arange(golay.LENGTH)
        for batch in batches:
            node, classes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            packed = batch.column(2).to_pylist()
            for at in range(0, len(node), 2_000):
                bits = np.unpackbits(np.frombuffer(b"".join(packed[at : at + 2_000]), np.uint8).reshape(-1, BYTES), axis=1)
                words = (bits[:, : SKETCHES * 2 * golay.LENGTH].reshape(len(bits), -1, golay.LENGTH).astype(np.int64) << shift).sum(2)
                rows, keys = golay.one_error_keys(words[:, [2 * n for n in names]], words[:, [2 * n + 1 for n in names]])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[at : at + 2_000][rows]), pa.array(classes[at : at + 2_000][rows])], ["key", "node", "class"])

    return run


def _mixed(placed: DataFrame, names: range) -> DataFrame:
    """(key, node, class) of the buckets that hold several classes: one shuffle, by key."""
    parts = max(1, math.ceil(placed.count() / ROWS))
    keyed = placed.select("node", "class", "sketch").repartition(parts).mapInArrow(_keyed(names), "key long, node long, class long")
    bucket = Window.partitionBy("key")
    return keyed.select("*", F.min("class").over(bucket).alias("lo"), F.max("class").over(bucket).alias("hi")).filter("lo <> hi").select("key", "node", "class")


def _rough_links(nodes: DataFrame) -> DataFrame:
    """(a, b): in each bucket of the first keys the least node with each other that is near it by all bits."""
    mixed = _mixed(nodes.withColumn("class", F.col("node")), range(FIRST))
    pairs = mixed.select(F.min("node").over(Window.partitionBy("key")).alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    own = nodes.select("node", "sketch")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return both.filter(apart("x", "y") <= APART).select("a", "b")


def _met(every: bool) -> Callable:
    """(a, b) from (key, chunk, asks, node, class, sketch, marks) in order of key, chunk and asks: a part of a bucket is held, those who
    ask pass, and each is paired with all near ones of other classes, or with its nearest of every class but its own (of equally near
    ones the least node). Without marks the sketches alone tell who is near."""
    limit = int(APART * BYTES * 8)

    def packed(column: pa.Array, width: int) -> np.ndarray:
        rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
        return np.pad(rows, ((0, 0), (0, -width % 8))).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for batch in batches:
            key, chunk, asks, node, classes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            bits = packed(batch.column(5), BYTES)
            signs = packed(batch.column(6), MARKS // 8 + 8) if batch.num_columns > 6 else np.zeros((len(bits), 1), np.uint64)
            new = (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (asks[1:] != asks[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if (key[lo], chunk[lo]) != now:
                    now, held, part = (key[lo], chunk[lo]), [], None
                if not asks[lo]:
                    held.append((node[lo:hi], classes[lo:hi], bits[lo:hi], signs[lo:hi]))
                    continue
                if not held:  # none of the bucket's nodes fell into this chunk
                    continue
                part = part or tuple(np.concatenate(x) for x in zip(*held))
                step = max(1, STEP // len(part[0]))
                for at in range(lo, hi, step):
                    end = min(hi, at + step)
                    far = np.bitwise_count(bits[at:end, None, :] ^ part[2][None, :, :]).sum(2, dtype=np.int32)
                    r, c = np.nonzero((far <= limit) & (classes[at:end, None] != part[1][None, :]))
                    may = [may_be_similar(signs[at:end][r[k : k + 65_536]], part[3][c[k : k + 65_536]]) for k in range(0, len(r), 65_536)]
                    may = np.concatenate([np.zeros(0, bool), *may])
                    r, c = r[may], c[may]
                    if not every:
                        order = np.lexsort((part[0][c], far[r, c], part[1][c], r))
                        r, c = r[order], c[order]
                        first = np.ones(len(r), bool)
                        first[1:] = (r[1:] != r[:-1]) | (part[1][c][1:] != part[1][c][:-1])
                        r, c = r[first], c[first]
                    x, y = node[at:end][r], part[0][c]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


_nearest = _met(every=False)


def _dealt(rows: DataFrame, asks: DataFrame, found: Callable) -> DataFrame:
    """(a, b) that found tells of rows and those who ask (key, chunks, node, class, sketch, marks): a key's rows are dealt in chunks, which
    those who ask visit all."""
    columns = ["node", "class", "sketch", "marks"]
    held = rows.select("key", F.pmod(F.hash("node"), "chunks").alias("chunk"), F.lit(0).alias("asks"), *columns)
    passing = asks.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("asks"), *columns)
    met = held.union(passing).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "asks")
    return met.mapInArrow(found, "a long, b long").distinct()


def _open_pairs(placed: DataFrame) -> DataFrame:
    """(a, b) nodes of different classes that share a key and are near by all bits: every node of a bucket but those of its largest
    class is compared with all of the bucket, and paired with its nearest of each class."""
    mixed = durable(_mixed(placed, range(SKETCHES)), "mixed")
    sizes = mixed.groupBy("key", "class").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    own = mixed.join(sizes, "key").join(placed.select("node", "sketch", "marks"), "node")
    out = durable(_dealt(own, own.filter("class <> largest"), _nearest), "pairs")
    drop(mixed)
    return out


def _further_pairs(placed: DataFrame, tried: DataFrame, label: DataFrame) -> DataFrame:
    """(a, b) that _open_pairs has left out behind a nearer one and that are of different classes in label, by all links found since:
    where a pair tried failed and the class of one has several members, all of those that are near the other one. None of tried."""
    own = placed.select("node", "class").join(label.select("node", F.col("class").alias("now")), "node")
    side = lambda name: own.select(F.col("node").alias(name), F.col("class").alias(f"class_{name}"), F.col("now").alias(f"now_{name}"))
    failed = tried.join(side("a"), "a").join(side("b"), "b").filter("now_a <> now_b")
    several = placed.groupBy(F.col("class").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    asking = failed.select(F.col("a").alias("node"), F.col("class_b").alias("key")).union(failed.select("b", "class_a")).distinct()
    asking = durable(asking.join(several, "key"), "asking")
    rows = placed.join(asking.select(F.col("key").alias("class"), "chunks").distinct(), "class").withColumn("key", F.col("class"))
    out = durable(_dealt(rows, asking.join(placed, "node"), _met(every=True)).join(tried, ["a", "b"], "left_anti"), "further")
    drop(asking)
    return out


def _with_class(nodes: DataFrame, links: DataFrame, *columns: str) -> DataFrame:
    label = components(links)
    return nodes.drop("class").join(label.withColumnRenamed("label", "class"), "node", "left").select("node", F.coalesce("class", "node").alias("class"), *columns)


def _votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the sketches' bits by class, of what this task has seen; at most 2,000 classes are held."""
    held: dict[int, list] = {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"class": list(held), "n": [v[0] for v in held.values()], "votes": [v[1].tolist() for v in held.values()]})

    for frame in frames:
        for c, part in frame.groupby("class"):
            bits = np.unpackbits(np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(-1, BYTES), axis=1).sum(0, dtype=np.int64)
            was = held.get(c, [0, 0])
            held[c] = [was[0] + len(part), was[1] + bits]
            if len(held) >= 2_000:
                yield rows()
                held.clear()
    if held:
        yield rows()


def _hubs(members: DataFrame) -> DataFrame:
    """(class, hub): the member nearest to the majority of its class's bits, of equal ones the least."""
    parts = members.mapInPandas(_votes, "class long, n long, votes array<long>")

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"class": frame["class"][:1], "n": [frame["n"].sum()], "votes": [np.sum(np.stack(frame["votes"].to_list()), axis=0).tolist()]})

    def centre(frame: pd.DataFrame) -> pd.DataFrame:
        votes = np.sum(np.stack(frame["votes"].to_list()), axis=0)
        return pd.DataFrame({"class": frame["class"][:1], "centre": [np.packbits(votes * 2 > frame["n"].sum()).tobytes()]})

    # a class of very many members has sums from every task: they meet in 64 groups first
    parts = parts.groupBy("class", F.pmod(F.xxhash64("n", "votes"), F.lit(64))).applyInPandas(added, "class long, n long, votes array<long>")
    centres = parts.groupBy("class").applyInPandas(centre, "class long, centre binary")
    far = members.join(centres, "class").select("class", "node", apart("sketch", "centre").alias("far"))
    return far.groupBy("class").agg(F.min(F.struct("far", "node")).alias("best")).select("class", F.col("best.node").alias("hub"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of similar texts from (a, chunk, asks, b, words): the text of a comes first, the others pass."""
    own = set()
    for batch in batches:
        found = []
        for a, asks, b, words in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if not asks:
                own = shingles(words)
            elif jaccard(own, shingles(words)) >= SIMILAR:
                found.append((a, b))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of pairs (a table) whose texts are similar. The text of a is sent once for GROUP of its pairs."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", F.pmod(F.hash("b"), "chunks").alias("chunk"), "b")
    side = lambda name: texts.select(F.col("node").alias(name), "words")
    first = dealt.select("a", "chunk").distinct().join(side("a"), "a").select("a", "chunk", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("b"), "words")
    others = dealt.join(side("b"), "b").select("a", "chunk", F.lit(1).alias("asks"), "b", "words")
    return first.union(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "asks").mapInArrow(_similar, "a long, b long")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) of the rows that have an id: the smallest id of the class that verified links connect.

    Texts of the same words are one class, also without any word. Equal texts are told by 64 bits of their words' hash.
    Candidates are found with high probability, not always (tests/llm measure it on whole tables, with strangers in the
    buckets). No rows: none.
    """
    small_batches(docs.sparkSession)
    words = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), normal(text_col).alias("words"))
    own = durable(words.select("id", F.xxhash64("words").alias("node"), sketches(F.col("words").cast("binary")).alias("sketch"), marks_of(F.col("words").cast("binary")).alias("marks")), "sketches")
    nodes = durable(own.groupBy("node").agg(F.min("id").alias("least"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks")), "nodes")
    rough = durable(_rough_links(nodes), "rough")
    members = durable(nodes.join(components(rough), "node").select("node", F.col("label").alias("class"), "sketch"), "members")

    def texts_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return durable(words.select(F.xxhash64("words").alias("node"), "words").join(needed, "node", "left_semi").dropDuplicates(["node"]), "texts")

    hubs = durable(members.join(_hubs(members), "class").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), "hubs")
    texts = texts_of(hubs)
    sure = durable(_verified(hubs, texts), "verified")
    placed = durable(_with_class(nodes, sure, "least", "sketch", "marks"), "placed")
    drop(nodes, rough, members, hubs, texts)
    pairs = _open_pairs(placed)
    texts = texts_of(pairs)
    more = durable(_verified(pairs, texts), "verified")
    drop(texts)
    classes = lambda links: durable(_with_class(placed.select("node", "least"), links, "least"), "classes")
    label = classes(sure.union(more))
    further = _further_pairs(placed, pairs, label)
    texts = texts_of(further)
    last = durable(_verified(further, texts), "verified")
    if not last.isEmpty():
        drop(label)
        label = classes(sure.union(more).union(last))
    smallest = label.groupBy("class").agg(F.min("least").alias("class_id"))
    found = own.select("id", "node").join(label.join(smallest, "class").select("node", "class_id"), "node")
    out = durable(found.select(F.col("id").alias(id_col), "class_id"), "similar")
    drop(own, placed, pairs, further, texts, sure, more, last, label)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one for each class: that with the smallest id (of equal ids, any one). Rows without an id can't be told
    apart from others and stay."""
    found = similar_classes(docs, id_col, text_col)
    keep = found.filter(F.col(id_col) == F.col("class_id")).select(id_col).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.filter(F.col(id_col).isNull())).select(*docs.columns)
