"""Operator 11: the trie of conversations' prefixes, by union-find over the common prefixes of sorted neighbours.

A turn is its 128-bit hash, and a conversation's turns are cut into blocks; a block's trie stands on the node at which the block
begins, told by a hash of what comes before. All blocks are sorted by that node and their turns over the whole table. In a
partition the edges between neighbours, weighted with their longest common prefix (LCP), are taken in descending depth: union-find
joins their components, and each depth at which components meet is a branching node. Nodes that touch an end of the partition may
go on in the next one; of them (two chains at most, of a block's depth) each partition's forest is contracted to partial sums,
which are merged by node. The nodes in between are whole and leave the task at once.

Sums over subtrees are sums over members: a conversation hands on the words of its turns up to the deepest node that it shares
with a smaller conversation (a first pass over the forests finds it), and a leaf counts at its smallest member. So no walk up the
trie is needed, neither across blocks nor across partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loomframe.llm.common import WORD, drop, durable, read, small_batches

#: Bytes of a turn's hash, turns of a block; rows of turns and blocks that a task sorts, about.
HASH, TURNS = 16, 128
TURN_ROWS, BLOCK_ROWS = 100_000, 20_000
#: Conversations of one family and the turns that those may borrow from the first of them.
FAMILY, HEAD = 20, 3
EMPTY = hashlib.sha256(b"").hexdigest()
ROW = {"kind": pa.int32(), "id": pa.binary(), "up": pa.binary(), "c": pa.int64(), "up_c": pa.int64(), "depth": pa.int64(), "n": pa.int64(), "kids": pa.int64(), "leaves": pa.int64(), "wt": pa.int64(), "low_wt": pa.int64(), "before": pa.int64(), "ends": pa.string()}
ROW_TYPES = "kind int, id binary, up binary, c long, up_c long, depth long, n long, kids long, leaves long, wt long, low_wt long, before long, ends string"
LOST, LEAF, OPEN, CLOSED, END = range(5)


# --- conversations and their blocks


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a partition's ordered rows (c, ...) from 1 within c."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(c)) + 1
        starts = np.concatenate([[0], cuts])
        k = np.arange(len(c)) - np.repeat(starts, np.diff(np.append(starts, len(c)))) + 1
        if c[0] == last:
            k[: cuts[0] if len(cuts) else len(c)] += count
        last, count = c[-1], int(k[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k)], ["c", "part", "turn", "words", "k"])


def turns_in_order(rows: DataFrame) -> DataFrame:
    """(c, p, turn binary, words): the turns of rows (conv_id, turn, role, text), numbered from 1 within a conversation; rows without a
    conv_id are left out. By turn (null first), equal turns by role and text. Ranges of the order are dealt, so a conversation of any
    length is spread; what a range's first conversation has in earlier ranges is added from a table of at most one row a range."""
    own = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(own.count() / TURN_ROWS))
    own = own.repartitionByRange(parts, "c", "t", "role", "text").sortWithinPartitions("c", "t", "role", "text")
    identity = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * HASH))
    light = own.select("c", F.spark_partition_id().alias("part"), identity.alias("turn"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    numbered = durable(light.mapInArrow(_numbered, "c long, part int, turn binary, words long, k long"), "turns")
    ends = numbered.groupBy("part").agg(F.array(F.min("c"), F.max("c")).alias("c")).select("part", F.explode("c").alias("c"))
    spread = ends.groupBy("c").agg(F.countDistinct("part").alias("parts")).filter("parts > 1").select("c")
    counts = numbered.join(F.broadcast(spread), "c").groupBy("c", "part").agg(F.max("k").alias("n"))
    before = F.sum("n").over(W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = counts.select("c", "part", before.alias("before")).filter("before > 0")
    out = numbered.join(F.broadcast(carried), ["c", "part"], "left")
    return out.select("c", (F.col("k") + F.coalesce("before", F.lit(0))).alias("p"), "turn", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, total) of each conversation and (c, p, turn, words, total) of its rebuilt turns: the first h of the first conversation of its
    family (all if it has fewer), then its own after its first h; h is crc32 of c modulo 4."""
    lengths = turns.groupBy("c").agg(F.max("p").alias("own"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % 4).cast("int")
    firsts = lengths.filter(F.col("c") % FAMILY == 0).select(F.col("c").alias("base"), F.least("own", F.lit(HEAD)).alias("head"))
    convs = lengths.select("c", "own", h.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base")).join(firsts, "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("head", F.lit(0))))
    convs = durable(convs.select("c", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    own = turns.join(convs.select("c", "h", "lent", "total"), "c").filter("p > h").select("c", (F.col("p") - F.col("h") + F.col("lent")).alias("p"), "turn", "words", "total")
    heads = turns.filter((F.col("c") % FAMILY == 0) & (F.col("p") <= HEAD)).select(F.col("c").alias("base"), "p", "turn", "words")
    lent = convs.filter("lent > 0").join(heads, "base").filter("p <= lent").select("c", "p", "turn", "words", "total")
    return convs, own.unionByName(lent)


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def sorted_blocks(turns: DataFrame, size: int, rows: int) -> DataFrame:
    """(part, b, s1, s2, key, c, words, w0, total): block b of conversation c: its turns' hashes one after the other, their words, the
    words before it and the hash (s1, s2) of all before it. part: ranges of the order by (b, s1, s2, key, c)."""
    block = F.floor((F.col("p") - 1) / size).cast("long")
    each = turns.groupBy("c", block.alias("b")).agg(F.array_sort(F.collect_list(F.struct("p", "turn", "words"))).alias("l"), F.max("total").alias("total"))
    key = F.unhex(F.array_join(F.transform("l", lambda e: F.hex(e["turn"])), ""))
    each = durable(each.select("c", "b", key.alias("key"), F.col("l.words").alias("words"), "total"), "blocks")
    long_ = each.filter(F.col("total") > size)
    digest = F.sha2(F.concat(F.concat(F.col("b").cast("string"), F.lit(":")).cast("binary"), "key"), 256)
    light = long_.select("c", "b", digest.alias("digest"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w).alias("w")).select("c", "b", "w", _half(F.col("digest"), 1).alias("d1"), _half(F.col("digest"), 17).alias("d2"))
    earlier = W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    starts = light.select("c", "b", *[F.coalesce(f(x).over(earlier), F.lit(0)).cast("long").alias(y) for f, x, y in ((F.bit_xor, "d1", "s1"), (F.bit_xor, "d2", "s2"), (F.sum, "w", "w0"))])
    zero = F.lit(0).cast("long")
    whole = each.filter(F.col("total") <= size).select("*", zero.alias("s1"), zero.alias("s2"), zero.alias("w0")).unionByName(long_.join(starts, ["c", "b"]))
    order = ("b", "s1", "s2", "key", "c")
    parts = max(1, math.ceil(each.count() / rows), min(turns.sparkSession.sparkContext.defaultParallelism, math.ceil(each.count() / 1_000)))
    out = whole.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = durable(out.select(F.spark_partition_id().alias("part"), *order, "words", "w0", "total"), "sorted")
    drop(each)
    return out


# --- the forest of one partition


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (n - (differ.bit_length() + 7) // 8) // HASH


class Forest:
    """Nodes above neighbours of one group, sorted by key: depth, range [lo, hi) of members, least member, parent, children.

    lost: (member, depth) of each component's least member that a join puts below a lesser one."""

    def __init__(self, keys: list[bytes], convs: list[int]):
        n = len(keys)
        self.depth, self.lo, self.hi = [len(k) // HASH for k in keys], list(range(n)), list(range(1, n + 1))
        self.least, self.up, self.kids = convs[:], [-1] * n, [[] for _ in range(n)]
        self.dead, self.lost = set(), []
        parent, top = list(range(n)), list(range(n))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        lcp = np.array([common_turns(a, b) for a, b in zip(keys, keys[1:])], np.int64)
        for edge in np.argsort(-lcp, kind="stable").tolist():
            at = int(lcp[edge])
            if not at:
                break
            x, y = find(edge), find(edge + 1)
            a, b = top[x], top[y]
            self.lost.append((max(self.least[a], self.least[b]), at, edge))
            if self.depth[a] > at:
                self.depth.append(at), self.lo.append(self.lo[a]), self.hi.append(self.hi[a]), self.least.append(self.least[a]), self.up.append(-1), self.kids.append([a])
                self.up[a] = a = len(self.depth) - 1
            # a ends or branches at this depth; what joins it from the right is deeper, or a copy that ends here too
            if self.depth[b] == at:
                self.dead.add(b)
            else:
                self.up[b] = a
                self.kids[a].append(b)
            self.hi[a], self.least[a] = self.hi[b], min(self.least[a], self.least[b])
            parent[y], top[x] = x, a

    def nodes(self) -> Iterator[int]:
        return (i for i in range(len(self.depth)) if i not in self.dead)


def group_id(b: int, s1: int, s2: int) -> bytes:
    """The node at which block b begins after what (s1, s2) stands for."""
    return hashlib.blake2b(f"group {b},{s1},{s2}".encode(), digest_size=HASH).digest()


ROOT = group_id(0, 0, 0)


class Group:
    """The part of one group (blocks that begin at the same node) that lies in a partition."""

    def __init__(self, head: tuple[int, int, int], rows: list[tuple], first: bool, last: bool, size: int):
        (self.b, self.s1, self.s2), self.size = head, size
        self.keys, self.convs = [r[0] for r in rows], [r[1] for r in rows]
        self.before = [list(accumulate(r[2], initial=r[3])) for r in rows]
        self.total, self.wt, self.leaf = [r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows]
        self.forest, self.first, self.last = Forest(self.keys, self.convs), first, last
        self.id = group_id(*head)

    def touches(self, node: int) -> bool:
        """Whether the node may have members in another partition."""
        f = self.forest
        return self.first and f.lo[node] == 0 or self.last and f.hi[node] == len(self.keys)

    def id_of(self, node: int, d: int) -> bytes:
        key = self.keys[self.forest.lo[node]][: d * HASH]
        if d < self.size:
            return hashlib.blake2b(f"{self.b},{self.s1},{self.s2}:".encode() + key, digest_size=HASH).digest()
        digest = hashlib.sha256(f"{self.b}:".encode() + key).digest()
        one, two = (int.from_bytes(digest[k : k + 8], signed=True) for k in (0, 8))
        return group_id(self.b + 1, self.s1 ^ one, self.s2 ^ two)

    def ends(self, node: int) -> list[int]:
        """Conversations that end at the node, ascending."""
        f, full = self.forest, self.b * self.size
        size, out = f.depth[node], []
        for i in range(f.lo[node], f.hi[node]):
            if len(self.keys[i]) != size * HASH:
                break
            if self.total[i] == full + size:
                out.append(self.convs[i])
        return out

    def first_pass(self) -> Iterator[dict]:
        """LOST: words up to where a conversation is below a lesser one; LEAF: least member of a leaf; OPEN: the same still to be merged."""
        f = self.forest
        for c, depth, edge in f.lost:
            yield {"kind": LOST, "c": c, "wt": self.before[edge][depth]}
        if self.b:
            yield {"kind": OPEN, "id": self.id, "kids": 1}
        for node in f.nodes():
            size, lo = f.depth[node], f.lo[node]
            ends, open_ = self.ends(node), self.touches(node)
            if not open_ and size < self.size and ends and not f.kids[node]:
                yield {"kind": LEAF, "c": f.least[node]}
            above = f.depth[f.up[node]] if f.up[node] >= 0 else 0
            for d in range(above + 1, size + 1) if open_ else [size] if size == self.size else []:
                longer = d < size or bool(f.kids[node])
                yield {"kind": OPEN, "id": self.id_of(node, d), "c": f.least[node], "wt": self.before[lo][d], "kids": int(longer), "up_c": ends[0] if ends and d == size else None}

    def second_pass(self) -> Iterator[dict]:
        """CLOSED: finished nodes but for parents that are open; OPEN: partial sums of nodes; END: who ends at an open node."""
        f, full = self.forest, self.b * self.size
        wt, leaf, place = [0, *accumulate(self.wt)], [0, *accumulate(self.leaf)], {}
        for i, c in enumerate(self.convs):
            place[c] = i
        opens = {node: self.touches(node) for node in f.nodes()}
        first_open = lambda node, above: opens[node] or above + 1 == self.size
        tops = [node for node in f.nodes() if f.up[node] < 0]
        closed = sum(not first_open(node, 0) for node in tops)
        own = {"kind": OPEN, "id": self.id, "depth": full, "n": 0, "kids": closed, "leaves": 0, "wt": 0}
        if not self.b:
            low = min(self.convs)
            own |= {"c": low, "n": len(self.convs), "leaves": leaf[-1], "wt": wt[-1], "low_wt": self.wt[place[low]], "before": 0}
        yield own
        for node in f.nodes():
            lo, hi, size, up, least = f.lo[node], f.hi[node], f.depth[node], f.up[node], f.least[node]
            above = f.depth[up] if up >= 0 else 0
            n, sum_wt, leaves, low_wt = hi - lo, wt[hi] - wt[lo], leaf[hi] - leaf[lo], self.wt[place[least]]
            ends = self.ends(node)
            for d in range(above + 1, size + 1):
                row = {"c": least, "depth": full + d, "n": n, "leaves": leaves}
                if d > above + 1:
                    parent = {"up": self.id_of(node, d - 1)} if opens[node] else {"up_c": least}
                elif up < 0:
                    parent = {"up": self.id}
                else:
                    parent = {"up": self.id_of(up, above)} if opens[up] else {"up_c": f.least[up]}
                before = self.before[lo][d - 1]
                if opens[node] or d == self.size:
                    kids = sum(not first_open(k, size) for k in f.kids[node]) if d == size else 0
                    own_id = self.id_of(node, d)
                    yield row | parent | {"kind": OPEN, "id": own_id, "kids": kids, "wt": sum_wt, "low_wt": low_wt, "before": before}
                    if d == size:
                        for c in ends:
                            yield {"kind": END, "id": own_id, "c": c}
                else:
                    hashed = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if d == size and ends else EMPTY
                    yield row | parent | {"kind": CLOSED, "kids": len(f.kids[node]) if d == size else 1, "wt": sum_wt - low_wt - (n - 1) * before, "ends": hashed}


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _forests(second: bool, size: int) -> Callable:
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in ROW.items()], list(ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, b, s1, s2, key, c, words, w0, total, wt, leaf) in order; a task holds one part at a time."""
        out = []
        for _, part in groupby(_rows_of(batches), key=lambda r: r[0]):
            groups = [(head, [r[4:] for r in rows]) for head, rows in groupby(part, key=lambda r: r[1:4])]
            for i, (head, rows) in enumerate(groups):
                group = Group(head, rows, i == 0, i == len(groups) - 1, size)
                for row in group.second_pass() if second else group.first_pass():
                    out.append(row)
                    if len(out) >= 5_000:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return run


def _passed(blocks: DataFrame, parts: int, second: bool, size: int) -> DataFrame:
    order = ("part", "b", "s1", "s2", "key", "c")
    rows = blocks.select(*order, "words", "w0", "total", "wt", "leaf").repartition(parts, "part").sortWithinPartitions(*order)
    return rows.mapInArrow(_forests(second, size), ROW_TYPES)


# --- merging across partitions


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ends) of (id, c) in order: a hash is fed as a stream."""
    now, state, out = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["id", "ends"])

    for node, c in _rows_of(batches):
        if node != now:
            if now is not None:
                out.append((now, state.hexdigest()))
            if len(out) >= 5_000:
                yield batch()
                out = []
            now, state = node, hashlib.sha256(str(c).encode())
        else:
            state.update(f",{c}".encode())
    if now is not None:
        out.append((now, state.hexdigest()))
        yield batch()


def trie(conversations: DataFrame, size: int = TURNS, rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the nodes of the trie of rebuilt
    conversations, from rows (conv_id, turn, role, text).

    Null role or text is empty; equal turns follow by role and text, repeated rows are turns of their own; rows without a conv_id take
    no part; other columns are ignored. No conversation: no row, not even a root. Two turns or prefixes are taken for equal if 128 bits
    of SHA-256 or BLAKE2b are. size: turns of a block, rows: blocks that a task sorts, about; the result is the same for any. The ids that end at one node are hashed by one task, which reads them as a stream.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    convs, turns = rebuilt(turns_in_order(conversations))
    blocks = sorted_blocks(turns, size, rows)
    parts = max(1, blocks.select("part").distinct().count())
    zero = F.lit(0).cast("long")
    found = durable(_passed(blocks.withColumns({"wt": zero, "leaf": zero}), parts, False, size), "first-pass")
    merged = found.filter(F.col("kind") == OPEN).groupBy("id").agg(F.min("c").alias("low"), F.max("kids").alias("longer"), F.min("up_c").alias("end"))
    lost = found.filter(F.col("kind") == LOST).select("c", "wt", zero.alias("leaf"))
    lost = lost.union(found.filter(F.col("kind") == OPEN).join(merged, "id").filter("c <> low").select("c", "wt", zero))
    leaves = found.filter(F.col("kind") == LEAF).select("c", zero, F.lit(1).cast("long"))
    leaves = leaves.union(merged.filter("longer = 0 AND end IS NOT NULL").select("end", zero, F.lit(1).cast("long")))
    handed = lost.union(leaves).groupBy("c").agg(F.max("wt").alias("wt"), F.max("leaf").alias("leaf"))
    known = blocks.join(handed, "c", "left").withColumns({"wt": F.coalesce("wt", zero), "leaf": F.coalesce("leaf", zero)})
    nodes = durable(_passed(known, parts, True, size), "second-pass")

    silent = convs.filter(F.col("total") == 0).select(F.lit(ROOT).alias("id"), "c")
    root = silent.groupBy("id").agg(F.min("c").alias("c"), F.count("*").alias("n"))
    parted = nodes.filter(F.col("kind") == OPEN).select("id", "up", "up_c", "depth", "c", "low_wt", "n", "kids", "leaves", "wt", "before")
    parted = parted.unionByName(root.select("id", "c", "n", zero.alias("depth"), zero.alias("kids"), zero.alias("leaves"), zero.alias("wt"), zero.alias("low_wt"), zero.alias("before")), allowMissingColumns=True)
    sums = [F.sum(x).alias(x) for x in ("n", "kids", "leaves", "wt")] + [F.max(x).alias(x) for x in ("depth", "up", "up_c", "before")]
    joined = durable(parted.groupBy("id").agg(F.min(F.when(F.col("c").isNotNull(), F.struct("c", "low_wt"))).alias("low"), *sums), "open-nodes")
    below = joined.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.count("*").alias("open_kids"))
    parents = joined.select(F.col("id").alias("up"), F.col("low.c").alias("parent_c"))
    ends = nodes.filter(F.col("kind") == END).select("id", "c").union(silent).repartition("id").sortWithinPartitions("id", "c").mapInArrow(_hashed_ends, "id binary, ends string")
    whole = joined.join(below, "id", "left").join(ends, "id", "left").join(parents, "up", "left")
    saved = F.col("wt") - F.col("low.low_wt") - (F.col("n") - 1) * F.col("before")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    parent = F.coalesce("up_c", "parent_c")
    open_ = whole.select(F.col("low.c").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("kids") + F.coalesce("open_kids", zero)).alias("n_children"), F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    closed = nodes.filter(F.col("kind") == CLOSED).select("c", "depth", "up", "up_c", "n", "kids", "leaves", "wt", "ends")
    known_up = closed.filter(F.col("up").isNull()).withColumn("parent_c", F.lit(None).cast("long"))
    closed = known_up.unionByName(closed.filter(F.col("up").isNotNull()).join(parents, "up"))
    closed = closed.select("c", "depth", parent, "n", "kids", "leaves", "wt", "ends")
    return open_.union(closed).toDF(*columns)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), crc(i, v) AS (
  WITH RECURSIVE r(i, v, k) AS (
    SELECT i, i, 0 FROM range(256) x(i)
    UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM r WHERE k < 8
  ) SELECT i, v FROM r WHERE k = 8
), hashed(c, k, v) AS (
  WITH RECURSIVE s(c, k, v) AS (
    SELECT DISTINCT c, 0, CAST(4294967295 AS BIGINT) FROM t
    UNION ALL SELECT s.c, s.k + 1, xor(s.v >> 8, crc.v)
    FROM s JOIN crc ON crc.i = xor(s.v, CAST(ascii(substr(CAST(s.c AS VARCHAR), s.k + 1, 1)) AS BIGINT)) % 256
    WHERE s.k < length(CAST(s.c AS VARCHAR))
  ) SELECT * FROM s
), convs AS (
  SELECT c, c - c % 20 AS base, xor(v, 4294967295) % 4 AS h FROM hashed WHERE k = length(CAST(c AS VARCHAR))
), again AS (
  SELECT v.c, t.p, t.role, t.text FROM convs v JOIN t ON t.c = v.base AND t.p <= v.h
  UNION ALL SELECT v.c, t.p, t.role, t.text FROM convs v JOIN t ON t.c = v.c AND t.p > v.h
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, md5(length(role) || ':' || role || text) AS id,
    CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM again
), paths AS (
  SELECT c, d, w, md5(string_agg(id, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS node FROM turns
  UNION ALL SELECT c, 0, 0, 'root' FROM convs
), lens AS (
  SELECT c, max(d) AS l FROM paths GROUP BY c
), nodes AS (
  SELECT p.d, p.node, min(p.c) AS c, count(*) AS n, max(p.w) AS w,
    coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE l.l = p.d), '') AS ends
  FROM paths p JOIN lens l ON l.c = p.c GROUP BY p.d, p.node
), steps AS (
  SELECT n.*, up.node AS up, (SELECT 0) AS z FROM nodes n LEFT JOIN paths up ON up.c = n.c AND up.d = n.d - 1
), kids AS (
  SELECT d - 1 AS d, up AS node, count(*) AS kids FROM steps WHERE up IS NOT NULL GROUP BY 1, 2
), own AS (
  SELECT s.*, coalesce(k.kids, 0) AS kids FROM steps s LEFT JOIN kids k ON k.d = s.d AND k.node = s.node
), subtree AS (
  SELECT p.d, p.node, count(*) FILTER (WHERE o.kids = 0) AS leaves, sum((o.n - 1) * o.w) AS saved
  FROM own o JOIN paths p ON p.c = o.c AND p.d <= o.d GROUP BY p.d, p.node
)
SELECT o.c AS conv_id, CAST(o.d AS BIGINT) AS depth, parent.c AS parent_conv_id, o.n AS n_convs, o.kids AS n_children,
  s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN subtree s ON s.d = o.d AND s.node = o.node LEFT JOIN own parent ON parent.d = o.d - 1 AND parent.node = o.up
"""
