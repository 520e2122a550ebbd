"""Operator 6: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A row's priority is a hash of its id, so each source's rows stand in a random order that any rerun repeats; the order's
leading bits are its blocks. What a source gives is a sequence of blocks: whole passes, each in an order of its own, and a last
one up to the block in which the target is reached, found from sums of ever finer cells, never from an ordering of all rows. The
block quotas of all sources are split between the two halves of the output shards by a multivariate hypergeometric draw, and so
on down to single shards: each shard's share of a source is the next so many blocks of that source's sequence. A row is taken
once for each of its block's places in the sequence that falls in a shard's share; in a sequence's last block only rows before
the exact cut are. Within a shard rows are ordered by a hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from loomframe.llm.common import WORD, drop, durable, local_table, read

WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS, SEED = 64, 17
#: Words that one output partition holds, about, at most.
PART_WORDS = 20_000_000
BLOCK_BITS = 10
BLOCKS = 1 << BLOCK_BITS
#: A source this near its target (a share of it) takes no further rows; rows that others take once more, at most.
CLOSE, ROUNDS = 0.001, 12
#: So many sources are planned on the driver; more as a table, in groups of so many.
MAX_SOURCES, GROUP = 20_000, 5_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Targets for sources in order: shares of all sizes by repeating weights; what is above most times a source's size goes
    to the others by weight until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float | None] = [None] * len(sizes)
    left = float(sum(sizes))
    while True:
        open_ = [i for i, t in enumerate(out) if t is None]
        whole = sum(w[i] for i in open_)
        above = [i for i in open_ if left * w[i] / whole > most * sizes[i]]
        if not above:
            return [left * w[i] / whole if t is None else t for i, t in enumerate(out)]
        for i in above:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in above)


def split(quotas: np.ndarray, shards: int, seed: int = SEED, shares: list[int] | None = None, group: int | None = None) -> np.ndarray:
    """(shards, sources): how many of each source's draws a shard gets; columns add up to the quotas, rows to shares (equal ones, if not
    named). group: of which group of sources, for draws of its own."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    ends = [total * k // shards for k in range(shards + 1)] if shares is None else [0, *np.cumsum(shares).tolist()]

    def node(first: int, last: int, counts: np.ndarray) -> None:
        if last - first == 1:
            out[first] = counts
            return
        mid = (first + last) // 2
        rng = np.random.default_rng([seed, first, last] if group is None else [seed, first, last, group])
        left = rng.multivariate_hypergeometric(counts, ends[mid] - ends[first], method="marginals")
        node(first, mid, left)
        node(mid, last, counts - left)

    if len(quotas):
        node(0, shards, quotas.astype(np.int64))
    return out


def _limits(sized: DataFrame, rest: DataFrame) -> DataFrame:
    """(source, limit, more): rows of priority under the limit, with those of the priorities in more, come near the source's
    rest of words. More are up to ROUNDS rows that are taken once more, each the largest that still fits, and at last the one
    that leaves the least. They matter for sources of few documents; of others one row is less than CLOSE.

    rest has (source, words, passes, target). Cells of 16 bits, of the next 16 in the cell where the words are reached, then single
    priorities: each level sums at most 65536 cells a source.
    """
    now = rest.select("source", "words", F.lit(0).cast("long").alias("prefix"))
    for used, bits in ((0, 16), (16, 16), (32, 31)):
        shift = 63 - used - bits
        at = now.select(F.col("source").alias("__source"), "words", "prefix")
        own = sized.join(at, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        own = own.filter(F.shiftright("priority", 63 - used) == F.col("prefix")) if used else own
        cell = F.shiftright("priority", shift).alias("cell")
        cells = own.groupBy("source", "words", cell).agg(F.sum("size").alias("size"))
        order = W.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("before", F.sum("size").over(order) - F.col("size"))
        reached = cells.filter("before <= words").groupBy("source").agg(F.max_by(F.struct("cell", "before", "size", "words"), "cell").alias("c"))
        now = reached.select("source", (F.col("c.words") - F.col("c.before")).alias("words"), F.col("c.cell").alias("prefix"), F.col("c.size").alias("size"))
        now = durable(now, "limits")
        if used:
            drop(held)
        held = now
    now = now.join(rest.select(F.col("source").alias("__source"), "passes", "target"), F.col("source").eqNullSafe(F.col("__source")))
    now = now.select("__source", "words", "passes", "target", F.col("prefix").alias("limit"), F.array().cast("array<long>").alias("more"), F.lit(True).alias("open"))
    left, near = F.col("words"), F.col("target") * CLOSE
    for _ in range(ROUNDS):
        wanting = now.filter(F.col("open") & (left > near))
        if wanting.isEmpty():
            break
        own = sized.join(wanting, F.col("source").eqNullSafe(F.col("__source")))
        own = own.filter(((F.col("priority") >= F.col("limit")) | (F.col("passes") < MOST - 1)) & (F.col("size") > 0) & ~F.array_contains("more", F.col("priority")))
        own = own.groupBy("source", "words", "priority").agg(F.sum("size").alias("size"))  # rows of one id are taken together
        row = F.struct("size", "priority")
        best = own.groupBy("source").agg(F.max(F.when(F.col("size") <= left, row)).alias("under"), F.min(F.when(F.col("size") > left, row)).alias("over"))
        now = now.join(best, F.col("source").eqNullSafe(F.col("__source")), "left")
        past = F.col("over.size") - left
        end = F.coalesce((past <= near) | (F.col("under").isNull() & (past < left)), F.lit(False))
        pick = F.when(F.col("open") & (left > near), F.when(end, F.col("over")).otherwise(F.col("under")))
        more = F.when(pick.isNull(), F.col("more")).otherwise(F.array_append("more", pick["priority"]))
        now = now.select("__source", (left - F.coalesce(pick["size"], F.lit(0))).alias("words"), "passes", "target", "limit", more.alias("more"), (pick.isNotNull() & ~end).alias("open"))
        now = durable(now, "limits")
    return now.withColumnRenamed("__source", "source")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), priority(id_col).alias("priority"))


def priority(id_col: str):
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col)), 1)


def plan(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each source of sized rows: source_size, target, passes, limit, more, bounds (the first place of each shard in the
    source's sequence of blocks, and its end), in order of code points with null last."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        return plan_many(rows, shards)
    found = sorted(((r.source, r["size"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in found]
    goal = targets(sizes) if found and sum(sizes) else [0.0] * len(found)
    passes = [int(t // n) if n else 0 for t, n in zip(goal, sizes)]
    names = _local(spark, [(s, t - p * n, p, t) for (s, n), t, p in zip(found, goal, passes)], "source string, words double, passes int, target double")
    limits = {r.source: r for r in _limits(rows, names).collect()}
    lines, quotas = [], []
    for (s, n), t, p in zip(found, goal, passes):
        cut = limits.get(s)
        limit, more = (cut.limit, cut.more) if cut and p < MOST and n else (0, [])
        partial = (limit >> (63 - BLOCK_BITS)) + 1 if limit or more else 0
        quotas.append(p * BLOCKS + partial)
        lines.append((s, n, t, p, limit, more))
    bounds = np.cumsum(np.vstack([np.zeros((1, len(quotas)), np.int64), split(np.array(quotas, np.int64), shards)]), axis=0)
    rows_ = [(*line, [int(x) for x in bounds[:, k]]) for k, line in enumerate(lines)]
    return F.broadcast(_local(spark, rows_, PLANNED))  # MAX_SOURCES rows at most


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    fields = StructType.fromDDL(schema)
    return local_table(spark, {c: [r[k] for r in rows] for k, c in enumerate(fields.names)}, fields)


PLANNED = "source string, source_size long, target double, passes int, limit long, more array<long>, bounds array<long>"


def plan_many(rows: DataFrame, shards: int = SHARDS, group: int = GROUP) -> DataFrame:
    """The same for any number of sources, as a table. Targets rise like water: the level (words a unit of weight) follows from the sums of
    what is full and what is not, a few rounds of sums of one row each. Of the tree, groups of sources are split first, as if each
    were a source, and then each group's share of every shard among its sources: a multivariate hypergeometric draw of parts of a draw
    is one of the whole."""
    spark = rows.sparkSession
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"))
    parts = max(1, math.ceil(sources.count() / (10 * group)))
    dealt = sources.repartitionByRange(parts, F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    dealt = durable(dealt.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tuple(r) for r in dealt.groupBy(part.alias("part")).count().collect())  # one row a range
    before = {p: sum(n for q, n in counts if q < p) for p, _ in counts}
    starts = spark.createDataFrame(list(before.items()), "part long, before long")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("pos") % len(WEIGHTS) + 1).cast("int"))
    listed = dealt.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "size", (F.col("before") + place).alias("pos")).withColumn("w", weight)
    level = 0.0
    while True:
        full = F.col("w") * level > F.col("size") * MOST
        s = listed.agg(F.sum("size").alias("all"), F.sum(F.when(full, F.col("size") * MOST).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w")).first()
        new = (s["all"] - s.held) / s.w if s.w else level
        if new <= level:
            break
        level = new
    full = F.col("w") * level > F.col("size") * MOST
    goal = F.when(full, (F.col("size") * MOST).cast("double")).otherwise(F.col("w") * level)
    passes = F.when(F.col("size") > 0, F.floor(goal / F.col("size"))).otherwise(0).cast("int")
    listed = listed.select("source", "size", "pos", goal.alias("target"), passes.alias("passes"))
    limits = _limits(rows, listed.select("source", (F.col("target") - F.col("passes") * F.col("size")).alias("words"), "passes", "target"))
    cut = limits.select(F.col("source").alias("__source"), "limit", "more", F.lit(True).alias("found"))
    own = listed.join(cut, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    use = F.col("found") & (F.col("passes") < MOST) & (F.col("size") > 0)
    own = own.withColumns({"limit": F.when(use, F.col("limit")).otherwise(F.lit(0).cast("long")), "more": F.when(use, F.col("more")).otherwise(F.array().cast("array<long>"))})
    partial = F.when((F.col("limit") > 0) | (F.size("more") > 0), F.shiftright("limit", 63 - BLOCK_BITS) + 1).otherwise(0)
    own = durable(own.select("source", F.col("size").alias("source_size"), "target", "passes", "limit", "more", "pos", (F.col("passes") * BLOCKS + partial).cast("long").alias("quota"), F.floor(F.col("pos") / group).cast("long").alias("g")), "quotas")
    groups = sorted((r.g, r.q) for r in own.groupBy("g").agg(F.sum("quota").alias("q")).collect())  # one row for GROUP sources
    shares = split(np.array([q for _, q in groups], np.int64), shards)
    shared = spark.createDataFrame([(g, shares[:, k].tolist()) for k, (g, _) in enumerate(groups)], "g long, shares array<long>")

    def places(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        own = split(frame["quota"].to_numpy(np.int64), shards, SEED, list(frame["shares"].iloc[0]), int(frame["g"].iloc[0]))
        bounds = np.cumsum(np.vstack([np.zeros((1, len(frame)), np.int64), own]), axis=0)
        return pd.DataFrame({"pos": frame["pos"], "bounds": [bounds[:, k].tolist() for k in range(len(frame))]})

    bounds = own.select("g", "pos", "quota").join(shared, "g").groupBy("g").applyInPandas(places, "pos long, bounds array<long>")
    out = durable(own.join(bounds, "pos").select(*[c.split()[0] for c in PLANNED.split(", ")]), "plan")
    drop(dealt, own)
    return out


def drawn(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows (with source, priority) with their source's plan and shards: the shard of each time that the mix takes the row."""
    p = planned.withColumnRenamed("source", "__source")
    out = rows.join(p, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    block, end = F.shiftright("priority", 63 - BLOCK_BITS), F.element_at("bounds", -1)
    # a whole pass takes its blocks in an order of its own: an odd factor and an offset, modulo the number of blocks
    turn = lambda e: F.pmod(block * (F.pmod(F.xxhash64(F.lit(SEED), "source", e), F.lit(BLOCKS // 2)) * 2 + 1) + F.pmod(F.xxhash64(e, "source"), F.lit(BLOCKS)), F.lit(BLOCKS))
    place = lambda e: e * BLOCKS + F.when(e < F.col("passes"), turn(e)).otherwise(block)
    # the shard in whose share a place falls; past the end none, and of the last pass' last block only rows before the cut
    cut = lambda e: (e == F.col("passes")) & (place(e) == end - 1) & (F.col("priority") >= F.col("limit"))
    share = lambda at: (F.size(F.filter("bounds", lambda b: b <= at)) - 1).cast("int")
    shard = lambda e: F.when((place(e) < end) & ~cut(e), share(place(e)))
    taken = F.filter(F.transform(F.sequence(F.lit(0), F.col("passes")), shard), lambda s: s.isNotNull())
    # rows taken once more go with a block of the sequence that their own priority picks
    again = F.when(F.array_contains("more", F.col("priority")), F.array(share(F.pmod(F.col("priority"), F.greatest(end, F.lit(1))))))
    return out.withColumn("shards", F.concat(taken, F.coalesce(again, F.array().cast("array<int>"))))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """(id, source, size, source_size, target, taken, shards) for each row of docs.

    Null texts have size 0 and null sources are a source. Rows equal in id and source are taken alike (of them a source's
    taken words may miss the target by all that are equal; else by half a document at most). Empty input: no rows.
    """
    rows = durable(sized(docs, id_col, text_col, source_col), "sizes")
    out = drawn(rows, plan(rows, shards))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """The mixed rows, as often as the mix takes them, columns unchanged, in order of shard and, inside, of a hash. Partitions are
    ranges of that order: each holds a shard or a part of one, about PART_WORDS words at most."""
    names = docs.columns
    rows = durable(sized(docs, id_col, text_col, source_col), "sizes")
    whole = docs.select(F.struct(*names).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), priority(id_col).alias("priority"))
    planned = plan(rows, shards)
    parts = max(shards, math.ceil((planned.agg(F.sum("target").alias("words")).first().words or 0) / PART_WORDS))
    out = drawn(whole, planned).select("row", "id", F.posexplode("shards").alias("turn", "shard"))
    out = out.withColumn("order", F.xxhash64(F.lit(SEED), "shard", "id", "turn"))
    return out.repartitionByRange(parts, "shard", "order").sortWithinPartitions("shard", "order").select("row.*")


def op6_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_plan(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "shards")
