import math
from collections import defaultdict

import numpy as np
import pytest

from loomframe.llm import mixing as M, topk as K
from loomframe.llm.common import read
from tests.llm.helpers import SF, docs


def test_targets_stop_at_three_times_the_size():
    assert M.targets([100, 100, 100]) == pytest.approx([300 * 5 / 8, 300 * 2 / 8, 300 / 8])
    out = M.targets([10, 1000, 1000, 20])
    assert out[0] == 30 and out[3] == 60 and sum(out) == pytest.approx(2030) and out[1] == pytest.approx(2 * out[2])
    assert M.targets([0, 5]) == [0, 5]


def test_tree_shares_out_all_quotas():
    quotas = np.array([1000, 7, 0, 350])
    parts = M.split(quotas, 10)
    assert (parts.sum(0) == quotas).all() and set(parts.sum(1)) <= {135, 136}
    assert (parts == M.split(quotas, 10)).all()
    assert abs(parts[:, 0] - 100).max() < 60


def test_sources_come_near_their_targets(spark):
    d = read(spark, SF, "documents")
    rows = M.mix_plan(d, shards=8).collect()
    again = {r.doc_id: r.taken for r in M.mix_plan(d.repartition(7), shards=8).collect()}
    assert {r.doc_id: r.taken for r in rows} == again
    size, taken, target, sizes = defaultdict(int), defaultdict(int), {}, defaultdict(list)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        sizes[r.source] += [r.size] * (r.size > 0)
        assert r.taken <= 3 * r.size and r.taken == r.size * len(r.shards) and all(0 <= s < 8 for s in r.shards)
    names = sorted(size)
    for name, goal in zip(names, M.targets([size[n] for n in names])):
        assert target[name] == pytest.approx(goal) and abs(taken[name] - goal) <= max(0.01 * goal, min(sizes[name]) / 2)
    mixed = M.mix(d, shards=8)
    assert mixed.columns == d.columns
    count = defaultdict(int)
    for r in mixed.collect():
        count[r.doc_id] += 1
    assert all(count[r.doc_id] == len(r.shards) for r in rows)


def test_targets_by_a_plain_reading():
    """Shares by weight among the sources that are not yet at three times their size, again and again."""
    rng = np.random.default_rng(9)
    for _ in range(40):
        sizes = [int(x) for x in rng.integers(0, 50, rng.integers(1, 12)) ** 2]
        weights, full = [(5, 2, 1)[i % 3] for i in range(len(sizes))], set()
        while True:
            left = sum(sizes) - sum(3 * sizes[i] for i in full)
            whole = sum(w for i, w in enumerate(weights) if i not in full)
            goal = [3 * n if i in full else left * weights[i] / whole for i, n in enumerate(sizes)]
            over = {i for i, g in enumerate(goal) if i not in full and g > 3 * sizes[i]}
            if not over:
                break
            full |= over
        assert M.targets(sizes) == pytest.approx(goal)


def test_shards_take_what_the_tree_gives_them(spark):
    d = docs(spark, ["w " * (1 + i % 7) for i in range(3000)])
    rows = M.mix_plan(d, shards=16).collect()
    words = np.zeros(16)
    for r in rows:
        for s in r.shards:
            words[s] += r.size
    assert abs(words - words.mean()).max() < 0.2 * words.mean()
    planned = M.plan(M.sized(d, "doc_id", "text", "source"), 16).collect()
    assert all(len(r.bounds) == 17 and r.bounds == sorted(r.bounds) for r in planned)


def test_the_plan_as_a_table_is_that_of_the_driver_but_for_its_draws(spark):
    d = read(spark, SF, "documents")
    rows = M.durable(M.sized(d, "doc_id", "text", "source"), "sizes")
    one = {r.source: r for r in M.plan(rows, 16).collect()}
    many = {r.source: r for r in M.plan_many(rows, 16, group=2).collect()}
    assert one.keys() == many.keys()
    for name, r in one.items():
        m = many[name]
        assert (m.source_size, m.passes, m.limit, m.more, m.bounds[0], m.bounds[-1]) == (r.source_size, r.passes, r.limit, r.more, 0, r.bounds[-1])
        assert m.target == pytest.approx(r.target) and m.bounds == sorted(m.bounds)
    ends = [sum(r.bounds[k] for r in one.values()) for k in range(17)]
    assert ends == [sum(r.bounds[k] for r in many.values()) for k in range(17)]  # shards get the same numbers of blocks


def test_fifty_thousand_sources(spark):
    from pyspark.sql import functions as F

    n = 50_000
    df = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + F.when(F.col("id") == 3, 40_000).otherwise(1)).cast("int")).alias("text"), F.when(F.col("id") % n > 0, F.format_string("s%05d", F.col("id") % n)).alias("source"))
    rows = M.mix_plan(df, shards=8).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"] and len(r.shards) * r["size"] == r.taken
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert len(names) == n and len(rows) == 2 * n
    for name, goal in zip(names, M.targets([size[s] for s in names])):
        assert target[name] == pytest.approx(goal)
        assert abs(taken[name] - goal) <= max(0.01 * goal, 7)
    assert sum(taken.values()) == pytest.approx(sum(size.values()), rel=0.02)


def test_repeated_rows_and_many_small_sources(spark):
    rows = [(k, "w " * (1 + k % 3), f"s{k % 300:03d}") for k in range(600)]
    out = M.mix_plan(spark.createDataFrame(rows + rows[:50], "doc_id long, text string, source string")).collect()
    assert len(out) == 650
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        taken[r.source], size[r.source], target[r.source] = taken[r.source] + r.taken, size[r.source] + r.size, r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 3 for s in taken) and abs(sum(taken.values()) - sum(size.values())) <= 0.2 * sum(size.values())


def test_odd_rows(spark):
    df = docs(spark, ["a b c", None, "", "d " * 500, "e", "f g"])
    rows = {r.doc_id: r for r in M.mix_plan(df).collect()}
    assert rows[1].size == rows[2].size == 0 and rows[1].taken == 0 and rows[2].source is None
    assert M.mix(df).columns == df.columns
    assert M.mix_plan(df.limit(0)).count() == 0 and M.mix(df.limit(0)).count() == 0
    assert M.mix_plan(df.withColumn("text", df.text.substr(0, 0))).count() == 6
    twice = M.mix_plan(df.union(df)).collect()
    assert len(twice) == 12


def brute(rows, k=20):
    v = [(i, np.array([math.floor(64 * c) for c in x], object)) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, a in v:
        if q % 20 == 0:
            s = sorted(((-min(max(int(a @ b), -(2**63)), 2**63 - 1), i) for i, b in v if i != q and len(a) == len(b)))[:k]
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return sorted(out)


def test_exact_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(200)]
    rows += [(200 + i, [0.5] * 8) for i in range(60)]  # many equal vectors
    rows += [(300, None), (301, []), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [0.1] * 8), (320, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "'y' as v")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_k(df).collect())
    assert got == brute(rows)
    assert K.top_k(df.limit(0)).count() == 0


def test_components_that_floats_cannot_sum(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(100)]
    rows += [(100, [1e12, -1e12, 3.0, 0.1]), (101, [float(2**54), 1.0, 0.0, 0.0]), (120, [float(2**40 + 1), 0.5, 0.0, -1.0]), (121, [3e5] * 4), (140, [4e5, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in K.top_k(df).collect()) == brute(rows)


def test_repeated_rows_and_vectors_of_one_id(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(20, [0.5, 0.5])] * 2 + [(1, [1.0, 1.0])] * 2 + [(1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in K.top_k(df).collect()) == sorted([(0, 20, 2048), (0, 1, 4096), (0, 1, 8192), (20, 0, 2048), (20, 1, 4096), (20, 1, 4096)])


def test_blocks_agree_with_one(spark, monkeypatch):
    df = read(spark, SF, "embeddings")
    whole = {tuple(r) for r in K.top_k(df).collect()}
    monkeypatch.setattr(K, "ROWS", 97)
    monkeypatch.setattr(K, "QUERIES", 7)
    assert {tuple(r) for r in K.top_k(df).collect()} == whole


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 10, (2000, 2)).round()
    lists, depths = K.Lists(x), []
    read_ = lists.read
    lists.read = lambda d, rows: depths.append(d) or read_(d, rows)
    q, v, s = K.nra(lists, np.arange(2000), np.array([[3.0, 1.0]]), np.array([5]), 20)
    assert max(depths) < 2000 and len(s) == 20
    best = sorted(((-float(x[i] @ [3, 1]), i) for i in range(2000) if i != 5))[:20]
    assert v.tolist() == [i for _, i in best]
