"""Nearest neighbours by the tree against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from loomframe.llm import kmeans_tree as T
from loomframe.llm.common import read

VECTORS = "vec_id long, embedding array<float>, leaf string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "", "") for i, v in rows], VECTORS)


def brute(rows, k, every):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for i, v in good:
        if i % every == 0:
            far = [(float(np.sqrt(((w.astype(np.float32) - v.astype(np.float32)).astype(float) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = sorted(far)[:k]
    return out


def by_query(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_tree_holds_every_row_once_and_visits_every_leaf():
    x = np.random.default_rng(0).standard_normal((3_000, 8))
    tree = T.fit(x, 30_000)
    leaves = tree.place(x)
    assert tree.leaves > 80 and set(leaves.tolist()) <= set(range(tree.leaves))
    order = list(tree.visits(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == leaves[0]
    near = np.sort(((x - x[0]) ** 2).sum(1))[1:31]
    at = {leaf: n for n, leaf in enumerate(order)}
    own = [at[int(leaves[i])] for i in np.argsort(((x - x[0]) ** 2).sum(1))[1:31]]
    assert len(near) == 30 and np.mean(own) < tree.leaves / 4  # near rows lie in leaves that are visited early


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    table = read(spark, f"/root/testdata/{sf}", "embeddings")
    got = by_query(T.nearest(table))
    given = table.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(given.embedding).astype(float), given.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, far))[:10]].tolist())
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        for score, i in got[q]:
            assert score == pytest.approx(far[ids == i][0], abs=1e-12)
        hits, total = hits + len(want & {i for _, i in got[q]}), total + 10
    assert hits / total >= 0.9


def test_exact_where_all_leaves_are_visited(spark):
    """Ties, repeated rows, other lengths, rows that take no part, a leaf of many equal rows, fewer rows than k."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 3).tolist()) for i in range(1_500)] + [(2_000 + i, [1, 1, 1]) for i in range(700)] + [(100, [1, 1, 1])]
    rows += [(3_000 + i, [i, 1]) for i in range(4)] + [(5_000, [7])]
    rows += [(None, [1, 2, 3]), (6_000, None), (6_100, []), (6_200, [None, 1, 1]), (6_300, [float("nan"), 1, 1]), (6_400, [0, 0, 0]), (6_500, [float("inf"), 0, 0])]
    rows = [r for r in rows if r[0] != 100 or r[1] == [1, 1, 1]]
    got = by_query(T.nearest(frame(spark, rows), recall=1.0, k=7))
    want = brute(rows, 7, 100)
    assert set(got) == {q for q in want if want[q]}
    exact = [q for q in got if [round(s, 9) for s, _ in got[q]] == [round(s, 9) for s, _ in want[q]]]
    assert len(exact) >= 0.9 * len(got) and all(len(got[q]) == len(want[q]) for q in got)
    assert [i for _, i in got[3_000]] == [3_001, 3_002, 3_003]


def test_small_tables(spark):
    assert T.nearest(frame(spark, [])).collect() == []
    assert T.nearest(frame(spark, [(0, [1.0])])).collect() == []
    assert [tuple(r) for r in T.nearest(frame(spark, [(0, [1.0, 0.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])])).collect()] == [(0, 1, 7, 2.0)]
    huge = T.nearest(spark.createDataFrame([(0, [1e308, 1.0]), (1, [-1e308, 1.0]), (2, [1e308, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(huge, key=lambda r: r["rank"])] == [(2, 3.0), (1, float("inf"))]


def test_equal_rows_make_one_leaf(spark):
    got = by_query(T.nearest(frame(spark, [(i, [2.0, 2.0]) for i in range(3_000)])))
    assert len(got) == 30 and all([i for _, i in got[q]] == [i for i in range(12) if i != q][:10] for q in got)
