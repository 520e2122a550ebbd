"""What a Python worker that serves one stage of the pipeline after another holds."""

import gc
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomframe.llm import bpe, common, mixing, toxicity as T
from tests.llm.helpers import docs

MARKS = ["idiot", "blockhead"]


def model():
    m = T.Model(list(MARKS))
    m.floors, m.root, m.weights = np.full(2, 0.5, np.float32), np.eye(2), np.array([1.0, 1.0, 0.1, -2.0])
    m.slope, m.offset = 2.0, -1.0
    return m


def test_a_likeness_holds_no_rows_of_other_words():
    s = T.Scorer(model())
    s.learn({"idiot", "blockhead", *(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100))})
    assert len(s.rows) >= 2 and all(row.base is None for row in s.rows)


def test_tokens_of_few_texts_are_held_at_a_time():
    words = ["".join(w) for w in np.random.default_rng(1).choice(list("abcdefgh"), (300, 7))]
    text = " ".join(words) + " idiot"

    def peak(n):
        s = T.Scorer(model())
        first = s.scores([text, None, ""])
        tracemalloc.start()
        out = s.scores([text, None, "", *[text] * (n - 3)])
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(out[:3], first) and (out[3:] == first[0]).all()
        return held

    assert peak(2_000) < 2 * peak(T.PART)


def test_a_worker_lets_go_of_what_an_earlier_stage_held(spark):
    frame = docs(spark, ["some idiot wrote this", "fine words"], extra=False).coalesce(1)
    bpe.digests(frame).collect()

    def encoders(score: pd.Series) -> pd.Series:
        gc.collect()
        return score * 0 + sum(isinstance(x, bpe.Encoder) for x in gc.get_objects())

    out = T.with_score(frame, model()).withColumn("encoders", F.pandas_udf(encoders, "double")("score")).collect()
    assert [r.encoders for r in out] == [0, 0]


def test_both_operators_of_one_stage_are_held(monkeypatch):
    stage, made = [1], []
    monkeypatch.setattr(common, "_HELD", {})
    monkeypatch.setattr(common, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"stageId": lambda self: stage[0]})())}))
    ask = lambda key: common.held(key, lambda: made.append(key) or key.upper())
    assert [ask("a"), ask("b"), ask("a"), ask("b")] == ["A", "B", "A", "B"] and made == ["a", "b"]
    stage[0] = 2
    assert ask("a") == "A" and made == ["a", "b"] and set(common._HELD) == {"a"}
    assert ask("b") == "B" and made == ["a", "b", "b"]


def test_the_drivers_small_tables_start_no_python_workers(spark):
    frame = docs(spark, ["a b c", "d e", "f", None], extra=False)
    planned = mixing.plan(mixing.sized(frame, "doc_id", "text", "source"))
    assert "PythonRDD" not in planned._jdf.queryExecution().toRdd().toDebugString()
    assert {r.source: r.source_size for r in planned.collect()} == {"a": 3, "b": 2, None: 1}
    assert mixing._local(spark, [(None, None, 1, [1, 2]), ("x", 0.5, 2, [])], "source string, t double, p int, more array<long>").collect() == [(None, None, 1, [1, 2]), ("x", 0.5, 2, [])]
