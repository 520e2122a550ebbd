"""An append cuts each new text once and moves no text from there on."""

import math
import random
import re

from pyspark.sql import functions as F

from loomframe.functions import text as T
from loomframe.operators import chunks as K, store as S, vectors as V
from loomframe.plans.records import lengths


def test_texts_are_cut_once_and_numbered_without_them(spark, monkeypatch):
    cut, seen, chunked, numbered = spark.sparkContext.accumulator(0), [], K.chunk_documents, V.dense_index

    def counted(text):
        cut.add(1)
        return text

    count = F.udf(counted).asNondeterministic()
    monkeypatch.setattr(K, "chunk_documents", lambda docs: chunked(docs.withColumn("text", count("text"))))
    monkeypatch.setattr(V, "dense_index", lambda rows, base: seen.append(rows.columns) or numbered(rows, base))
    embed = lambda rows: S.embedded(rows, lengths)
    texts = [("s", "a", "one. " * 600), ("s", "b", "two"), ("s", "b", " "), ("t", "a", "three"), ("t", "c", "\u3000\n"), ("t", "d", None)]
    own = spark.createDataFrame(texts, "shard_id string, doc_id string, text string")
    first, result = S.grown(S.empty_store(spark, ["s", "t"], 2), own.filter("doc_id <> 'a'"), embed)
    assert cut.value == 1
    assert sorted(map(tuple, result.collect())) == [("s", "b", "error"), ("s", "b", "ok"), ("t", "c", "error"), ("t", "d", "error")]
    store, result = S.grown(first, own, embed)
    assert cut.value == 3 and len(seen) == 2 and not any("text" in columns for columns in seen)
    assert sorted(map(tuple, result.collect())) == [("s", "a", "ok"), ("s", "b", "skip"), ("s", "b", "skip"), ("t", "a", "ok"), ("t", "c", "error"), ("t", "d", "error")]
    meta = sorted((r.shard_id, r.vector_index, r.doc_id) for r in store["meta"].collect())
    assert [m[1:] for m in meta if m[0] == "s"] == [(0, "b"), (1, "a"), (2, "a")] and [m for m in meta if m[0] == "t"] == [("t", 0, "a")]
    assert {(r.shard_id, r.vector_index): r.embedding[0] for r in store["vectors"].collect()}[("s", 0)] == 3.0
    assert sorted(map(tuple, store["manifest"].select("shard_id", "doc_id").collect())) == [("s", "a"), ("s", "b"), ("t", "a")]


def test_faster_patterns_keep_their_rules(spark, monkeypatch):
    """Tokens and sentences as the plain patterns give them."""
    r = random.Random(3)
    texts = ["".join(r.choice("aZ_09 \t\n\r\u3000\u00a0\u2028\u0130é。！?!.日本、😀") for _ in range(r.randrange(60))) for _ in range(2_000)] + ["", " ", "\u3000", "A", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    text = F.col("text")
    got = {x.i: x for x in rows.select("i", T.estimate_tokens(text).alias("n"), T.is_blank(text).alias("blank"), (T.stripped(F.coalesce(text, F.lit(""))) == "").alias("stripped")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words, rest = len(re.findall("[A-Za-z0-9_]+", t)), len(re.sub("[A-Za-z0-9_ \t\n\x0b\f\r\u3000\u00a0]+", "", t))
        assert got[i].n == (max(1, rest + math.floor(words * 1.3)) if t else 0), repr(t)
        assert got[i].blank == got[i].stripped, repr(t)
    now = [K.unit_spans(t or "", 25) for t in texts]
    monkeypatch.setattr(K, "_SENTENCE", re.compile(r".*?[。！？!?]|.+", re.S))
    assert now == [K.unit_spans(t or "", 25) for t in texts]
