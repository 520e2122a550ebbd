"""Plain versions of what the operators return."""

import hashlib

import numpy as np

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=True):
    """A documents table with clashing extra columns."""
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for c in ("fp", "key", "size", "label", "score", "stats", "ids", "id", "priority"):
        df = df.withColumn(c, F.lit("x")) if extra else df
    return df


def components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def bits(a, b):
    return int(np.bitwise_count(np.uint64(a) ^ np.uint64(b)))
