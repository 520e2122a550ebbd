"""Arrow batches of texts are bounded by rows and bytes, whatever the session's defaults."""

import pandas as pd
from pyspark.sql import functions as F

from loomframe.operators import chunks as K, corpus as C, store as S
from loomframe.sources.shared import BATCH_BYTES, BATCH_ROWS

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def sizes(texts: pd.Series) -> pd.Series:
    """Of each text: rows and characters of its batch."""
    return texts.map(lambda t: [float(len(texts)), float(texts.map(len).sum())])


def defaults(spark):
    for key in KEYS:
        spark.conf.unset(key)


def test_batches_of_texts_are_bounded(spark):
    defaults(spark)
    rows = spark.range(6_000, numPartitions=1)
    short = S.embedded(rows.select(F.lit("a b").alias("text")), sizes).agg(F.max(F.col("embedding")[0])).first()[0]
    long = S.embedded(rows.limit(300).select(F.repeat(F.lit("ab "), 100_000).alias("text")), sizes).agg(F.max(F.col("embedding")[1])).first()[0]
    assert short <= BATCH_ROWS and long <= 2 * BATCH_BYTES


def test_chunks_and_cleaning_bound_their_batches(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    pages = docs.withColumn("page_no", F.lit(1))
    for run in (lambda: K.chunk_documents(docs), lambda: K.chunk_pages(pages), lambda: C.tagged_lines(docs), lambda: C.repeated_lines(C.lines(docs))):
        defaults(spark)
        run()
        assert int(spark.conf.get(KEYS[0])) <= BATCH_ROWS and int(spark.conf.get(KEYS[1])) <= BATCH_BYTES
