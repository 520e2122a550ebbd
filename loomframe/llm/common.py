"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bounds of an Arrow batch, so that a Python worker's memory does not follow the length of texts.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where it is unset and the session is local.
    Elsewhere its absence is an error: executors would not see a folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/loomframe/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that durable has written, once nothing that is still to be worked out reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forget_half(memo: dict) -> None:
    """Takes the older half of a memo's entries out of it."""
    for key in list(islice(memo, len(memo) // 2)):
        del memo[key]


_HELD: dict[Hashable, list] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What this worker keeps under a key, made when first asked for. What was last asked for in another stage goes before: a worker
    serves one operator after another, and would else hold the tables and memos of all."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if key not in _HELD or _HELD[key][0] != stage:
        for other in [k for k, (last, _) in _HELD.items() if k != key and last != stage]:
            del _HELD[other]
        _HELD[key] = [stage, _HELD[key][1] if key in _HELD else make()]
    return _HELD[key][1]


def local_table(spark: SparkSession, columns: dict[str, list], schema: StructType) -> DataFrame:
    """A small table of the driver's, by Arrow: rows given to createDataFrame pass through Python workers of their own kind, which then
    stand idle beside the operators' for a minute on every executor."""
    return spark.createDataFrame(pa.table(columns, to_arrow_schema(schema)), schema)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and bytes, from now on: operators are worked out only when their rows are asked for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
