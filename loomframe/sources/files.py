"""Catalogues of files, page tables of several shapes, and texts of uncertain encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomframe.functions import text as T

#: Encodings tried in order; the last way puts a mark for what can't be read.
ENCODINGS = ("utf-8-sig", "utf-16", "shift_jis", "cp932")


def catalogue(paths: DataFrame) -> DataFrame:
    """(path) -> (collection_id, shard_id, doc_id, pdf_filename) of <collection>/pdfs/<shard>/<name>.pdf, whatever the case of
    the suffix; other paths are left out."""
    pattern = r"(?i)([^/]+)/pdfs/([^/]+)/([^/]+)\.pdf$"
    part = lambda k: F.regexp_extract("path", pattern, k)
    own = paths.filter(F.col("path").rlike(pattern))
    return own.select(part(1).alias("collection_id"), part(2).alias("shard_id"), part(3).alias("doc_id"), T.base_name(F.col("path")).alias("pdf_filename"))


def scan_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue of the PDF files under a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return catalogue(files.select("path"))


def read_pages(tables: DataFrame, json: str = "json") -> DataFrame:
    """(doc_id, json) -> (doc_id, page_no, text): a list, or an object with pages, page_texts or pages_text_list; items are texts,
    numbered from 1, or objects with page_no, page or page_number. Pages of no positive number go; bad JSON has none."""
    v = F.try_parse_json(json)
    get = lambda path: F.try_variant_get(v, path, "array<variant>")
    items = F.coalesce(get("$"), get("$.pages"), get("$.page_texts"), get("$.pages_text_list"))
    own = tables.select("doc_id", F.posexplode(items).alias("at", "item"))
    number = F.coalesce(*[F.try_variant_get("item", f"$.{k}", "long") for k in ("page_no", "page", "page_number")])
    plain = F.schema_of_variant("item") == "STRING"
    no = F.when(plain, F.col("at") + 1).otherwise(number).cast("long")
    text = F.when(plain, F.try_variant_get("item", "$", "string")).otherwise(F.coalesce(F.try_variant_get("item", "$.text", "string"), F.lit("")))
    return own.select("doc_id", no.alias("page_no"), text.alias("text")).filter("page_no > 0")


def page_tables(pages: DataFrame, kind: str) -> DataFrame:
    """(doc_id, table): one JSON object for each document, pages in order."""
    own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no"), F.col("text")))).alias("pages"))
    return own.select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), F.lit(kind).alias("kind"), F.col("doc_id"), F.col("pages"))).alias("table"))


def decoded(raw: Column | str) -> Column:
    """Struct (text, encoding) of bytes: the first encoding that reads them all, else UTF-8 with marks (replace)."""

    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for b in values:
            for name in ENCODINGS if b is not None else ():
                if name == "utf-16" and b[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                    continue
                try:
                    rows.append((b.decode(name), name))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                rows.append((None, None) if b is None else (b.decode("utf-8", "replace"), "replace"))
        return pd.DataFrame(rows, columns=["text", "encoding"])

    return F.pandas_udf(run, StructType([StructField("text", StringType()), StructField("encoding", StringType())]))(raw)


def pretty_json(c: Column | str) -> Column:
    """Struct (text, failed): JSON laid out over lines; what does not parse stays as it is."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.try_parse_json(c)
    return F.struct(F.coalesce(F.to_json(v, {"pretty": "true"}), c).alias("text"), v.isNull().alias("failed"))
