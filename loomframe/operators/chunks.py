"""Sentence-aware chunks of documents and pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions import text as T
from loomframe.operators import vectors as V
from loomframe.sources.shared import small_batches, stored

MOST, LEAST, HARD = 1_200, 400, 1_800
# Where a long unit is cut at best, in order.
SOFT = ("。", "、", "；", "：", ";", ":", "）", ")", " ")
#: What stripping takes away, paragraphs and sentences of normalised texts.
BLANK = " \t\n\x0b\f\r\u3000\u00a0"
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")
_SENTENCE = re.compile(r"[^。！？!?]+[。！？!?]?|[。！？!?]")


def normalised(c: Column) -> Column:
    """LF, spaces for tabs, no blanks before line ends, at most two line ends in a row, stripped."""
    c = F.replace(T.newlines(c), F.lit("\t"), F.lit(" "))
    c = F.regexp_replace(c, r"[ 　]++(?=\n|$)", "")
    return T.stripped(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def units(c: Column) -> Column:
    """Sentences: paragraphs cut after 。！？!?, stripped, blanks dropped; a text without any is its own."""
    cut = F.flatten(F.transform(F.split(c, r"\n\n+"), lambda p: F.split(p, r"(?<=[。！？!?])")))
    own = F.filter(F.transform(cut, T.stripped), lambda s: s != "")
    return F.when((F.size(own) == 0) & (c != ""), F.array(c)).otherwise(own)


def _inner(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the blanks at its ends."""
    part = text[start:end]
    left = len(part) - len(part.lstrip(BLANK))
    return start + left, max(start + left, start + len(part.rstrip(BLANK)))


def unit_spans(text: str, hard: int) -> list[tuple[int, int]]:
    """Spans of the units of a normalised text. One above hard characters is cut after the last line end, else after the last soft
    mark in order of preference, that lies in the second half; else at the bound."""
    out = []
    for paragraph in _PARAGRAPH.finditer(text):
        for m in _SENTENCE.finditer(text, *paragraph.span()):
            start, end = _inner(text, *m.span())
            while end - start > hard:
                places = (text.rfind(mark, start, start + hard) - start for mark in ("\n", *SOFT))
                cut = start + next((p + 1 for p in places if p >= max(1, hard // 2)), hard)
                out.append(_inner(text, start, cut))
                start = _inner(text, cut, end)[0]
            out.append((start, end))
    return [(a, b) for a, b in out if a < b]


def chunk_numbers(lengths: list[int], most: int, least: int, hard: int) -> list[int]:
    """Chunk numbers for unit lengths: a chunk grows while it stays within most (a line end between units counts), is closed once
    it has least, may grow to hard if it is shorter, and is closed else."""
    out, no, size = [], 0, -1
    for n in lengths:
        more = size + 1 + n
        if size < 0 or more <= most or (size < least and more <= hard):
            size = more if size >= 0 else n
        else:
            no, size = no + 1, n
        out.append(no)
    return out


def _chunks(most: int, least: int, hard: int, paged: bool):
    """Arrow function: pages of normalised texts and their numbers -> chunks. A fold over a document, so no JVM expression."""

    def one(texts, numbers) -> list[tuple]:
        units_ = [(t[a:b], a, b, int(p)) for t, p in zip(texts, numbers) for a, b in unit_spans(t, hard)]
        grouped: dict[int, list] = {}
        for no, u in zip(chunk_numbers([len(u[0]) for u in units_], most, least, hard), units_):
            grouped.setdefault(no, []).append(u)
        out, at = [], 0
        for no, us in grouped.items():
            text = "\n".join(u[0] for u in us)
            start, end = (at, at + len(text)) if paged else (us[0][1], us[-1][2])
            at += len(text) + 1
            out.append((no, text, us[0][3], us[-1][3], start, end))
        return out

    def run(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([one(t, p) for t, p in zip(texts, numbers)], dtype=object)

    return F.pandas_udf(run, "array<struct<chunk_index int, text string, page_start long, page_end long, span_start int, span_end int>>")


def _out(rows: DataFrame, chunks: Column) -> DataFrame:
    own = rows.select("doc_id", F.inline(chunks))
    return own.withColumn("chunk_len_tokens", T.estimate_tokens(F.col("text")))


def chunk_documents(docs: DataFrame, most: int = MOST, least: int = LEAST, hard: int = HARD) -> DataFrame:
    """(doc_id, chunk_index, text, chunk_len_tokens, span_start, span_end); null and blank texts have no chunks. Spans are of the
    normalised text: what stands there is the chunk up to white space between its units."""
    small_batches(docs.sparkSession)
    own = docs.filter("text is not null").select("doc_id", F.array(normalised(F.col("text"))).alias("texts"), F.array(F.lit(0).cast("long")).alias("numbers"))
    return _out(own, _chunks(most, least, hard, False)("texts", "numbers")).drop("page_start", "page_end")


def chunk_pages(pages: DataFrame, most: int = MOST, least: int = LEAST, hard: int = HARD) -> DataFrame:
    """The same over pages, each normalised and split by itself, with the first and last page of each chunk. Pages have no common
    text, so spans are of the chunks joined by line ends."""
    small_batches(pages.sparkSession)
    own = pages.filter("text is not null").select("doc_id", F.col("page_no").cast("long").alias("page_no"), normalised(F.col("text")).alias("text"))
    own = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return _out(own, _chunks(most, least, hard, True)("p.text", "p.page_no"))


#: What sources must name for their metadata and manifest rows.
SOURCE = ("collection_id", "shard_id", "doc_id", "file", "source_pdf_path", "source_text_path", "source_pages_path", "source_text_kind", "sha256", "embed_model", "attrs")
META = ("collection_id", "shard_id", "doc_id", "file", "file_name", "vector_index", "chunk_id", "chunk_index", "text", "span_start", "span_end", "chunk_len_tokens", "page_start", "page_end", "source_pdf_path", "source_text_path", "source_pages_path", "source_text_kind", "sha256", "embed_model", "ingested_at", "attrs")
MANIFEST = ("collection_id", "shard_id", "doc_id", "file", "sha256", "source_pdf_path", "source_text_path", "source_text_kind", "embed_model", "ingested_at", "attrs")


def _sources(sources: DataFrame, ingested_at: Column | str) -> DataFrame:
    """Sources with paths relative, kinds normalised, missing texts empty and missing attrs an empty object."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in sources.columns else F.lit("")
    make = {c: T.relative_path(text(c)) for c in ("source_pdf_path", "source_text_path", "source_pages_path")}
    make |= {"source_text_kind": T.source_kind(text("source_text_kind")), "attrs": F.coalesce(T.blank_to_null(text("attrs")), F.lit("{}"))}
    at = F.lit(ingested_at) if isinstance(ingested_at, str) else ingested_at
    return sources.select(*[make.get(c, text(c)).alias(c) for c in SOURCE], at.alias("ingested_at"))


def _same_count(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """chunks with their page_start and page_end from ranges (doc_id, chunk_index, page_start, page_end); a document whose chunks and
    ranges are not the same is an error."""
    both = chunks.drop("page_start", "page_end").join(ranges.withColumn("__range", F.lit(True)), ["doc_id", "chunk_index"], "full_outer")
    odd = F.col("text").isNull() | F.col("__range").isNull()
    said = F.raise_error(F.concat(F.lit("chunks and page ranges of a document differ: "), F.col("doc_id").cast("string")))
    return both.withColumn("text", F.when(odd, said.cast("string")).otherwise(F.col("text"))).drop("__range")


def meta_rows(chunks: DataFrame, sources: DataFrame, base: DataFrame, ingested_at: Column | str, ranges: DataFrame | None = None) -> DataFrame:
    """Metadata (the columns META) of chunks (doc_id, chunk_index, text, span_start, span_end, chunk_len_tokens), joined with their
    sources (SOURCE; a missing column is empty).

    Blank chunks are left out. vector_index goes on from base (shard_id, base) in each shard, by document and chunk. Pages come from
    ranges where given, else from the chunks, else they are 0; negative and bad pages are 0. Chunks are stored once; rows are joined and
    numbered without their texts, which meet them at the end.
    """
    held = stored(chunks.withColumn("__row", F.monotonically_increasing_id()), "chunks")
    own = held.withColumn("text", F.when(T.stripped(F.col("text")) == "", "").when(F.col("text").isNotNull(), "x"))  # stands for the text
    own = own if ranges is None else _same_count(own, ranges)
    own = own.filter(T.stripped(F.coalesce("text", F.lit(""))) != "").withColumn("doc_id", F.col("doc_id").cast("string"))
    page = lambda c: T.page_no(F.col(c).cast("string")).cast("long") if c in own.columns else F.lit(0).cast("long")
    rows = own.select("__row", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "span_start", "span_end", "chunk_len_tokens", page("page_start").alias("page_start"), page("page_end").alias("page_end"))
    rows = stored(rows.join(_sources(sources, ingested_at), "doc_id"), "rows")  # numbering reads them twice
    rows = V.dense_index(rows, base).join(held.select("__row", "text"), "__row")
    named = rows.withColumn("chunk_id", T.chunk_id(F.col("doc_id"), F.col("chunk_index"))).withColumn("file_name", T.base_name(F.col("file")))
    return named.select(*META)


def manifest_rows(meta: DataFrame, sources: DataFrame, ingested_at: Column | str) -> DataFrame:
    """The manifest's rows (the columns MANIFEST) of the sources that have metadata: one a document."""
    known = meta.select("shard_id", "doc_id").distinct()
    return _sources(sources, ingested_at).join(known, ["shard_id", "doc_id"], "left_semi").select(*MANIFEST)
