"""Corpus text cleaning as a job over a table of lines, pages of lines, and documents from pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomframe.functions import text as T
from loomframe.sources.shared import small_batches

# Headings that stand alone, and how headings, bullets and lines of contents begin.
HEADINGS = ("目次", "まえがき", "前書き", "序", "序文", "資料", "資料編", "参考資料")
HEADING = r"^(第\s*\d+\s*[章節項]|[IVX]+\.|\d+\s*[.)]|\(\d+\)|（\d+）|[〇○●◎■◆◇・※\-])"
CONTENTS = r"^\s*((第\s*\d+\s*[章節項])|([IVX]+[.\s])|(\d+\s*[.)])).*(\s*[0-9]{1,3}\s*)$"


@dataclass(frozen=True)
class Options:
    nfkc: bool = True
    join_japanese: bool = True
    drop_garbage: bool = True
    toc_min_run: int = 6
    repeated_min: int = 3
    repeated_most: int = 40
    join_wrapped: bool = True


def inline(c: Column, nfkc: bool = True, join_japanese: bool = True) -> Column:
    """One text's newlines, compatibility forms, runs of decoration, lone pipes and spaces; then no spaces between Japanese
    characters and digits (line ends there go too)."""
    c = T.newlines(c)
    c = T.nfkc(c) if nfkc else c
    # what is too much of a run goes, in one pass: three ・ or ー leave one, four dots three, three = two
    c = F.regexp_replace(c, r"・{2,}(?=・)|ー{2,}(?=ー)|(?<=\.\.\.)\.+|(?<===)=+", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s[|｜]\s", " "), r"[ \t]{2,}", " ")
    if join_japanese:
        c = F.regexp_replace(c, rf"(?<=[{T.JAPANESE}])[{T.SPACE}]+(?=[{T.JAPANESE}0-9])|(?<=[0-9])[{T.SPACE}]+(?=[{T.JAPANESE}])", "")
    return c


def is_heading(c: Column) -> Column:
    s = T.stripped(c)
    return s.rlike(HEADING) | s.isin(*HEADINGS)


def is_decoration(c: Column) -> Column:
    s = T.stripped(c)
    return (s != "") & (s.rlike(r"[ー―─\-_=・.。]{5,}") & s.rlike(r"(ー|―|─|-|_|=|・|\.|。){5,}") | ((T.share(s, T.SYMBOLS) >= 0.7) & (F.char_length(s) >= 6)) | s.rlike(r"^[|｜¦┃\s]{4,}$"))


def is_tiny(c: Column) -> Column:
    s = T.stripped(c)
    return (s != "") & ~is_heading(s) & (F.char_length(s) <= 2) & ~s.rlike(r"^[0-9]{1,3}$")


def is_garbage(c: Column) -> Column:
    """Short Latin lines. Ordinary English lines are such too: leave it off for corpora that are not Japanese."""
    s = T.stripped(c)
    latin = T.share(s, "A-Za-z")
    return (s != "") & ~is_heading(s) & (F.char_length(s) <= 60) & (T.share(s, T.JAPANESE) < 0.10) & (latin + T.share(s, T.SYMBOLS) >= 0.60) & (latin >= 0.25)


def is_contents(c: Column) -> Column:
    s = T.stripped(c)
    loose = s.rlike(r"\s[0-9]{1,3}\s*$") & (T.share(s, T.SYMBOLS) >= 0.35) & (F.char_length(s) >= 8) & s.rlike(r"^(第\s*\d+|[IVX]+\.|\d+\s*[.)])")
    return (s == "目次") | s.rlike(CONTENTS) | loose


def canonical(c: Column, nfkc: bool = True) -> Column:
    s = T.stripped(c)
    return F.regexp_replace(T.nfkc(s) if nfkc else s, r"[ \t]{2,}", " ")


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 0, line); a null text has none."""
    return docs.select("doc_id", F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def tag_contents(rows: DataFrame, least: int = 6) -> DataFrame:
    """rows with toc: lines of contents in a run of at least so many lines (two at least)."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    flag = is_contents(F.col("line")).alias("c")
    own = rows.withColumn("c", flag).withColumn("n", F.row_number().over(order))
    own = own.withColumn("g", F.col("n") - F.row_number().over(W.partitionBy("doc_id", "c").orderBy("line_no")))
    size = F.count("*").over(W.partitionBy("doc_id", "c", "g"))
    return own.withColumn("toc", F.col("c") & (size >= max(2, least))).drop("c", "n", "g")


def repeated_lines(rows: DataFrame, least: int = 3, most: int = 40, nfkc: bool = True) -> DataFrame:
    """(doc_id, canon, count) of lines found so often in a document and no longer than most; headings are exempt."""
    small_batches(rows.sparkSession)
    own = rows.select("doc_id", canonical(F.col("line"), nfkc).alias("canon")).filter("canon <> ''")
    out = own.groupBy("doc_id", "canon").agg(F.count("*").alias("count"))
    return out.filter((F.col("count") >= max(2, least)) & (F.char_length("canon") <= max(10, most)) & ~is_heading(F.col("canon")))


def measured(rows: DataFrame, nfkc: bool = True, shares: bool = True) -> DataFrame:
    """rows with what the predicates look at, each worked out once: the stripped line, its canonical form, its length, shares of
    symbols and, if asked for, of Latin and Japanese characters, and whether it is a heading."""
    own = rows.withColumn("s", T.stripped(F.col("line"))).withColumn("n", F.char_length("s"))
    share = lambda characters: F.when(F.col("n") == 0, 0.0).otherwise((F.col("n") - F.char_length(F.regexp_replace("s", f"[{characters}]+", ""))) / F.col("n"))
    own = own.withColumn("symbols", share(T.SYMBOLS))
    own = own.withColumn("latin", share("A-Za-z")).withColumn("japanese", share(T.JAPANESE)) if shares else own
    # plain ASCII is its own compatibility form, so only other lines go through Python
    other = T.nfkc(F.when(F.octet_length("s") > F.col("n"), F.col("s")))
    own = own.withColumn("canon", F.coalesce(other, F.col("s")) if nfkc else F.col("s"))
    wide = F.contains("canon", F.lit("  ")) | F.contains("canon", F.lit("\t"))
    own = own.withColumn("canon", F.when(wide, F.regexp_replace("canon", r"[ \t]{2,}", " ")).otherwise(F.col("canon")))
    return own.withColumn("heading", F.col("s").rlike(HEADING) | F.col("s").isin(*HEADINGS))


def tagged_lines(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """Measured lines of normalised texts with the reason why each is dropped: decoration, tiny, garbage, toc, repeated; null if
    kept. Later reasons look only at what earlier ones leave, as contents runs and repeats are counted there. One pass: all
    windows are over parts of documents, whose texts are shuffled once, before they are cut into lines.
    """
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text").repartition("doc_id")  # the one shuffle, of whole texts
    rows = measured(lines(own.select("doc_id", inline(F.col("text"), o.nfkc, o.join_japanese).alias("text"))), o.nfkc, o.drop_garbage)
    s, n, some = F.col("s"), F.col("n"), F.col("n") > 0
    decoration = ((F.col("symbols") >= 0.7) & (n >= 6)) | ((n >= 5) & s.rlike(r"[ー―─\-_=・.。]{5,}")) | s.rlike(r"^[|｜¦┃\s]{4,}$")
    tiny = ~F.col("heading") & (n <= 2) & ~s.rlike(r"^[0-9]{1,3}$")
    noise = F.when(some & decoration, "decoration").when(some & tiny, "tiny")
    if o.drop_garbage:
        garbage = ~F.col("heading") & (n <= 60) & (F.col("japanese") < 0.10) & (F.col("latin") + F.col("symbols") >= 0.60) & (F.col("latin") >= 0.25)
        noise = noise.when(some & garbage, "garbage")
    loose = (F.col("symbols") >= 0.35) & (n >= 8) & s.rlike(r"^(第\s*\d+|[IVX]+\.|\d+\s*[.)])") & s.rlike(r"\s[0-9]{1,3}\s*$")
    rows = rows.select("doc_id", "line_no", "s", "canon", "heading", noise.alias("noise"), ((s == "目次") | s.rlike(CONTENTS) | loose).alias("contents"))
    # a run of contents is what stands between two lines that are kept and no contents
    between = F.sum((F.col("noise").isNull() & ~F.col("contents")).cast("int")).over(W.partitionBy("doc_id").orderBy("line_no"))
    rows = rows.withColumn("run", between)
    in_run = F.col("noise").isNull() & F.col("contents")
    size = F.sum(in_run.cast("int")).over(W.partitionBy("doc_id", "run"))
    rows = rows.withColumn("toc", in_run & (size >= max(2, o.toc_min_run)))
    left = F.col("noise").isNull() & ~F.col("toc")
    times = F.sum(left.cast("int")).over(W.partitionBy("doc_id", "canon"))
    again = left & (F.col("canon") != "") & (times >= max(2, o.repeated_min)) & (F.char_length("canon") <= max(10, o.repeated_most)) & ~is_heading(F.col("canon"))
    reason = F.when(F.col("noise").isNotNull(), F.col("noise")).when(F.col("toc"), "toc").when(again, "repeated")
    return rows.select("doc_id", "line_no", F.col("s").alias("line"), "heading", reason.alias("reason"))


def joined(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): wrapped lines joined by a space. A new line begins after a blank one, at and after headings and
    bullets, and where the line before ends a sentence; blank lines go. rows may have heading already."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    own = rows.withColumn("line", T.stripped(F.col("line")))
    own = own.select("doc_id", "line_no", "line", (F.col("heading") if "heading" in rows.columns else is_heading(F.col("line"))).alias("alone"))
    before, alone = F.lag("line").over(order), F.lag("alone").over(order)
    fresh = before.isNull() | (before == "") | alone | F.col("alone") | before.rlike(r"[。．.!！?？:]$")
    own = own.withColumn("g", F.sum(fresh.cast("int")).over(order)).filter("line <> ''")
    out = own.groupBy("doc_id", "g").agg(F.min("line_no").alias("line_no"), F.expr("listagg(line, ' ') WITHIN GROUP (ORDER BY line_no)").alias("line"))
    return out.select("doc_id", "line_no", "line")


def compressed(rows: DataFrame) -> DataFrame:
    """Lines stripped, with one blank line for each run of them."""
    own = rows.select("doc_id", "line_no", T.stripped(F.col("line")).alias("line"))
    before = F.lag("line").over(W.partitionBy("doc_id").orderBy("line_no"))
    return own.withColumn("b", before).filter((F.col("line") != "") | F.col("b").isNull() | (F.col("b") != "")).drop("b")


def assembled(rows: DataFrame) -> DataFrame:
    """(doc_id, text): lines in order."""
    return rows.groupBy("doc_id").agg(T.stripped(F.expr("listagg(line, chr(10)) WITHIN GROUP (ORDER BY line_no)")).alias("text"))


def clean_corpus(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, text) of cleaned documents; one of which nothing is left has no row."""
    kept = tagged_lines(docs, o).filter("reason is null").drop("reason")
    return assembled(joined(kept) if o.join_wrapped else compressed(kept))


def cleaning_report(tagged: DataFrame) -> DataFrame:
    """(doc_id, lines_in, kept, and dropped lines by reason)."""
    count = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return tagged.groupBy("doc_id").agg(F.count("*").alias("lines_in"), F.count_if(F.col("reason").isNull()).alias("kept"), *map(count, ("decoration", "tiny", "garbage", "toc", "repeated")))


def paged(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, page_no, text): so many lines a page."""
    own = lines(docs).withColumn("page_no", F.floor(F.col("line_no") / size) + 1)
    return own.groupBy("doc_id", "page_no").agg(F.expr("listagg(line, chr(10)) WITHIN GROUP (ORDER BY line_no)").alias("text"))


def offsets(pages: DataFrame) -> DataFrame:
    """pages with start and end (exclusive) of each in the document's characters."""
    n = F.char_length("text")
    end = F.sum(n).over(W.partitionBy("doc_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0))
    return pages.withColumn("end", end).withColumn("start", F.col("end") - n)


def page_at(points: DataFrame, pages: DataFrame) -> DataFrame:
    """points (doc_id, pos) with page_no: the page that holds the position, by a union of points and page starts and the last
    page so far. A position past the end has the last page; a document without pages 0."""
    starts = offsets(pages).select("doc_id", F.col("start").alias("pos"), "page_no", F.lit(0).alias("kind"))
    own = points.select("doc_id", "pos", F.lit(None).cast("long").alias("page_no"), F.lit(1).alias("kind"))
    order = W.partitionBy("doc_id").orderBy("pos", "kind", "page_no").rowsBetween(W.unboundedPreceding, 0)
    found = starts.unionByName(own).withColumn("found", F.last("page_no", True).over(order))
    return found.filter("kind = 1").select("doc_id", "pos", F.coalesce("found", F.lit(0)).alias("page_no"))


def documents_of(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(T.stripped(F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY page_no)")).alias("text"))


def preferred(clean: DataFrame, raw: DataFrame) -> DataFrame:
    """Pages of documents that have clean ones, else their raw ones, with kind."""
    own = raw.join(clean.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("kind", F.lit("raw"))
    return clean.withColumn("kind", F.lit("clean")).unionByName(own)


def pdf_kind(pages: DataFrame, sample: int = 3, least: int = 40) -> DataFrame:
    """text if the first pages have at least so many characters in all, else image."""
    n = F.sum(F.when(F.col("page_no") <= sample, F.char_length(T.stripped(F.col("text")))).otherwise(0))
    return pages.groupBy("doc_id").agg(F.when(n >= least, "text").otherwise("image").alias("kind"))


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, pages, completed, done, first_missing) of documents with so many pages, from the pages that are done."""
    wanted = totals.select("doc_id", "pages", F.explode(F.sequence(F.lit(1).cast("long"), "pages")).alias("page_no"))
    own = wanted.join(done.select("doc_id", "page_no", F.lit(1).alias("ok")).distinct(), ["doc_id", "page_no"], "left")
    out = own.groupBy("doc_id", "pages").agg(F.count("ok").alias("completed"), F.min(F.when(F.col("ok").isNull(), F.col("page_no"))).alias("first_missing"))
    return out.withColumn("done", F.col("completed") == F.col("pages"))


def contexts(docs: DataFrame, name: str, most: int = 15_000) -> DataFrame:
    """(doc_id, kind, text, truncated, extracted_chars) of documents with text: newlines as LF, cut at most characters."""
    own = docs.select("doc_id", T.detect_kind(F.col(name)).alias("kind"), T.newlines(F.col("text")).alias("whole")).filter(T.stripped(F.col("whole")) != "")
    n = F.char_length("whole")
    return own.select("doc_id", "kind", F.substring("whole", 1, most).alias("text"), (n > most).alias("truncated"), n.alias("extracted_chars"))
