from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import chunks as K, corpus as C
from loomframe.plans.views import query, table

docs = lambda spark, sf_dir: table(spark, sf_dir, "documents")
pages = lambda spark, sf_dir: C.paged(docs(spark, sf_dir), 5)
#: As by default, but that the corpora are not Japanese.
PLAIN = C.Options(drop_garbage=False)
_LINES = "(SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
_SYM = r"""[|｜¦┃━―─\-_=~^`''\".,。・:：;；!！?？()（）\[\]［］{}｛｝<>＜＞／/\\+*#@＆&％%…]"""
_S = r"regexp_replace(line, '^[\s　 ]+|[\s　 ]+$', '', 'g')"
_HEAD = r"regexp_matches(s, '^(第\s*\d+\s*[章節項]|[IVX]+\.|\d+\s*[.)]|\(\d+\)|（\d+）|[〇○●◎■◆◇・※\-])')"
_TAGGED = f"(SELECT doc_id, line_no, line, s, {_HEAD} AS heading, length(s) AS n, length(s) - length(regexp_replace(s, '{_SYM}', '', 'g')) AS sym, length(s) - length(regexp_replace(s, '[A-Za-z]', '', 'g')) AS latin FROM (SELECT *, {_S} AS s FROM {_LINES} a) b)"
_DECOR = r"s <> '' AND (regexp_matches(s, '(ー|―|─|-|_|=|・|\.|。){5,}') OR (CAST(sym AS DOUBLE) / n >= 0.7 AND n >= 6) OR regexp_full_match(s, '[|｜¦┃\s]{4,}'))"


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\.{3,}', '...', 'g'), '={3,}', '==', 'g'), '\s[|｜]\s', ' ', 'g'), '[ \t]{2,}', ' ', 'g') AS text FROM documents")
def j1_inline(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", C.inline(F.col("text"), nfkc=False).alias("text"))


@query(f"SELECT doc_id, line_no, coalesce(heading, false) AS heading FROM {_TAGGED} t")
def j3_headings(spark, sf_dir):
    return C.lines(docs(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), C.is_heading(F.col("line")).alias("heading"))


#: Every fifth line gives way to one of decoration, of symbols, of pipes or of too few marks.
_MARKED_LINE = "CASE WHEN line_no % 5 <> 2 THEN line WHEN line_no % 4 = 0 THEN '  ----- ' || CAST(line_no AS VARCHAR(20)) WHEN line_no % 4 = 1 THEN '(*)[#]a' WHEN line_no % 4 = 2 THEN '|  ｜ |' ELSE 'a ---- b' END"
_MARKED = f"(SELECT doc_id, line_no, {_MARKED_LINE} AS line FROM {_LINES} x)"


@query(f"SELECT doc_id, line_no FROM {_TAGGED.replace(_LINES, _MARKED)} t WHERE {_DECOR}")
def j4_decoration_lines(spark, sf_dir):
    own = C.lines(docs(spark, sf_dir)).withColumn("line", F.expr(_MARKED_LINE))
    return own.filter(C.is_decoration(F.col("line"))).select("doc_id", "line_no")


@query(f"SELECT doc_id, line_no FROM {_TAGGED} t WHERE s <> '' AND n <= 2 AND NOT heading AND NOT regexp_full_match(s, '[0-9]{{1,3}}')")
def j5_tiny_lines(spark, sf_dir):
    return C.lines(docs(spark, sf_dir)).filter(C.is_tiny(F.col("line"))).select("doc_id", "line_no")


@query(f"SELECT doc_id, line_no FROM {_TAGGED} t WHERE s <> '' AND n <= 60 AND NOT heading AND CAST(latin AS DOUBLE) / n + CAST(sym AS DOUBLE) / n >= 0.60 AND CAST(latin AS DOUBLE) / n >= 0.25")
def j6_garbage_lines(spark, sf_dir):
    return C.lines(docs(spark, sf_dir)).filter(C.is_garbage(F.col("line"))).select("doc_id", "line_no")


_NUMBERED = "(SELECT doc_id, line_no, CASE WHEN line_no % 11 < 7 THEN '1. ' || CAST(line_no % 10 AS VARCHAR) || ' part ' || CAST(line_no % 90 AS VARCHAR) ELSE line END AS line FROM " + _LINES + " x)"


@query(f"""SELECT doc_id, line_no FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, c, g) AS size FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, c ORDER BY line_no) AS g FROM (
SELECT doc_id, line_no, regexp_matches(line, '^\\s*((第\\s*\\d+\\s*[章節項])|([IVX]+[.\\s])|(\\d+\\s*[.)])).*(\\s*[0-9]{{1,3}}\\s*)$') AS c FROM {_NUMBERED} a) b) d) e WHERE c AND size >= 6""")
def j7_contents_runs(spark, sf_dir):
    n = F.col("line_no")
    line = F.when(n % 11 < 7, F.concat(F.lit("1. "), (n % 10).cast("string"), F.lit(" part "), (n % 90).cast("string"))).otherwise(F.col("line"))
    own = C.lines(docs(spark, sf_dir)).withColumn("line", line)
    return C.tag_contents(own).filter("toc").select("doc_id", "line_no")


_AGAIN = f"(SELECT doc_id, regexp_replace(s, '[ \\t]{{2,}}', ' ', 'g') AS canon, count(*) AS count FROM {_TAGGED} t WHERE s <> '' AND NOT heading GROUP BY ALL HAVING count(*) >= 3 AND length(canon) <= 40)"


@query(f"SELECT * FROM {_AGAIN} q")
def d17_repeated_lines(spark, sf_dir):
    return C.repeated_lines(C.lines(docs(spark, sf_dir)), nfkc=False)


@query(f"SELECT t.doc_id, t.line_no FROM {_TAGGED} t LEFT JOIN {_AGAIN} q ON t.doc_id = q.doc_id AND regexp_replace(t.s, '[ \\t]{{2,}}', ' ', 'g') = q.canon WHERE q.canon IS NULL")
def j8_without_repeated(spark, sf_dir):
    own = C.lines(docs(spark, sf_dir)).withColumn("canon", C.canonical(F.col("line"), False))
    return own.join(C.repeated_lines(own, nfkc=False), ["doc_id", "canon"], "left_anti").select("doc_id", "line_no")


# DuckDB lacks NFKC: Spark is given documents of odd ids in full-width letters and digits and every third with Japanese whose
# characters are spaced, of which cleaning makes what SQL is given.
_PLAIN_TEXT = "(SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '手賀沼の2つ。' ELSE '' END AS text FROM documents)"
_INLINE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\.{3,}', '...', 'g'), '={3,}', '==', 'g'), '\s[|｜]\s', ' ', 'g'), '[ \t]{2,}', ' ', 'g')"
# No blanks, line ends among them, between Japanese characters and these or digits. A match takes both its ends, so it is done twice.
_JA = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
for _ in range(2):
    _INLINE = rf"regexp_replace({_INLINE}, '({_JA})[\s\x0b\x{{3000}}\x{{a0}}]+({_JA}|[0-9])|([0-9])[\s\x0b\x{{3000}}\x{{a0}}]+({_JA})', '\1\2\3\4', 'g')"


def _wide(spark, sf_dir, japanese=True):
    ascii_ = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    wide = F.translate("text", ascii_, "".join(chr(ord(c) + 0xFEE0) for c in ascii_))
    text = F.when(F.col("doc_id") % 2 == 1, wide).otherwise(F.col("text"))
    end = F.when(F.col("doc_id") % 3 == 0, F.lit("\n手 賀　沼 の ２ つ。")).otherwise("") if japanese else F.lit("")
    return docs(spark, sf_dir).select("doc_id", F.concat(text, end).alias("text"))


@query(f"SELECT doc_id, {_INLINE} AS text FROM {_PLAIN_TEXT} d")
def j1b_inline_nfkc(spark, sf_dir):
    return _wide(spark, sf_dir).select("doc_id", C.inline(F.col("text")).alias("text"))


@query(f"SELECT * FROM {_AGAIN} q")
def d17b_repeated_lines_nfkc(spark, sf_dir):
    return C.repeated_lines(C.lines(_wide(spark, sf_dir, False)))


@query(f"SELECT t.doc_id, t.line_no FROM {_TAGGED} t LEFT JOIN {_AGAIN} q ON t.doc_id = q.doc_id AND regexp_replace(t.s, '[ \\t]{{2,}}', ' ', 'g') = q.canon WHERE q.canon IS NULL")
def j8b_without_repeated_nfkc(spark, sf_dir):
    own = C.lines(_wide(spark, sf_dir, False)).withColumn("canon", C.canonical(F.col("line")))
    return own.join(C.repeated_lines(own), ["doc_id", "canon"], "left_anti").select("doc_id", "line_no")


@query(f"""SELECT doc_id, min(line_no) AS line_no, string_agg(s, ' ' ORDER BY line_no) AS line FROM (SELECT *, sum(CASE WHEN b IS NULL OR b = '' OR bh OR heading OR regexp_matches(b, '[。．.!！?？:]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g
FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS b, lag(heading) OVER (PARTITION BY doc_id ORDER BY line_no) AS bh FROM {_TAGGED} t) u) v WHERE s <> '' GROUP BY doc_id, g""")
def j9_joined_lines(spark, sf_dir):
    return C.joined(C.lines(docs(spark, sf_dir)))


@query(f"SELECT doc_id, line_no, s AS line FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM {_TAGGED} t) u WHERE s <> '' OR b IS NULL OR b <> ''")
def j10_compressed_lines(spark, sf_dir):
    return C.compressed(C.lines(docs(spark, sf_dir)))


_CLEAN_LINES = f"(SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM (SELECT doc_id, {_INLINE} AS text FROM {_PLAIN_TEXT} d) i)"
_CONTENTS = r"s = '目次' OR regexp_matches(s, '^\s*((第\s*\d+\s*[章節項])|([IVX]+[.\s])|(\d+\s*[.)])).*(\s*[0-9]{1,3}\s*)$') OR (n >= 8 AND CAST(sym AS DOUBLE) / n >= 0.35 AND regexp_matches(s, '^(第\s*\d+|[IVX]+\.|\d+\s*[.)])') AND regexp_matches(s, '\s[0-9]{1,3}\s*$'))"
_REASONS = f"""(SELECT *, CASE WHEN noise IS NOT NULL THEN noise WHEN toc THEN 'toc' WHEN canon <> '' AND times >= 3 AND length(canon) <= 40 AND NOT heading THEN 'repeated' END AS reason FROM (
  SELECT *, sum(CASE WHEN noise IS NULL AND NOT toc THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, canon) AS times FROM (
    SELECT *, noise IS NULL AND contents AND sum(CASE WHEN noise IS NULL AND contents THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) >= 6 AS toc FROM (
      SELECT *, sum(CASE WHEN noise IS NULL AND NOT contents THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run, regexp_replace(s, '[ \\t]{{2,}}', ' ', 'g') AS canon FROM (
        SELECT doc_id, line_no, s, coalesce(heading, false) AS heading, coalesce({_CONTENTS}, false) AS contents,
          CASE WHEN {_DECOR} THEN 'decoration' WHEN s <> '' AND NOT heading AND n <= 2 AND NOT regexp_full_match(s, '[0-9]{{1,3}}') THEN 'tiny' END AS noise FROM {_TAGGED.replace(_LINES, _CLEAN_LINES)} t) a) b) c) d)"""


@query(f"""SELECT doc_id, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^[\\s　 ]+|[\\s　 ]+$', '', 'g') AS text FROM (
SELECT doc_id, min(line_no) AS line_no, string_agg(s, ' ' ORDER BY line_no) AS line FROM (
  SELECT *, sum(CASE WHEN b IS NULL OR b = '' OR bh OR heading OR regexp_matches(b, '[。．.!！?？:]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM (
    SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS b, lag(heading) OVER (PARTITION BY doc_id ORDER BY line_no) AS bh FROM {_REASONS} r WHERE reason IS NULL) u) v
WHERE s <> '' GROUP BY doc_id, g) w GROUP BY doc_id""")
def j11_clean_corpus(spark, sf_dir):
    return C.clean_corpus(_wide(spark, sf_dir), PLAIN)


@query(f"""SELECT doc_id, count(*) AS lines_in, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason = 'decoration') AS decoration, count(*) FILTER (WHERE reason = 'tiny') AS tiny,
CAST(0 AS BIGINT) AS garbage, count(*) FILTER (WHERE reason = 'toc') AS toc, count(*) FILTER (WHERE reason = 'repeated') AS repeated FROM {_REASONS} r GROUP BY doc_id""")
def d20_cleaning_report(spark, sf_dir):
    return C.cleaning_report(C.tagged_lines(_wide(spark, sf_dir), PLAIN))


@query("SELECT * FROM page", "page")
def e8_pages(spark, sf_dir):
    return pages(spark, sf_dir)


@query("SELECT doc_id, page_no, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_no) - length(text) AS BIGINT) AS start, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_no) AS BIGINT) AS \"end\" FROM page", "page")
def e4_page_offsets(spark, sf_dir):
    return C.offsets(pages(spark, sf_dir)).select("doc_id", "page_no", "start", "end")


@query("""SELECT d.doc_id, d.pos, coalesce((SELECT max(page_no) FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_no) - length(text) AS start FROM page) p WHERE p.doc_id = d.doc_id AND p.start <= d.pos), 0) AS page_no
FROM (SELECT doc_id, (doc_id * 97) % 3000 AS pos FROM documents) d""", "page")
def c7_page_at(spark, sf_dir):
    points = docs(spark, sf_dir).select("doc_id", ((F.col("doc_id") * 97) % 3000).alias("pos"))
    return C.page_at(points, pages(spark, sf_dir))


@query("SELECT doc_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY page_no), '^[\\s　 ]+|[\\s　 ]+$', '', 'g') AS text FROM page GROUP BY doc_id", "page")
def d18_document_text(spark, sf_dir):
    return C.documents_of(pages(spark, sf_dir))


@query("SELECT doc_id, page_no, CASE WHEN doc_id % 3 = 0 THEN 'clean' ELSE 'raw' END AS kind FROM page", "page")
def a15_preferred_pages(spark, sf_dir):
    own = pages(spark, sf_dir)
    return C.preferred(own.filter("doc_id % 3 = 0"), own).select("doc_id", "page_no", "kind")


@query("SELECT doc_id, CASE WHEN sum(CASE WHEN page_no <= 3 THEN length(regexp_replace(text, '^[\\s　 ]+|[\\s　 ]+$', '', 'g')) ELSE 0 END) >= 40 THEN 'text' ELSE 'image' END AS kind FROM page GROUP BY doc_id", "page")
def h30_pdf_kind(spark, sf_dir):
    return C.pdf_kind(pages(spark, sf_dir))


@query("""SELECT doc_id, pages, completed, CASE WHEN completed = pages THEN NULL ELSE first_missing END AS first_missing, completed = pages AS done FROM (
SELECT doc_id, max(page_no) AS pages, count(*) FILTER (WHERE (doc_id + page_no) % 4 <> 0) AS completed, min(page_no) FILTER (WHERE (doc_id + page_no) % 4 = 0) AS first_missing FROM page GROUP BY doc_id) q""", "page")
def d21_progress(spark, sf_dir):
    own = pages(spark, sf_dir).select("doc_id", "page_no")
    return C.progress(own.filter("(doc_id + page_no) % 4 <> 0"), own.groupBy("doc_id").agg(F.max("page_no").alias("pages")))


@query("SELECT doc_id, 'word' AS kind, substr(text, 1, 2000) AS text, length(text) > 2000 AS truncated, CAST(length(text) AS INTEGER) AS extracted_chars FROM documents WHERE regexp_matches(text, '[^\\s　 ]')")
def a17_contexts(spark, sf_dir):
    return C.contexts(docs(spark, sf_dir).withColumn("name", F.lit("a.docx")), "name", 2000)


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), '[ 　]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s　 ]+', ''), '[\\s　 ]+$', '') AS text FROM documents")
def k1_normalised(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", K.normalised(F.col("text")).alias("text"))


@query("SELECT doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([。！？!?])', '\\1' || chr(1), 'g'), chr(1) || '|\\n\\n+'), lambda u: trim(u, ' ' || chr(10) || chr(9) || chr(13))), lambda u: u <> '')) AS n FROM documents")
def k2_sentence_units(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(K.units(K.normalised(F.col("text")))).alias("n"))


def _chunks_sql(source: str, paged: bool) -> str:
    """Chunks of source (doc_id, page_no, text) by recursion: sentences of paragraphs, long ones cut again and again, and a fold that
    packs them."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '　' || chr(160)"
    normal = "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), '[ 　]+\\n', chr(10), 'g'), '[ 　]+$', ''), '\\n{3,}', chr(10) || chr(10), 'g'), " + blank + ")"
    marks = ["chr(10)", *[f"'{m}'" for m in K.SOFT]]
    # the place behind the last mark within the bound, if it lies in the second half, by the marks' order
    places = ", ".join(f"CASE WHEN length(regexp_extract(substr(rest, 1, {K.HARD}), '(?s)^.*' || regexp_escape({m}))) > {K.HARD // 2} THEN length(regexp_extract(substr(rest, 1, {K.HARD}), '(?s)^.*' || regexp_escape({m}))) END" for m in marks)
    left = lambda x: f"(length({x}) - length(ltrim({x}, {blank})))"
    span = "joined AS span_start, joined + length(text) AS span_end" if paged else "span_start, span_end"
    more = "(r.size + 1 + o.n)"
    grow = f"({more} <= {K.MOST} OR (r.size < {K.LEAST} AND {more} <= {K.HARD}))"
    return f"""WITH RECURSIVE t AS (SELECT doc_id, page_no, {normal} AS text FROM {source} s WHERE text IS NOT NULL),
  p AS (SELECT doc_id, page_no, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i, unnest(string_split(text, chr(10) || chr(10))) AS p FROM t),
  pp AS (SELECT *, coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id, page_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM p),
  s AS (SELECT doc_id, page_no, i, base, generate_subscripts(regexp_extract_all(p, '[^。！？!?]*[。！？!?]|[^。！？!?]+'), 1) AS j, unnest(regexp_extract_all(p, '[^。！？!?]*[。！？!?]|[^。！？!?]+')) AS s FROM pp),
  ss AS (SELECT *, base + coalesce(sum(length(s)) OVER (PARTITION BY doc_id, page_no, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s),
  u AS (SELECT doc_id, page_no, i, j, 0 AS k, CAST(a + {left("s")} AS BIGINT) AS a, trim(s, {blank}) AS rest, CAST(NULL AS VARCHAR) AS unit FROM ss WHERE trim(s, {blank}) <> ''
    UNION ALL SELECT doc_id, page_no, i, j, k + 1, a + cut + {left("substr(rest, cut + 1)")}, ltrim(substr(rest, cut + 1), {blank}), rtrim(substr(rest, 1, cut), {blank})
    FROM (SELECT *, CAST(coalesce({places}, {K.HARD}) AS BIGINT) AS cut FROM u WHERE length(rest) > {K.HARD}) c),
  pieces AS (SELECT doc_id, page_no, i, j, k, unit AS text, lag(a) OVER (PARTITION BY doc_id, page_no, i, j ORDER BY k) AS a FROM u
    UNION ALL SELECT doc_id, page_no, i, j, k + 1, rest, a FROM u WHERE length(rest) <= {K.HARD}),
  o AS (SELECT doc_id, page_no, text, length(text) AS n, a, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, i, j, k) AS m FROM pieces WHERE text <> ''),
  r AS (SELECT doc_id, m, 0 AS chunk_index, n AS size FROM o WHERE m = 1
    UNION ALL SELECT o.doc_id, o.m, CASE WHEN {grow} THEN r.chunk_index ELSE r.chunk_index + 1 END, CASE WHEN {grow} THEN {more} ELSE o.n END FROM r JOIN o ON o.doc_id = r.doc_id AND o.m = r.m + 1),
  c AS (SELECT r.doc_id, r.chunk_index, string_agg(o.text, chr(10) ORDER BY o.m) AS text, min(o.a) AS span_start, max(o.a + o.n) AS span_end, min(o.page_no) AS page_start, max(o.page_no) AS page_end FROM r JOIN o ON o.doc_id = r.doc_id AND o.m = r.m GROUP BY r.doc_id, r.chunk_index),
  d AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS joined FROM c)
  SELECT doc_id, chunk_index, text, greatest(1, length(regexp_replace(text, '[A-Za-z0-9_\\s　 ]+', '', 'g')) + CAST(floor(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) * 1.3) AS INTEGER)) AS chunk_len_tokens, {span}{", page_start, page_end" if paged else ""} FROM d"""


@query(_chunks_sql("(SELECT doc_id, 0 AS page_no, text FROM documents)", False))
def k4_chunks(spark, sf_dir):
    return K.chunk_documents(docs(spark, sf_dir))


@query(f"SELECT * FROM ({_chunks_sql('page', True)}) q", "page")
def k6_page_chunks(spark, sf_dir):
    return K.chunk_pages(pages(spark, sf_dir))


def _meta_sources(spark, sf_dir):
    n = F.col("doc_id")
    return docs(spark, sf_dir).select(F.lit("main").alias("collection_id"), F.col("source").alias("shard_id"), n.cast("string").alias("doc_id"), F.concat(F.lit("in\\"), "source", F.lit("/"), n.cast("string"), F.lit(".txt")).alias("file"), F.concat(F.lit(" /pdf\\"), n.cast("string"), F.lit(".pdf")).alias("source_pdf_path"), F.when(n % 3 > 0, F.lit("//text/x.txt")).alias("source_text_path"), F.when(n % 4 == 0, " RAW").when(n % 4 == 1, "clean").otherwise("scan").alias("source_text_kind"), F.sha2("text", 256).alias("sha256"), F.lit("text-embedding-3-large").alias("embed_model"), F.when(n % 5 == 0, '{"a":1}').alias("attrs"))


def _given_chunks(spark, sf_dir):
    """Pages of five lines stand for chunks, so that SQL has the same."""
    own = pages(spark, sf_dir)
    size = F.char_length("text")
    return own.select("doc_id", (F.col("page_no") - 1).alias("chunk_index"), "text", F.lit(0).alias("span_start"), size.alias("span_end"), size.alias("chunk_len_tokens"))


_PATHS = "'pdf/' || CAST(d.doc_id AS VARCHAR) || '.pdf' AS source_pdf_path, CASE WHEN d.doc_id % 3 > 0 THEN 'text/x.txt' ELSE '' END AS source_text_path"
_KINDS = "CASE d.doc_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'clean' ELSE 'other' END AS source_text_kind, sha256(d.text) AS sha256, 'text-embedding-3-large' AS embed_model, '2024-01-01T00:00:00Z' AS ingested_at, CASE WHEN d.doc_id % 5 = 0 THEN '{\"a\":1}' ELSE '{}' END AS attrs"
_NAMED = "'main' AS collection_id, d.source AS shard_id, CAST(d.doc_id AS VARCHAR) AS doc_id, 'in\\' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS file"
_GIVEN = "(SELECT * FROM page WHERE regexp_matches(text, '[^\\s　 ]'))"


@query(f"""SELECT {_NAMED}, CAST(d.doc_id AS VARCHAR) || '.txt' AS file_name, 10 + row_number() OVER (PARTITION BY d.source ORDER BY CAST(d.doc_id AS VARCHAR), p.page_no) - 1 AS vector_index,
CAST(d.doc_id AS VARCHAR) || '#c' || lpad(CAST(p.page_no AS VARCHAR), 6, '0') AS chunk_id, p.page_no - 1 AS chunk_index, p.text, 0 AS span_start, length(p.text) AS span_end, length(p.text) AS chunk_len_tokens,
p.page_no AS page_start, CASE WHEN p.page_no % 2 = 0 THEN p.page_no + 1 ELSE 0 END AS page_end, {_PATHS}, '' AS source_pages_path, {_KINDS} FROM {_GIVEN} p JOIN documents d ON d.doc_id = p.doc_id""", "page")
def k7_meta_rows(spark, sf_dir):
    """All 22 columns, over given chunks with their page ranges."""
    own = _given_chunks(spark, sf_dir)
    n = F.col("chunk_index") + 1
    ranges = own.select("doc_id", "chunk_index", n.alias("page_start"), F.when(n % 2 == 0, n + 1).otherwise(-1).alias("page_end"))
    base = docs(spark, sf_dir).select(F.col("source").alias("shard_id"), F.lit(10).alias("base")).distinct()
    return K.meta_rows(own, _meta_sources(spark, sf_dir), base, "2024-01-01T00:00:00Z", ranges)


@query(f"SELECT {_NAMED}, {_PATHS}, {_KINDS} FROM documents d WHERE EXISTS (SELECT 1 FROM {_GIVEN} p WHERE p.doc_id = d.doc_id)", "page")
def k7b_manifest_rows(spark, sf_dir):
    sources = _meta_sources(spark, sf_dir)
    base = sources.select("shard_id", F.lit(10).alias("base")).distinct()
    meta = K.meta_rows(_given_chunks(spark, sf_dir), sources, base, "2024-01-01T00:00:00Z")
    return K.manifest_rows(meta, sources, "2024-01-01T00:00:00Z")


@query(f"""SELECT {_NAMED}, CAST(d.doc_id AS VARCHAR) || '.txt' AS file_name, row_number() OVER (PARTITION BY d.source ORDER BY CAST(d.doc_id AS VARCHAR), c.chunk_index) - 1 AS vector_index,
CAST(d.doc_id AS VARCHAR) || '#c' || lpad(CAST(c.chunk_index + 1 AS VARCHAR), 6, '0') AS chunk_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.text, c.span_start, c.span_end, c.chunk_len_tokens, CAST(0 AS BIGINT) AS page_start, CAST(0 AS BIGINT) AS page_end,
{_PATHS}, '' AS source_pages_path, {_KINDS} FROM ({_chunks_sql("(SELECT doc_id, 0 AS page_no, text FROM documents)", False)}) c JOIN documents d ON d.doc_id = c.doc_id""")
def k7c_meta_of_chunks(spark, sf_dir):
    """The same over the chunks of whole documents."""
    sources = _meta_sources(spark, sf_dir)
    base = sources.select("shard_id", F.lit(0).alias("base")).distinct()
    return K.meta_rows(K.chunk_documents(docs(spark, sf_dir)), sources, base, "2024-01-01T00:00:00Z")
