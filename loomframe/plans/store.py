from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import text as T
from loomframe.operators import corpus as C, lifecycle as L, store as S, vectors as V
from loomframe.plans.views import query, table, view
from loomframe.sources import files as SF, jsonl as J

_v = lambda spark, sf_dir: view(spark, sf_dir, "vec")
_m = lambda spark, sf_dir: view(spark, sf_dir, "meta")
_p = lambda spark, sf_dir: view(spark, sf_dir, "manifest")
docs = lambda spark, sf_dir: table(spark, sf_dir, "documents")


@query("SELECT DISTINCT shard_id, doc_id FROM meta WHERE shard_id <> '2' ORDER BY ALL", "meta")
def a11_shards(spark, sf_dir):
    own = _m(spark, sf_dir).withColumn("shard_id", F.when(F.col("shard_id") == "2", "_2").otherwise(F.col("shard_id")))
    return S.shards(own, "doc_id", "shard_id").select("shard_id", "doc_id")


@query("SELECT lang AS collection_id, source AS shard_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END AS pdf_filename FROM documents WHERE doc_id % 5 <> 0")
def a12_catalogue(spark, sf_dir):
    n = F.col("doc_id")
    suffix = F.when(n % 5 == 0, ".txt").when(n % 2 == 0, ".pdf").otherwise(".PDF")
    return SF.catalogue(docs(spark, sf_dir).select(F.concat(F.lit("/x/"), "lang", F.lit("/pdfs/"), "source", F.lit("/"), n.cast("string"), suffix).alias("path")))


@query("SELECT doc_id, CAST(1 AS BIGINT) AS page_no, lang AS text FROM documents UNION ALL SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 7 END, text FROM documents WHERE doc_id % 4 <> 3")
def a13_page_tables_read(spark, sf_dir):
    n = F.col("doc_id")
    both = lambda first, last: F.when(n % 4 != 3, F.array(first, last)).otherwise(F.array(first))
    item = lambda k, no, c: F.struct(F.lit(no).alias(k), F.col(c).alias("text"))
    listed = F.to_json(both(F.col("lang"), F.col("text")))
    objects = lambda key, k: F.to_json(F.struct(F.array(item(k, 1, "lang"), F.struct(F.when(n % 4 != 3, 7).otherwise(0).alias(k), F.col("text").alias("text"))).alias(key)))
    json = F.when(n % 3 == 0, listed).when(n % 3 == 1, objects("pages", "page_no")).otherwise(objects("page_texts", "page"))
    return SF.read_pages(docs(spark, sf_dir).select("doc_id", json.alias("json")))


@query("SELECT doc_id, page_no, text FROM page", "page")
def a14_page_tables_written(spark, sf_dir):
    return SF.read_pages(SF.page_tables(C.paged(docs(spark, sf_dir), 5), "raw").select("doc_id", F.col("table").alias("json")))


#: 0 UTF-8, 1 UTF-16, and of ASCII texts, which cp932 has too: 2 Shift_JIS, 3 cp932 only, 4 a cut character.
_KIND = "CASE WHEN doc_id % 5 > 1 AND {bytes}(text) > {chars}(text) THEN doc_id % 2 ELSE doc_id % 5 END"


@query(f"""SELECT doc_id, text || CASE k WHEN 3 THEN '日本①' WHEN 4 THEN chr(65533) ELSE '日本' END AS text, CASE WHEN text IS NULL THEN NULL WHEN k = 0 THEN 'utf-8-sig' WHEN k = 1 THEN 'utf-16' WHEN k = 2 THEN 'shift_jis' WHEN k = 3 THEN 'cp932' ELSE 'replace' END AS encoding
FROM (SELECT doc_id, text, {_KIND.format(bytes="strlen", chars="length")} AS k FROM documents) q""")
def a16_decoded(spark, sf_dir):
    t, k = F.concat("text", F.lit("日本")), F.expr(_KIND.format(bytes="octet_length", chars="char_length"))
    end = lambda x: F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit(x)))
    raw = F.when(k == 0, F.encode(t, "UTF-8")).when(k == 1, F.encode(t, "UTF-16")).when(k == 2, end("93FA967B")).when(k == 3, end("93FA967B8740")).otherwise(end("81"))
    return docs(spark, sf_dir).select("doc_id", SF.decoded(raw).alias("d")).select("doc_id", "d.*")


@query("SELECT line_no, line NOT LIKE '{\"%' AND line <> '[1]' AS failed FROM log", "log")
def a18_pretty_json(spark, sf_dir):
    return view(spark, sf_dir, "log").select("line_no", SF.pretty_json("line")["failed"].alias("failed"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'image' ELSE 'text' END AS pdf_kind, CAST(CASE WHEN doc_id % 4 > 0 AND doc_id % 10 > 0 THEN doc_id % 10 END AS INTEGER) AS page_count,
doc_id % 4 > 0 AND doc_id % 2 = 1 AS text_extracted, doc_id % 4 > 0 AND doc_id % 5 = 0 AS cleaned, CASE WHEN doc_id % 4 > 0 AND doc_id % 7 = 0 THEN 'bad' END AS error_message FROM documents""")
def a19_status_rows(spark, sf_dir):
    n = F.col("doc_id")
    status = docs(spark, sf_dir).filter("doc_id % 4 > 0").select("doc_id", F.when(n % 3 == 0, " IMAGE").otherwise("text").alias("pdf_kind"), (n % 10).cast("string").alias("page_count"), F.when(n % 2 == 1, "Yes").otherwise("0").alias("text_extracted"), F.when(n % 5 == 0, "1").alias("cleaned"), F.when(n % 7 == 0, " bad ").otherwise(" ").alias("error_message"))
    return L.status_row(docs(spark, sf_dir).select("doc_id"), status)


@query("SELECT doc_id, lang = 'en' AS ingested, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS status FROM documents")
def a20_rag_status(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", F.when(F.col("lang") == "de", " ").otherwise(F.concat(F.lit(" "), F.upper("lang"))).alias("s"))
    status = T.blank_to_null(F.lower("s"))
    return own.select("doc_id", F.coalesce(status == "en", F.lit(False)).alias("ingested"), status.alias("status"))


@query("SELECT doc_id, doc_id % 3 > 0 AS same FROM documents")
def b10_same_source(spark, sf_dir):
    sha = F.sha2("text", 256)
    saved = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), sha))
    return docs(spark, sf_dir).select("doc_id", F.coalesce(T.blank_to_null(saved) == T.blank_to_null(sha), F.lit(False)).alias("same"))


@query("SELECT item_id, 'main__' || owner || '__' || item_id AS key FROM inb WHERE owner = '7'", "inb")
def b13_composite_keys(spark, sf_dir):
    own = view(spark, sf_dir, "inb").withColumn("key", F.concat_ws("__", F.lit("main"), "owner", "item_id"))
    wanted = own.filter("owner = '7'").select("key").distinct()
    return own.join(wanted, "key", "left_semi").select("item_id", "key")


@query("SELECT doc_id, page_no, min(pos) AS pos FROM (SELECT doc_id, page_no, page_no * 2 AS pos FROM page UNION ALL SELECT doc_id, page_no, page_no * 2 + 1 FROM page WHERE page_no % 2 = 0) q GROUP BY doc_id, page_no", "page")
def b14_selected_pages(spark, sf_dir):
    pages = C.paged(docs(spark, sf_dir), 5).select("doc_id", "page_no")
    again = pages.filter("page_no % 2 = 0").select("doc_id", "page_no", (F.col("page_no") * 2 + 1).alias("pos"))
    return L.selected_pages(pages, pages.withColumn("pos", F.col("page_no") * 2).unionByName(again))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'image' END AS pdf_kind, doc_id % 3 > 0 AS has_pages, doc_id % 2 = 0 OR doc_id % 5 = 0 AS ready, doc_id % 7 = 0 AS ingested FROM documents")
def c8_readiness(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id")
    n = F.col("doc_id")
    status = own.select("doc_id", F.when(n % 2 == 0, "text").otherwise("image").alias("pdf_kind"), (n % 2 == 0).alias("text_done"), (n % 5 == 0).alias("clean_done"))
    return L.readiness(own, status, own.filter("doc_id % 3 > 0"), own.filter("doc_id % 7 = 0"))


_SELECTED = "(SELECT DISTINCT shard_id, doc_id FROM meta WHERE doc_id LIKE '%3')"


@query(f"SELECT DISTINCT 'status/' || shard_id || '/' || doc_id || '.json' AS path FROM {_SELECTED} q", "meta")
def c11_status_paths(spark, sf_dir):
    own = _m(spark, sf_dir)
    gone = own.filter(F.col("doc_id").endswith("3")).select("shard_id", "doc_id")
    return own.join(gone, ["shard_id", "doc_id"], "left_semi").select(F.concat(F.lit("status/"), "shard_id", F.lit("/"), "doc_id", F.lit(".json")).alias("path")).distinct()


@query("SELECT shard_id, doc_id, CASE WHEN doc_id LIKE '%2' OR NOT EXISTS (SELECT 1 FROM manifest p WHERE p.shard_id = q.shard_id AND p.doc_id = q.doc_id) THEN 'old' ELSE 'new' END AS model FROM (SELECT DISTINCT shard_id, doc_id FROM meta) q UNION ALL SELECT '0', 'd-extra', 'new'", "meta", "manifest")
def c12_models(spark, sf_dir):
    manifest = _p(spark, sf_dir).withColumn("embed_model", F.when(F.col("doc_id").endswith("2"), " ").otherwise("new"))
    return S.models(manifest, _m(spark, sf_dir).withColumn("embed_model", F.lit("old")))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS ok, count(*) FILTER (WHERE status = 'running') AS skip, count(*) FILTER (WHERE status = 'error') AS error FROM run", "run")
def d11_batch_totals(spark, sf_dir):
    status = F.when(F.col("status") == "success", "ok").when(F.col("status") == "running", "skip")
    return S.totals(view(spark, sf_dir, "run").select(status.alias("status")))


@query(f"SELECT (SELECT count(*) FROM {_SELECTED} q) AS selected, (SELECT count(*) FROM meta WHERE doc_id LIKE '%3') AS rows, (SELECT count(*) FROM {_SELECTED} q) AS in_meta, (SELECT count(*) FROM manifest WHERE doc_id LIKE '%3') AS in_manifest", "meta", "manifest")
def d13_removal_plan(spark, sf_dir):
    own = _m(spark, sf_dir)
    return S.removal_plan(own, _p(spark, sf_dir), own.filter(F.col("doc_id").endswith("3")))


@query("SELECT m.shard_id, m.doc_id, m.vector_index FROM meta m WHERE doc_id NOT LIKE '%3'", "meta")
def m7_removed(spark, sf_dir):
    own = _m(spark, sf_dir)
    meta, _ = S.removed(_v(spark, sf_dir), own, _p(spark, sf_dir), own.filter(F.col("doc_id").endswith("3")).select("shard_id", "doc_id").distinct())
    return meta.select("shard_id", "doc_id", "vector_index")


@query("SELECT doc_id % 200 AS doc_id, event_type AS flag, arg_max(value > 250, event_id) AS value FROM (SELECT event_id, event_id AS doc_id, event_type, value, ts FROM events) q GROUP BY ALL")
def n3_manual_flags(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 200).alias("doc_id"), F.col("event_type").alias("flag"), "ts", (F.col("value") > 250).alias("value"))
    return L.latest_by_flag(own, "doc_id", "flag")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'clean' WHEN doc_id % 3 = 0 THEN 'raw' END AS kind, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN '' ELSE 'no text' END AS reason FROM documents")
def n7_source_resolution(spark, sf_dir):
    n = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", L.source_choice(F.lit("text"), n % 2 == 0, n % 3 == 0).alias("s")).select("doc_id", "s.*")


@query("SELECT DISTINCT source, len(source) AS positive FROM documents")
def h7_normalised_values(spark, sf_dir):
    return docs(spark, sf_dir).select("source", T.positive_int(F.char_length("source").cast("string")).cast("long").alias("positive")).distinct()


@query("SELECT DISTINCT doc_id % 1200 AS n, CASE WHEN doc_id % 1200 <= 999 THEN lpad(CAST(doc_id % 1200 AS VARCHAR), 3, '0') END AS no, CASE WHEN doc_id % 1200 >= 1000 THEN doc_id % 1200 END AS year FROM documents")
def h17_project_numbers(spark, sf_dir):
    n = F.col("doc_id") % 1200
    return docs(spark, sf_dir).select(n.alias("n"), T.project_no(n.cast("string")).alias("no"), T.project_year(n.cast("string")).cast("long").alias("year")).distinct()


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 1 ELSE greatest(1, least(doc_id % 9 - 2, n_chars % 7)) END AS page FROM documents")
def h18_clamped_pages(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clamp_page(F.col("doc_id") % 9 - 2, F.col("n_chars") % 7).alias("page"))


def _snapshot(spark, sf_dir):
    from loomframe.sources.shared import new_path

    main = F.lit("main").alias("collection_id")
    parts = {"vectors": _v(spark, sf_dir), "meta": _m(spark, sf_dir), "manifest": _p(spark, sf_dir)}
    path = new_path(spark, "store")
    S.write_snapshot({k: df.select("*", main) for k, df in parts.items()}, path)
    return path


@query("SELECT shard_id, vector_index, vec_id FROM vec WHERE shard_id = '1'", "vec")
def a9_snapshot(spark, sf_dir):
    path = _snapshot(spark, sf_dir)
    own = S.read_snapshot(spark, path, shard_id="1")["vectors"]
    return own.select(F.col("shard_id").cast("string").alias("shard_id"), "vector_index", "vec_id")


@query("SELECT shard_id, doc_id, vector_index FROM meta WHERE shard_id = '2'", "meta")
def a25_backup(spark, sf_dir):
    path = _snapshot(spark, sf_dir)
    own = S.read_snapshot(spark, S.backup(spark, path, "20240101", shard_id="2"))["meta"]
    return own.select(F.col("shard_id").cast("string").alias("shard_id"), "doc_id", "vector_index")


@query("SELECT d.shard_id, d.doc_id, EXISTS (SELECT 1 FROM manifest p WHERE p.shard_id = d.shard_id AND p.doc_id = d.doc_id AND d.doc_id NOT LIKE '%4') AS same FROM (SELECT DISTINCT shard_id, doc_id FROM meta) d", "meta", "manifest")
def b8_same_processed(spark, sf_dir):
    own = _m(spark, sf_dir).select("shard_id", "doc_id", F.sha2("doc_id", 256).alias("sha256")).distinct()
    known = _p(spark, sf_dir).withColumn("sha256", F.when(F.col("doc_id").endswith("4"), "other").otherwise(F.sha2("doc_id", 256)))
    return S.same_processed(own, known, "sha256").select("shard_id", "doc_id", "same")


@query("SELECT doc_id, (doc_id % 2 = 1 AND doc_id % 5 = 0) OR (doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 7 > 0) AS done FROM documents")
def b11_already_processed(spark, sf_dir):
    n = F.col("doc_id")
    done = L.already_processed(F.when(n % 2 == 0, "text").otherwise("image"), n % 3 == 0, n % 5 == 0, n % 7 > 0)
    return docs(spark, sf_dir).select("doc_id", done.alias("done"))


@query("SELECT item_id FROM inb WHERE CAST(item_id AS BIGINT) % 9 = 0", "inb")
def c9_selected_items(spark, sf_dir):
    own = view(spark, sf_dir, "inb")
    keys = own.filter("cast(item_id as long) % 9 = 0").select("item_id")
    return own.join(keys.union(keys), "item_id", "left_semi").select("item_id")


@query("SELECT doc_id, doc_id % 2 = 0 AS cleaned, CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'text' END AS kind FROM documents")
def a26_extraction_record(spark, sf_dir):
    n = F.col("doc_id")
    status = docs(spark, sf_dir).select("doc_id", F.when(n % 3 == 0, "image").otherwise("text").alias("pdf_kind"), F.lit("2024-01-01").alias("text_at"), (n % 2 == 0).alias("clean_done"), F.lit("2024-01-02").alias("clean_at"))
    record = L.extraction_record(status)
    return record.select("doc_id", F.get_json_object("record", "$.cleaning").isNotNull().alias("cleaned"), F.get_json_object("record", "$.extract.kind").alias("kind"))


@query("SELECT doc_id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' ELSE 'error' END AS level, CASE WHEN event_id % 3 > 0 THEN '[' || CAST(1 + event_id % 2 AS VARCHAR) || ', ' || CAST(5 + event_id % 2 AS VARCHAR) || ']' END AS pages FROM (SELECT event_id % 200 AS doc_id, max(event_id) AS event_id FROM events GROUP BY ALL) q")
def n2_text_check_results(spark, sf_dir):
    n = F.col("event_id")
    level = F.when(n % 3 == 0, " OK").when(n % 3 == 1, "warning").otherwise("error")
    pages = F.array((5 + n % 2).cast("int"), (1 + n % 2).cast("int"), (5 + n % 2).cast("int"), F.lit(-1))
    own = table(spark, sf_dir, "events").select("event_id", (n % 200).alias("doc_id"), "ts", level.alias("level"), pages.alias("pages"))
    return L.text_check_results(own, "doc_id").withColumn("pages", F.col("pages").cast("string"))


