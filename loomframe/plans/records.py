"""Store maintenance, checks, exports and times as whole jobs: every row of their tables passes through the operator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from loomframe.functions import text as T
from loomframe.operators import items as I, lifecycle as L, store as S, vectors as V
from loomframe.plans.views import query, table, view
from loomframe.sources import jsonl as J
from loomframe.sources.shared import new_path, stored

docs = lambda spark, sf_dir: table(spark, sf_dir, "documents")
_prj = lambda spark, sf_dir: view(spark, sf_dir, "prj")


def lengths(texts: pd.Series) -> pd.Series:
    """Stands for a caller's vectoriser: two numbers of a text."""
    return texts.map(lambda t: [float(len(t)), float(t.count(" "))])


_embed = lambda rows: S.embedded(rows, lengths)


@query("SELECT doc_id, CAST(length(text) AS FLOAT) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS FLOAT) AS spaces FROM documents WHERE regexp_matches(text, '[^\\s　 ]')")
def l0_embedded_texts(spark, sf_dir):
    own = S.embedded(docs(spark, sf_dir).select("doc_id", "text"), lengths)
    return own.select("doc_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("spaces"))


def _sources(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("source").alias("shard_id"), F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 11 > 0, F.col("text")).otherwise(" \n").alias("text"))


def _grown(spark, sf_dir):
    """An empty store of dimension two that takes in documents not divisible by three, then all."""
    own = _sources(spark, sf_dir)
    shards = [r.shard_id for r in own.select("shard_id").distinct().collect()]
    first, _ = S.grown(S.empty_store(spark, shards, 2), own.filter("cast(doc_id as long) % 3 > 0"), _embed)
    return S.grown(first, own, _embed)


@query("""SELECT source AS shard_id, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 11 > 0 AND k THEN 'skip' WHEN doc_id % 11 = 0 OR NOT k THEN 'error' ELSE 'ok' END AS status,
CASE WHEN doc_id % 11 > 0 AND k THEN 1 ELSE 0 END AS manifest_rows, doc_id % 11 > 0 AND k AS has_vectors, doc_id % 11 > 0 AND k AND doc_id % 3 = 0 AS after_first, true AS dense FROM (SELECT *, regexp_matches(text, '[^\\s　 ]') AS k FROM documents) q""")
def m4_incremental_append(spark, sf_dir):
    store, result = _grown(spark, sf_dir)
    key = ["shard_id", "doc_id"]
    sizes = store["vectors"].groupBy("shard_id").agg(F.count("*").alias("n"), F.countDistinct("vector_index").alias("d"), F.max("vector_index").alias("top"))
    dense = sizes.select("shard_id", ((F.col("n") == F.col("d")) & (F.col("top") == F.col("n") - 1)).alias("dense"))
    first = store["meta"].join(result.filter("status = 'skip'"), key, "left_semi").groupBy("shard_id").agg(F.max("vector_index").alias("old"))
    spans = store["meta"].join(store["vectors"].select("shard_id", "vector_index"), ["shard_id", "vector_index"], "left_semi").groupBy(*key).agg(F.min("vector_index").alias("lo"))
    rows = store["manifest"].groupBy(*key).agg(F.count("*").cast("int").alias("manifest_rows"))
    out = result.join(rows, key, "left").join(spans, key, "left").join(first, "shard_id", "left").join(dense, "shard_id")
    return out.select(*key, "status", F.coalesce("manifest_rows", F.lit(0)).alias("manifest_rows"), F.col("lo").isNotNull().alias("has_vectors"), F.coalesce(F.col("lo") > F.col("old"), F.lit(False)).alias("after_first"), "dense")


@query("SELECT source AS shard_id, CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 4 = 0 AS rebuilt, 1 AS manifest_rows FROM documents WHERE doc_id % 11 > 0 AND regexp_matches(text, '[^\\s　 ]')")
def m5_rebuilt_rows(spark, sf_dir):
    """Documents divisible by four are taken in anew: they alone have metadata behind the vectors that were there."""
    own = _sources(spark, sf_dir)
    shards = [r.shard_id for r in own.select("shard_id").distinct().collect()]
    before, _ = S.grown(S.empty_store(spark, shards, 2), own, _embed)
    size = before["vectors"].groupBy("shard_id").agg(F.count("*").alias("n"))
    after, _ = S.rebuilt(before, own.filter("cast(doc_id as long) % 4 = 0"), _embed)
    rows = after["meta"].join(size, "shard_id").groupBy("shard_id", "doc_id").agg(F.min(F.col("vector_index") >= F.col("n")).alias("rebuilt"), F.max(F.col("vector_index") >= F.col("n")).alias("any"))
    known = after["manifest"].groupBy("shard_id", "doc_id").agg(F.count("*").cast("int").alias("manifest_rows"))
    return rows.filter("rebuilt = any").join(known, ["shard_id", "doc_id"]).select("shard_id", "doc_id", "rebuilt", "manifest_rows")


@query("SELECT shard_id, vec_id, n, true AS same FROM (SELECT shard_id, vec_id, 1 AS n FROM vec WHERE vec_id % 3 > 0 UNION ALL SELECT shard_id, vec_id, 2 FROM vec WHERE vec_id % 3 = 0) q", "vec")
def g4_appended(spark, sf_dir):
    own = view(spark, sf_dir, "vec")
    more = own.filter("vec_id % 3 = 0")
    out = S.appended(own.withColumn("n", F.lit(0)), more.withColumn("n", F.lit(1)))
    rows = out.groupBy("shard_id", "vec_id").agg(F.count("*").cast("int").alias("n"), F.countDistinct(F.hash("embedding")).alias("d"))
    return rows.select("shard_id", "vec_id", "n", (F.col("d") == 1).alias("same"))


_GONE = "(SELECT DISTINCT shard_id, doc_id FROM meta WHERE shard_id = '1' AND doc_id LIKE '%3' UNION SELECT '1', 'nowhere')"


def _deregistered(spark, sf_dir):
    from loomframe.plans.store import _snapshot

    path = _snapshot(spark, sf_dir)
    own = view(spark, sf_dir, "meta")
    gone = own.filter((F.col("shard_id") == "1") & F.col("doc_id").endswith("3")).select("shard_id", "doc_id").union(spark.createDataFrame([("1", "nowhere")], "shard_id string, doc_id string"))
    return path, *S.deregistered(spark, path, stored(gone.distinct(), "gone"), "20240101", shard_id="1")


@query(f"""SELECT (SELECT count(*) FROM {_GONE} g) AS selected, (SELECT count(*) FROM meta WHERE shard_id = '1' AND doc_id LIKE '%3') AS rows, (SELECT count(DISTINCT doc_id) FROM meta WHERE shard_id = '1' AND doc_id LIKE '%3') AS in_meta,
(SELECT count(*) FROM manifest m JOIN {_GONE} g ON m.shard_id = g.shard_id AND m.doc_id = g.doc_id) AS in_manifest, (SELECT count(DISTINCT doc_id) FROM meta WHERE shard_id = '1' AND doc_id LIKE '%3') AS removed, 'partial' AS status""", "meta", "manifest")
def m7b_deregistration_result(spark, sf_dir):
    return _deregistered(spark, sf_dir)[1]


@query("""SELECT 'meta' AS part, shard_id, doc_id, count(*) AS n FROM meta WHERE NOT (shard_id = '1' AND doc_id LIKE '%3') GROUP BY ALL UNION ALL SELECT 'manifest', shard_id, doc_id, count(*) FROM manifest WHERE NOT (shard_id = '1' AND doc_id LIKE '%3') GROUP BY ALL
UNION ALL SELECT 'backup', shard_id, doc_id, count(*) FROM meta WHERE shard_id = '1' GROUP BY ALL UNION ALL SELECT 'reset', shard_id, doc_id, 1 FROM (SELECT DISTINCT shard_id, doc_id FROM meta WHERE shard_id = '1' AND doc_id LIKE '%3') q""", "meta", "manifest")
def m7c_deregistered_store(spark, sf_dir):
    """What lies in the snapshot and its backup afterwards, and the status events."""
    path, _, resets = _deregistered(spark, sf_dir)
    after, saved = S.read_snapshot(spark, path), S.read_snapshot(spark, f"{path}/_backups/ts=20240101")
    part = lambda df, name: df.groupBy(F.lit(name).alias("part"), F.col("shard_id").cast("string").alias("shard_id"), "doc_id").agg(F.count("*").alias("n"))
    return part(after["meta"], "meta").unionByName(part(after["manifest"], "manifest")).unionByName(part(saved["meta"], "backup")).unionByName(part(resets, "reset"))


_M7D = "(SELECT DISTINCT shard_id, doc_id FROM meta WHERE shard_id = '2' UNION SELECT DISTINCT shard_id, doc_id FROM manifest WHERE shard_id = '2')"


@query(f"""SELECT 'meta' AS part, shard_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM meta WHERE shard_id <> '2' GROUP BY ALL UNION ALL SELECT 'manifest', shard_id, count(*), count(DISTINCT doc_id) FROM manifest WHERE shard_id <> '2' GROUP BY ALL
UNION ALL SELECT 'vectors', shard_id, count(*), 0 FROM vec GROUP BY ALL UNION ALL SELECT 'before', shard_id, count(*), count(DISTINCT doc_id) FROM meta GROUP BY ALL UNION ALL SELECT 'restored', shard_id, count(*), count(DISTINCT doc_id) FROM meta GROUP BY ALL
UNION ALL SELECT 'success', '2', count(*), count(*) FROM {_M7D} q""", "vec", "meta", "manifest")
def m7d_emptied_shard(spark, sf_dir):
    """A shard loses all its documents: it is empty afterwards, its vectors stay, the version before still has them, and a restored
    one has them again."""
    from loomframe.plans.store import _snapshot

    path = _snapshot(spark, sf_dir)
    keys = ["shard_id", "doc_id"]
    gone = view(spark, sf_dir, "meta").select(*keys).union(view(spark, sf_dir, "manifest").select(*keys)).filter("shard_id = '2'").distinct()
    result, _ = S.deregistered(spark, path, stored(gone, "gone"), "20240101", shard_id="2")
    store = S.versions(spark, path)
    after, before = store.read(), store.read(1)
    store.restore(1, shard_id="2")
    part = lambda df, name: df.groupBy(F.lit(name).alias("part"), "shard_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    vectors = after["vectors"].groupBy(F.lit("vectors").alias("part"), "shard_id").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("docs"))
    out = part(after["meta"], "meta").unionByName(part(after["manifest"], "manifest")).unionByName(vectors)
    out = out.unionByName(part(before["meta"], "before")).unionByName(part(store.read()["meta"], "restored"))
    return out.unionByName(result.select(F.col("status").alias("part"), F.lit("2").alias("shard_id"), F.col("selected").alias("n"), F.col("removed").alias("docs")))


@query("SELECT doc_id, pos FROM (SELECT trim(source) AS doc_id, min(doc_id) AS pos FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE source END AS source, doc_id FROM documents) a GROUP BY 1) q WHERE doc_id <> ''")
def e1_first_sources(spark, sf_dir):
    padded = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "source"))
    return S.first_by_id(docs(spark, sf_dir).select(padded.alias("doc_id"), F.col("doc_id").alias("pos")))


@query("SELECT shard_id, doc_id, vector_index FROM meta WHERE (doc_id LIKE '%1' OR doc_id LIKE '%d7') AND (vector_index % 4 = 0 OR vector_index % 9 >= 4)", "meta")
def b9_cost_scope(spark, sf_dir):
    at = F.when(F.col("vector_index") % 4 > 0, F.concat(F.lit("2024-0"), (F.col("vector_index") % 9 + 1).cast("string")))
    return V.in_scope(view(spark, sf_dir, "meta").withColumn("created_at", at), ["1", "d7"], "2024-05", "doc_id").select("shard_id", "doc_id", "vector_index")


@query("SELECT shard_id, CAST(list_sort(list(DISTINCT model)) AS VARCHAR) AS models FROM (SELECT shard_id, CASE WHEN doc_id LIKE '%2' OR NOT EXISTS (SELECT 1 FROM manifest p WHERE p.shard_id = m.shard_id AND p.doc_id = m.doc_id) THEN 'old' ELSE 'new' END AS model FROM meta m WHERE shard_id <> '0') q GROUP BY shard_id", "meta", "manifest")
def d19_source_models(spark, sf_dir):
    manifest = view(spark, sf_dir, "manifest").withColumn("embed_model", F.when(F.col("doc_id").endswith("2"), " ").otherwise("new"))
    meta = view(spark, sf_dir, "meta").filter("shard_id <> '0'").withColumn("embed_model", F.lit("old"))
    own = S.models(manifest, meta).join(meta.select("shard_id", "doc_id").distinct(), ["shard_id", "doc_id"], "left_semi")
    return own.groupBy("shard_id").agg(F.array_sort(F.collect_set("model")).cast("string").alias("models"))


_CHECK = "CASE WHEN pdf_lock_flag <> 1 THEN 'skip' WHEN src_key % 9 = 0 THEN 'done' WHEN trim(coalesce(report_pdf_stored_filename, '')) = '' THEN 'error' WHEN src_key % 4 = 0 THEN 'image' ELSE 'text' END"


@query(f"""SELECT *, CASE WHEN skipped = total THEN 'all skipped' ELSE processed || ' of ' || total || ': ' || "text" || ' new, ' || replaced || ' replaced, ' || image || ' images, ' || skipped || ' skipped, ' || error || ' errors' END AS message FROM (
SELECT project_year, count(*) AS total, count(*) FILTER (WHERE d IN ('text', 'image')) AS processed, count(*) FILTER (WHERE d = 'text' AND src_key % 2 = 1) AS "text", count(*) FILTER (WHERE d = 'text' AND src_key % 2 = 0) AS replaced,
count(*) FILTER (WHERE d = 'image') AS image, count(*) FILTER (WHERE d IN ('skip', 'done')) AS skipped, count(*) FILTER (WHERE d = 'error') AS error FROM (SELECT *, {_CHECK} AS d FROM prj) q GROUP BY project_year) r""", "prj")
def d12_year_totals(spark, sf_dir):
    n = F.col("src_key")
    kind = F.when(n % 4 == 0, "image").otherwise("text")
    has = F.trim(F.coalesce("report_pdf_stored_filename", F.lit(""))) != ""
    own = _prj(spark, sf_dir).select("project_year", L.check_decision(F.col("pdf_lock_flag") == 1, n % 9 == 0, kind, has).alias("decision"), (n % 2 == 0).alias("had_text"))
    return L.year_totals(own)


@query("""SELECT project_year, project_no, outcome, CASE WHEN outcome = 'done' AND a = 'lock' THEN 1 WHEN outcome = 'done' AND a = 'unlock' THEN 0 ELSE pdf_lock_flag END AS locked,
CASE WHEN outcome = 'done' AND a = 'replace' THEN 'new.pdf' WHEN outcome = 'done' AND a = 'delete' THEN NULL ELSE report_pdf_stored_filename END AS stored FROM (
SELECT *, CASE WHEN a IS NULL THEN NULL WHEN (a IN ('replace', 'delete') AND pdf_lock_flag = 1) OR (a = 'lock' AND trim(coalesce(report_pdf_stored_filename, '')) = '') THEN 'refused' ELSE 'done' END AS outcome FROM (
SELECT *, CASE src_key % 5 WHEN 0 THEN 'replace' WHEN 1 THEN 'lock' WHEN 2 THEN 'unlock' WHEN 3 THEN 'delete' END AS a FROM prj) p) q""", "prj")
def n12_report_updates(spark, sf_dir):
    n = F.col("src_key") % 5
    action = F.when(n == 0, "replace").when(n == 1, "lock").when(n == 2, "unlock").when(n == 3, "delete")
    actions = _prj(spark, sf_dir).select("project_year", "project_no", action.alias("action"), F.lit("new.pdf").alias("stored")).filter("action is not null")
    out = L.report_updates(_prj(spark, sf_dir), actions)
    return out.select("project_year", "project_no", "outcome", F.col("pdf_lock_flag").alias("locked"), F.col("report_pdf_stored_filename").alias("stored"))


@query("""SELECT source, count(*) FILTER (WHERE d IN ('new', 'processed')) AS ok, count(*) FILTER (WHERE d = 'new') AS "new", count(*) FILTER (WHERE d = 'processed') AS processed, count(*) FILTER (WHERE d = 'skip') AS skip, count(*) FILTER (WHERE d = 'error') AS error FROM (
SELECT source, CASE WHEN doc_id % 2 = 1 THEN NULL WHEN doc_id % 3 = 0 AND doc_id % 5 > 0 THEN 'skip' WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 3 = 0 THEN 'processed' ELSE 'new' END AS d FROM documents) q GROUP BY source""")
def d22b_run_totals(spark, sf_dir):
    n = F.col("doc_id")
    own = docs(spark, sf_dir).select("source", L.run_decision(n % 2 == 0, n % 3 == 0, n % 5 == 0, n % 7 == 0).alias("decision"))
    return L.run_totals(own, "source")


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'clean' WHEN doc_id % 8 = 0 THEN 'raw' END AS kind, CASE WHEN doc_id % 4 > 0 THEN 'not locked' WHEN doc_id % 3 = 0 OR doc_id % 8 = 0 THEN '' ELSE 'no text' END AS reason FROM documents")
def h29_locked_sources(spark, sf_dir):
    n = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", L.source_choice(F.lit("text"), n % 3 == 0, n % 8 == 0, n % 4 == 0).alias("s")).select("doc_id", "s.*")


@query("SELECT kind, count(*) AS total, CAST(greatest(1, ceil(count(*) / 30.0)) AS BIGINT) AS pages FROM inb GROUP BY kind UNION ALL SELECT 'none', 0, 1", "inb")
def f4_page_counts(spark, sf_dir):
    own, out = view(spark, sf_dir, "inb"), None
    for kind in ("pdf", "word", "excel", "ppt", "image", "text", "other", "none"):
        part = I.page_count(own.filter(F.col("kind") == kind), 30).select(F.lit(kind).alias("kind"), "total", "pages")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, strftime(moment, '%Y-%m-%d %H:%M:%S') || '（JST）' AS short, CASE WHEN doc_id % 5 = 0 THEN 'soon' WHEN doc_id % 7 = 0 THEN '—' ELSE year(moment) || '年' || month(moment) || '月' || day(moment) || '日　' || strftime(moment, '%H時%M分%S秒') END AS long FROM (SELECT doc_id, TIMESTAMP '2024-01-31 23:59:58' + doc_id * INTERVAL 3601 SECOND AS moment FROM documents) q")
def h9_display_times(spark, sf_dir):
    n = F.col("doc_id")
    at = F.lit("2024-01-31 23:59:58").cast("timestamp_ntz") + F.make_dt_interval(secs=n * 3601)
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    long = F.when(n % 5 == 0, "soon").when(n % 7 == 0, F.lit(None).cast("string")).otherwise(iso)
    return docs(spark, sf_dir).select("doc_id", T.jst_short(iso).alias("short"), T.jst_long(long).alias("long"))


@query("SELECT doc_id, CASE WHEN doc_id % 14 BETWEEN 1 AND 12 THEN 'logs/' || source || '/app_2024-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '.jsonl' END AS path FROM documents")
def h28_log_paths(spark, sf_dir):
    month = F.format_string("2024-%02d", F.col("doc_id") % 14)
    return docs(spark, sf_dir).select("doc_id", T.log_path(F.concat(F.lit("logs/"), "source", F.lit("/")), "app", month).alias("path"))


@query("SELECT project_year, project_no FROM prj WHERE CAST(project_no AS INTEGER) BETWEEN 1 AND 200 AND src_key % 6 > 0", "prj")
def h32_number_range(spark, sf_dir):
    given = F.when(F.col("src_key") % 6 == 0, "x").otherwise(F.col("project_no"))
    return _prj(spark, sf_dir).filter(T.number_in(given)).select("project_year", "project_no")


@query("""SELECT conv_id, turn, CAST(turn AS INTEGER) AS first_year, trim(question) AS question, trim(answer) AS answer, CAST(conv_id % 9 AS INTEGER) AS top_k, len(CAST(conv_id AS VARCHAR)) AS ref_chars FROM qa""", "qa")
def a24_result_payload(spark, sf_dir):
    """Read back from the payload: every part of it is in it."""
    own = view(spark, sf_dir, "qa")
    made = own.select("conv_id", "turn", L.answer_payload(F.concat(F.lit(" "), "question"), F.col("answer"), F.array(F.col("turn").cast("int"), F.lit(2024)), F.col("conv_id") % 9, F.array(F.col("conv_id").cast("string"))).alias("p"))
    schema = "query struct<question string, top_k int, selected_years array<int>>, result struct<answer string>, used_references array<string>"
    j = made.select("conv_id", "turn", F.from_json("p", schema).alias("j"))
    return j.select("conv_id", "turn", F.col("j.query.selected_years")[0].alias("first_year"), "j.query.question", "j.result.answer", "j.query.top_k", F.char_length(F.col("j.used_references")[0]).alias("ref_chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x' || doc_id END AS a, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS \"b c\", CASE WHEN doc_id % 50 = 0 THEN '[1]' END AS z FROM documents WHERE doc_id % 7 > 0")
def a1b_union_of_keys(spark, sf_dir):
    n, v = F.col("doc_id"), F.col("doc_id").cast("string")
    parts = F.array_compact(F.array(F.when(n % 2 == 0, F.concat(F.lit('"a":"x'), v, F.lit('"'))), F.when(n % 3 == 0, F.concat(F.lit('"b c":'), v)), F.when(n % 50 == 0, '"z":[1]')))
    line = F.when(n % 7 == 0, F.concat(F.lit("{"), F.array_join(parts, ","))).otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
    return J.all_rows(docs(spark, sf_dir).select("doc_id", line.alias("line")))


@query(r"""SELECT '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS month, CAST(sum(2 + len(text) - len(replace(text, chr(10), ''))) AS BIGINT) AS lines_total, count(*) FILTER (WHERE doc_id % 7 > 1) AS rows_ok,
count(*) FILTER (WHERE doc_id % 7 = 0) + CAST(sum(len(list_filter(string_split(text, chr(10)), lambda l: trim(l, chr(32) || chr(9)) <> ''))) AS BIGINT) AS rows_bad_json, count(*) FILTER (WHERE doc_id % 7 = 1) AS lines_unread
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\n\x09\x20-\x7e]|["{}\[\]]', '.', 'g') AS text FROM documents) d WHERE doc_id % 12 BETWEEN 2 AND 9 GROUP BY doc_id % 12""")
def a2b_log_statistics(spark, sf_dir):
    """Monthly files of a log, each document's lines and a line of JSON, a broken one or one that is not UTF-8, read by months."""
    n = F.col("doc_id")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r'[^\n\x09\x20-\x7e]|["{}\[\]]', ".")
    own = F.when(n % 7 == 0, F.lit("{bad")).when(n % 7 == 1, F.unhex(F.lit("7BFF7D")).cast("string")).otherwise(F.concat(F.lit('{"doc":'), n.cast("string"), F.lit("}")))
    month = F.format_string("2024-%02d", n % 12 + 1)
    path = new_path(spark, "monthly")
    docs(spark, sf_dir).select(F.concat(own, F.lit("\n"), text).alias("value"), month.alias("month")).write.partitionBy("month").text(path)
    return J.month_stats(spark, path, "2024-03", "2024-10")


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month, event_type AS action, CAST(user_id AS VARCHAR) AS \"user\", 'app' AS app_name, 'page' AS page_name FROM events")
def a3_log_rows(spark, sf_dir):
    """Written under its months and read back."""
    own = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("action"), "event_id")
    path = new_path(spark, "log")
    J.write_log(own, path, "app", "page")
    back = spark.read.schema("ts string, user string, action string, event_id long, app_name string, page_name string, month string").json(path)
    return back.select("event_id", "month", "action", "user", "app_name", "page_name")


@query("SELECT item_id, CASE WHEN found THEN kind || '/' || item_id || '__' || original_name END AS path, CASE WHEN found THEN n END AS content_bytes FROM (SELECT item_id, kind, original_name, true AS found, strlen(text) AS n FROM inb JOIN documents ON CAST(doc_id AS VARCHAR) = item_id WHERE CAST(item_id AS BIGINT) % 9 = 0 UNION ALL SELECT 'no such', '', '', false, 0) q", "inb")
def a21_bulk_export(spark, sf_dir):
    """Written with contents, by kind, and read back with the list of what was missing."""
    own = view(spark, sf_dir, "inb").join(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("item_id"), "text"), "item_id")
    wanted = own.filter("cast(item_id as long) % 9 = 0").select("item_id").union(spark.createDataFrame([("no such",)], "item_id string"))
    path = new_path(spark, "export")
    I.write_export(I.exported(own, wanted, "text"), path)
    found = spark.read.schema("item_id string, path string, content string, kind string").parquet(f"{path}/items").select("item_id", "path", F.octet_length("content").cast("long").alias("content_bytes"))
    none = F.lit(None)
    return found.unionByName(spark.read.schema("item_id string").parquet(f"{path}/missing").select("item_id", none.cast("string").alias("path"), none.cast("long").alias("content_bytes")))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 > 0 AND doc_id % 5 > 0 AND doc_id % 7 > 0 AS valid FROM documents")
def b12_manual_ok(spark, sf_dir):
    n, sha = F.col("doc_id"), F.sha2("text", 256)
    then = F.when(n % 2 == 0, F.upper(sha)).otherwise(F.lit("x"))
    names = [F.col("source"), F.when(n % 3 == 0, "other").otherwise(F.col("source")), F.when(n % 5 > 0, F.col("source"))]
    return docs(spark, sf_dir).select("doc_id", L.manual_ok_valid(n % 7 > 0, names, sha, then).alias("valid"))
