from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import lifecycle as L
from loomframe.operators.states import document_states
from loomframe.plans.views import query, table, view
from loomframe.sources import jsonl as J
from loomframe.sources.shared import new_path

_log = lambda spark, sf_dir: view(spark, sf_dir, "log")
_prj = lambda spark, sf_dir: view(spark, sf_dir, "prj")


@query("SELECT line_no, line[10:strpos(line, '\",') - 1] AS \"user\", split_part(split_part(line, '\"action\":\"', 2), '\"', 1) AS action FROM log WHERE line LIKE '{\"user%'", "log")
def a1_tolerant_rows(spark, sf_dir):
    return J.rows(_log(spark, sf_dir), "user string, action string")


@query("SELECT count(*) AS lines_total, count(*) FILTER (WHERE line LIKE '{\"%') AS rows_ok, count(*) FILTER (WHERE line IN ('{bad', '[1]')) AS rows_bad_json FROM log", "log")
def a2_load_statistics(spark, sf_dir):
    return J.stats(_log(spark, sf_dir))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m') AS month, CASE WHEN event_id % 3 = 0 THEN '(anonymous)' ELSE CAST(user_id AS VARCHAR) END AS \"user\" FROM events")
def h11_normalised_log(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("ts"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("user"))
    return J.normalised(own).select("event_id", "date", "month", "user")


@query("SELECT event_id, 'WARN' AS level, event_type AS action, 'inbox' AS app_name FROM events WHERE event_type = 'error'")
def a5_level_rows(spark, sf_dir):
    own = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.col("event_type").alias("action"))
    return J.enveloped(own, "inbox", level="WARN")


@query("SELECT month, max(file) AS file FROM (SELECT '2024-0' || CAST(event_id % 9 + 1 AS VARCHAR) AS month, 'd' || CAST(event_id % 5 AS VARCHAR) || '/app_2024-0' || CAST(event_id % 9 + 1 AS VARCHAR) || '.jsonl' AS file FROM events) q GROUP BY month")
def a4_months(spark, sf_dir):
    n = F.col("event_id")
    own = table(spark, sf_dir, "events").select(F.concat(F.lit("d"), (n % 5).cast("string"), F.lit("/app_2024-0"), (n % 9 + 1).cast("string"), F.lit(".jsonl")).alias("file"))
    return J.months(own, "app")


_META = "CASE vec_id % 50 WHEN 1 THEN '{bad' WHEN 2 THEN '[1]' WHEN 3 THEN '{\"a\":1}' WHEN 4 THEN '{\"vector_index\":\"x\"}' WHEN 5 THEN '{\"vector_index\":-1}' WHEN 6 THEN '{\"vector_index\":999999}' ELSE concat('{\"vector_index\":', CAST(vec_id - vec_id % 2 AS VARCHAR(20)), '}') END"


@query("""SELECT line_no, CASE WHEN issue IS NULL OR issue IN ('duplicate', 'negative', 'out_of_range') THEN i END AS vector_index, issue FROM (
SELECT vec_id AS line_no, CASE vec_id % 50 WHEN 5 THEN -1 WHEN 6 THEN 999999 ELSE vec_id - vec_id % 2 END AS i,
CASE vec_id % 50 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'not_dict' WHEN 3 THEN 'missing' WHEN 4 THEN 'non_int' WHEN 5 THEN 'negative' WHEN 6 THEN 'out_of_range' ELSE CASE WHEN vec_id % 2 = 1 AND vec_id % 50 > 7 THEN 'duplicate' END END AS issue FROM embeddings) q""")
def a6_checked_metadata(spark, sf_dir):
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    return J.checked_meta(spark.sql(f"SELECT vec_id AS line_no, {_META} AS line FROM embeddings"), 999_999)


@query("SELECT line_no, line AS raw FROM log WHERE line IN ('{bad', '[1]')", "log")
def a7_broken_lines(spark, sf_dir):
    return _log(spark, sf_dir).filter("line <> ''").filter(~J.is_object(F.col("line"))).select("line_no", F.col("line").alias("raw"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS source_text_kind, '' AS embed_model, n_chars AS span_end, CAST(0 AS BIGINT) AS page_start FROM documents")
def a8_record_defaults(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("source_text_kind"), F.col("n_chars").alias("span_end"))
    return J.with_defaults(own, ["doc_id", "source_text_kind", "embed_model"], ["span_end", "page_start"])


_STATUS = """, kept AS (SELECT * FROM (SELECT *, max(event_id) FILTER (WHERE stage = 'pdf_info') OVER (PARTITION BY doc_id) AS reset FROM stat) q WHERE reset IS NULL OR event_id >= reset),
st AS (SELECT doc_id, arg_max(pdf_kind, event_id) FILTER (WHERE stage = 'pdf_info') AS pdf_kind, max(ts) FILTER (WHERE stage = 'ocr') AS ocr_at, max(ts) FILTER (WHERE stage = 'text') AS text_at, max(ts) FILTER (WHERE stage = 'clean') AS clean_at,
max(ts) FILTER (WHERE stage = 'error') AS e FROM kept GROUP BY doc_id)"""


def _status_sql(body: str) -> str:
    from loomframe.plans.views import VIEWS

    return f"WITH stat AS ({VIEWS['stat']}){_STATUS} {body}"


_LATEST = _status_sql("SELECT doc_id, pdf_kind, ocr_at IS NOT NULL AS ocr_done, ocr_at, text_at IS NOT NULL AS text_done, text_at, clean_at IS NOT NULL AS clean_done, clean_at, CASE WHEN e > coalesce(greatest(ocr_at, text_at, clean_at), TIMESTAMP '1970-01-01') THEN e END AS error_at FROM st")


@query(_LATEST)
def n1_latest_status(spark, sf_dir):
    return L.latest_status(view(spark, sf_dir, "stat"))


@query(_LATEST)
def n1b_merged_status(spark, sf_dir):
    """The same from a state table into which the events were merged in three batches."""
    states = document_states(spark, new_path(spark, "documents"), 8)
    events = view(spark, sf_dir, "stat")
    for k in (1, 2, 0):
        states.update(L.status_partials(events.filter(F.col("event_id") % 3 == k)))
    return L.finished_status(states.read())


@query(_status_sql("SELECT doc_id, coalesce((pdf_kind = 'text' AND text_at IS NOT NULL) OR (pdf_kind = 'image' AND clean_at IS NOT NULL), false) AS ready, CASE WHEN clean_at IS NOT NULL THEN 'clean' WHEN pdf_kind = 'text' AND text_at IS NOT NULL THEN 'raw' END AS kind FROM st"))
def n5_ready_documents(spark, sf_dir):
    own = L.latest_status(view(spark, sf_dir, "stat"))
    choice = L.source_choice(F.col("pdf_kind"), F.col("clean_done"), F.col("text_done"))
    return own.select("doc_id", F.coalesce(L.ready(F.col("pdf_kind"), F.col("text_done"), F.col("clean_done")), F.lit(False)).alias("ready"), choice["kind"].alias("kind"))


@query(_status_sql("SELECT coalesce(pdf_kind, 'none') AS pdf_kind, count(*) AS docs, count(text_at) AS text_docs, count(clean_at) AS clean_docs FROM st GROUP BY ALL"))
def d22_status_counts(spark, sf_dir):
    own = L.latest_status(view(spark, sf_dir, "stat"))
    return own.groupBy(F.coalesce("pdf_kind", F.lit("none")).alias("pdf_kind")).agg(F.count("*").alias("docs"), F.count_if("text_done").alias("text_docs"), F.count_if("clean_done").alias("clean_docs"))


@query("SELECT project_year, count(*) AS projects FROM prj GROUP BY project_year", "prj")
def d5_projects_per_year(spark, sf_dir):
    return _prj(spark, sf_dir).groupBy("project_year").agg(F.count("*").alias("projects"))


@query("SELECT DISTINCT project_year FROM prj WHERE trim(coalesce(report_pdf_stored_filename, '')) <> '' ORDER BY 1", "prj")
def d6_years_with_reports(spark, sf_dir):
    return _prj(spark, sf_dir).filter("trim(coalesce(report_pdf_stored_filename, '')) <> ''").select("project_year").distinct().orderBy("project_year")


@query("SELECT project_year, project_no, trim(report_pdf_stored_filename) AS stored FROM prj WHERE project_year = 1995 AND trim(coalesce(report_pdf_stored_filename, '')) <> ''", "prj")
def f8_reports_of_a_year(spark, sf_dir):
    return L.reports_of(_prj(spark, sf_dir), 1995)


@query("SELECT project_year, project_no, src_key, client_id FROM prj WHERE project_year = 1996 AND project_no = '007'", "prj")
def b7_project_by_key(spark, sf_dir):
    return _prj(spark, sf_dir).filter("project_year = 1996 and project_no = '007'").select("project_year", "project_no", "src_key", "client_id")


@query("SELECT project_year, project_no FROM prj WHERE project_year <> 1995", "prj")
def g7_without_year(spark, sf_dir):
    return _prj(spark, sf_dir).filter("project_year <> 1995").select("project_year", "project_no")


@query("SELECT project_year AS \"年度\", project_no AS \"番号\", client_id FROM prj", "prj")
def a22_labelled_export(spark, sf_dir):
    return _prj(spark, sf_dir).select("project_year", "project_no", "client_id").withColumnsRenamed({"project_year": "年度", "project_no": "番号", "none": "x"})


@query("""SELECT y AS project_year, n AS project_no, s AS state, s = 'S0' AS can_insert, s <> 'S3' AS can_edit_pdf, s <> 'S4' AS can_edit_text FROM (
SELECT w.y, w.n, CASE WHEN p.pdf_lock_flag IS NULL THEN 'S0' WHEN p.pdf_lock_flag = 1 THEN 'S3' WHEN p.src_key % 2 = 0 THEN 'S4' ELSE 'S1' END AS s
FROM (SELECT project_year + 1 AS y, project_no AS n FROM prj) w LEFT JOIN prj p ON w.y = p.project_year AND w.n = p.project_no) q""", "prj")
def n6_project_states(spark, sf_dir):
    own = _prj(spark, sf_dir)
    rag = own.select("project_year", "project_no", F.when(F.col("src_key") % 2 == 0, " Ingested").otherwise("failed").alias("rag_status"))
    return L.project_state(own, rag, own.select((F.col("project_year") + 1).alias("project_year"), "project_no"))


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'skip' WHEN event_id % 5 = 0 THEN 'unchecked' WHEN event_id % 11 = 0 THEN 'manual_ok' WHEN event_id % 3 = 0 OR event_id % 7 = 1 THEN 'needs_review'
WHEN event_id % 4 > 0 AND event_id % 2 = 0 THEN 'special_ok' WHEN event_id % 4 > 0 THEN 'needs_review' ELSE 'ok' END AS status FROM events""")
def n4_text_check(spark, sf_dir):
    n = F.col("event_id")
    level = F.when(n % 3 == 0, "warning").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", L.text_check(n % 5 != 0, level, (n % 7 == 1).cast("int"), n % 4, n % 2 == 0, n % 11 == 0, n % 13 == 0).alias("status"))


@query("""SELECT project_year, count(*) FILTER (WHERE d = 'skip') AS skipped, count(*) FILTER (WHERE d = 'text') AS text, count(*) FILTER (WHERE d = 'image') AS image, count(*) FILTER (WHERE d = 'error') AS error FROM (
SELECT project_year, CASE WHEN pdf_lock_flag <> 1 THEN 'skip' WHEN trim(coalesce(report_pdf_stored_filename, '')) = '' THEN 'error' WHEN src_key % 3 = 0 THEN 'image' ELSE 'text' END AS d FROM prj) q GROUP BY project_year""", "prj")
def n8_year_checks(spark, sf_dir):
    kind = F.when(F.col("src_key") % 3 == 0, "image").otherwise("text")
    has = F.trim(F.coalesce("report_pdf_stored_filename", F.lit(""))) != ""
    own = _prj(spark, sf_dir).withColumn("d", L.check_decision(F.col("pdf_lock_flag") == 1, F.lit(False), kind, has))
    count = lambda d, name: F.count_if(F.col("d") == d).alias(name)
    return own.groupBy("project_year").agg(count("skip", "skipped"), count("text", "text"), count("image", "image"), count("error", "error"))


@query("SELECT conv_id, turn, question, answer FROM qa", "qa")
def c13_turn_pairs(spark, sf_dir):
    return L.turn_pairs(table(spark, sf_dir, "conversations"))


@query("SELECT CAST(conv_id AS VARCHAR) AS user_sub, trim(question) AS question, trim(answer) AS answer, '[' || CAST(turn AS VARCHAR) || ',2024]' AS selected_years_json, CAST(0 AS INTEGER) AS hit_count FROM qa", "qa")
def a23_question_record(spark, sf_dir):
    own = view(spark, sf_dir, "qa").select(F.col("conv_id").cast("string").alias("user_sub"), "question", "answer", F.array(F.col("turn"), F.lit(2024)).alias("years"), F.lit(None).cast("int").alias("hit_count"))
    return L.question_record(own)


@query("SELECT user_sub, run_id FROM (SELECT *, row_number() OVER (PARTITION BY user_sub ORDER BY started_at DESC, run_id) AS n FROM run) q WHERE n <= 5", "run")
def e7_newest_versions(spark, sf_dir):
    return L.newest(view(spark, sf_dir, "run"), "user_sub", [F.desc("started_at"), F.col("run_id")]).select("user_sub", "run_id")


@query("""SELECT project_year, project_no, coalesce(nullif(regexp_replace(trim(coalesce(report_pdf_stored_filename, '')), '\\.pdf$', ''), ''), 'text') || '_cleaned.txt' AS clean_name,
'/out/' || CAST(project_year AS VARCHAR) || project_no || '/others' AS others, '/out/' || CAST(project_year AS VARCHAR) || project_no || '/pdf/' || CAST(project_year AS VARCHAR) || project_no || '.pdf' AS report FROM prj""", "prj")
def h28_output_names(spark, sf_dir):
    from loomframe.functions import text as T

    year, no = F.col("project_year").cast("string"), F.col("project_no")
    name = F.regexp_replace("report_pdf_stored_filename", r"\.pdf$", F.when(F.col("src_key") % 2 == 0, ".TXT").otherwise(".txt"))
    return _prj(spark, sf_dir).select("project_year", "project_no", T.clean_text_name(name).alias("clean_name"), T.project_folder("/out/", year, no, "others").alias("others"), T.report_path("/out", year, no).alias("report"))
