"""Views over the test tables that stand for the library's input tables; one SQL text for Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "documents", "embeddings", "conversations", "orders")

VIEWS = {
    "ses": "SELECT event_id, concat(CAST(user_id AS VARCHAR(20)),'-app',CAST(event_id%4 AS VARCHAR(20))) AS session_id, CAST(user_id AS VARCHAR(20)) AS user_sub, concat('app',CAST(event_id%4 AS VARCHAR(20))) AS app_name, CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' ELSE 'heartbeat' END AS kind, ts FROM events",
    "run": "SELECT CAST(event_id AS VARCHAR(20)) AS run_id, CAST(user_id AS VARCHAR(20)) AS user_sub, concat('app',CAST(event_id%4 AS VARCHAR(20))) AS app_name, CASE event_id%4 WHEN 0 THEN 'gpt-5-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'text-embedding-3-large' ELSE 'unpriced' END AS model, CASE WHEN event_type='error' THEN 'error' WHEN event_id%7=0 THEN 'running' ELSE 'success' END AS status, ts AS started_at, CASE WHEN event_id%7=0 AND event_type<>'error' THEN NULL ELSE CAST(event_id%5000 AS BIGINT) END AS elapsed_ms, CASE WHEN event_id%11=0 THEN NULL ELSE event_id%2000 END AS input_tokens, CASE WHEN event_id%13=0 THEN NULL ELSE event_id%700 END AS output_tokens, CASE WHEN event_id%4=3 THEN 'local' ELSE 'openai' END AS provider, CASE WHEN event_id%4=2 THEN 'embedding' ELSE 'chat' END AS task_type, concat('page',CAST(event_id%3 AS VARCHAR(20))) AS page_name, CASE WHEN event_id%10=0 THEN NULL ELSE CAST(event_id-event_id%10 AS VARCHAR(20)) END AS parent_run_id, CASE WHEN event_id%3=0 THEN NULL ELSE concat('{\"n\":',CAST(event_id%5 AS VARCHAR(20)),'}') END AS start_meta, CASE WHEN event_id%2=0 THEN concat('{\"k\":',CAST(event_id%9 AS VARCHAR(20)),'}') END AS finish_meta, CASE WHEN event_type='error' THEN concat('E',CAST(event_id%6 AS VARCHAR(20))) END AS error_type FROM events",
    "inb": "SELECT CAST(doc_id AS VARCHAR(20)) AS item_id, CASE doc_id%7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' WHEN 2 THEN 'excel' WHEN 3 THEN 'ppt' WHEN 4 THEN 'image' WHEN 5 THEN 'text' ELSE 'other' END AS kind, concat(CASE doc_id%3 WHEN 0 THEN '9' WHEN 1 THEN 'Report' ELSE '_x' END,source,'_',CAST(doc_id AS VARCHAR(20)),'.bin') AS original_name, n_chars AS size_bytes, concat('[\"',lang,'\",\"',source,'\"]') AS tags_json, CAST(DATE '2024-01-01' + CAST(doc_id%60 AS INT) AS TIMESTAMP) AS added_at, CAST(doc_id%50 AS VARCHAR(20)) AS owner FROM documents",
    "lv": "SELECT CAST(user_id AS VARCHAR(20)) AS user_sub, CAST(event_id%200 AS VARCHAR(20)) AS item_id, max(ts) AS last_viewed_at FROM events GROUP BY user_id, event_id%200",
    "prj": "SELECT year(o_orderdate) AS project_year, lpad(CAST(o_orderkey%1000 AS VARCHAR(20)),3,'0') AS project_no, min(o_orderkey) AS src_key, min(o_custkey) AS client_id, max(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS pdf_lock_flag, CASE WHEN min(o_orderkey)%5=0 THEN NULL WHEN min(o_orderkey)%7=0 THEN '  ' ELSE concat('report_',CAST(min(o_orderkey) AS VARCHAR(20)),'.pdf') END AS report_pdf_stored_filename FROM orders GROUP BY year(o_orderdate), o_orderkey%1000",
    "vec": "SELECT CAST(vec_id%4 AS VARCHAR(20)) AS shard_id, CAST(FLOOR(vec_id/4) AS BIGINT) AS vector_index, vec_id, embedding FROM embeddings",
    "meta": "SELECT CAST(vec_id%4 AS VARCHAR(20)) AS shard_id, CAST(FLOOR(vec_id/4) AS BIGINT) AS vector_index, concat('d',CAST(CAST(FLOOR(vec_id/12) AS BIGINT) AS VARCHAR(20))) AS doc_id, (vec_id*37)%9000 AS chunk_len_tokens FROM embeddings WHERE vec_id%10<>0",
    "manifest": "SELECT DISTINCT CAST(vec_id%4 AS VARCHAR(20)) AS shard_id, concat('d',CAST(CAST(FLOOR(vec_id/12) AS BIGINT) AS VARCHAR(20))) AS doc_id FROM embeddings WHERE CAST(FLOOR(vec_id/12) AS BIGINT)%6<>0 UNION ALL SELECT '0','d-extra'",
    "stat": "SELECT event_id, event_id%200 AS doc_id, ts, CASE event_type WHEN 'signup' THEN 'pdf_info' WHEN 'click' THEN 'ocr' WHEN 'view' THEN 'text' WHEN 'purchase' THEN 'clean' ELSE 'error' END AS stage, CASE WHEN event_id%3=0 THEN 'image' ELSE 'text' END AS pdf_kind FROM events",
    "qa": "SELECT conv_id, turn, text AS question, nxt AS answer FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole FROM conversations) q WHERE role='user' AND nrole='assistant'",
    "log": "SELECT event_id AS line_no, CASE WHEN event_id%50=1 THEN '{bad' WHEN event_id%50=2 THEN '' WHEN event_id%50=3 THEN '[1]' ELSE concat('{\"user\":\"',CAST(user_id AS VARCHAR(20)),'\",\"action\":\"',event_type,'\"}') END AS line FROM events",
}
#: DuckDB's form of pages of five lines; Spark's is made by operators.pages.
PAGE_SQL = "SELECT doc_id, CAST(FLOOR((pos-1)/5) AS BIGINT)+1 AS page_no, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) q GROUP BY doc_id, CAST(FLOOR((pos-1)/5) AS BIGINT)+1"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its plan holds the tables, so the temporary names may be reused."""
    for t in TABLES:
        if t in VIEWS[name]:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Registers the decorated function (spark, sf_dir) -> DataFrame with its SQL over the named views."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            parts = [f"{v} AS ({PAGE_SQL if v == 'page' else VIEWS[v]})" for v in views]
            SQL[key] = (f"WITH {', '.join(parts)} " if parts else "") + sql.strip()
        return f

    return keep
