from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from loomframe.operators import vectors as V
from loomframe.operators.pruned import pruned_search
from loomframe.plans.views import query, view

_v = lambda spark, sf_dir: view(spark, sf_dir, "vec")
_m = lambda spark, sf_dir: view(spark, sf_dir, "meta")
_p = lambda spark, sf_dir: view(spark, sf_dir, "manifest")
_RANKED = """SELECT query_id, CAST(rank AS INTEGER) AS rank, shard_id, vector_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard_id, vector_index) AS rank FROM (
SELECT q.vec_id AS query_id, c.shard_id, c.vector_index, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
FROM (SELECT * FROM vec WHERE vec_id % 20 = 0) q, {rows} c) a) b WHERE rank <= {k}"""


def _asked(spark, sf_dir):
    """Every row whose id is divisible by 20."""
    return _v(spark, sf_dir).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_RANKED.format(k=5, rows="vec"), "vec")
def l1_top_k(spark, sf_dir):
    return V.search(_v(spark, sf_dir), _asked(spark, sf_dir))


@query(_RANKED.format(k=10, rows="(SELECT vec.* FROM vec JOIN meta USING (shard_id, vector_index))"), "vec", "meta")
def l2_live_shards(spark, sf_dir):
    return V.search(V.live(_v(spark, sf_dir), _m(spark, sf_dir)), _asked(spark, sf_dir), 10)


@query(_RANKED.format(k=10, rows="vec"), "vec")
def l3_batch_search(spark, sf_dir):
    return V.search(_v(spark, sf_dir), _asked(spark, sf_dir), 10)


@query(_RANKED.format(k=10, rows="vec"), "vec")
def l5_pruned_search(spark, sf_dir):
    return pruned_search(_v(spark, sf_dir), _asked(spark, sf_dir), 10)[0]


@query(_RANKED.format(k=5, rows="(SELECT * FROM vec WHERE shard_id IN ('1', '3'))"), "vec")
def l4_named_shards(spark, sf_dir):
    return V.search(_v(spark, sf_dir), _asked(spark, sf_dir), 5, ["1", "3"])


@query(_RANKED.format(k=8, rows="vec"), "vec")
def g5_union_of_shard_hits(spark, sf_dir):
    hits = None
    for shard in ("0", "1", "2", "3"):
        found = V.search(_v(spark, sf_dir), _asked(spark, sf_dir), 8, [shard]).drop("rank")
        hits = found if hits is None else hits.unionByName(found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "shard_id", "vector_index")
    return hits.withColumn("rank", F.row_number().over(order)).filter("rank <= 8").select("query_id", "rank", "shard_id", "vector_index", "score")


@query("SELECT shard_id, vector_index, doc_id FROM vec JOIN meta USING (shard_id, vector_index)", "vec", "meta")
def c2_live_vectors(spark, sf_dir):
    return V.live(_v(spark, sf_dir), _m(spark, sf_dir)).select("shard_id", "vector_index", "doc_id")


_DOCS = "(SELECT DISTINCT shard_id, doc_id FROM meta)"


def _docs(spark, sf_dir):
    return _m(spark, sf_dir).select("shard_id", "doc_id").distinct()


@query(f"SELECT * FROM {_DOCS} d WHERE NOT EXISTS (SELECT 1 FROM manifest p WHERE p.shard_id = d.shard_id AND p.doc_id = d.doc_id)", "meta", "manifest")
def c3_unprocessed(spark, sf_dir):
    return V.unprocessed(_docs(spark, sf_dir), _p(spark, sf_dir))


@query(f"SELECT d.*, EXISTS (SELECT 1 FROM manifest p WHERE p.shard_id = d.shard_id AND p.doc_id = d.doc_id) AS ingested FROM {_DOCS} d", "meta", "manifest")
def c4_ingested_flag(spark, sf_dir):
    return V.with_ingested(_docs(spark, sf_dir), _p(spark, sf_dir))


_NOTES = """SELECT coalesce(a.shard_id, b.shard_id) AS shard_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(n, 0) AS chunks,
CASE WHEN b.doc_id IS NULL THEN 'meta only' WHEN a.doc_id IS NULL THEN 'processed only' ELSE 'both' END AS note
FROM (SELECT shard_id, doc_id, count(*) AS n FROM meta GROUP BY ALL) a FULL JOIN (SELECT DISTINCT shard_id, doc_id FROM manifest) b ON a.shard_id = b.shard_id AND a.doc_id = b.doc_id"""


@query(_NOTES, "meta", "manifest")
def c5_reconciled(spark, sf_dir):
    return V.reconciled(_m(spark, sf_dir), _p(spark, sf_dir))


@query(f"SELECT note, count(*) AS docs FROM ({_NOTES}) q WHERE note <> 'both' GROUP BY note", "meta", "manifest")
def g2_one_sided_docs(spark, sf_dir):
    return V.reconciled(_m(spark, sf_dir), _p(spark, sf_dir)).filter("note <> 'both'").groupBy("note").agg(F.count("*").alias("docs"))


@query("SELECT shard_id, doc_id, count(*) AS chunks, min(vector_index) AS first, max(vector_index) AS last FROM meta GROUP BY ALL", "meta")
def d8_doc_summary(spark, sf_dir):
    return V.doc_summary(_m(spark, sf_dir))


@query("SELECT shard_id, doc_id, count(*) AS chunks FROM meta GROUP BY ALL ORDER BY chunks DESC, shard_id, min(vector_index) LIMIT 30", "meta")
def d9_top_docs(spark, sf_dir):
    return V.doc_summary(_m(spark, sf_dir)).orderBy(F.desc("chunks"), "shard_id", "first").limit(30).select("shard_id", "doc_id", "chunks")


@query("SELECT doc_id, count(*) AS count FROM (SELECT doc_id FROM manifest) q GROUP BY doc_id HAVING count(*) > 1", "manifest")
def d10_duplicates(spark, sf_dir):
    return V.duplicates(_p(spark, sf_dir), "doc_id")


@query("SELECT vec.shard_id, vec.vector_index FROM vec ANTI JOIN meta USING (shard_id, vector_index)", "vec", "meta")
def g1_orphans(spark, sf_dir):
    return V.orphans(_v(spark, sf_dir), _m(spark, sf_dir))


@query("SELECT shard_id, doc_id FROM meta UNION SELECT shard_id, doc_id FROM manifest", "meta", "manifest")
def g3_rebuild_scope(spark, sf_dir):
    return _docs(spark, sf_dir).union(_p(spark, sf_dir).select("shard_id", "doc_id")).distinct()


@query("SELECT shard_id, vector_index FROM meta m WHERE NOT (shard_id = '1' AND doc_id IN ('d1', 'd5', 'd9'))", "meta")
def g6_without_docs(spark, sf_dir):
    gone = _docs(spark, sf_dir).filter("shard_id = '1' and doc_id in ('d1', 'd5', 'd9')")
    return V.without_docs(_m(spark, sf_dir), gone).select("shard_id", "vector_index")


@query("SELECT shard_id, vector_index - 3 AS vector_index, CASE WHEN vector_index - 3 < 0 THEN 'negative' END AS issue FROM meta WHERE vector_index < 3", "meta")
def m1_misaligned(spark, sf_dir):
    return V.misaligned(_v(spark, sf_dir), _m(spark, sf_dir).withColumn("vector_index", F.col("vector_index") - 3))


#: Shard 0 without what only one side has and without orphans, shard 1 with metadata that points behind its vectors, 2 and 3 as they are.
_LIVE = "(SELECT v.* FROM vec v WHERE v.shard_id <> '0' OR EXISTS (SELECT 1 FROM meta m WHERE m.shard_id = v.shard_id AND m.vector_index = v.vector_index))"
_DENSE = f"(SELECT shard_id, CASE WHEN shard_id = '0' THEN row_number() OVER (PARTITION BY shard_id ORDER BY vector_index) - 1 ELSE vector_index END AS vector_index FROM {_LIVE} l)"
_META2 = "(SELECT shard_id, CASE WHEN shard_id = '0' THEN row_number() OVER (PARTITION BY shard_id ORDER BY vector_index) - 1 WHEN shard_id = '1' AND vector_index % 5 = 0 THEN vector_index + 1000000 ELSE vector_index END AS vector_index, doc_id FROM meta)"
_MANIFEST2 = "(SELECT shard_id, doc_id FROM manifest WHERE shard_id <> '0' UNION SELECT shard_id, doc_id FROM meta WHERE shard_id = '0')"
_AUDIT = f"""SELECT s.shard_id, s.vectors, s.meta, s.processed, s.orphans, s.meta_only, s.processed_only, s.misaligned,
CASE WHEN misaligned > 0 THEN 'error' WHEN orphans + meta_only + processed_only > 0 THEN 'warn' ELSE 'ok' END AS health
FROM (SELECT v.shard_id, count(*) AS vectors, (SELECT count(*) FROM {_META2} m WHERE m.shard_id = v.shard_id) AS meta, (SELECT count(*) FROM {_MANIFEST2} p WHERE p.shard_id = v.shard_id) AS processed,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {_META2} m WHERE m.shard_id = v.shard_id AND m.vector_index = v.vector_index)) AS orphans,
  (SELECT count(DISTINCT m.doc_id) FROM {_META2} m WHERE m.shard_id = v.shard_id AND NOT EXISTS (SELECT 1 FROM {_MANIFEST2} p WHERE p.shard_id = m.shard_id AND p.doc_id = m.doc_id)) AS meta_only,
  (SELECT count(DISTINCT p.doc_id) FROM {_MANIFEST2} p WHERE p.shard_id = v.shard_id AND NOT EXISTS (SELECT 1 FROM {_META2} m WHERE m.shard_id = p.shard_id AND m.doc_id = p.doc_id)) AS processed_only,
  (SELECT count(*) FROM {_META2} m WHERE m.shard_id = v.shard_id AND m.vector_index >= (SELECT count(*) FROM {_DENSE} x WHERE x.shard_id = m.shard_id)) AS misaligned
  FROM {_DENSE} v GROUP BY v.shard_id) s"""


def _mixed_health(spark, sf_dir):
    vec, meta, manifest = _v(spark, sf_dir), _m(spark, sf_dir), _p(spark, sf_dir)
    first = F.col("shard_id") == "0"
    dense = F.when(first, F.row_number().over(W.partitionBy("shard_id").orderBy("vector_index")).cast("long") - 1)
    own = vec.filter(~first).unionByName(V.live(vec.filter(first), meta).select(*vec.columns)).withColumn("vector_index", dense.otherwise(F.col("vector_index")))
    moved = dense.when((F.col("shard_id") == "1") & (F.col("vector_index") % 5 == 0), F.col("vector_index") + 1_000_000)
    known = manifest.filter(~first).unionByName(meta.filter(first).select(*manifest.columns).distinct())
    return own, meta.withColumn("vector_index", moved.otherwise(F.col("vector_index"))), known


@query(_AUDIT, "vec", "meta", "manifest")
def m2_audit(spark, sf_dir):
    return V.audit(*_mixed_health(spark, sf_dir))


_TWICE = f"(SELECT * FROM {_MANIFEST2} a UNION ALL SELECT * FROM {_MANIFEST2} b WHERE shard_id IN ('2', '3') AND doc_id LIKE '%7')"
_MOVED = f"(SELECT shard_id, CASE WHEN shard_id = '2' AND vector_index % 9 = 4 THEN vector_index - 1 WHEN shard_id = '2' AND vector_index < 2 THEN vector_index - 5 ELSE vector_index END AS vector_index, doc_id FROM {_META2} x)"


def _neighbours(meta):
    at = F.col("vector_index")
    second = F.col("shard_id") == "2"
    return meta.withColumn("vector_index", F.when(second & (at % 9 == 4), at - 1).when(second & (at < 2), at - 5).otherwise(at))


_SIZES = f"(SELECT shard_id, count(*) AS size FROM {_DENSE} x GROUP BY shard_id)"
_PER_DOC = f"""(SELECT coalesce(a.shard_id, b.shard_id) AS shard_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.first, coalesce(a.m, 0) AS m, coalesce(b.p, 0) AS p FROM
(SELECT shard_id, doc_id, min(vector_index) AS first, count(*) AS m FROM {_MOVED} x GROUP BY ALL) a FULL JOIN (SELECT shard_id, doc_id, count(*) AS p FROM {_TWICE} y GROUP BY ALL) b ON a.shard_id = b.shard_id AND a.doc_id = b.doc_id)"""


@query(f"""SELECT m.shard_id, CASE WHEN vector_index < 0 THEN 'negative' ELSE 'out_of_range' END AS issue, doc_id, vector_index, CAST(1 AS BIGINT) AS n FROM {_MOVED} m LEFT JOIN {_SIZES} s ON m.shard_id = s.shard_id WHERE vector_index < 0 OR vector_index >= coalesce(size, 0)
UNION ALL SELECT shard_id, 'duplicate_index', NULL, vector_index, count(*) FROM {_MOVED} m GROUP BY shard_id, vector_index HAVING count(*) > 1
UNION ALL SELECT shard_id, 'orphan', NULL, vector_index, 1 FROM {_DENSE} v WHERE NOT EXISTS (SELECT 1 FROM {_MOVED} m WHERE m.shard_id = v.shard_id AND m.vector_index = v.vector_index)
UNION ALL SELECT shard_id, 'meta_only', doc_id, NULL, m FROM {_PER_DOC} d WHERE p = 0
UNION ALL SELECT shard_id, 'processed_only', doc_id, NULL, p FROM {_PER_DOC} d WHERE m = 0
UNION ALL SELECT shard_id, 'duplicate_processed', doc_id, NULL, p FROM {_PER_DOC} d WHERE p > 1
UNION ALL SELECT shard_id, 'top_doc', doc_id, first, m FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY m DESC, first, doc_id) AS place FROM {_PER_DOC} d WHERE m > 0) q WHERE place <= 30""", "vec", "meta", "manifest")
def m2b_audit_details(spark, sf_dir):
    """The audit's shards, with some documents of shards 2 and 3 taken in twice and some metadata of shard 2 under its neighbour's index."""
    vec, meta, manifest = _mixed_health(spark, sf_dir)
    return V.audit_details(vec, _neighbours(meta), manifest.unionByName(manifest.filter("shard_id in ('2', '3') and doc_id like '%7'")))


@query(f"""SELECT shard_id, vectors - meta AS diff, CASE WHEN misaligned > 0 THEN 'error' WHEN vectors = meta THEN 'info' ELSE 'warning' END AS need FROM ({_AUDIT}) q""", "vec", "meta", "manifest")
def m3_rebuild_need(spark, sf_dir):
    return V.rebuild_need(V.audit(*_mixed_health(spark, sf_dir)))


_STORE = "SELECT vec.shard_id, count(*) AS vectors, max(len(embedding)) AS dim, (SELECT count(*) FROM meta m WHERE m.shard_id = vec.shard_id) AS meta, (SELECT count(*) FROM manifest p WHERE p.shard_id = vec.shard_id) AS processed FROM vec GROUP BY vec.shard_id"


@query(_STORE, "vec", "meta", "manifest")
def d14_store_summary(spark, sf_dir):
    return V.store_summary(_v(spark, sf_dir), _m(spark, sf_dir), _p(spark, sf_dir))


@query(f"SELECT shard_id, k.key AS key, CAST(k.value AS VARCHAR) AS value FROM (SELECT shard_id, unnest([{{'key': 'vectors', 'value': vectors}}, {{'key': 'dim', 'value': dim}}, {{'key': 'meta', 'value': meta}}, {{'key': 'processed', 'value': processed}}]) AS k FROM ({_STORE}) q) r", "vec", "meta", "manifest")
def m8_key_values(spark, sf_dir):
    return V.key_values(V.store_summary(_v(spark, sf_dir), _m(spark, sf_dir), _p(spark, sf_dir)), "shard_id")


@query("SELECT shard_id, doc_id, vector_index AS old_index, row_number() OVER (PARTITION BY shard_id ORDER BY doc_id, vector_index) - 1 AS vector_index FROM meta", "meta")
def m6_compaction(spark, sf_dir):
    return V.compacted(_v(spark, sf_dir), _m(spark, sf_dir))


@query("""SELECT shard_id, doc_id, chunk_index, b.n + row_number() OVER (PARTITION BY shard_id ORDER BY doc_id, chunk_index) - 1 AS vector_index
FROM (SELECT shard_id, doc_id, vector_index AS chunk_index FROM meta) c JOIN (SELECT shard_id, count(*) AS n FROM vec GROUP BY shard_id) b USING (shard_id)""", "vec", "meta")
def e2_dense_index(spark, sf_dir):
    rows = _m(spark, sf_dir).select("shard_id", "doc_id", F.col("vector_index").alias("chunk_index"))
    return V.dense_index(rows, _v(spark, sf_dir).groupBy("shard_id").agg(F.count("*").alias("base")))


_OK = "chunk_len_tokens BETWEEN 0 AND 8192"


@query(f"""SELECT CAST(sum(chunk_len_tokens) FILTER (WHERE {_OK}) AS BIGINT) AS total, count(*) FILTER (WHERE {_OK}) AS n, round(avg(chunk_len_tokens) FILTER (WHERE {_OK}), 6) AS mean,
(SELECT chunk_len_tokens FROM (SELECT chunk_len_tokens, row_number() OVER (ORDER BY chunk_len_tokens) AS r, count(*) OVER () AS c FROM meta WHERE {_OK}) q WHERE r = CAST(ceil(c * 0.95) AS BIGINT)) AS p95,
max(chunk_len_tokens) FILTER (WHERE {_OK}) AS most, count(*) FILTER (WHERE chunk_len_tokens > 8192) AS outliers,
round(CAST(sum(chunk_len_tokens) FILTER (WHERE {_OK}) AS DOUBLE) / 1e6 * 0.13, 9) AS usd, round(CAST(sum(chunk_len_tokens) FILTER (WHERE {_OK}) AS DOUBLE) / 1e6 * 0.13 * 150, 6) AS jpy FROM meta""", "meta")
def d7_embedding_costs(spark, sf_dir):
    return V.embedding_costs(_m(spark, sf_dir), 0.13)


_NEXT = "r.t + o.w > 120000 OR r.n >= 48"


@query(f"""SELECT shard_id, vector_index, chunk_len_tokens, batch_no FROM (
  WITH RECURSIVE o AS (SELECT *, coalesce(chunk_len_tokens, 0) AS w, row_number() OVER (PARTITION BY shard_id ORDER BY vector_index, chunk_len_tokens) AS k FROM meta),
  r AS (SELECT shard_id, k, CAST(0 AS BIGINT) AS batch_no, CAST(w AS BIGINT) AS t, 1 AS n FROM o WHERE k = 1 UNION ALL
    SELECT o.shard_id, o.k, CASE WHEN {_NEXT} THEN batch_no + 1 ELSE batch_no END, CASE WHEN {_NEXT} THEN o.w ELSE r.t + o.w END, CASE WHEN {_NEXT} THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.shard_id = r.shard_id AND o.k = r.k + 1)
  SELECT * FROM o JOIN r USING (shard_id, k)) q""", "meta")
def l0b_packed_requests(spark, sf_dir):
    return V.packed(_m(spark, sf_dir), "chunk_len_tokens", "vector_index", 120_000, 48, "shard_id")
