from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import text as T
from loomframe.operators import items as I
from loomframe.operators.pages import Order
from loomframe.plans.views import query, view

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_JOIN = "FROM inb LEFT JOIN (SELECT * FROM lv WHERE user_sub = '7') v ON inb.item_id = v.item_id"
_RANK = "CASE kind WHEN 'pdf' THEN 1 WHEN 'word' THEN 2 WHEN 'excel' THEN 3 WHEN 'ppt' THEN 4 WHEN 'image' THEN 5 WHEN 'text' THEN 6 WHEN 'other' THEN 7 ELSE 99 END"
_CLASS = "CASE WHEN regexp_matches(original_name, '^[0-9]') THEN 0 WHEN regexp_matches(original_name, '^[A-Za-z]') THEN 1 ELSE 2 END"


def _items(spark, sf_dir):
    return view(spark, sf_dir, "inb")


def _viewed(spark, sf_dir, user="7"):
    return I.with_views(_items(spark, sf_dir), view(spark, sf_dir, "lv"), user)


@query(f"SELECT inb.item_id, last_viewed_at {_JOIN}", "inb", "lv")
def c1_items_last_viewed(spark, sf_dir):
    return _viewed(spark, sf_dir).select("item_id", "last_viewed_at")


@query(f"SELECT inb.item_id {_JOIN} WHERE kind IN ('pdf', 'word', 'other') AND contains({_LOW.format('tags_json')}, 'en') AND contains({_LOW.format('original_name')}, 'report') AND added_at >= TIMESTAMP '2024-01-05' AND added_at < TIMESTAMP '2024-02-11' AND size_bytes BETWEEN 100 AND 100000", "inb", "lv")
def b1_search(spark, sf_dir):
    found = I.search(_viewed(spark, sf_dir), ["pdf", "word", "other"], ("EN",), ("report",), "2024-01-05", "2024-02-10", 100, 100000)
    return found.select("item_id")


@query("SELECT item_id FROM inb WHERE false", "inb")
def b1a_no_kinds(spark, sf_dir):
    return I.search(_items(spark, sf_dir), []).select("item_id")


@query(f"SELECT item_id FROM inb WHERE {_LOW.format('tags_json')} LIKE '%s_c1%'", "inb")
def b1b_raw_tags(spark, sf_dir):
    return I.search(_items(spark, sf_dir), tag_terms=("S_C1",), raw_like=True).select("item_id")


@query(f"SELECT item_id FROM inb WHERE contains({_LOW.format('original_name')}, 'src1') AND contains({_LOW.format('original_name')}, '_1')", "inb")
def b1c_name_terms(spark, sf_dir):
    return I.search(_items(spark, sf_dir), name_terms=("SRC1", "_1")).select("item_id")


@query("SELECT item_id FROM inb WHERE added_at >= TIMESTAMP '2024-01-10' AND added_at < TIMESTAMP '2024-01-13'", "inb")
def b1d_added_between(spark, sf_dir):
    return I.search(_items(spark, sf_dir), added_from="2024-01-10", added_to="2024-01-12").select("item_id")


@query("SELECT item_id FROM inb WHERE size_bytes >= 2000", "inb")
def b1e_size_from(spark, sf_dir):
    return I.search(_items(spark, sf_dir), size_min=2000).select("item_id")


@query(f"SELECT inb.item_id, last_viewed_at IS NULL AS never {_JOIN} WHERE last_viewed_at IS NULL OR last_viewed_at >= TIMESTAMP '2024-01-20'", "inb", "lv")
def b1f_viewed_modes(spark, sf_dir):
    own = _viewed(spark, sf_dir)
    never, since = I.search(own, viewed="never"), I.search(own, viewed="ever", viewed_since="2024-01-20 00:00:00")
    return never.select("item_id", F.lit(True).alias("never")).union(since.select("item_id", F.lit(False)))


@query("SELECT item_id, kind, original_name, added_at, size_bytes FROM inb WHERE kind IN ('image', 'text') AND size_bytes > 500", "inb")
def b2_minimal_list(spark, sf_dir):
    return I.search(_items(spark, sf_dir), ["image", "text"], size_min=501).select("item_id", "kind", "original_name", "added_at", "size_bytes")


@query("SELECT item_id, kind, coalesce(NULL, '') AS note FROM inb WHERE item_id = '42'", "inb")
def b3_point_lookup(spark, sf_dir):
    own = _items(spark, sf_dir).withColumn("note", F.lit(None).cast("string"))
    return own.filter("item_id = '42'").select("item_id", "kind", F.coalesce("note", F.lit("")).alias("note"))


#: The keys of the order by name, by name.
_BY_NAME = lambda: {"class": I.name_class(), "low": T.ascii_lower(F.col("original_name")), "id": F.col("item_id")}


def _page(order: str, columns: str = "inb.item_id") -> str:
    return f"SELECT {columns} {_JOIN} ORDER BY {order} LIMIT 25 OFFSET 50"


@query(_page(f"{_CLASS}, {_LOW.format('original_name')}, inb.item_id"), "inb", "lv")
def f1_by_name(spark, sf_dir):
    return I.page(_viewed(spark, sf_dir), I.ordering("name"), 3, 25).select("item_id")


@query(_page(f"{_CLASS}, {_LOW.format('original_name')}, inb.item_id"), "inb", "lv")
def f1b_page_from_ranges(spark, sf_dir):
    """The third page from a stored order, of which only the ranges that hold it are sorted."""
    return Order(_viewed(spark, sf_dir), _BY_NAME(), range_rows=60).page(3, 25).select("item_id")


@query(_page(f"{_CLASS}, {_LOW.format('original_name')}, inb.item_id"), "inb", "lv")
def f1c_page_after_page(spark, sf_dir):
    """The third page by going on from the last row of the second."""
    order, key = Order(_viewed(spark, sf_dir), _BY_NAME(), range_rows=60), None
    for _ in range(3):
        rows, key = order.after(key, 25)
    return rows.select("item_id")


@query(_page("last_viewed_at DESC NULLS LAST, added_at DESC, inb.item_id"), "inb", "lv")
def f2b_viewed_from_ranges(spark, sf_dir):
    keys = {"viewed": F.col("last_viewed_at"), "added": F.col("added_at"), "id": F.col("item_id")}
    return Order(_viewed(spark, sf_dir), keys, ("viewed", "added"), range_rows=60).page(3, 25).select("item_id")


@query(_page(f"{_RANK}, added_at DESC, inb.item_id"), "inb", "lv")
def f1_by_kind_and_added(spark, sf_dir):
    return I.page(_viewed(spark, sf_dir), I.ordering("added", True), 3, 25).select("item_id")


@query(_page("last_viewed_at DESC NULLS LAST, added_at DESC, inb.item_id"), "inb", "lv")
def f2_by_viewed(spark, sf_dir):
    return I.page(_viewed(spark, sf_dir), I.ordering("viewed"), 3, 25).select("item_id")


@query(f"SELECT q.item_id, n AS total FROM (SELECT inb.item_id, count(*) OVER () AS n {_JOIN} WHERE kind = 'pdf' ORDER BY added_at DESC, inb.item_id LIMIT 20 OFFSET 20) q", "inb", "lv")
def f3_page_with_total(spark, sf_dir):
    own = I.search(_viewed(spark, sf_dir), ["pdf"])
    return I.page(own, I.ordering("added"), 2, 20).select("item_id").crossJoin(own.agg(F.count("*").alias("total")))


@query(f"SELECT count(*) AS total {_JOIN} WHERE last_viewed_at IS NOT NULL", "inb", "lv")
def d4_filtered_count(spark, sf_dir):
    return I.search(_viewed(spark, sf_dir), viewed="ever").agg(F.count("*").alias("total"))


@query("SELECT owner, sum(size_bytes) AS used FROM inb GROUP BY owner", "inb")
def d15_storage_used(spark, sf_dir):
    return I.storage_used(_items(spark, sf_dir))


@query("""SELECT item_id, u.used + sum(size_bytes) OVER (PARTITION BY inb.owner ORDER BY item_id ROWS UNBOUNDED PRECEDING) <= 60000 AS ok
FROM inb JOIN (SELECT owner, sum(size_bytes) AS used FROM inb GROUP BY owner) u ON inb.owner = u.owner""", "inb")
def d15_admission(spark, sf_dir):
    own = _items(spark, sf_dir)
    return I.admitted(own, I.storage_used(own), 60000).select("item_id", "ok")


@query("""SELECT s.item_id, kind || '/' || inb.item_id || '__' || original_name AS path FROM (SELECT CAST(doc_id * 2 AS VARCHAR) AS item_id FROM documents) s LEFT JOIN inb ON s.item_id = inb.item_id""", "inb")
def a21_export(spark, sf_dir):
    own = _items(spark, sf_dir)
    return I.exported(own, own.select((F.col("item_id").cast("long") * 2).cast("string").alias("item_id")))


@query("SELECT '9-' || item_id AS item_id, kind, original_name, size_bytes, '9' AS owner, owner AS origin_user, item_id AS origin_item_id, 'send' AS origin_type FROM inb WHERE owner = '3'", "inb")
def n9_sent_items(spark, sf_dir):
    return I.sent(_items(spark, sf_dir), "9", "3")


_FILES = "(SELECT item_id, replace(original_name, '.bin', CASE CAST(item_id AS BIGINT) % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.csv' WHEN 3 THEN '.png' WHEN 4 THEN '.xls' ELSE '.md' END) AS original_name, size_bytes FROM inb)"


def _files(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, (".pdf", ".DOCX", ".csv", ".png", ".xls", ".md"))), (F.col("item_id").cast("int") % 6 + 1).cast("int"))
    return _items(spark, sf_dir).select("item_id", F.replace("original_name", F.lit(".bin"), ends).alias("original_name"), "size_bytes")


@query(f"SELECT item_id, CASE CAST(item_id AS BIGINT) % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' WHEN 2 THEN 'excel' WHEN 3 THEN 'image' WHEN 4 THEN 'other' ELSE 'text' END AS kind, original_name, size_bytes, '' AS note FROM {_FILES} f", "inb")
def n10_registered(spark, sf_dir):
    return I.registered(_files(spark, sf_dir))


@query("SELECT item_id, CASE WHEN CAST(item_id AS BIGINT) % 4 = 0 THEN 'other' ELSE kind END AS kind FROM inb", "inb")
def n11_updates(spark, sf_dir):
    own = _items(spark, sf_dir)
    changes = own.filter(F.col("item_id").cast("long") % 4 == 0).select("item_id", F.lit("other").alias("kind"))
    return I.updated(own, changes, "item_id", "kind").select("item_id", "kind")


@query(f"SELECT DISTINCT kind, CASE kind WHEN 'pdf' THEN 'PDF' WHEN 'word' THEN 'Word' WHEN 'excel' THEN 'Excel' WHEN 'ppt' THEN 'PowerPoint' WHEN 'text' THEN 'テキスト' WHEN 'image' THEN '図・画像' ELSE 'その他' END AS label FROM inb", "inb")
def h5_kind_labels(spark, sf_dir):
    return _items(spark, sf_dir).select("kind").distinct().withColumn("label", T.kind_label(F.col("kind")))
