"""Item search: conditions, order and pages over items and when a user last viewed them; quotas, copies and updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomframe.functions import text as T

KIND_RANK = ("pdf", "word", "excel", "ppt", "image", "text", "other")
QUOTA = 5 << 30


def _like(column: str, term: str, raw: bool) -> Column:
    """A term as a substring, ASCII case ignored; raw leaves % and _ their meaning in LIKE."""
    own = T.ascii_lower(F.col(column))
    low = term.translate(str.maketrans(T.UPPER, T.LOWER))
    return own.like(f"%{low}%") if raw else own.contains(low)


def with_views(items: DataFrame, views: DataFrame, user: str) -> DataFrame:
    """items with last_viewed_at of one user; null if never viewed."""
    return items.join(views.filter(F.col("user_sub") == user).select("item_id", "last_viewed_at"), "item_id", "left")


def search(items: DataFrame, kinds: list[str] | None = None, tag_terms: tuple[str, ...] = (), name_terms: tuple[str, ...] = (), added_from: str | None = None, added_to: str | None = None, size_min: int | None = None, size_max: int | None = None, viewed: str | None = None, viewed_since: str | None = None, raw_like: bool = False) -> DataFrame:
    """Rows that meet all conditions given. An empty list of kinds matches nothing. viewed is "never" or "ever"; days are whole
    days of the session's time zone, the last included."""
    tests: list[Column] = []
    if kinds is not None:
        tests.append(F.col("kind").isin(*kinds) if kinds else F.lit(False))
    tests += [_like("tags_json", t, raw_like) for t in tag_terms]
    tests += [_like("original_name", t, raw_like) for t in name_terms]
    if added_from:
        tests.append(F.col("added_at") >= F.lit(added_from).cast("timestamp"))
    if added_to:
        tests.append(F.col("added_at") < F.date_add(F.lit(added_to).cast("date"), 1).cast("timestamp"))
    if size_min is not None:
        tests.append(F.col("size_bytes") >= size_min)
    if size_max is not None:
        tests.append(F.col("size_bytes") <= size_max)
    if viewed:
        tests.append(F.col("last_viewed_at").isNull() if viewed == "never" else F.col("last_viewed_at").isNotNull())
    if viewed_since:
        tests.append(F.col("last_viewed_at") >= F.lit(viewed_since).cast("timestamp_ntz"))
    return items.filter(reduce(lambda a, b: a & b, tests)) if tests else items


def kind_rank() -> Column:
    out = F.when(F.col("kind") == KIND_RANK[0], 1)
    for k, name in enumerate(KIND_RANK[1:], 2):
        out = out.when(F.col("kind") == name, k)
    return out.otherwise(99)


def name_class() -> Column:
    """Digits before letters before others."""
    return F.when(F.col("original_name").rlike("^[0-9]"), 0).when(F.col("original_name").rlike("^[A-Za-z]"), 1).otherwise(2)


def ordering(mode: str = "name", grouped: bool = False) -> list[Column]:
    """Keys of an order: name, added or viewed, grouped by kind or not; the id breaks ties."""
    name = [name_class(), T.ascii_lower(F.col("original_name"))]
    keys = {"name": name, "added": [F.desc("added_at")], "viewed": [F.desc_nulls_last("last_viewed_at"), F.desc("added_at")]}[mode]
    return [*([kind_rank()] if grouped else []), *keys, F.col("item_id")]


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    """One row: total and pages of so many rows (one at least); no rows are one page."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / max(1, size))).cast("long"))


def storage_used(items: DataFrame) -> DataFrame:
    return items.groupBy("owner").agg(F.sum("size_bytes").alias("used"))


def admitted(arrivals: DataFrame, used: DataFrame, quota: int = QUOTA) -> DataFrame:
    """arrivals with ok: whether the owner's store, with what came before in order of item_id, stays within the quota."""
    so_far = F.sum("size_bytes").over(W.partitionBy("owner").orderBy("item_id").rowsBetween(W.unboundedPreceding, 0))
    return arrivals.join(used, "owner", "left").withColumn("ok", F.coalesce("used", F.lit(0)) + so_far <= quota).drop("used")


def exported(items: DataFrame, selected: DataFrame, content: str | None = None) -> DataFrame:
    """(item_id, path) for each selected id: kind/id__name, or null if there is no such item; with the named column as content."""
    path = F.concat(F.col("kind"), F.lit("/"), F.col("item_id"), F.lit("__"), T.safe_filename(F.col("original_name")))
    with_it = [F.col(content).alias("content")] if content else []
    return selected.select("item_id").distinct().join(items.select("item_id", path.alias("path"), *with_it), "item_id", "left")


def write_export(rows: DataFrame, path: str) -> None:
    """Exported rows that were found, in a folder for each kind; those without a path are listed under missing."""
    found = rows.filter("path is not null").withColumn("kind", F.element_at(F.split("path", "/"), 1))
    found.write.partitionBy("kind").parquet(f"{path}/items")
    rows.filter("path is null").select("item_id").write.parquet(f"{path}/missing")


def sent(items: DataFrame, receiver: str, sender: str) -> DataFrame:
    """Copies of the sender's items for a receiver, with where they come from; to oneself nothing is sent."""
    own = items.filter((F.col("owner") == sender) & F.lit(sender != receiver))
    origin = [F.col("owner").alias("origin_user"), F.col("item_id").alias("origin_item_id"), F.lit("send").alias("origin_type")]
    return own.select(F.concat(F.lit(f"{receiver}-"), "item_id").alias("item_id"), "kind", "original_name", "size_bytes", F.lit(receiver).alias("owner"), *origin)


def registered(files: DataFrame) -> DataFrame:
    """(item_id, kind, original_name, size_bytes, note): new rows of files, kind by extension."""
    return files.select("item_id", T.detect_kind(F.col("original_name")).alias("kind"), T.safe_filename(F.col("original_name")).alias("original_name"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.lit("").alias("note"))


def updated(rows: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows with the columns of changes (unique by key) where those are not null."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out
