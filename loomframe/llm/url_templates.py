"""Operator 8: URL filters by listed rules and a tree of path templates; DataFrame functions only.

A path's shape has its digits replaced. Per host, the shapes form a tree that is built from the top, a level at a time, on what
stands above already generalised: where a branch has many different children, those that are not most of it and whose share of
bad pages does not differ from all siblings' share by a two-sided test are merged into one wildcard branch, and the next level's
children are those of the merged branch. Labelled pages are counted for each template. Sibling templates that the same test
finds alike lend each other their counts, and a template is rejected when its share of bad pages, smoothed towards the share of
all labelled pages, reaches a limit. All tree work is on counts per host and shape, made with partial sums, so a host of a third
of all pages is spread like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomframe.llm.common import drop, durable, read

#: (verdict, host and path): listed rules of the query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: So many rules are an expression of each row; more are joined.
EXPRESSION_RULES = 200
#: A branch is variable where it has so many different children; one with more than the second share of its pages stays itself.
FANOUT, LEAD = 8, 0.5
#: Levels of the tree that the SQL works out, one after another; deeper, it takes paths as they stand. The tree itself has as many levels
#: as any two paths share.
SQL_LEVELS = 8
#: Deviations (after half a page of continuity) at which shares differ; pages of the prior; share that rejects.
Z, SMOOTHING, REJECT = 2.58, 5.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str | Column) -> Column:
    """Between the first :// and the next /, ?, # or end, with A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: str | Column) -> Column:
    """From after the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits the host or a domain above it and the path's start; of
    equal lengths the later in code points; null if none fits."""
    found = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def differs(n: str, bad: str, all_n: str, all_bad: str) -> Column:
    """Whether bad of n pages are another share than all_bad of all_n by a two-sided test; never without labelled pages."""
    n, bad, all_n, all_bad = map(F.col, (n, bad, all_n, all_bad))
    share = F.when(all_n > 0, all_bad / all_n).otherwise(F.lit(0.0))
    return (n > 0) & (F.abs(bad - n * share) - F.lit(0.5) > F.lit(Z) * F.sqrt(n * share * (F.lit(1.0) - share)))


def with_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows (with host and path) with r, as of rule_of. Many rules are a table: a host with the domains above it meets the lengths of
    the paths that rules of those have, and each such beginning of the path the rules by equality; so rows in between are as many
    as domains and lengths, never as rules."""
    if len(rules) <= EXPRESSION_RULES:
        return rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    spark = rows.sparkSession
    parted = [(*rule.partition("/")[::2], "/" in rule, rule, verdict) for verdict, rule in rules]
    table = spark.createDataFrame([(h, "/" * slash + rest, len(rule), rule, verdict) for h, rest, slash, rule, verdict in parted], "domain string, start string, length int, rule string, verdict string")
    lengths = table.select("domain", F.char_length("start").alias("n")).distinct()
    own = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = own.withColumn("domain", F.explode(F.array_distinct(above))).join(lengths, "domain").filter(F.col("n") <= F.char_length("path"))
    met = met.withColumn("start", F.substring("path", F.lit(1), F.col("n"))).join(table, ["domain", "start"])
    best = met.groupBy("host", "path").agg(F.max(F.struct("length", "rule", "verdict")).alias("r"))
    return rows.join(best, ["host", "path"], "left")


def pieces(shape: str | Column) -> Column:
    """The non-empty segments of a shape."""
    return F.filter(F.split(shape, "/"), lambda s: s != "")


def _joined(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.when(p != "", p) for p in parts])


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n_pages, n, bad) -> the same with template (pieces joined by /) and parent (without its last piece).

    Level by level, as long as any branch holds several shapes: a shape that is alone in its branch has no siblings from there on, so
    the rest of it is its template as it stands, however deep, and shapes that have come to their end are done too.
    """
    now = shapes.withColumn("pieces", pieces("shape")).withColumn("template", F.lit("")).withColumn("parent", F.lit(""))
    node, out, done, level = ["host", "template"], ["host", "shape", "n_pages", "n", "bad", "template", "parent"], [], 0
    now = held = durable(now, "level")
    while True:
        whole_ = now.filter(F.size("pieces") > level).groupBy(*node).agg(F.count("*").alias("shapes"))
        now = now.join(whole_, node, "left").withColumn("shapes", F.when(F.size("pieces") > level, F.col("shapes")))
        rest = lambda last: F.array_join(F.slice("pieces", F.lit(level + 1), F.greatest(F.size("pieces") - level - last, F.lit(0))), "/")  # noqa: E731, B023
        lone = now.filter("shapes = 1").withColumn("parent", _joined(F.col("template"), rest(1))).withColumn("template", _joined(F.col("template"), rest(0)))
        done.append(durable(now.filter("shapes IS NULL").select(*out).union(lone.select(*out)), "templates"))
        open_ = durable(now.filter("shapes > 1").drop("shapes"), "level")
        drop(held)
        if open_.isEmpty():
            drop(open_)
            break
        held, now = open_, open_.withColumn("piece", F.get("pieces", F.lit(level)))
        children = now.groupBy(*node, "piece").agg(*(F.sum(c).alias(c) for c in ("n_pages", "n", "bad")))
        whole = children.groupBy(*node).agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n_pages", "n", "bad")))
        merged = children.join(whole.filter(F.col("children") >= FANOUT), node).filter(F.col("n_pages") <= F.col("all_n_pages") * LEAD)
        merged = merged.filter(~differs("n", "bad", "all_n", "all_bad")).select(*node, "piece", F.lit("*").alias("wild"))
        now = now.join(merged, [*node, "piece"], "left").withColumn("parent", F.col("template")).withColumn("template", _joined(F.col("template"), F.coalesce("wild", "piece")))
        now, level = durable(now.select(*out[:5], "pieces", "template", "parent"), "level"), level + 1
        drop(held)
        held = now
    return reduce(DataFrame.union, done)


def judged_templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, purity): the smoothed share of bad pages of the template, or of its siblings merged with it."""
    placed = templates(shapes)
    counts = placed.groupBy("host", "template", "parent").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    around = counts.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    total = shapes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = total.bad / total.n if total.n else 0.0
    counts = counts.join(around, ["host", "parent"]).withColumn("similar", ~differs("n", "bad", "all_n", "all_bad"))
    merged = counts.filter("similar").groupBy("host", "parent").agg(F.sum("n").alias("near_n"), F.sum("bad").alias("near_bad"))
    counts = counts.join(merged, ["host", "parent"], "left")
    n = F.when(F.col("similar"), F.col("near_n")).otherwise(F.col("n"))
    bad = F.when(F.col("similar"), F.col("near_bad")).otherwise(F.col("bad"))
    purity = (bad + SMOOTHING * base) / (n + SMOOTHING)
    counts = counts.select("host", "template", "parent", purity.alias("purity"))
    return placed.join(counts, ["host", "template", "parent"]).select("host", "shape", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, template, purity, verdict) for each row of pages: the longest listed rule's verdict, else the template's.

    A page is bad if its label has quality 0 or toxic 1; null and unlabelled ids count for nothing and several labels of an
    id as the worst. Null urls and those without :// have an empty host and path and a template of their own.
    """
    own = pages.select(F.col(id_col).alias("id"), host(url_col).alias("host"), path(url_col).alias("path"))
    own = own.withColumn("shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(bad).alias("bad"))
    counted = own.join(known, "id", "left").groupBy("host", "shape").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    out = with_rules(own.join(judged_templates(durable(counted, "shapes")), ["host", "shape"]), rules)
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), "template", "purity", F.coalesce("r.verdict", method).alias("verdict"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages", "page_id", "url"), read(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "template", "verdict")


_OWN = r"""
WITH own AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), shaped AS (SELECT *, regexp_replace(path, '[0-9]+', '{n}', 'g') AS shape FROM own
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), shapes AS (
  SELECT host, shape, count(*) AS n_pages, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM shaped LEFT JOIN known ON page_id = doc_id GROUP BY host, shape
), split AS (SELECT *, list_filter(string_split(shape, '/'), lambda s: s <> '') AS whole FROM shapes
), t0 AS (
  SELECT host, shape, n_pages, n, bad, '' AS parent, '' AS template,
    whole AS p FROM split
"""

_LEVEL = """
), c{k} AS MATERIALIZED (
  SELECT host, template, p[{k}] AS piece, sum(n_pages) AS n_pages, sum(n) AS n, sum(bad) AS bad FROM t{j} WHERE len(p) >= {k} GROUP BY ALL
), w{k} AS (
  SELECT host, template, count(*) AS children, sum(n_pages) AS all_pages, sum(n) AS all_n, sum(bad) AS all_bad FROM c{k} GROUP BY ALL
), m{k} AS MATERIALIZED (
  SELECT host, template, piece FROM (
    SELECT *, CASE WHEN all_n > 0 THEN CAST(all_bad AS DOUBLE) / all_n ELSE 0.0 END AS share FROM c{k} JOIN w{k} USING (host, template)
  ) WHERE children >= 8 AND n_pages <= all_pages * 0.5 AND NOT (n > 0 AND abs(bad - n * share) - 0.5 > 2.58 * sqrt(n * share * (1.0 - share)))
), t{k} AS MATERIALIZED (
  SELECT t.host, t.shape, t.n_pages, t.n, t.bad, t.p, CASE WHEN len(p) >= {k} THEN t.template ELSE t.parent END AS parent,
    CASE WHEN len(p) < {k} THEN t.template
      ELSE (CASE WHEN t.template <> '' THEN t.template || '/' ELSE '' END) || (CASE WHEN m.piece IS NULL THEN t.p[{k}] ELSE '*' END) END AS template
  FROM t{j} t LEFT JOIN m{k} m ON t.host = m.host AND t.template = m.template AND len(t.p) >= {k} AND t.p[{k}] = m.piece
"""

_JUDGED = r"""
), tmpl AS (
  SELECT host, shape, n_pages, n, bad, CASE WHEN len(p) > {last} + 1 THEN concat_ws('/', template, array_to_string(p[{last} + 1:len(p) - 1], '/')) WHEN len(p) = {last} + 1 THEN template ELSE parent END AS parent,
    CASE WHEN len(p) > {last} THEN concat_ws('/', template, array_to_string(p[{last} + 1:], '/')) ELSE template END AS template FROM t{last}
), counts AS (SELECT host, template, parent, sum(n) AS n, sum(bad) AS bad FROM tmpl GROUP BY host, template, parent
), around AS (SELECT host, parent, sum(n) AS all_n, sum(bad) AS all_bad FROM counts GROUP BY host, parent
), shares AS (
  SELECT c.*, CASE WHEN all_n > 0 THEN CAST(all_bad AS DOUBLE) / all_n ELSE 0.0 END AS share FROM counts c JOIN around USING (host, parent)
), tested AS (SELECT *, NOT (n > 0 AND abs(bad - n * share) - 0.5 > 2.58 * sqrt(n * share * (1.0 - share))) AS alike FROM shares
), merged AS (SELECT host, parent, sum(n) AS near_n, sum(bad) AS near_bad FROM tested WHERE alike GROUP BY host, parent
), total AS (SELECT CASE WHEN sum(n) > 0 THEN CAST(sum(bad) AS DOUBLE) / sum(n) ELSE 0.0 END AS base FROM counts
), purity AS (
  SELECT t.host, t.template, t.parent, (CASE WHEN alike THEN near_bad ELSE bad END + 5.0 * base) / (CASE WHEN alike THEN near_n ELSE n END + 5.0) AS purity
  FROM tested t LEFT JOIN merged m ON t.host = m.host AND t.parent = m.parent, total
), rules AS (SELECT * FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) r(v, rule)
), cut AS (SELECT v, rule, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM rules
), judged AS (
  SELECT s.page_id, s.host, s.path, t.template, p.purity,
    (SELECT arg_max(struct_pack(rule := rule, v := v), struct_pack(l := length(rule), r := rule)) FROM cut
     WHERE (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)) AS r
  FROM shaped s JOIN tmpl t ON s.host = t.host AND s.shape = t.shape JOIN purity p ON p.host = t.host AND p.template = t.template AND p.parent = t.parent
)
SELECT page_id, host, path, r.rule AS rule, template, coalesce(r.v, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""

#: The tree of the definition, a level after another.
SQL = _OWN + "".join(_LEVEL.format(k=k, j=k - 1) for k in range(1, SQL_LEVELS + 1)) + _JUDGED.replace("{last}", str(SQL_LEVELS))
