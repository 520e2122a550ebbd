"""JSON lines read tolerantly, with what was wrong; logs written with an envelope; records with defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loomframe.functions import text as T

ANONYMOUS = "(anonymous)"
#: Different keys of a log whose schema is not given.
MAX_KEYS = 5_000


def is_object(c: Column) -> Column:
    """Whether text is a whole JSON object."""
    v = F.try_parse_json(c)
    return v.isNotNull() & F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT"))


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line) of all lines of all files; missing paths give none."""
    spark_paths = [p for p in paths if _exists(spark, p)]
    if not spark_paths:
        return spark.createDataFrame([], "file string, line string")
    return spark.read.text(spark_paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def rows(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """Columns of the lines that are JSON objects; keys that are not in the schema are left out. Blank and bad lines and other JSON go."""
    own = lines.filter(T.stripped(F.col(line)) != "").filter(is_object(F.col(line)))
    return own.select(*[c for c in lines.columns if c != line], F.from_json(line, schema).alias("j")).select(*[c for c in lines.columns if c != line], "j.*")


def all_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same with every key that occurs in any line, as text: the keys are gathered in one pass, the values read in a second. Keys
    become columns; more than MAX_KEYS of them are an error, as a log with keys of their own for each line is no table."""
    good = lines.filter(T.stripped(F.col(line)) != "").filter(is_object(F.col(line)))
    keys = sorted(r.k for r in good.select(F.explode(F.json_object_keys(line)).alias("k")).distinct().limit(MAX_KEYS + 1).collect())
    if len(keys) > MAX_KEYS:
        raise ValueError(f"the lines have more than {MAX_KEYS} different keys; name a schema")
    quoted = ", ".join(f"`{k.replace('`', '``')}` string" for k in keys)
    return rows(lines, quoted, line) if keys else good.drop(line)


def stats(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row: lines_total, rows_ok, rows_bad_json (blank lines count in the first only)."""
    blank = T.stripped(F.col(line)) == ""
    good = is_object(F.col(line))
    return lines.agg(F.count("*").alias("lines_total"), F.count_if(~blank & good).alias("rows_ok"), F.count_if(~blank & ~good).alias("rows_bad_json"))


def stats_by(lines: DataFrame, *by: str, line: str = "line") -> DataFrame:
    """(by, lines_total, rows_ok, rows_bad_json, lines_unread) for each value of by. A line that is not UTF-8 is not read: it counts
    among all lines and as neither good nor bad, and its neighbours are read on."""
    known = F.is_valid_utf8(line)
    blank = T.stripped(F.col(line)) == ""
    good = is_object(F.when(known, F.col(line)))
    counts = [F.count(line).alias("lines_total"), F.count_if(known & ~blank & good).alias("rows_ok"), F.count_if(known & ~blank & ~good).alias("rows_bad_json"), F.count_if(~known).alias("lines_unread")]
    return lines.groupBy(*by).agg(*counts)


def read_stats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row: files, lines_total, rows_ok, rows_bad_json, files_failed of the files that exist among paths (folders and patterns stand
    for their files, empty ones too). A file fails if any of its lines is not UTF-8. Files are summed up by themselves first, so a
    long one is shared by tasks."""
    found = [p for p in paths if _exists(spark, p)]
    lines = scan(spark, found)
    files = len(set(lines.inputFiles())) if found else 0  # the scan's listing, which has files without lines as well
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("lines_total", "rows_ok", "rows_bad_json")]
    return stats_by(lines, "file").agg(F.lit(files).cast("long").alias("files"), *sums, F.count_if(F.col("lines_unread") > 0).alias("files_failed"))


def log_stats(spark: SparkSession, path: str, log: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(month, lines_total, rows_ok, rows_bad_json, lines_unread) of a log's months from first to last; other months are not read."""
    return stats_by(read_log(spark, path, log, first, last), "month")


def month_stats(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The same of a log that write_log wrote under month=yyyy-MM: folders of other months are pruned from the scan."""
    lines = spark.read.schema("value string, month string").text(path)
    for bound in [F.col("month") >= first] * (first is not None) + [F.col("month") <= last] * (last is not None):
        lines = lines.filter(bound)
    return stats_by(lines, "month", line="value")


def normalised(log: DataFrame) -> DataFrame:
    """log with date and month of ts (text; bad is null) and a user where none is given."""
    at = F.try_to_timestamp("ts")
    return log.withColumn("date", F.date_format(at, "yyyy-MM-dd")).withColumn("month", F.date_format(at, "yyyy-MM")).withColumn("user", F.coalesce(T.blank_to_null(F.col("user")), F.lit(ANONYMOUS)))


def enveloped(log: DataFrame, app: str, page: str | None = None, level: str | None = None) -> DataFrame:
    """Columns in the order ts, user, action, level, others, app_name, page_name."""
    first = [c for c in ("ts", "user", "action") if c in log.columns]
    rest = [c for c in log.columns if c not in first]
    own = [F.lit(level).alias("level")] if level else []
    last = [F.lit(app).alias("app_name")] + ([F.lit(page).alias("page_name")] if page else [])
    return log.select(*first, *own, *rest, *last)


def write_log(log: DataFrame, path: str, app: str, page: str | None = None) -> None:
    """Appends under month=yyyy-MM, so that months are pruned when read."""
    out = enveloped(log, app, page).withColumn("month", F.date_format(F.try_to_timestamp("ts"), "yyyy-MM"))
    out.write.partitionBy("month").mode("append").json(path)


def months(files: DataFrame, log: str) -> DataFrame:
    """(month, file) of names <log>_yyyy-MM.jsonl; of several of a month the last path counts."""
    month = F.regexp_extract("file", rf"(?:^|/){log}_(\d{{4}}-\d{{2}})\.jsonl$", 1)
    return files.select(month.alias("month"), "file").filter("month <> ''").groupBy("month").agg(F.max("file").alias("file"))


def month_files(spark: SparkSession, path: str, log: str, first: str | None = None, last: str | None = None) -> list[str]:
    """Files <log>_yyyy-MM.jsonl below path of the months from first to last, one for each month (of several the last path counts):
    names are listed, no file is opened."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = root.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    files = fs.listFiles(root, True) if fs.exists(root) else None
    while files is not None and files.hasNext():
        name = files.next().getPath().toString()
        m = re.search(rf"(?:^|/){re.escape(log)}_(\d{{4}}-\d{{2}})\.jsonl$", name)
        if m and (first is None or m[1] >= first) and (last is None or m[1] <= last):
            found[m[1]] = max(name, found.get(m[1], ""))
    return [found[m] for m in sorted(found)]


def read_log(spark: SparkSession, path: str, log: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(file, line, month) of a log's lines in the months from first to last: files of other months are not read."""
    files = month_files(spark, path, log, first, last)
    lines = scan(spark, files) if files else spark.createDataFrame([], "file string, line string")
    return lines.withColumn("month", F.regexp_extract("file", r"_(\d{4}-\d{2})\.jsonl$", 1))


ISSUES = ("invalid_json", "not_dict", "missing", "non_int", "negative", "out_of_range", "duplicate")


def checked_meta(lines: DataFrame, n_rows: int) -> DataFrame:
    """(line_no, line) -> (line_no, vector_index, issue): issue is null for valid rows; of equal indices the first line counts."""
    v = F.try_parse_json("line")
    raw = F.try_variant_get(v, "$.vector_index", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.vector_index", "variant"))
    index = F.when(kind == "BIGINT", raw.try_cast("long"))
    own = lines.filter(T.stripped(F.col("line")) != "").select("line_no", v.isNull().alias("bad"), is_object(F.col("line")).alias("object"), raw.alias("raw"), index.alias("vector_index"))
    issue = F.when(F.col("bad"), "invalid_json").when(~F.col("object"), "not_dict").when(F.col("raw").isNull(), "missing").when(F.col("vector_index").isNull(), "non_int")
    issue = issue.when(F.col("vector_index") < 0, "negative").when(F.col("vector_index") >= n_rows, "out_of_range")
    own = own.withColumn("issue", issue)
    again = F.row_number().over(W.partitionBy("vector_index").orderBy("line_no")) > 1
    good = own.filter("issue is null").withColumn("issue", F.when(again, "duplicate"))
    return own.filter("issue is not null").unionByName(good).select("line_no", "vector_index", "issue")


def with_defaults(df: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """Missing and null texts are empty, numbers 0, in that order of columns."""
    have = set(df.columns)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in texts]
    number = [F.coalesce(F.col(c).try_cast("long"), F.lit(0)).alias(c) if c in have else F.lit(0).cast("long").alias(c) for c in numbers]
    return df.select(*text, *number)
