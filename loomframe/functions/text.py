"""Column functions for names, tags, identifiers, times and text measures. All are JVM expressions but nfkc and norm_text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Extensions of each kind of file, and each kind's label.
KINDS = {
    "pdf": ("pdf",),
    "word": ("docx", "doc"),
    "excel": ("xlsx", "xlsm", "csv", "tsv"),
    "ppt": ("pptx", "ppt"),
    "text": ("txt", "md", "log", "json", "tex"),
    "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff", "tif"),
}
KIND_LABELS = {"pdf": "PDF", "word": "Word", "excel": "Excel", "ppt": "PowerPoint", "text": "テキスト", "image": "図・画像", "other": "その他"}
# Abbreviations, longest first, and what stands for them.
ABBREVIATIONS = (("PJNO", "プロジェクト番号"), ("PJN", "プロジェクト番号"), ("PNO", "プロジェクト番号"), ("PJ", "プロジェクト"), ("YEAR", "年度"), ("FY", "年度"))
# Marks that count as symbols, and ranges of Japanese characters.
SYMBOLS = r"|｜¦┃━―─\-_=~^`'\".,。・:：;；!！?？()（）\[\]［］{}｛｝<>＜＞／/\\+*#@＆&％%…"
JAPANESE = r"぀-ヿ㐀-䶿一-鿿"
#: The same as characters: what stripping takes from both ends.
BLANK = " \t\n\x0b\f\r\u3000\u00a0"
SPACE = r"\s　 "


def nfkc(c: Column | str) -> Column:
    """Spark has no Unicode normalisation, so this is an Arrow function."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.pandas_udf(run, StringType())(c)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def norm_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(nfkc(c), r"[ \t　]+", " "))


def terms(c: Column) -> Column:
    """Split at commas, slashes and spaces; blanks dropped."""
    return F.filter(F.split(c, r"[,/／、\s　]+"), lambda t: t != "")


def parse_recent(c: Column) -> Column:
    """Interval of "7日", "7d", "3時間", "3h", "10分", "10m"; else null."""
    n = F.regexp_extract(c, r"^\s*(\d+)\s*(日|d|時間|h|分|m)\s*$", 1)
    unit = F.regexp_extract(c, r"^\s*(\d+)\s*(日|d|時間|h|分|m)\s*$", 2)
    count = F.nullif(n, F.lit("")).try_cast("int")
    return F.when(unit.isin("日", "d"), F.make_dt_interval(days=count)).when(unit.isin("時間", "h"), F.make_dt_interval(hours=count)).when(unit.isin("分", "m"), F.make_dt_interval(mins=count))


def mb_to_bytes(c: Column) -> Column:
    """Bad values give 0."""
    return F.coalesce(F.floor(c.try_cast("double") * 1024 * 1024), F.lit(0)).cast("long")


def bytes_human(n: Column) -> Column:
    kb, mb, gb = n / 1024, n / 1024**2, n / 1024**3
    return F.when(n < 1024, F.format_string("%d B", n)).when(kb < 1024, F.format_string("%.1f KB", kb)).when(mb < 1024, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%.2f GB", gb))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.]\.([^./]+)$", 1))


def detect_kind(name: Column) -> Column:
    ext, out = extension(name), None
    for kind, known in KINDS.items():
        out = F.when(ext.isin(*known), kind) if out is None else out.when(ext.isin(*known), kind)
    return out.otherwise("other")


def kind_label(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])[F.lower(kind)], kind)


def safe_filename(name: Column, most: int = 120) -> Column:
    """Nine forbidden characters become _, longer names are cut before their suffix."""
    own = F.translate(name, '\\/:*?"<>|', "_________")
    suffix = F.regexp_extract(own, r"(\.[^.]*)$", 1)
    stem = F.substring(own, F.lit(1), F.greatest(F.lit(1), F.lit(most) - F.char_length(suffix)))
    return F.when(F.char_length(own) > most, F.concat(stem, suffix)).otherwise(own)


def to_bool(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "on")


def positive_int(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n > 0, n)


def sha256_or_null(c: Column) -> Column:
    own = F.lower(F.trim(c))
    return F.when(own.rlike("^[0-9a-f]{64}$"), own)


def page_numbers(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x > 0)))


def tags(c: Column) -> Column:
    """Newlines count as commas; without a comma white space splits."""
    own = F.regexp_replace(c, r"[\r\n]+", ",")
    parts = F.when(own.contains(","), F.split(own, ",")).otherwise(F.split(own, r"\s+"))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def first_tag(tags_json: Column) -> Column:
    """Empty for bad JSON, no array or none in it."""
    return F.coalesce(F.from_json(tags_json, "array<string>")[0], F.lit(""))


def jst_minute(c: Column) -> Column:
    """YYYY/MM/DD HH:MM in the session's time zone; text that is no time stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy/MM/dd HH:mm"), c)


def jst_short(c: Column) -> Column:
    """ISO text with a space for its T and （JST） for +09:00; — where there is none."""
    own = F.replace(F.replace(c, F.lit("T"), F.lit(" ")), F.lit("+09:00"), F.lit("（JST）"))
    return F.when(F.coalesce(c, F.lit("")) == "", "—").otherwise(own)


def jst_long(c: Column) -> Column:
    """Y年M月D日　HH時mm分ss秒 of ISO text; text that is no time stays, — where there is none."""
    wall = F.try_to_timestamp(F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", ""))
    return F.when(F.coalesce(c, F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(wall, "y年M月d日　HH時mm分ss秒"), c))


def log_path(root: Column | str, log: str, month: Column) -> Column:
    """Where a log's month lies: root/<log>_yyyy-MM.jsonl; bad months give null."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.concat(F.regexp_replace(root, "/+$", ""), F.lit(f"/{log}_"), month, F.lit(".jsonl")))


def clean_text_name(c: Column) -> Column:
    """The name of a text's cleaned form: <name>_cleaned.txt, without an ending .txt of any case; text where there is no name."""
    own = F.coalesce(blank_to_null(c), F.lit("text"))
    return F.concat(F.regexp_replace(own, r"(?i)\.txt$", ""), F.lit("_cleaned.txt"))


def project_folder(root: str, year: Column, no: Column, part: str | None = None) -> Column:
    """root/<year><no>, or its part pdf or others; null where year or number is bad."""
    return F.concat(F.lit(root.rstrip("/") + "/"), project_id(year, no), F.lit(f"/{part}" if part else ""))


def report_path(root: str, year: Column, no: Column) -> Column:
    """Where a project's report lies: root/<id>/pdf/<id>.pdf."""
    return F.concat(project_folder(root, year, no, "pdf"), F.lit("/"), project_id(year, no), F.lit(".pdf"))


def number_in(c: Column, least: int = 1, most: int = 200) -> Column:
    """Whether a project's number lies within its limits; bad numbers do not."""
    return F.coalesce(c.try_cast("int").between(least, most), F.lit(False))


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def doc_id(*parts: Column) -> Column:
    """Parts trimmed, with / for \\ and none at their ends, joined by /; a blank part is an error."""
    own = [F.regexp_replace(F.translate(F.trim(p), "\\", "/"), "^/+|/+$", "") for p in parts]
    blank = own[0] == ""
    for p in own[1:]:
        blank = blank | (p == "")
    return F.when(blank, F.raise_error(F.lit("blank part of a document id")).cast("string")).otherwise(F.concat_ws("/", *own))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)


def chunk_id(doc: Column, index: Column) -> Column:
    """index counts from 0, the id from 1."""
    return F.format_string("%s#c%06d", doc, index + 1)


def project_parts(c: Column) -> Column:
    """Struct (year, no, rest) of "year/no/rest"; the number padded to three digits."""
    p = F.split(c, "/", 3)
    return F.struct(p[0].try_cast("int").alias("year"), F.lpad(p[1], 3, "0").alias("no"), F.get(p, F.lit(2)).alias("rest"))


def source_kind(c: Column) -> Column:
    own = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(own.isin("raw", "clean"), own).otherwise("other")


def relative_path(c: Column) -> Column:
    return F.ltrim(F.translate(F.trim(c), "\\", "/"), F.lit("/"))


def page_no(c: Column) -> Column:
    return F.greatest(F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(0))


def project_year(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(1000, 9999), n)


def project_no(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(0, 999), F.lpad(n.cast("string"), 3, "0"))


def project_id(year: Column, no: Column) -> Column:
    return F.concat(project_year(year).cast("string"), project_no(no))


def clamp(c: Column, low: int, high: int) -> Column:
    """Bad values give low."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("int"), F.lit(low))))


def clamp_page(page: Column, total: Column) -> Column:
    return F.when(total <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(page, total)))


def estimate_tokens(c: Column) -> Column:
    """Other characters that are no space, plus 1.3 for each run of ASCII letters, digits and _; empty 0, else at least 1."""
    c = F.coalesce(c, F.lit(""))
    plain = F.replace(F.replace(c, F.lit("\u3000"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))  # classes of ASCII alone are much faster
    short = F.regexp_replace(plain, r"\w++\s*+", "A")  # one A for each run; none of its characters is left elsewhere
    other = F.replace(short, F.lit("A"), F.lit(""))
    words = F.char_length(short) - F.char_length(other)
    rest = F.char_length(F.regexp_replace(other, r"\s+", ""))
    return F.greatest(F.least(F.lit(1), F.char_length(c)), rest + F.floor(words * 1.3)).cast("int")


def stripped(c: Column) -> Column:
    return F.trim(c, F.lit(BLANK))


def is_blank(c: Column) -> Column:
    """Whether nothing is left of a text, or null, when it is stripped; looks no further than its first other character."""
    return F.ltrim(F.coalesce(c, F.lit("")), F.lit(BLANK)) == ""


def share(c: Column, characters: str) -> Column:
    """Share of the stripped text's characters that are in a class; 0 for a blank text."""
    s = stripped(c)
    n = F.char_length(s)
    return F.when(n == 0, 0.0).otherwise((n - F.char_length(F.regexp_replace(s, f"[{characters}]", ""))) / n)


def expand_abbreviations(c: Column) -> tuple[Column, dict[str, Column]]:
    """The text with abbreviations that stand by themselves written out, and how often each was."""
    counts = {}
    for short, whole in ABBREVIATIONS:
        pattern = rf"(?i)(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])"
        counts[short] = F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, pattern, whole)
    return c, counts


def newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def model_key(c: Column) -> Column:
    """Struct (provider, model) of "provider:model"; openai where none is named."""
    p = F.split(F.trim(c), ":", 2)
    return F.struct(F.when(F.size(p) > 1, F.trim(p[0])).otherwise("openai").alias("provider"), F.trim(F.element_at(p, -1)).alias("model"))


def is_mojibake(c: Column) -> Column:
    """At least 200 characters but white space, under 5 % Japanese, and 10 % Latin or Greek or at most 5 Japanese."""
    own = F.regexp_replace(c, rf"[{SPACE}]+", "")
    n = F.char_length(own)
    count = lambda k: n - F.char_length(F.regexp_replace(own, f"[{k}]", ""))
    jp, latin = count(JAPANESE), count(r"À-ɏͰ-Ͽ")
    return (n >= 200) & (jp < n * 0.05) & ((latin >= n * 0.10) | (jp <= 5))


def strip_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(srt)?[ \t]*\r?\n", ""), r"\r?\n?```$", ""))
