"""Jobs done in whole: every query, every character, every row."""

import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomframe.functions import text as T
from loomframe.operators import corpus as C, vectors as V
from loomframe.plans import QUERIES
from loomframe.plans.corpus import PLAIN
from loomframe.plans.views import view

SF = "/root/testdata/sf0.001"


def test_search_meets_all_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    x = np.random.default_rng(5).integers(-2, 3, (60, 4)).astype(float)
    x[3] = 0
    x[20] = x[41] = x[7] = [1, 2, 0, 1]
    v = spark.createDataFrame([(str(i % 3), i // 3, r.tolist()) for i, r in enumerate(x)], "shard_id string, vector_index long, embedding array<double>")
    asks = [i for i in range(60) if x[i].any()]
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in asks], "query_id long, embedding array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    score = np.round(unit @ unit.T, 6) + 0.0
    want = {(q, rank + 1, str(i % 3), i // 3) for q in asks for rank, i in enumerate(sorted(range(60), key=lambda i: (-score[q, i], str(i % 3), i // 3))[:4])}
    assert {(r.query_id, r.rank, r.shard_id, r.vector_index) for r in V.search(v, queries, 4).collect()} == want


def test_searches_take_every_row_divisible_by_twenty(spark):
    want = {r.vec_id for r in view(spark, SF, "vec").filter("vec_id % 20 = 0").select("vec_id").collect()}
    for name in ("l1_top_k", "l2_live_shards", "l3_batch_search", "l4_named_shards", "g5_union_of_shard_hits"):
        assert {r.query_id for r in QUERIES[name](spark, SF).select("query_id").collect()} == want, name


def test_whole_texts_are_decoded_in_every_encoding(spark):
    own = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["a16_decoded"](spark, SF).collect()
    assert {r.encoding for r in out} == {"utf-8-sig", "utf-16", "shift_jis", "cp932", "replace"}
    assert len(out) == len(own) and all(r.text.startswith(own[r.doc_id]) for r in out)
    assert max(len(r.text) for r in out) > 200


WIDE = [
    "第１章　はじめに\nＡＢＣ　ｄｅｆ は 全角 です\n次の行へ ② つづく。\nﾍﾟｰｼﾞ Ａ\n本文 ＝＝＝＝ あり\nペｰジ A\nページ Ａ\nページ A\n終わり。",
    "\n".join(f"{'０１２３４５６７'[i]}．　節 {'０１２３４５６７'[i]}" for i in range(1, 8)) + "\n１２\n．．．．．．\n・・・・点\r\n㍍ と ㌔\n\nか ゛\n",
    "plain text line\nFoo bar|baz | x  y\n\nFoo\nＦｏｏ\nFoo\nlast",
    "",
    None,
]


def plain_strip(s):
    return re.sub(rf"^[{T.SPACE}]+|[{T.SPACE}]+$", "", s, flags=re.A)


def plain_inline(s):
    s = unicodedata.normalize("NFKC", s.replace("\r\n", "\n").replace("\r", "\n"))
    for a, b in ((r"・{3,}", "・"), (r"\.{3,}", "..."), (r"ー{3,}", "ー"), (r"={3,}", "=="), (r"\s[|｜]\s", " "), (r"[ \t]{2,}", " ")):
        s = re.sub(a, b, s, flags=re.A)
    for a, b in ((T.JAPANESE, T.JAPANESE), ("0-9", T.JAPANESE), (T.JAPANESE, "0-9")):
        s = re.sub(rf"(?<=[{a}])[{T.SPACE}]+(?=[{b}])", "", s, flags=re.A)
    return s


def plain_heading(s):
    s = plain_strip(s)
    return bool(re.search(C.HEADING, s, re.A)) or s in C.HEADINGS


def plain_canon(s):
    return re.sub(r"[ \t]{2,}", " ", unicodedata.normalize("NFKC", plain_strip(s)))


def plain_repeated(lines):
    found = Counter(c for c in map(plain_canon, lines) if c)
    return {c: n for c, n in found.items() if n >= 3 and len(c) <= 40 and not plain_heading(c)}


def plain_reasons(text):
    rows = plain_inline(text).split("\n")
    share = lambda s: len(re.findall(f"[{T.SYMBOLS}]", s)) / len(s)
    reasons = {}
    for i, s in enumerate(map(plain_strip, rows)):
        if s and (re.search(r"(ー|―|─|-|_|=|・|\.|。){5,}", s) or (len(s) >= 6 and share(s) >= 0.7) or re.search(r"^[|｜¦┃\s]{4,}$", s, re.A)):
            reasons[i] = "decoration"
        elif s and not plain_heading(s) and len(s) <= 2 and not re.search("^[0-9]{1,3}$", s):
            reasons[i] = "tiny"
    left, run = [i for i in range(len(rows)) if i not in reasons], []
    contents = lambda s: s == "目次" or re.search(C.CONTENTS, s, re.A) or (re.search(r"\s[0-9]{1,3}\s*$", s, re.A) and len(s) >= 8 and share(s) >= 0.35 and re.search(r"^(第\s*\d+|[IVX]+\.|\d+\s*[.)])", s, re.A))
    for i in [*left, None]:
        if i is not None and contents(plain_strip(rows[i])):
            run.append(i)
        else:
            reasons.update(dict.fromkeys(run if len(run) >= 6 else [], "toc"))
            run = []
    left = [i for i in left if i not in reasons]
    again = plain_repeated([rows[i] for i in left])
    reasons.update({i: "repeated" for i in left if plain_canon(rows[i]) in again})
    return rows, reasons


def plain_clean(text):
    rows, reasons = plain_reasons(text)
    out, before = [], None
    for s in (plain_strip(r) for i, r in enumerate(rows) if i not in reasons):
        fresh = not before or plain_heading(before) or plain_heading(s) or re.search(r"[。．.!！?？:]$", before)
        if s:
            out.append(s) if fresh or not out else out.append(out.pop() + " " + s)
        before = s
    return plain_strip("\n".join(out))


def test_cleaning_normalises_full_width_text(spark):
    df = spark.createDataFrame(list(enumerate(WIDE)), "doc_id long, text string")
    own = {i: t for i, t in enumerate(WIDE) if t is not None}
    assert {r.doc_id: r.text for r in df.select("doc_id", C.inline(F.col("text")).alias("text")).collect()} == {**{i: plain_inline(t) for i, t in own.items()}, 4: None}
    repeated = {(i, c, n) for i, t in own.items() for c, n in plain_repeated(t.split("\n")).items()}
    found = C.repeated_lines(C.lines(df))
    assert {tuple(r) for r in found.collect()} == repeated and {i for i, *_ in repeated} == {0, 2}
    assert {r.doc_id: r.text for r in C.clean_corpus(df, PLAIN).collect()} == {i: x for i, t in own.items() if (x := plain_clean(t))}
    for r in C.cleaning_report(C.tagged_lines(df, PLAIN)).collect():
        rows, reasons = plain_reasons(own[r.doc_id])
        want = Counter(reasons.values())
        assert (r.lines_in, r.kept, r.decoration, r.tiny, r.garbage, r.toc, r.repeated) == (len(rows), len(rows) - len(reasons), want["decoration"], want["tiny"], 0, want["toc"], want["repeated"])


def test_a_group_is_packed_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(V, "PACK_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(g, i, int(t)) for g, n in (("a", 200), ("b", 1), (None, 50), ("c", 14)) for i, t in enumerate(rng.choice([1, 5, 20, 60, 150], n))]
    want, at = {}, {}
    for g, i, t in rows:
        no, s, n = at.get(g, (0, 0, 0))
        at[g] = (no + 1, t, 1) if n and (s + t > 100 or n >= 5) else (no, s + t, n + 1)
        want[g, i, t] = at[g][0]
    df = spark.createDataFrame(rows, "g string, i long, t long").repartition(5)
    found = V.packed(df, "t", "i", 100, 5, "g").collect()
    assert len(found) == len(rows) and {(r.g, r.i, r.t): r.batch_no for r in found} == want
    monkeypatch.setattr(V, "PACK_ROWS", 65_536)
    assert {(r.g, r.i, r.t): r.batch_no for r in V.packed(df, "t", "i", 100, 5, "g").collect()} == want


def test_no_task_holds_a_whole_group(spark, monkeypatch):
    monkeypatch.setattr(V, "PACK_ROWS", 10)
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").alias("i"), F.lit(30).alias("t"))
    plan = V.packed(df, "t", "i", 100, 5, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_append" not in plan
