"""Operators on small literals, and the sequential ones against sequential versions."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomframe.functions import costs, text as T
from loomframe.operators import chunks as K, corpus as C, items as I, lifecycle as L, sessions as S, vectors as V
from loomframe.sources import jsonl as J


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'long'}" for i, v in enumerate(values)))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.norm_text, "  ＡＢ　\t c ") == "AB c"
    assert one(spark, T.terms, "a, b／c d，") == ["a", "b", "c", "d，"]
    assert one(spark, T.parse_recent, "3時間") == timedelta(hours=3) and one(spark, T.parse_recent, "7d") == timedelta(days=7) and one(spark, T.parse_recent, "x") is None
    assert one(spark, T.mb_to_bytes, "1.5") == 1572864 and one(spark, T.mb_to_bytes, "x") == 0
    assert one(spark, T.safe_filename, 'a/b:"c".txt') == "a_b__c_.txt" and len(one(spark, T.safe_filename, "x" * 200 + ".pdf")) == 120
    assert one(spark, T.detect_kind, "a.XLS") == "other" and one(spark, T.detect_kind, "b.Tex") == "text" and one(spark, T.detect_kind, "none") == "other"
    assert one(spark, T.tags, "a b") == ["a", "b"] and one(spark, T.tags, "a\n b c,,") == ["a", "b c"]
    assert one(spark, T.first_tag, '["x","y"]') == "x" and one(spark, T.first_tag, "bad") == "" and one(spark, T.first_tag, None) == ""
    assert one(spark, T.doc_id, " a\\b/", "/c ") == "a/b/c"
    assert one(spark, lambda c: T.expand_abbreviations(c)[0], "PJ no ABPJ12 pjno FY") == "プロジェクト no ABPJ12 プロジェクト番号 年度"
    assert one(spark, T.estimate_tokens, "abc 日本 x_1!") == 5 and one(spark, T.estimate_tokens, " ") == 1 and one(spark, T.estimate_tokens, "") == 0
    assert one(spark, T.strip_fence, "```srt\n1\nx\n```") == "1\nx"
    assert one(spark, T.project_no, "7") == "007" and one(spark, T.project_year, "99") is None
    assert one(spark, lambda c: C.inline(c), "手賀 沼　の 2 つ") == "手賀沼の2つ"
    with pytest.raises(Exception):
        one(spark, T.doc_id, "a", "  ")


def test_costs_of_unknown_models_are_null(spark):
    df = spark.createDataFrame([("gpt-5", 1000, 10), ("nope", 1, 1), ("gpt-5", None, 1)], "model string, i long, o long")
    out = [r.c for r in costs.priced(df).select(costs.chat_usd(F.col("i"), F.col("o")).alias("c")).collect()]
    assert sorted(out, key=lambda x: x is None)[0] == pytest.approx(0.00135) and out.count(None) == 2
    with pytest.raises(Exception):
        costs.priced(df).select(costs.strict_usd(F.col("i"), F.col("o"))).collect()


def pack(lengths, most, least, hard):
    out, no, size = [], 0, None
    for n in lengths:
        if size is None:
            size = n
        elif size + 1 + n <= most or (size < least and size + 1 + n <= hard):
            size += 1 + n
        else:
            no, size = no + 1, n
        out.append(no)
    return out


def test_packing_against_a_loop(spark):
    rng = random.Random(0)
    rows = [[rng.randint(1, 60) for _ in range(rng.randint(1, 40))] for _ in range(200)]
    assert all(K.chunk_numbers(r, 100, 40, 150) == pack(r, 100, 40, 150) for r in rows)


def plain_cut(unit, hard):
    out, rest = [], unit.strip()
    while len(rest) > hard:
        head = rest[:hard]
        at = next((p + 1 for p in (head.rfind(m) for m in ("\n", *K.SOFT)) if p >= max(1, hard // 2)), hard)
        out += [rest[:at].strip()]
        rest = rest[at:].strip()
    return [x for x in [*out, rest] if x]


def test_chunks_and_spans_against_a_plain_reading(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts |= {10**6: "一文目。二文目！ 三文目？\n\n" + "長い、" * 900 + "\n\n\u3000終わり。", 10**6 + 1: "a" * 7000, 10**6 + 2: "x!!?!\n \t\ny", 10**6 + 3: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.chunk_index): r for r in K.chunk_documents(df).collect()}
    clean = {r.doc_id: r.t for r in df.select("doc_id", K.normalised(F.col("text")).alias("t")).collect()}
    want = {}
    for i, t in clean.items():
        units = [p for para in re.split(r"\n\n+", t or "") for u in re.split(r"(?<=[。！？!?])", para) for p in plain_cut(u, K.HARD)]
        for no, u in zip(pack([len(u) for u in units], K.MOST, K.LEAST, K.HARD), units):
            want[i, no] = f"{want[i, no]}\n{u}" if (i, no) in want else u
    assert {k: r.text for k, r in got.items()} == want
    squeeze = lambda s: "".join(s.split())
    ends: dict = {}
    for (i, no), r in sorted(got.items()):
        assert squeeze(clean[i][r.span_start : r.span_end]) == squeeze(r.text) and r.span_start >= ends.get(i, 0)
        assert clean[i][r.span_start] == r.text[0] and clean[i][r.span_end - 1] == r.text[-1]
        ends[i] = r.span_end


def test_chunks_hold_the_whole_text(spark):
    text = "First sentence! Second one? " * 80 + "\n\n" + "x" * 5000 + "\n\n日本語。テスト。"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n ")], "doc_id long, text string")
    out = K.chunk_documents(df).orderBy("chunk_index").collect()
    assert {r.doc_id for r in out} == {1}
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(r.text for r in out)) == squeeze(text) and max(len(r.text) for r in out) <= 1800
    assert all(a.span_end <= b.span_start for a, b in zip(out, out[1:]))
    pages = spark.createDataFrame([(1, 1, "A b c! D."), (1, 2, "E f? G!"), (1, 3, None)], "doc_id long, page_no long, text string")
    whole = K.chunk_pages(pages).collect()
    assert len(whole) == 1 and (whole[0].page_start, whole[0].page_end) == (1, 2)
    assert [("aa。" + "b" * 8)[a:b] for a, b in K.unit_spans("aa。" + "b" * 8, 5)] == ["aa。", "bbbbb", "bbb"]


def test_cleaning_of_japanese_lines(spark):
    text = "\n".join(["ヘッダー", "第1章 はじめに", "本文はここから始まり", "次の行へ続く。", "-----------", "|", "x", "Abc def ghi", "ヘッダー", "12", "1. 一 1", "2. 二 2", "3. 三 3", "ヘッダー", "終わり"])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in C.clean_corpus(df, C.Options(toc_min_run=3, join_japanese=False)).collect()}
    assert out == {1: "第1章 はじめに\n本文はここから始まり 次の行へ続く。\n12 終わり"}
    report = C.cleaning_report(C.tagged_lines(df, C.Options(toc_min_run=3, join_japanese=False))).filter("doc_id = 1").first()
    assert (report.lines_in, report.decoration, report.tiny, report.garbage, report.toc, report.repeated) == (13, 1, 0, 1, 3, 3)
    assert report.lines_in == report.kept + report.decoration + report.tiny + report.garbage + report.toc + report.repeated


def test_sessions_follow_their_events(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(1, "s", "u", "a", "login", at(0)), (2, "s", "u", "a", "heartbeat", at(30)), (3, "s", "u", "a", "logout", at(60)), (4, "t", "v", "a", "heartbeat", at(50)), (5, "s", "u", "a", "heartbeat", at(100))]
    df = spark.createDataFrame(rows, "event_id long, session_id string, user_sub string, app_name string, kind string, ts timestamp_ntz")
    state = {r.session_id: r for r in S.latest_sessions(df).collect()}
    assert state["s"].login_at == at(0) and state["s"].logout_at is None and state["t"].login_at == at(50)
    samples = [(r.bucket_ts, r.active_users, r.peak_users) for r in S.minute_samples(df).orderBy("bucket_ts").collect()]
    assert samples == [(at(0), 2, 2), (at(60), 2, 2)]
    assert S.minute_samples(df.limit(0)).count() == 0


def test_status_log(spark):
    rows = [(1, 1, datetime(2024, 1, 1), "ocr", "text"), (2, 1, datetime(2024, 1, 2), "pdf_info", "image"), (3, 1, datetime(2024, 1, 3), "error", "text"), (4, 1, datetime(2024, 1, 4), "clean", "text")]
    r = L.latest_status(spark.createDataFrame(rows, "event_id long, doc_id long, ts timestamp_ntz, stage string, pdf_kind string")).first()
    assert (r.pdf_kind, r.ocr_done, r.clean_done, r.error_at) == ("image", False, True, None)


def test_vector_health(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 0.0])], "shard_id string, vector_index long, embedding array<double>")
    meta = spark.createDataFrame([("a", 0, "d"), ("a", 0, "d"), ("a", 5, "d"), ("a", -1, "e")], "shard_id string, vector_index long, doc_id string")
    manifest = spark.createDataFrame([("a", "d")], "shard_id string, doc_id string")
    assert {(r.vector_index, r.issue) for r in V.misaligned(v, meta).collect()} == {(5, "out_of_range"), (-1, "negative"), (0, "duplicate")}
    assert V.audit(v, meta, manifest).first().health == "error"
    hits = [(r.vector_index, r.score) for r in V.search(v, [(9, [2.0, 0.0])], 5).orderBy("rank").collect()]
    assert hits == [(0, 1.0), (1, 0.0)]
    with pytest.raises(ValueError):
        V.search(v, [(9, [0.0, 0.0])])
    packed = V.packed(spark.createDataFrame([("a", i, t) for i, t in enumerate([50, 60, 200, 10, 10])], "g string, i long, t long"), "t", "i", 100, 2, "g")
    assert [r.batch_no for r in packed.orderBy("i").collect()] == [0, 1, 2, 3, 3]


def test_item_search_conditions(spark):
    items = spark.createDataFrame([("1", "pdf", "Ab_1%.pdf", '["x"]', 5), ("2", "word", "abc.doc", '["y"]', 9)], "item_id string, kind string, original_name string, tags_json string, size_bytes long")
    ids = lambda **k: sorted(r.item_id for r in I.search(items, **k).collect())
    assert ids(kinds=[]) == [] and ids() == ["1", "2"] and ids(name_terms=("AB",)) == ["1", "2"]
    assert ids(name_terms=("1%",)) == ["1"] and ids(name_terms=("b%",)) == [] and ids(name_terms=("b%",), raw_like=True) == ["1", "2"]


def test_jsonl_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user":"u","n":1}\n\n{bad\n[1]\n{"action":"x"}\n')
    lines = J.scan(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "missing.jsonl")])
    assert tuple(J.stats(lines).first()) == (5, 2, 2)
    assert sorted((r.user or "", r.action or "") for r in J.rows(lines, "user string, action string").collect()) == [("", "x"), ("u", "")]
    log = spark.createDataFrame([("2024-03-01 10:00:00", "u", "go", 3)], "ts string, user string, action string, k long")
    J.write_log(log, str(tmp_path / "log"), "app", "page")
    back = spark.read.json(str(tmp_path / "log")).first()
    assert back.month == "2024-03" and back.app_name == "app" and back.k == 3
    assert J.scan(spark, [str(tmp_path / "none")]).count() == 0


def plain_samples(events, ttl):
    """(app, time) -> (users, sessions) at each heartbeat, by looking at every session's event before it."""
    later, out = {}, {}
    for e in sorted(events, key=lambda e: (e[1], e[4], e[0])):
        later.setdefault(e[1], []).append(e)
    spans = []
    for own in later.values():
        for e, after in zip(own, [*own[1:], None]):
            if e[5] != "logout":
                spans.append((e[3], e[2], e[1], e[4], min(e[4] + timedelta(seconds=ttl, microseconds=1), after[4] if after else datetime.max)))
    for e in events:
        if e[5] == "heartbeat":
            on = [(u, s) for app, u, s, a, b in spans if app == e[3] and a <= e[4] < b]
            if on:
                out[e[3], e[4]] = (len({u for u, _ in on}), len({s for _, s in on}), {u for u, _ in on})
    return out


@pytest.mark.parametrize("ttl", [5, 120, 4000])
def test_sweep_against_looking_at_every_session(spark, ttl):
    rnd, start = random.Random(ttl), datetime(2024, 3, 1, 10, 58)
    events = []
    for n in range(500):
        s, at = rnd.randrange(25), start + timedelta(seconds=rnd.choice([1, 1, 60]) * rnd.randrange(240), microseconds=rnd.choice([0, 1, 999_999]))
        events.append((n, f"s{s}", f"u{s % 7}", f"app{s % 2}", at, rnd.choice(["login", "heartbeat", "heartbeat", "heartbeat", "logout"])))
    df = spark.createDataFrame([(n, s, u, a, t, k) for n, s, u, a, t, k in events], "event_id long, session_id string, user_sub string, app_name string, ts timestamp_ntz, kind string")
    want = {}
    for (app, at), (users, sessions, _) in sorted(plain_samples(events, ttl).items(), key=lambda x: x[0][1]):
        key = (at.replace(second=0, microsecond=0), app)
        peak = want.get(key, (0, 0, 0, 0))
        want[key] = (users, sessions, max(peak[2], users), max(peak[3], sessions))
    got = {(r.bucket_ts.replace(tzinfo=None), r.app_name): tuple(r)[2:] for r in S.minute_samples(df, ttl).collect()}
    assert got == want
    days, seen = {}, {}
    for (app, at), (users, sessions, names) in sorted(plain_samples(events, ttl).items(), key=lambda x: x[0][1]):
        if seen.setdefault((app, at.replace(second=0, microsecond=0)), at) == at:
            for u in names:
                n, most, more = days.get((f"{at:%Y-%m-%d}", u, app), (0, 0, 0))
                days[f"{at:%Y-%m-%d}", u, app] = (n + 1, max(most, users), max(more, sessions))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in S.daily_minutes(df, ttl).collect()} == days


def test_two_thousand_users_in_one_minute(spark):
    """Rows in between are as many as events, not as pairs of users."""
    start = datetime(2024, 3, 1, 12)
    rows = [(n, f"s{n % 2000}", f"u{n % 2000}", "app", start + timedelta(microseconds=9_000 * n), "heartbeat") for n in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, session_id string, user_sub string, app_name string, ts timestamp_ntz, kind string")
    pieces = S._pieces(df, 120)
    users = S._user_pieces(pieces)
    assert pieces.count() <= 2 * 6000 + 2 * 2000 and users.count() <= pieces.count() and S._swept(pieces, users, df).count() == 6000
    first = S.minute_samples(df).orderBy("bucket_ts").first()
    assert (first.active_users, first.active_sessions, first.peak_users) == (2000, 2000, 2000)
    assert S.daily_minutes(df).count() == 1
