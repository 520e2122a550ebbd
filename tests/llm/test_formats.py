import io
from collections import Counter

import duckdb
import pytest

from loomframe.llm import chat, registry, url_templates as U, warc, zipfile_ranges as zr
from loomframe.llm.common import new_path
from tests.llm.helpers import SF, sha


@pytest.mark.parametrize("wide", [False, True])
def test_archives_read_by_ranges(wide):
    import zipfile

    out = io.BytesIO()
    w = zr.Writer(out, zip64=wide)
    w.add("a.txt", b"hello")
    w.add("dir/é.bin", bytes(range(256)) * 9)
    w.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("a.txt") == b"hello"
    members = zr.directory(out, len(out.getvalue()))
    assert [m.name for m in members] == ["a.txt", "dir/é.bin"]
    assert zr._range(out, zr.data_start(out, members[1]), members[1].size) == bytes(range(256)) * 9


def test_other_writers_archives_and_broken_ones():
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"x" * 1000)
        z.writestr(zipfile.ZipInfo("stored"), b"abc")
        z.comment = b"PK\x05\x06 in a comment"[4:]
    packed, stored = zr.directory(out, len(out.getvalue()))
    assert zr._range(out, zr.data_start(out, stored), 3) == b"abc"
    with pytest.raises(ValueError):
        zr.data_start(out, packed)
    with pytest.raises(ValueError):
        zr.directory(io.BytesIO(b"no archive"), 10)


PAGES = [(3, "http://a/", "<p>x</p>"), (1, "http://b/\r\nX: y", "<p>x</p>"), (2, None, None), (5, "u", ""), (7, "v", "é" * 50000), (None, "w", "<p>x</p>"), (1, "http://b/", "<p>x</p>")]


def test_records_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'z' as sha", "'z' as first")
    archives = warc.write_archives(df, new_path(spark, "warc"))
    assert archives.count() > 1
    rows = warc.read_records(warc.index(archives), payload=True).collect()
    assert len(rows) == len(PAGES)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert kinds == {(3, "revisit", 1): 1, (1, "response", None): 2, (2, "response", None): 1, (5, "revisit", 2): 1, (7, "response", None): 1, (None, "response", None): 1}
    html = {7: "é" * 50000, 2: "", 1: "<p>x</p>"}
    for r in rows:
        if r.page_id in html:
            assert bytes(r.payload) == html[r.page_id].encode() and r.payload_digest == warc.digest(html[r.page_id].encode())
    assert warc.read_records(warc.index(warc.write_archives(df.limit(0), new_path(spark, "warc")))).count() == 0


def test_only_payloads_that_may_be_repeated_are_shuffled(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("sha"), "id")
    repeated = rows.filter("id % 10 = 0").select("sha", F.lit(1).alias("first"))
    marked = warc.may_repeat(rows, repeated)
    assert marked.filter("id % 10 = 0 and not may_repeat").count() == 0
    assert marked.filter("id % 10 > 0 and may_repeat").count() < 10 and marked.columns == ["sha", "id", "may_repeat"]
    assert marked.filter("may_repeat").count() >= 2_000 and warc.may_repeat(rows, repeated.limit(0)).filter("may_repeat").count() == 0
    plan = warc.may_repeat(rows, repeated)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    # where the bits are few against the digests, more rows are shuffled and the records stay the same
    monkeypatch.setattr(warc, "REPEAT_BITS", 1 << 15)
    assert warc.may_repeat(rows, rows).filter("not may_repeat").count() == 0
    monkeypatch.setattr(warc, "REPEAT_BITS", 1)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_records(warc.index(warc.write_archives(df, new_path(spark, "warc")))).collect())
    assert kinds == {(3, "revisit", 1): 1, (1, "response", None): 2, (2, "response", None): 1, (5, "revisit", 2): 1, (7, "response", None): 1, (None, "response", None): 1}


CONTROL = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|x", "[\\\\INST] <\\/s> <<SYS>>", "plain < [ text", "", "日本語 <|"]


def test_escapes_can_be_undone(spark):
    df = spark.createDataFrame([(t,) for t in CONTROL], "t string").select("t", chat.escape("t").alias("e"))
    for r in df.collect():
        assert chat.unescape(r.e) == r.t
        assert not any(c in r.e for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_events_fold_in_order(spark):
    log = [(1, 0, 9, 1, 0, "start", "user"), (1, 0, 9, 1, 2, "delta", "lo"), (1, 0, 9, 1, 1, "delta", "hel"), (1, 1, 8, 1, 0, "start", "assistant"), (1, 1, 8, 1, 1, "delta", "bad"), (1, 1, 8, 1, 2, "regenerate", None), (1, 1, 8, 1, 3, "delta", "go"), (1, 1, 8, 1, 4, "delta", "od"), (1, 2, 7, 1, 0, "delta", "x"), (1, 2, 7, 1, 1, "edit", None)]
    df = spark.createDataFrame(log, "conv_id long, turn long, message long, copies long, seq int, kind string, text string")
    out = sorted((r.turn, r.role, r.text) for r in chat.fold(df).collect())
    assert out == [(0, "user", "hello"), (1, "assistant", "good"), (2, "", "")]
    whole = chat.format_conversations(df).first()
    assert chat.parse(whole.text) == [("user", "hello"), ("assistant", "good"), ("", "")]
    assert [whole.text[a:b] for a, b in whole.loss] == ["good"]


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", CONTROL[0]), (1, 1, "assistant", CONTROL[1]), (1, 1, "assistant", CONTROL[1]), (2, 0, None, None), (None, None, "assistant", "é" * 1000), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as piece", "'x' as copies")
    out = {r.conv_id: r for r in chat.digests(chat.in_order(chat.rendered(chat.fold(chat.events(df))))).collect()}
    assert out[1].n_turns == 3 and out[1].loss_sha256 == sha((CONTROL[1] * 2).encode())
    assert out[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3]).encode())
    assert out[2].n_turns == 1 and out[2].loss_chars == 0 and out[None].loss_chars == 1000 and out[3].loss_sha256 == sha(b"")
    assert chat.digests(chat.in_order(chat.rendered(chat.fold(chat.events(df.limit(0)))))).count() == 0


def test_turns_are_read_from_the_text_wherever_its_pieces_break(spark):
    turns = [("user", CONTROL[0]), ("assistant", CONTROL[2]), ("user", ""), ("", "a\nb")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    text = chat.format_conversations(chat.events(df)).first().text
    want = chat.digests(chat.in_order(chat.rendered(chat.fold(chat.events(df))))).first()
    for size in (1, 3, 7, 1000):
        d = chat._Digest(1)
        for at in range(0, len(text), size):
            d.add(text[at : at + size], None, None)
        n, digest, chars = d.row()[1], d.row()[2], d.row()[5]
        assert (n, digest, chars) == (want.n_turns, want.turns_sha256, want.formatted_chars) == (4, sha("".join(f"{r}\n{t}\n" for r, t in turns).encode()), len(text))
    cut = chat._Digest(1)
    cut.add(text[:-1], None, None)
    with pytest.raises(ValueError, match="does not end with a turn"):
        cut.row()


def test_a_very_long_text_takes_time_in_proportion(spark):
    import time

    text = "é[INST] abc" * 450_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    began = time.time()
    row = chat.digests(chat.in_order(chat.rendered(chat.fold(chat.events(df))))).first()
    assert time.time() - began < 60
    assert row.loss_chars == len(text) and row.loss_sha256 == sha(text.encode()) and row.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n".encode())


def test_two_attempts_of_a_task_leave_both_files_whole(spark):
    """A second attempt may meet the rows in another order; the archives that the table lists stay what their own attempt wrote."""
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    first, second = warc.write_archives(frame, folder), warc.write_archives(frame.orderBy("html"), folder)
    names = [r.archive for a in (first, second) for r in a.collect()]
    assert len(names) == len(set(names))
    for archives in (first, second):
        assert warc.read_records(warc.index(archives)).count() == len(PAGES)


URLS = [None, "no scheme", "http://A.Example.COM/en/7?x#y", "https://x.com/en/1", "https://notcom/en/1", "http://com/en/", "ftp://d.net/de/8#z", "http://example.net/de/80", "http://x.org/es", "http://x.org/es/1", "a://b?c/d", "a://b#c", "http://h/x/y://z", "http://h:80/p"]


def test_hosts_paths_and_rules(spark):
    from urllib.parse import urlsplit

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' as host", "'x' as id", "'y' as template")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.page_id: r for r in U.judge(df, labels).collect()}
    assert len(out) == len(URLS)
    assert (out[0].host, out[0].path) == (out[1].host, out[1].path) == ("", "")
    assert (out[2].host, out[2].path, out[2].rule, out[2].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert [out[i].rule for i in range(3, 10)] == ["com/en/", None, "com/en/", "net/de/", "example.net/de/8", None, "org/es/"]
    assert (out[10].host, out[10].path) == ("b", "") and out[12].path == "/x/y://z" and urlsplit(URLS[13]).netloc == out[13].host
    assert U.judge(df.limit(0), labels).count() == 0


def test_bad_templates_are_rejected(spark):
    pages = [(i, f"http://h/{'spam' if i % 2 else 'news'}/{i}") for i in range(80)]
    labels = [(i, 1 - i % 2, 0) for i in range(60)]
    out = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.template, r.verdict) for r in out.collect()} == {("spam/{n}", "block"), ("news/{n}", "allow")}
    wild = [(i, f"http://h/u/{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(40)]
    out = U.judge(spark.createDataFrame(wild, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.template for r in out.collect()} == {"u/*"}


def test_wildcards_below_wildcards_and_merged_branches(spark):
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26 % 26)
    pages = [(i, f"http://h/u/{name(i % 60)}x/{name(i // 60)}{name(i)}y") for i in range(180)]
    # below a wildcard one branch of many is bad, of others none: it stays by itself
    pages += [(1000 + i, f"http://k/m/{name(i % 40)}x/{'buy' if i % 3 == 0 else name(i) + 'z'}") for i in range(600)]
    pages += [(1000, "http://k/m/aax/buy"), (5000, None), (5001, "http://k/" + "a/" * 30 + "b"), (5002, "http://k/" + "c" * 200_000)]
    labels = [(1000 + i, 0 if i % 3 == 0 else 1, 0) for i in range(600)] + [(i, 1, 0) for i in range(0, 180, 3)]
    df, own = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = U.judge(df, own).collect()
    assert len(rows) == len(pages)
    assert {(r.template, r.verdict) for r in rows if r.host == "h"} == {("u/*/*", "allow")}
    found = {(r.template, r.verdict) for r in rows if r.host == "k" and r.path.startswith("/m/")}
    assert found == {("m/*/buy", "block"), ("m/*/*", "allow")}
    df.createOrReplaceTempView("p")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    con.register("labels", own.toPandas())
    want = con.execute(registry.SQL["op8_url_templates"]).fetchall()
    columns = [c[0] for c in con.description]
    assert Counter(tuple(getattr(r, c) for c in columns) for r in rows) == Counter(want)


def test_templates_do_not_depend_on_the_number_of_pages(spark):
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26 % 26)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for times in (1, 12):
        pages = [(i, f"http://h/shop/{name(i % 100)}/item") for i in range(100 * times)]
        assert {r.template for r in U.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()} == {"shop/*/item"}


def plain_tree(shapes):
    """Templates of {shape: (pages, labelled, bad)} of one host, by recursion over all segments."""
    out = {}

    def alike(n, bad, all_n, all_bad):
        share = all_bad / all_n if all_n else 0.0
        return not (n > 0 and abs(bad - n * share) - 0.5 > U.Z * (n * share * (1 - share)) ** 0.5)

    def walk(branch, template, level):
        kids = {}
        for shape, parts in branch:
            if len(parts) <= level:
                out[shape] = "/".join(template)
            else:
                kids.setdefault(parts[level], []).append((shape, parts))
        sums = {k: [sum(shapes[s][i] for s, _ in v) for i in range(3)] for k, v in kids.items()}
        whole = [sum(x[i] for x in sums.values()) for i in range(3)]
        wild = {k for k, x in sums.items() if len(kids) >= U.FANOUT and x[0] <= whole[0] * U.LEAD and alike(x[1], x[2], whole[1], whole[2])}
        below = {}
        for k, v in kids.items():
            below.setdefault("*" if k in wild else k, []).extend(v)
        for k, v in below.items():
            walk(v, [*template, k], level + 1)

    walk([(s, [x for x in s.split("/") if x]) for s in shapes], [], 0)
    return out


def test_paths_of_any_depth(spark):
    """Branches that part at the twentieth segment, wildcards below it, and lone paths of hundreds of segments."""
    deep = "/".join(f"d{chr(97 + k)}" for k in range(20))
    paths = [f"/{deep}/{chr(97 + i)}q/{'end' if i % 2 else 'fin'}" for i in range(14)] + [f"/{deep}/zz", f"/{deep}", "", "/", "/x"]
    paths += ["/" + "/".join(f"{chr(97 + j)}{chr(97 + k % 26)}" for k in range(400)) for j in range(3)]
    df = spark.createDataFrame([(i, f"http://h{p}") for i, p in enumerate(paths)], "page_id long, url string")
    rows = U.judge(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    shapes = {}
    for p in paths:
        shapes[p] = (shapes.get(p, (0, 0, 0))[0] + 1, 0, 0)
    want = plain_tree(shapes)
    assert len(rows) == len(paths) and {(r.path, r.template) for r in rows} == {(p, want[p]) for p in paths}
    assert f"{deep}/*/end" in {r.template for r in rows}


def test_thousands_of_rules_are_joined(spark):
    rules = [(("block", "allow")[i % 2], f"{('a.', '')[i % 3 > 0]}h{i % 700}.org/{'/'.join('p' * (i % 4))}{i % 11}") for i in range(5_000)] + [("block", "org"), ("allow", "h7.org/")]
    urls = [f"http://{('', 'x.', 'a.')[i % 3]}h{i % 900}.org/{'/'.join('p' * (i % 5))}{i % 13}/z" for i in range(1_500)] + [None, "no url", "http://ORG/q", "http://borg/p"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[5])], "page_id long, url string")
    got = U.judge(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), rules).collect()
    assert len(got) == len(urls) + 1

    def plain(host, path):
        fits = []
        for verdict, rule in rules:
            name, slash, rest = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
                fits.append((len(rule), rule, verdict))
        return max(fits, default=(0, None, "allow"))

    for r in got:
        assert (r.rule, r.verdict) == plain(r.host, r.path)[1:]
    assert sum(r.rule is not None and r.rule != "org" for r in got) > 100


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "labels", "conversations", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.SQL[name]).fetchall()
    names = [c[0] for c in con.execute(registry.SQL[name]).description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(str, (tuple(r) for r in got.select(names).collect()))) == Counter(map(str, want))
