"""State tables: merged batches against all events at once, and which files a batch touches."""

import random
from datetime import datetime, timedelta
from pathlib import Path

from loomframe.operators import lifecycle as L, sessions as S, states

EVENTS = "event_id long, session_id string, user_sub string, app_name string, kind string, ts timestamp_ntz"
STATUS = "event_id long, doc_id long, stage string, pdf_kind string, ts timestamp_ntz"


def made(n, seed):
    rnd, start = random.Random(seed), datetime(2024, 1, 1)
    return [(i, f"s{rnd.randrange(40)}", f"u{rnd.randrange(9)}", f"a{rnd.randrange(3)}", rnd.choice(["login", "heartbeat", "logout"]), start + timedelta(seconds=rnd.randrange(500))) for i in range(n)]


def test_batches_in_any_order_and_again(spark, tmp_path):
    events = made(400, 1)
    table = states.session_states(spark, str(tmp_path / "s"), 8)
    random.Random(2).shuffle(events)
    for k in (0, 300, 100, 200, 100):  # one batch comes again
        table.update(S.session_partials(spark.createDataFrame(events[k : k + 100], EVENTS)))
    assert {tuple(r) for r in S.finished_sessions(table.read()).collect()} == {tuple(r) for r in S.latest_sessions(spark.createDataFrame(events, EVENTS)).collect()}
    one = table.lookup("s3", "nobody")
    assert [r.session_id for r in one.collect()] == ["s3"]
    assert table.update(S.session_partials(spark.createDataFrame([], EVENTS))) is None


def test_documents_and_their_resets(spark, tmp_path):
    rnd, start = random.Random(5), datetime(2024, 1, 1)
    events = [(i, rnd.randrange(12), rnd.choice(["pdf_info", "ocr", "text", "clean", "error"]), rnd.choice(["text", "image"]), start + timedelta(seconds=rnd.randrange(60))) for i in range(300)]
    table = states.document_states(spark, str(tmp_path / "d"), 4)
    for k in range(0, 300, 75):
        table.update(L.status_partials(spark.createDataFrame(events[k : k + 75], STATUS)))
    assert {tuple(r) for r in L.finished_status(table.read()).collect()} == {tuple(r) for r in L.latest_status(spark.createDataFrame(events, STATUS)).collect()}


def test_files_of_other_buckets_stay_as_they_are(spark, tmp_path):
    table = states.session_states(spark, str(tmp_path / "s"), 16)
    table.update(S.session_partials(spark.createDataFrame(made(300, 7), EVENTS)))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(tmp_path, "s", "state").rglob("part-*.parquet")}
    before = files()
    late = [(999, "s3", "u", "a", "logout", datetime(2025, 1, 1))]
    assert table.update(S.session_partials(spark.createDataFrame(late, EVENTS))) == 2
    after = files()
    assert all(after[f] == t for f, t in before.items()) and len(after) == len(before) + 1
    new = [f for f in after if f not in before]
    assert "version=2" in new[0]
    assert {r.bucket: r.version for r in table.versions.groups().collect()} == {r.bucket: 2 if f"bucket={r.bucket}/" in new[0] else 1 for r in table.versions.groups().collect()}
