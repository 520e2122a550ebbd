import re
import zlib
from collections import Counter

import numpy as np
from itertools import combinations

from loomframe.llm import quality as Q, string_kernel as sk, toxicity as T
from loomframe.llm.common import read
from tests.llm.helpers import SF, docs

TEXTS = ["", None, "one two three four five six seven eight nine ten " * 3, "a\nb\na\n\n \nb c\n", "### $$ <x> | word", "w " * 30, " ".join(f"w{i}" for i in range(5000)), "é 漢字\x0bnext"]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_statistics_match_the_plain_definition(spark):
    out = Q.with_stats(docs(spark, TEXTS)).collect()
    for r in out:
        assert tuple(r.stats[c] for c in Q.BASE) == plain(r.text), r.text


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, chars, symbols, dup, repeat = plain(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda a, b: a / b if b else 0.0
    distinct = sum(len(set(words[i : i + Q.BLOCK])) for i in range(0, n, Q.BLOCK))
    joined = "".join(words)
    return {"n_words": float(n), "mean_word": share(chars, n), "symbols_per_word": share(symbols, n), "dup_lines": share(dup, len(lines)), "repeat_words": share(repeat, n), "distinct_words": share(distinct, n), "upper": share(len(re.findall("[A-Z]", joined)), chars), "exclaim_per_word": share(joined.count("!"), n)}


def test_the_query_is_a_plain_reading_of_the_learned_list(spark):
    folder = "/root/testdata/sf0.01"  # of fewer labels no rule comes out
    d, labels = read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "labels", "doc_id", "quality")
    rules = Q.fit(d, labels)
    assert rules
    texts = {r.doc_id: r.text for r in d.collect()}
    out = Q.op4_quality_rules(spark, folder).collect()
    assert len(out) == len(texts)
    for r in out:
        x, own = plain_features(texts[r.doc_id]), plain(texts[r.doc_id])
        assert tuple(r[c] for c in Q.BASE) == own
        failed = own[0] < 20 or 100 * own[4] > 30 * own[0]
        hit = any(all(x[c.feature] >= c.threshold if c.above else x[c.feature] <= c.threshold for c in rule) for rule in rules)
        assert r.base_failed == failed and r.kept == (not failed and not hit)


def test_base_rule_at_its_edges(spark):
    eight = " ".join(f"r{i}" for i in range(8))
    texts = ["w " * 19, " ".join(f"w{i}" for i in range(20)), " ".join([eight, eight, *(f"w{i}" for i in range(37))]), " ".join([eight, eight, *(f"w{i}" for i in range(38))])]
    assert [plain(t)[0] for t in texts] == [19, 20, 53, 54] and [plain(t)[4] for t in texts[2:]] == [16, 16]
    out = Q.with_stats(docs(spark, texts)).select("doc_id", Q.base_failed().alias("f")).collect()
    assert {r.doc_id: r.f for r in out} == {0: True, 1: False, 2: True, 3: False}  # 16 of 53 is above 30 %, of 54 below


def test_learned_rules_find_what_sets_bad_rows_apart():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5)
    rules = Q.learn(x, bad, ["a", "b", "c"])
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= Q._covered(rule, x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.98
    assert Q.learn(x, np.zeros(3000, bool), ["a", "b", "c"]) == []
    assert Q.learn(x[:0], bad[:0], ["a", "b", "c"]) == []


def test_rules_become_one_column(spark):
    rules = [[Q.Condition("n_words", True, 10.0), Q.Condition("upper", True, 0.5)], [Q.Condition("symbols_per_word", True, 1.0)]]
    df = Q.with_stats(docs(spark, ["UPPER " * 12, "low " * 12, "#### ####", None])).withColumn("v", Q.verdict(rules))
    assert {r.doc_id: r.v for r in df.collect()} == {0: 1, 1: 0, 2: 2, 3: 0}


def test_filter_keeps_columns_and_clean_documents(spark):
    d, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    out = Q.filter_quality(d, labels)
    assert out.columns == d.columns
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    kept = {r.doc_id for r in out.collect()}
    long = {r.doc_id for r in Q.judged(d, labels).filter("not base_failed").collect()}
    assert len((good & long) - kept) <= 0.02 * len(good)
    assert Q.filter_quality(d.limit(0), labels).count() == 0
    assert Q.filter_quality(d, labels.limit(0)).count() == len(long)


def slow_kernel(s, t, p=3, decay=0.6):
    def sub(z):
        out = Counter()
        for ix in combinations(range(len(z)), p):
            out["".join(z[i] for i in ix)] += decay ** (ix[-1] - ix[0] + 1)
        return out

    a, b = sub(s), sub(t)
    dot = lambda u, v: sum(u[k] * v[k] for k in u)
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_kernel_is_the_gap_weighted_subsequence_kernel():
    pairs = [("idxiot", "idiot"), ("worrthless", "worthless"), ("stupid", "stupid"), ("moooron", "moron")]
    for a, b in pairs:
        assert abs(float(sk.similarity([a], [b])[0, 0]) - slow_kernel(a, b)) < 1e-3


def test_the_pair_filter_drops_nothing_that_counts(monkeypatch):
    rng = np.random.default_rng(8)
    marks = ["scum", "idiot", "worthless", "pathetic", "réeux", "dummkopf"]
    words = sorted({v for m in marks for v in T.variants(m)} | {v for m in marks for u in T.variants(m) for v in T.variants(u)} | {"".join(rng.choice(list("aeioscumdtr"), rng.integers(3, 10))) for _ in range(500)})
    fast = sk.similarity(words, marks)
    monkeypatch.setattr(sk, "COMMON", 0)
    whole = sk.similarity(words, marks)
    assert np.array_equal(np.where(fast >= 0.5, fast, 0), np.where(whole >= 0.5, whole, 0)) and (whole >= 0.5).sum() > 100
    low = (whole >= T.FLOORS[0]) & (whole < 0.5)  # of what is below a half a little may go
    assert (fast[low] > 0).mean() > 0.9


def test_held_out_labels_are_found(spark):
    d, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels", "doc_id", "toxic")
    model = T.fit(d, labels)
    rows = d.join(labels, "doc_id").filter(T.held_out() & labels.toxic.isNotNull()).select("text", "toxic").collect()
    hit = T.Scorer(model).scores([r.text for r in rows]) >= T.THRESHOLD
    toxic = np.array([r.toxic == 1 for r in rows])
    assert hit[toxic].mean() >= 0.85 and hit[~toxic].mean() <= 0.01


def test_long_repeated_and_missing_texts(spark):
    texts = ["idiot. " * 5, "idiot. " * 5, None, "word " * 300_000, "idiot " + "word " * 300_000]
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    out = T.with_score(frame.union(frame), T.fit(frame, labels)).collect()
    assert len(out) == 10 and len({(r.doc_id, r["score"]) for r in out}) == 5
    assert T.fit(frame.limit(0), labels).landmarks == [] and T.with_score(frame.limit(0), T.Model([])).count() == 0


def test_units_see_through_marks():
    assert sk.units("1d1ot!!") == ["idiot"] and sk.units("s.t-u_pid,") == ["stupid"] and sk.units("ab") == []
    assert len(sk.units("x" * 100)) == 6


def test_held_out_texts(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abeiorstnl"), 6)) for _ in range(400)]
    insults = ["scoundrel", "blockhead", "numskull"]
    texts, toxic = [], []
    for i in range(300):
        w = list(rng.choice(words, 40))
        if i % 2:
            w[5] = insults[i % 3]
        texts.append(" ".join(w) + ".")
        toxic.append(i % 2)
    model = T.train(texts, np.array(toxic) == 1)
    s = T.Scorer(model)
    probe = ["my word, blockhead. Fine.", "n u m s k u l l they said", "sc0undrel!", " ".join(words[:50]), "", None]
    score = s.scores(probe)
    assert (score[:3] >= 0.7).all() and (score[3:] < 0.7).all()
    assert T.train(["x"], np.array([False])).landmarks == []


def test_scores_of_odd_rows(spark):
    d, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = T.fit(d, labels)
    out = T.with_score(docs(spark, TEXTS), model).collect()
    assert all(0 <= r.score <= 1 for r in out)
    assert T.filter_toxic(d, labels).columns == d.columns
    ids = [0, 1, 5, 77, 12345]
    got = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", T.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}
