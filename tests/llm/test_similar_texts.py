import numpy as np

from loomframe.llm import similar_texts as S
from tests.llm.helpers import SF, components, docs


def plain_words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_similarity(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a, b))
    return len(x & y) / len(x | y)


def plain_classes(rows):
    words = [plain_words(t) for _, t in rows]
    roots = components(words, lambda a, b: plain_similarity(a, b) >= 0.8)
    least = {}
    for root, (i, _) in zip(roots, rows):
        least[root] = min(least.get(root, i), i)
    return {i: least[root] for root, (i, _) in zip(roots, rows)}


def changed(rng, words, share):
    words = list(words)
    for k in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[k] = f"other{rng.integers(1000)}"
    return words


def test_a_documents_table_against_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.class_id for r in S.similar_classes(df).collect()}
    assert got == plain_classes([(r.doc_id, r.text) for r in df.collect()])


def test_a_large_group_of_near_copies_about_one_text(spark):
    rng = np.random.default_rng(4)
    base = [f"word{rng.integers(400)}" for _ in range(300)]
    texts = [" ".join(changed(rng, base, 0.015)) for _ in range(150)] + [" ".join(base)] + [" ".join(f"else{rng.integers(400)}" for _ in range(200)) for _ in range(20)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in S.similar_classes(docs(spark, texts)).collect()}
    want = plain_classes(rows)
    assert got == want and len(set(want.values())) == 21


def test_candidates_are_found_at_the_least_similarity():
    rng = np.random.default_rng(6)
    found = total = 0
    for _ in range(150):
        a = [f"w{rng.zipf(1.3) % 5000}" for _ in range(rng.integers(60, 600))]
        b = changed(rng, a, 1 / 46)
        if plain_similarity(a, b) < 0.8:
            continue
        bits = np.unpackbits(np.frombuffer(S.sketch(" ".join(a).encode()) + S.sketch(" ".join(b).encode()), np.uint8).reshape(2, -1), axis=1)
        words = (bits[:, : S.SKETCHES * 46].reshape(2, -1, 23).astype(np.int64) << np.arange(23)).sum(2)
        rows, keys = S.golay.one_error_keys(words[:, 0::2], words[:, 1::2])
        total += 1
        found += bool(set(keys[rows == 0]) & set(keys[rows == 1])) and (bits[0] != bits[1]).mean() <= S.APART
    assert total > 80 and found >= 0.93 * total


def test_one_bit_apart_share_a_key():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 1 << 23, (400, 2))
    other = words.copy()
    at = rng.integers(0, 46, 400)
    other[np.arange(400), at // 23] ^= 1 << (at % 23)
    sides = []
    for w in (words, other):
        rows, keys = S.golay.one_error_keys(w[:, :1], w[:, 1:])
        sides.append([set(keys[rows == k]) for k in range(400)])
    assert all(a & b for a, b in zip(*sides))


def test_rows_without_words_ids_or_a_fifth_word(spark):
    texts = ["a b c", "A b\nc", "a b c d", "", None, " \n", "x " * 5000]
    df = docs(spark, texts)
    df = df.union(df.filter("doc_id = 1")).union(df.filter("doc_id = 2").selectExpr("cast(null as long) doc_id", *df.columns[1:]))
    got = {(r.doc_id, r.class_id) for r in S.similar_classes(df).collect()}
    assert got == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 3), (6, 6)}
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "3", "6", "None"]
    assert S.deduplicate(df.limit(0)).count() == 0


def test_strangers_in_a_bucket_hide_nothing(spark):
    """Near copies whose every key is shared with strangers of smaller ids, in one bucket: all near pairs are candidates."""
    rng = np.random.default_rng(8)
    fresh = lambda: rng.integers(0, 256, S.BYTES, dtype=np.uint8)
    base, strangers = fresh(), [fresh() for _ in range(40)]
    for x in strangers:
        x[:69] = base[:69]  # the same keys ...
        flip = rng.choice(552, 250, replace=False)
        x[flip // 8] ^= (1 << (flip % 8)).astype(np.uint8)  # ... but far by all bits, where keys allow
    near = base.copy()
    near[:3] ^= 1
    rows = [(i, i, x) for i, x in enumerate([*strangers, base, near])] + [(99, 7, near)]
    batch = lambda asks: S.pa.RecordBatch.from_arrays(
        [S.pa.array([5] * len(rows)), S.pa.array([0] * len(rows), S.pa.int32()), S.pa.array([asks] * len(rows), S.pa.int32()), S.pa.array([r[0] for r in rows]), S.pa.array([r[1] for r in rows]), S.pa.array([r[2].tobytes() for r in rows])], list("abcdef"))
    found = {p for b in S._nearest(iter([batch(0), batch(1)])) for p in zip(*(c.to_pylist() for c in b.columns))}
    assert (40, 41) in found and (40, 99) in found and (41, 99) in found
    assert not any(a < 40 and b < 40 for a, b in found)


def planted(rng, groups, strangers):
    """(texts, group): groups of two to four texts at a similarity of 0.8 to 0.9, and texts of their own vocabulary."""
    texts, group = [], []
    word = lambda: f"w{rng.zipf(1.25) % 20_000}"
    for g in range(groups):
        base = [word() for _ in range(int(rng.integers(40, 160)))]
        own = [base]
        while len(own) < 2 + g % 3:
            other = changed(rng, base, float(rng.uniform(0.005, 0.022)))
            if 0.8 <= plain_similarity(base, other) <= 0.9:
                own.append(other)
        texts += [" ".join(t) for t in own]
        group += [g] * len(own)
    texts += [" ".join(word() for _ in range(int(rng.integers(20, 160)))) for _ in range(strangers)]
    return texts, group + list(range(groups, groups + strangers))


def test_recall_of_whole_classes_among_many_strangers(spark):
    rng = np.random.default_rng(10)
    texts, group = planted(rng, 400, 6_000)
    order = rng.permutation(len(texts))  # so that the least ids of buckets are mostly strangers'
    df = spark.createDataFrame([(int(i), texts[k]) for i, k in enumerate(order)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.class_id for r in S.similar_classes(df).collect()}
    members = {}
    for i, k in enumerate(order):
        members.setdefault(group[k], []).append(i)
    whole = sum(len({got[i] for i in own}) == 1 for own in members.values() if len(own) > 1)
    assert whole >= 0.95 * 400
    assert all(got[i] in own for own in members.values() for i in own)  # nobody is taken for a stranger's copy


def test_buckets_and_texts_in_parts(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.class_id for r in S.similar_classes(df).collect()}
    monkeypatch.setattr(S, "CHUNK", 2), monkeypatch.setattr(S, "GROUP", 2)
    assert {r.doc_id: r.class_id for r in S.similar_classes(df).collect()} == want


def test_marks_never_rule_out_similar_texts():
    rng = np.random.default_rng(13)
    ruled = total = 0
    for n in (1, 4, 5, 6, 30, 150, 900, 4_000):
        for share in (0.0, 0.001, 0.01, 0.02, 0.03, 0.1):
            a = [f"w{rng.zipf(1.3) % 3000}" for _ in range(n)]
            b = changed(rng, a, share)[: n - n // 40] if share else a[: n - n // 9]
            x, y = (np.frombuffer(S.marks(" ".join(t).encode()), np.uint64)[None] for t in (a, b))
            may = bool(S.may_be_similar(x, y)[0])
            assert may or plain_similarity(a, b) < 0.8
            ruled += not may
            total += plain_similarity(a, b) < 0.8
    assert total > 15 and ruled > 0.7 * total


def test_a_nearer_text_of_a_class_hides_none_behind_it(spark):
    """Two texts of the same words in another order are nearest by sketch, but only through the third text similar."""
    rng = np.random.default_rng(14)
    for n, k in ((60, 1), (5_000, 80)):
        one = [f"v{j}" for j in rng.permutation(n)]
        at = np.arange(2 * k) * (n // (2 * k)) + n // (4 * k)
        mid, other = list(one), list(one)
        for p, q in zip(at[:k], at[k:]):
            mid[p] = one[q]
            other[p], other[q] = one[q], one[p]
        texts = [" ".join(t) for t in (one, other, mid)]
        assert plain_similarity(one, other) < 0.8 <= min(plain_similarity(one, mid), plain_similarity(other, mid))
        got = {r.doc_id: r.class_id for r in S.similar_classes(docs(spark, texts)).collect()}
        assert got == plain_classes(list(enumerate(texts))) == {0: 0, 1: 0, 2: 0}


def test_texts_near_by_words_alone_make_no_pairs(spark):
    """The same words in 40 orders: one bucket, 780 pairs by sketch, none by shingles."""
    rng = np.random.default_rng(15)
    words = [f"u{j}" for j in range(120)]
    rows = []
    for i in range(40):
        own = " ".join(rng.permutation(words)).encode()
        rows.append((i, i, i, bytearray(S.sketch(own)), bytearray(getattr(S, "marks", lambda _: b"")(own))))
    placed = spark.createDataFrame(rows, "node long, class long, least long, sketch binary, marks binary")
    assert S._open_pairs(placed).count() == 0
