import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from loomframe.llm import golay, simhash
from tests.llm.helpers import SF, bits, components, docs

TEXTS = ["a b c d e f g", "a b c d e f g", "A B c d e f g", "x", "", None, "  \n", "lorem ipsum dolor sit amet " * 40, "lorem ipsum dolor sit amet " * 40 + "x", "a b c", "é ü 漢字 word more words here"]


def plain_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_plain_definition():
    for t in TEXTS:
        assert golay.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_every_word_is_within_three_bits_of_its_codeword():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 5000)
    decoded = golay.decode(v)
    code = {int(golay.decode(np.array([c]))[0]): None for c in v[:50]}
    assert len(code) > 40 and decoded.max() < 4096
    assert (np.bitwise_count(golay._ERRORS) <= 3).all()


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_four_bits_apart_share_a_key(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    keys = [set(golay.keys(np.array([x], np.uint64))[1].tolist()) for x in (fp, other)]
    assert keys[0] & keys[1]


def test_classes_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    chain = [base[0]]
    for k in range(1, 16):  # a chain whose ends are far apart
        chain.append(chain[-1] ^ (0b1111 << (4 * (k % 15))))
    dense = [base[1] ^ int(sum(1 << int(b) for b in rng.choice(20, 3, replace=False))) for _ in range(120)]
    values = sorted({*base, *chain, *dense})
    fps = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), i) for i, v in enumerate(values)], "fp long, least long")
    got = {r.fp: r["class"] for r in simhash.classes(fps).collect()}
    want = components(values, lambda a, b: bits(a, b) <= 4)
    got = [got[int(np.uint64(v).astype(np.int64))] for v in values]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_a_bucket_of_many_classes_is_joined_whole(monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 500)  # several blocks and the parting by pieces
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    values = np.unique(np.array([base ^ int(sum(1 << int(b) for b in rng.choice(40, rng.integers(1, 7), replace=False))) for _ in range(300)], np.uint64))
    forest = simhash.Forest()
    own = values.view(np.int64)
    simhash.join_near(values, own, forest)
    want = components([int(v) for v in values], lambda a, b: bits(a, b) <= 4)
    got = [forest.find(int(x)) for x in own]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) < len(values)
    assert len(forest.new) == len(values) - len(set(got))


def test_a_documents_table_against_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    least = {}
    for root, r in zip(components(fps, lambda a, b: bits(a, b) <= 4), rows):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{fp:016x}", least[root]) for root, fp, r in zip(components(fps, lambda a, b: bits(a, b) <= 4), fps, rows)}
    from loomframe.llm.simhash import op5_simhash_golay

    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash_golay(spark, SF).collect()} == want


def test_rows_come_back_whole(spark):
    df = docs(spark, TEXTS)
    df = df.union(df.filter("doc_id = 0"))
    out = simhash.near_duplicates(df).collect()
    assert len(out) == df.count()
    by = {r.doc_id: r.component_id for r in out}
    assert by[1] == by[2] == 0 and by[5] == by[6] == by[4] == 4 and by[8] == 7


def test_no_rows_and_no_ids(spark):
    assert simhash.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(nameless).collect()} == {3}
