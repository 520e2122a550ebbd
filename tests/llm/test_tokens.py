import hashlib
import struct
import unicodedata

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomframe.llm import bpe, token_counts as tc
from tests.llm.helpers import SF, docs

TEXTS = ["", None, "Hello, world! it's 12345", "naïve  \n\n\t café — 漢字かな 😀", "<|endoftext|> is text", "x" * 3000, "The quick brown fox " * 300, "don't WE'LL ΑΣΣ Σ", "a b c\x1cd\x85e", "é İI ﬁ"]


@pytest.fixture(scope="module")
def encoding():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(P.path(bpe.RANKS)))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path(tc.VOCABULARY))


def test_perfect_hash_is_minimal_and_exact():
    tokens = bpe.read_ranks(P.path(bpe.RANKS))
    h = bpe.PerfectHash(tokens)
    assert sorted(h.ranks) == list(range(len(tokens)))
    assert all(h.get(t) == r for r, t in enumerate(tokens))
    assert h.get(b"surely not a token of it") == -1


def test_ids_are_the_library_s(spark, encoding):
    out = {r.doc_id: r for r in bpe.digests(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        ids = encoding.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_of_columns(spark):
    df = docs(spark, TEXTS)
    out = bpe.decode(bpe.encode(df)).select("doc_id", "decoded").collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in out} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.digests(df.limit(0)).count() == 0


def test_counts_are_the_library_s(spark, tokenizer):
    out = {r.doc_id: r.n_tokens for r in tc.count_tokens(docs(spark, TEXTS)).collect()}
    assert out == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert tc.count_tokens(docs(spark, ["x"]).limit(0)).count() == 0


def test_every_prefix(tokenizer):
    own = tc.counter(P.path(tc.VOCABULARY))
    for text in ["it's <|endoftext|> ok<|startoftext|>x'LL ünï", "don't we'll they've '' 'l", "all right, thble tionhe $$$!! 123", "漢字 かな"]:
        table = own.table(text)
        low = text.lower()
        assert len(table) == len(low) + 1
        assert [int(x) for x in table] == [len(tokenizer.encode(low[:k], add_special_tokens=False).ids) for k in range(len(low) + 1)]


def test_budgets_come_from_the_table(spark):
    df = tc.prefix_counts(docs(spark, ["one two three four", "", None]))
    got = {r.doc_id: r.n for r in df.select("doc_id", tc.fitting("counts", 2).alias("n")).collect()}
    assert got == {0: len("one two "), 1: 0, 2: 0}


def test_tables_are_of_the_texts_own_characters(spark):
    own = tc.counter(P.path(tc.VOCABULARY))
    for text in ["cafe\u0301 au lait", "e\u0301e\u0301e\u0301 x", "I\u0307stanbul İstanbul", "한글 \u1112\u1161\u11ab\u1100\u1173\u11af", "ΣΑΣ Å A\u030a\u0301 z"]:
        table = own.table(text)
        assert len(table) == len(text) + 1 and table[-1] == own.total(text)
        for k in range(len(text)):
            if unicodedata.normalize("NFC", text) == unicodedata.normalize("NFC", text[:k]) + unicodedata.normalize("NFC", text[k:]):
                assert table[k] == own.total(text[:k]), (text, k)
    df = tc.prefix_counts(docs(spark, ["cafe\u0301 " * 20]))
    row = df.withColumn("n", tc.fitting("counts", 7)).first()
    assert own.total(("cafe\u0301 " * 20)[: row.n]) <= 7 < own.total(("cafe\u0301 " * 20)[: row.n + 6])


def test_repeated_rows_and_whole_tables_agree_with_the_libraries(spark, encoding, tokenizer):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    df = df.union(df.limit(20))
    rows = df.collect()
    want = sorted((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in tc.count_tokens(df).select("doc_id", "n_tokens").collect()) == want
    ids = {r.doc_id: encoding.encode_ordinary(r.text or "") for r in rows}
    out = bpe.digests(df).collect()
    assert len(out) == len(rows)
    for r in out:
        own = ids[r.doc_id]
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
