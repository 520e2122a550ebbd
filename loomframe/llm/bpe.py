"""Operator 9: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash of the vocabulary (hash and displace): a pre-token that is in the vocabulary as a whole
costs one probe and one comparison. Tier two merges the bytes of any other pre-token, linked left and right, in the order
of a heap of (rank, place). What a worker has resolved it remembers, up to MEMO_BYTES.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from loomframe.llm.common import forget_half, held, read, small_batches

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes that one worker remembers of pre-tokens, about, at most; bytes of the longest that it remembers; what an entry takes beside them.
MEMO_BYTES, LONGEST, ENTRY = 96 << 20, 64, 180


def read_ranks(path: str) -> list[bytes]:
    """The tokens by rank; the file is a vocabulary, bounded as such."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    return [found[k] for k in range(len(found))]


class PerfectHash:
    """token -> rank. Buckets are placed from the largest: each tries seeds until its tokens fall on free slots; a bucket of
    one takes the next free slot by number, held as a negative. All len(tokens) slots get used."""

    def __init__(self, tokens: list[bytes]):
        n = self.n = len(tokens)
        buckets: dict[int, list[int]] = {}
        for rank, token in enumerate(tokens):
            buckets.setdefault(xxh64_intdigest(token, 0) % n, []).append(rank)
        self.seeds = array("l", bytes(8 * n))
        self.ranks = array("l", [-1]) * n
        self.tokens = tokens
        order = sorted(buckets.items(), key=lambda kv: (-len(kv[1]), kv[0]))
        free = iter(range(n))
        for bucket, ranks in order:
            if len(ranks) > 1:
                seed = 1
                while True:
                    slots = [xxh64_intdigest(tokens[r], seed) % n for r in ranks]
                    if len(set(slots)) == len(slots) and all(self.ranks[s] < 0 for s in slots):
                        break
                    seed += 1
                self.seeds[bucket] = seed
                for s, r in zip(slots, ranks):
                    self.ranks[s] = r
            else:
                slot = next(s for s in free if self.ranks[s] < 0)
                self.seeds[bucket] = -slot - 1
                self.ranks[slot] = ranks[0]

    def get(self, token: bytes) -> int:
        """Its rank, or -1."""
        seed = self.seeds[xxh64_intdigest(token, 0) % self.n]
        rank = self.ranks[-seed - 1 if seed < 0 else xxh64_intdigest(token, seed) % self.n]
        return rank if self.tokens[rank] == token else -1


class Encoder(dict):
    """Pre-token -> its ids as packed unsigned 32-bit little-endian integers; resolved when first asked for."""

    def __init__(self, tokens: list[bytes], pattern: str):
        super().__init__()
        self.tokens, self.hash = tokens, PerfectHash(tokens)
        self.by_bytes = {t: r for r, t in enumerate(tokens)}
        self.find, self.held = regex.compile(pattern).findall, 0

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.hash.get(raw)
        ids = rank.to_bytes(4, "little") if rank >= 0 else array("I", self.merge(raw)).tobytes()
        if len(raw) <= LONGEST:
            if self.held > MEMO_BYTES:
                forget_half(self)
                self.held = sum(ENTRY + len(p) + len(i) for p, i in self.items())
            self.held += ENTRY + len(raw) + len(ids)
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        get = self.by_bytes.get
        n = len(raw)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = get(raw[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, end = pop(heap)
            mid = after[i]
            if mid < 0 or mid >= n or after[mid] != end:
                continue  # one of the two has been merged since
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                rank = get(raw[i : after[end]])
                if rank is not None:
                    push(heap, (rank, i, after[end]))
            left = before[i]
            if left >= 0:
                rank = get(raw[left:end])
                if rank is not None:
                    push(heap, (rank, left, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.by_bytes[raw[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """This process's encoder for a rank file. The file must be at the path on every executor."""
    return held(("bpe", path, pattern), lambda: Encoder(read_ranks(path), pattern))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """docs with a binary column: the ids, packed as unsigned 32-bit little-endian integers.

    Null and empty texts: no ids. Strings of special tokens are ordinary text. A column named as out is replaced.
    """
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)

    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([encoder(path).encode(t) for t in texts], dtype=object)

    return docs.withColumn(out, F.pandas_udf(ids, BinaryType())(text_col))


def decode(docs: DataFrame, ids_col: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """docs with a binary column: the bytes that packed ids stand for. Null ids: no bytes. An unknown id fails."""
    path = path or public_tokenizers.path(RANKS)

    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([encoder(path).decode(x) for x in ids], dtype=object)

    return docs.withColumn(out, F.pandas_udf(text, BinaryType())(ids_col))


DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each row: encode, then decode, with ids and bytes kept in the worker."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)

    def digest(texts: pd.Series) -> pd.DataFrame:
        own = encoder(path)
        rows = []
        for t in texts:
            ids = own.encode(t)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=DIGEST.names)

    return docs.select(F.col(id_col), F.pandas_udf(digest, DIGEST)(text_col).alias("d")).select(id_col, "d.*")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents", "doc_id", "text"))
