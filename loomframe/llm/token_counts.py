"""Operator 10: exact token counts of every prefix by dynamic programming.

For a BPE vocabulary the encoding of a prefix ends in exactly one token that keeps its place beside the last token of the
prefix before it: `last[e]` is found by trying the tokens that end at e, and `count[e] = count[e - len] + 1`. A text's
count is the last entry; truncation and budget questions read the table and encode nothing again.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from loomframe.llm.common import forget_half, read, small_batches

VOCABULARY = "word_bpe_49k.json"
#: Bytes that one worker remembers of pre-tokens, about, at most; characters of the longest that it remembers; what an entry takes beside
#: them; pairs of tokens that it remembers at most.
MEMO_BYTES, LONGEST, ENTRY, PAIRS = 32 << 20, 64, 150, 150_000
LIMIT = 2048


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others numbered from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Counter(dict):
    """Pre-token (already normalised) -> its number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.merges = {tuple(pair): (rank, "".join(pair)) for rank, pair in enumerate(model["merges"])}
        self.vocabulary = frozenset(model["vocab"])
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocabulary)
        self.pairs: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0
        self.held, self.passing = 0, []  # bytes, about; long pre-tokens of the texts at hand
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.characters = byte_characters()

    def normal(self, text: str) -> str:
        """NFC, then each character's lower case by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the lowest merge first, leftmost of equals."""
        n = len(symbols)
        symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self.merges.get((symbols[i], symbols[after[i]]))):
                heapq.heappush(heap, (m[0], i, m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != made or self.merges[symbols[i], symbols[j]][0] != rank:
                continue
            symbols[i], symbols[j] = made, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def beside(self, left: str, right: str) -> bool:
        """Whether right is a token and BPE leaves the two as they are when they stand side by side (left may be none)."""
        if right not in self.vocabulary:
            return False
        stem = right.removesuffix(self.end)
        return self.merged([*left, *stem[:-1], stem[-1] + right[len(stem) :]]) == ([left, right] if left else [right])

    def _step(self, word: str, e: int, count: list[int], last: list[str], suffix: str) -> tuple[int, str]:
        """Tokens of word[:e] (with the suffix on its last character), and the last of them. One start alone fits."""
        pairs = self.pairs
        for s in range(e - 1, max(0, e - self.longest) - 1, -1):
            token = word[s:e] + suffix
            known = pairs[last[s]]
            stands = known.get(token)
            if stands is None:
                stands = known[token] = self.beside(last[s], token)
                self.n_pairs += 1
            if stands:
                return count[s] + 1, token
        raise ValueError(f"no encoding of {word[:e]!r}")

    def written(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.characters.__getitem__, piece.encode()))

    def word(self, piece: str) -> list[int]:
        """Token counts of the piece's character prefixes."""
        word, count, last = self.written(piece), [0], [""]
        for e in range(1, len(word)):
            c, t = self._step(word, e, count, last, "")
            count.append(c)
            last.append(t)
        ends = np.cumsum([len(c.encode()) for c in piece]).tolist()
        return [self._step(word, e, count, last, self.end)[0] for e in ends]

    def learn(self, pieces: set[str]) -> None:
        """Works out all pieces that are not known, in order of their characters: what a piece shares with the one before it
        stays in the table."""
        for piece in self.passing:
            self.pop(piece, None)
        self.passing = [p for p in pieces if len(p) > LONGEST]
        if self.held > MEMO_BYTES:
            forget_half(self)
            self.held = sum(ENTRY + len(p) for p in self)
        if self.n_pairs >= PAIRS:
            forget_half(self.pairs)
            self.n_pairs = sum(map(len, self.pairs.values()))
        self.held += sum(ENTRY + len(p) for p in pieces if p not in self and len(p) <= LONGEST)
        before, count, last, step = "", [0], [""], self._step
        for word, piece in sorted((self.written(p), p) for p in pieces if p not in self):
            e, most = 0, min(len(count), len(word)) - 1
            while e < most and before[e] == word[e]:
                e += 1
            del count[e + 1 :], last[e + 1 :]
            for e in range(e + 1, len(word)):
                c, t = step(word, e, count, last, "")
                count.append(c)
                last.append(t)
            self[piece] = step(word, len(word), count, last, self.end)[0]
            before = word

    def totals(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; null and empty texts have none."""
        out: list[int] = []
        for at in range(0, len(texts), 400):
            found = []
            for text in texts[at : at + 400]:
                parts = self.special.split(text) if text and "<|" in text else [text or ""]
                found.append((len(parts) - 1, [p for part in parts for p in self.find(self.normal(part))]))
            self.learn(set().union(*(p for _, p in found)))
            out += [n + sum(map(self.__getitem__, p)) for n, p in found]
        return out

    def total(self, text: str | None) -> int:
        return self.totals([text])[0]

    def places(self, part: str) -> np.ndarray:
        """For each number of characters of part, how many characters of its normal form they are; inside of what is composed to
        one character, as with all of it."""
        if part.isascii():
            return np.arange(len(part) + 1)
        out, at, held = [0], 0, ""  # held: what the next character may still be composed with
        for c in part:
            if held and not c.isascii() and self.normal(held + c) != self.normal(held) + self.normal(c):
                held += c
                out[-len(held) + 1 :] = [at + len(self.normal(held))] * (len(held) - 1)
                out.append(out[-1])
            else:
                at, held = at + len(self.normal(held)), c
                out.append(at + len(self.normal(c)))
        return np.array(out)

    def table(self, text: str | None) -> np.ndarray:
        """counts[k]: tokens of the first k characters of the text (special strings count when complete)."""
        if not text:
            return np.zeros(1, np.int64)
        out, at, base = [np.zeros(1, np.int64)], 0, 0
        for m in [*self.special.finditer(text), None]:
            own = text[at : m.start() if m else len(text)]
            part = self.normal(own)
            counts = np.full(len(part), -1, np.int64)
            for w in self.spans(part):
                piece = w.group()
                if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # cut short, its letters stand by themselves
                    mark = self.total("'")
                    got = [mark, *(mark + n for n in self.word(piece[1:-1])), self.word(piece)[-1]]
                else:
                    got = self.word(piece)
                counts[w.start() : w.end()] = np.array(got) + base
                base += got[-1]
            # white space adds nothing to what stands before it
            known = np.concatenate([[out[-1][-1]], counts])
            known = known[np.maximum.accumulate(np.where(known >= 0, np.arange(len(known)), 0))]
            out.append(known[self.places(own)][1:])
            if m:
                out.append(self.table_of_special(m.group(), base))
                base += 1
                at = m.end()
        return np.concatenate(out)

    def table_of_special(self, string: str, base: int) -> np.ndarray:
        return np.array([base + self.total(string[:k]) for k in range(1, len(string))] + [base + 1], np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This process's counter for a vocabulary file. The file must be at the path on every executor."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text, without added special tokens.

    Null and empty texts: 0. Strings of special tokens inside a text count as those tokens. A column named as out is replaced.
    """
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path).totals(texts.tolist()), dtype="int64")

    return docs.withColumn(out, F.pandas_udf(count, LongType())(text_col))


def prefix_counts(docs: DataFrame, text_col: str = "text", path: str | None = None, out: str = "counts") -> DataFrame:
    """docs with an array: element k holds the tokens of the text's first k characters, element 0 is 0."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def table(texts: pd.Series) -> pd.Series:
        own = counter(path)
        return pd.Series([own.table(t).astype("int32") for t in texts], dtype=object)

    return docs.withColumn(out, F.pandas_udf(table, ArrayType(IntegerType()))(text_col))


def fitting(counts: str, budget: int):
    """Column: the most characters whose prefix has at most budget tokens, from a table of prefix_counts."""
    return F.array_max(F.filter(F.transform(counts, lambda c, k: F.when(c <= budget, k)), lambda k: k.isNotNull()))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    counted = count_tokens(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
