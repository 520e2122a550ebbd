"""Operator 4: quality rules as learned decision lists.

Statistics of each whole text are the only inputs. Sequential covering over labelled rows grows a conjunction of thresholds
by FOIL gain on two thirds of them, prunes its tail on the other third, keeps it if it is precise enough, removes what it
covers and goes on. The rules come out as one ordered Spark conditional expression; a text that none fits is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomframe.llm.common import read, small_batches

#: Labelled rows that a fit looks at, at most; those with the least hash of their id.
FIT_ROWS = 20_000
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Different words are counted in blocks of so many, as their share in a whole text falls with its length.
BLOCK = 64
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: A rule must be right on this share of what it covers, smoothed, in both parts of the labelled rows.
PRECISION = 0.95
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_distinct", "n_upper", "n_exclaim")
STATS = StructType([StructField(c, LongType()) for c in COUNTS])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.nonzero(np.isin(w, twice))[0].tolist()
    seen: dict[tuple, list[int]] = {}
    for i in at:  # hashes may collide; the words decide
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    cover = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(cover, places, 1)
            np.add.at(cover, np.array(places) + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: bytes | None) -> tuple[int, ...]:
    words = text.split() if text else []
    if not words:
        return (0,) * len(COUNTS)
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = len(joined)
    return (
        len(words),
        len(joined.decode()),
        without - len(joined.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(len(set(words[i : i + BLOCK])) for i in range(0, len(words), BLOCK)),
        without - len(joined.translate(None, UPPER)),
        joined.count(b"!"),
    )


def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=COUNTS, dtype="int64")


def with_stats(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """docs with a struct of COUNTS of each whole text; null texts have no words."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(_stats, STATS)(F.col(text_col).cast("binary")))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def features(stats: str = "stats") -> dict[str, Column]:
    s = {c: F.col(f"{stats}.{c}") for c in COUNTS}
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": _share(s["word_chars"], s["n_words"]),
        "symbols_per_word": _share(s["n_symbols"], s["n_words"]),
        "dup_lines": _share(s["n_dup_lines"], s["n_lines"]),
        "repeat_words": _share(s["n_repeat_words"], s["n_words"]),
        "distinct_words": _share(s["n_distinct"], s["n_words"]),
        "upper": _share(s["n_upper"], s["word_chars"]),
        "exclaim_per_word": _share(s["n_exclaim"], s["n_words"]),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value <= threshold
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self, named: dict[str, Column]) -> Column:
        v = named[self.feature]
        return v >= F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)


def _covered(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Condition]:
    rule, rows = [], np.ones(len(x), bool)
    while (~y[rows]).any() and y[rows].any() and len(rule) < 2 * len(names):
        p0, n0 = y[rows].sum(), (~y[rows]).sum()
        best, found = 0.0, None
        for f, name in enumerate(names):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            vs, ys = v[order], y[rows][order]
            cut = np.nonzero(vs[1:] > vs[:-1])[0]  # between cut and cut + 1
            if not len(cut):
                continue
            p_low, n_low = np.cumsum(ys)[cut], np.cumsum(~ys)[cut]
            for above in (False, True):
                p, n = (p0 - p_low, n0 - n_low) if above else (p_low, n_low)
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best + 1e-9:
                    best, found = gain[k], Condition(name, above, float((vs[cut[k]] + vs[cut[k] + 1]) / 2))
        if found is None:
            break
        rule.append(found)
        rows &= found.holds(x, names)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = PRECISION, least: int = 4) -> list[list[Condition]]:
    """Ordered rules that say reject. Rows must come in an order that has nothing to do with their labels; every third prunes."""
    rules: list[list[Condition]] = []
    part = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    right = lambda rule, rows: (lambda c: ((bad[rows] & c).sum() + 1) / (c.sum() + 1.0 + 1 / max(least, 1)))(_covered(rule, x[rows], names))
    while True:
        grow, prune = left & ~part, left & part
        if bad[grow].sum() < least or bad[prune].sum() < 1:
            return rules
        rule = _grow(x[grow], bad[grow], names)
        if not rule:
            return rules
        worth = []
        for k in range(1, len(rule) + 1):
            c = _covered(rule[:k], x[prune], names)
            p, n = (bad[prune] & c).sum(), (~bad[prune] & c).sum()
            worth.append((p - n) / max(p + n, 1))
        rule = rule[: int(np.argmax(worth)) + 1]
        hit = _covered(rule, x, names) & left
        if (bad & hit).sum() < least or right(rule, grow) < precision or right(rule, prune) < precision:
            return rules
        rules.append(rule)
        left &= ~hit


def verdict(rules: list[list[Condition]], stats: str = "stats") -> Column:
    """The number of the first rule that fits (from 1), else 0."""
    named, out = features(stats), None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            test = test & c.column(named)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[list[Condition]]:
    """Rules from the labelled texts: quality 0 is bad. Unlabelled, unknown and null ids count for nothing; of several
    labels of one id the worst does. Without both labels there are no rules."""
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so many rows at most: safe to broadcast
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    named = features()
    seen = with_stats(own).select("doc_id", "quality", *[c.alias(k) for k, c in named.items()])
    # rows of equal ids are possible: so the limit holds for them too
    seen = seen.orderBy(F.xxhash64("doc_id"), *named).limit(rows).toPandas()
    return learn(seen[list(named)].to_numpy(float), (seen["quality"] == 0).to_numpy(), list(named))


def base_failed(stats: str = "stats") -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > REPEAT_PERCENT * n)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with stats, base_failed, rule (the number of the learned rule that rejects, else 0) and kept."""
    out = with_stats(docs)
    rule = verdict(fit(docs, labels))
    return out.withColumn("base_failed", base_failed()).withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose texts the rules keep, columns unchanged, whatever their names."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    return judged(rows, labels).filter("kept").select("__row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in BASE], "base_failed", "kept")
