"""Operator 1: toxicity by a subsequence string kernel SVM with Nyström landmarks.

Words, and the starts of longer words, are compared with landmarks by the gap-weighted subsequence kernel, so inserted, doubled
and swapped-in characters and spaced-out letters cost similarity but don't hide a word. A text's likeness to each landmark is the
sum over its different words (a convolution kernel of bags of words), mapped by the inverse root of the landmarks' own kernel and
scored by a linear SVM: one plain insult or several weak signs add up to a toxic text, and the number of different words counts
against signs that long texts hold by chance. Landmarks are chosen from all labelled texts of the fit, the most telling first and
by cover of what others have not covered yet.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomframe.llm import string_kernel as sk
from loomframe.llm.common import held, local_table, read, small_batches

#: Labelled texts of each class that a fit looks at, at most (those with the least hash of their id); bytes of one such text and
#: of all together. Longer texts are scored whole like any other, only not learned from.
FIT_ROWS, FIT_TEXT, FIT_BYTES = 1_500, 1 << 20, 64 << 20
#: Landmarks at most; letters of a word's start; greatest likeness to one landmark that counts for a text.
LANDMARKS, START, MOST = 64, 5, 8.0
#: Likeness that counts for weak landmarks; for strong ones the least of FLOORS that at most a share STRAY of clean texts has by chance.
LIKE, FLOORS, STRAY = 0.65, tuple(k / 20 for k in range(8, 20)), 0.002
#: Least share and log odds of toxic texts with a landmark; share of toxic texts, and toxic share (classes weighed alike), from
#: which it is toxic by itself; weight of such a landmark in disguise.
SHARE, ODDS, COMMON, PURE, ALONE = 0.01, 1.5, 0.05, 0.97, 3
#: Costs of a text inside the margin that are tried, and parts of the texts for that.
COSTS, FOLDS = (0.05, 0.2, 1.0), 3
#: Tokens that one worker remembers at most, and characters of them.
MEMO, MEMO_CHARS = 100_000, 8 << 20
#: Texts whose tokens a worker holds at a time.
PART = 200
THRESHOLD = 0.7
#: A clean text that is flagged counts as so many toxic ones missed, by share.
CLEAN_WEIGHT = 4


@dataclass
class Model:
    landmarks: list[str]
    floors: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # likeness to each landmark from which it counts
    root: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))  # of the mapped likenesses, the length, and the bias
    slope: float = 0.0
    offset: float = -3.0


def units_of(token: str) -> list[str]:
    """What a token is compared as: its word (or windows of a long one), and the word's start."""
    own = sk.units(token)
    return own + [own[0][:START]] if own and len(own[0]) > START + 1 else own


class Scorer:
    """A model with what this process knows of tokens: token -> place of its similarities, or -1 for none above the floor."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.known: dict[str, int] = {}  # the same for units
        self.rows: list[np.ndarray] = []
        self.held = 0  # characters of the tokens

    def learn(self, tokens: set[str]) -> None:
        if len(self.place) > MEMO or self.held > MEMO_CHARS:
            self.forget()
        new = {t: units_of(t) for t in tokens - self.place.keys()}
        words = list({u for us in new.values() for u in us} - self.known.keys())
        near = sk.similarity(words, self.model.landmarks)
        near[near < self.model.floors] = 0
        hit = near.any(1) if words else []
        for word, any_, row in zip(words, hit, near):
            self.known[word] = len(self.rows) if any_ else -1
            if any_:
                self.rows.append(row.copy())  # a view would hold the rows of all words without any likeness too
        for token, us in new.items():
            found = [p for u in us if (p := self.known[u]) >= 0]
            if len(found) > 1:  # a word and its start, or windows of one long word: the greatest of each
                self.rows.append(np.max([self.rows[p] for p in found], axis=0))
                found = [len(self.rows) - 1]
            self.place[token] = found[0] if found else -1
            self.held += len(token)

    def forget(self) -> None:
        """Keeps the newer half of the tokens, unless they are few and long."""
        kept = list(self.place.items())[len(self.place) // 2 :] if len(self.place) > MEMO else []
        rows, self.rows, self.place, self.known = self.rows, [], {}, {}
        for token, p in kept:
            self.place[token] = len(self.rows) if p >= 0 else -1
            if p >= 0:
                self.rows.append(rows[p])
        self.held = sum(map(len, self.place))

    def features(self, tokens: set[str]) -> np.ndarray:
        """Sums of likenesses over a text's different tokens, and its length."""
        out = np.zeros(len(self.model.landmarks) + 1)
        for t in tokens:
            p = self.place.get(t, -1)
            if p >= 0:
                out[:-1] += self.rows[p]
        out[-1] = len(tokens)
        return out

    def greatest(self, tokens: set[str]) -> np.ndarray:
        """The greatest likeness to each landmark among a text's tokens."""
        hit = [self.rows[p] for t in tokens if (p := self.place.get(t, -1)) >= 0]
        return np.max(hit, axis=0) if hit else np.zeros(len(self.model.landmarks), np.float32)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return mapped(x, self.model.root) @ self.model.weights[:-1] + self.model.weights[-1]

    def learned(self, texts: list[str | None]) -> list[np.ndarray]:
        """Features of texts, whose tokens are all held meanwhile."""
        tokens = [tokens_of(t.lower()) if t else set() for t in texts]
        self.learn(set().union(*tokens))
        return [self.features(t) for t in tokens]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text; null and empty texts as those without any likeness."""
        x = np.zeros((len(texts), len(self.model.landmarks) + 1))
        for at in range(0, len(texts), PART):
            x[at : at + PART] = self.learned(texts[at : at + PART])
        z = np.clip(self.model.slope * self.margins(x) + self.model.offset, -30, 30)
        return 1 / (1 + np.exp(-z))


def mapped(x: np.ndarray, root: np.ndarray) -> np.ndarray:
    """What the SVM sees of features: the Nyström map of the bounded likenesses, and the logarithm of the length."""
    return np.hstack([np.minimum(x[:, :-1], MOST) @ root, np.log1p(x[:, -1:]) / 5])


def tokens_of(lower: str) -> set[str]:
    tokens = set(lower.split())
    if sum(len(t) == 1 for t in tokens) >= sk.ORDER:
        tokens.update("".join(run.split()) for run in sk.SPACED.findall(lower))
    return tokens


def bag(tokens: set[str]) -> set[str]:
    return {u for t in tokens for u in units_of(t)}


def choose_landmarks(tokens: list[set[str]], toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Units that set toxic texts apart, with the texts that have them, greedily: each the one that covers the greatest share of
    toxic texts (a text counts half as much each time that it has been covered) less CLEAN_WEIGHT times the share of clean ones."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return {}
    least = max(4, SHARE * n_toxic)
    often = {u for u, n in Counter(u for s, y in zip(tokens, toxic) if y for u in bag(s)).items() if n >= least}
    found: dict[str, list[int]] = {u: [] for u in often}
    for k, s in enumerate(tokens):  # only what is often toxic is kept of a text's units
        for u in bag(s) & often:
            found[u].append(k)
    able = {}
    for u, ks in found.items():
        at = np.array(ks)
        n = int(toxic[at].sum())
        if np.log((n + 0.5) / (n_toxic + 1)) - np.log((len(ks) - n + 0.5) / (n_clean + 1)) > ODDS:
            able[u] = at
    weight, out = np.where(toxic, 1 / n_toxic, -CLEAN_WEIGHT / n_clean), {}
    while able and len(out) < LANDMARKS:
        best = max(able, key=lambda u: (weight[able[u]].sum(), u))
        at = able.pop(best)
        if weight[at].sum() < SHARE / 2:
            break
        out[best] = at
        weight[at[toxic[at]]] /= 2
    return out


def strong(landmarks: dict[str, np.ndarray], toxic: np.ndarray) -> list[str]:
    """Landmarks that a toxic text is told by alone."""
    out = []
    for u, at in landmarks.items():
        share, other = toxic[at].sum() / toxic.sum(), ((~toxic[at]).sum() + 0.1) / max((~toxic).sum(), 1)
        if share >= COMMON and share / (share + other) >= PURE:
            out.append(u)
    return out


def best_cut(margin: np.ndarray, toxic: np.ndarray) -> float:
    """The margin that parts the classes best, a clean text counting four times; of equal ones the middle of the widest gap."""
    at = np.unique(margin)
    if len(at) < 2:
        return float(at[0]) + 1.0
    middle = (at[1:] + at[:-1]) / 2
    hit = np.array([(margin[toxic] > m).mean() - CLEAN_WEIGHT * (margin[~toxic] > m).mean() for m in middle])
    best = np.flatnonzero(hit >= hit.max() - 1e-9)
    return float(middle[best[int(np.argmax((at[1:] - at[:-1])[best]))]])


def variants(word: str) -> list[str]:
    """The word with a foreign character, a doubled one or one less at each inner place: what a disguised insult looks like."""
    inner = range(1, len(word))
    return [word[:i] + x + word[i:] for i in inner for x in ("x", word[i])] + [word[:i] + word[i + 1 :] for i in inner if len(word) > 5 and i < len(word) - 1]


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """A model from whole labelled texts; without both labels, or anything that sets them apart, one that calls nothing toxic."""
    same: dict[str, str] = {}  # one string for each token, however many texts have it
    tokens = [{same.setdefault(x, x) for x in tokens_of(t.lower())} if t else set() for t in texts]
    found = choose_landmarks(tokens, toxic)
    model = Model(list(found))
    if not found:
        return Model([])
    told = strong(found, toxic)
    model.root = sk.inverse_root(sk.similarity(model.landmarks, model.landmarks))
    model.floors = np.full(len(model.landmarks), FLOORS[0], np.float32)
    scorer = Scorer(model)
    scorer.learn(set().union(*tokens))
    stray = np.array([scorer.greatest(s) for s, y in zip(tokens, toxic) if not y])
    for k, u in enumerate(model.landmarks):
        able = [f for f in FLOORS if (stray[:, k] >= f).mean() <= STRAY]
        model.floors[k] = min(able, default=FLOORS[-1]) if u in told else LIKE
    for row in scorer.rows:
        row[row < model.floors] = 0
    x = np.array([scorer.features(s) for s in tokens])
    # each strong landmark in disguise, as the only sign of a text of middling length, is toxic too
    alone = sk.similarity(sorted({v for u in told for v in variants(u)}), model.landmarks)
    alone[alone < model.floors] = 0
    alone = np.hstack([alone[alone.any(1)], np.full((int(alone.any(1).sum()), 1), float(np.median(x[:, -1])))])

    def fitted(rows: np.ndarray, cost: float) -> np.ndarray:
        z = mapped(np.vstack([x[rows]] + [alone] * ALONE), model.root)
        return sk.train_svm(z, np.concatenate([np.where(toxic[rows], 1.0, -1.0), np.ones(len(alone) * ALONE)]), cost)

    fold = np.arange(len(texts)) % FOLDS
    tried = []
    for cost in COSTS:  # margins of texts that the weights have not seen
        margin = np.zeros(len(texts))
        for k in range(FOLDS):
            rest = fold != k
            if toxic[rest].any() and not toxic[rest].all():
                w = fitted(rest, cost)
                margin[~rest] = mapped(x[~rest], model.root) @ w[:-1] + w[-1]
        cut = best_cut(margin, toxic)
        tried.append(((margin[toxic] > cut).mean() - CLEAN_WEIGHT * (margin[~toxic] > cut).mean(), -cost, cut, margin))
    _, cost, cut, margin = max(tried, key=lambda t: t[:2])
    model.weights = fitted(np.ones(len(texts), bool), -cost)
    model.slope = max(sk.platt(margin, toxic)[0], 2.0)
    model.offset = float(np.log(THRESHOLD / (1 - THRESHOLD))) - model.slope * cut
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id's labels are kept for measuring; a null id's are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """From labels.toxic of rows that are not held out, rows of each class at most. Null ids and labels count for nothing; of
    several labels of one id toxic wins. Texts come in order of a hash of their id until FIT_BYTES are reached."""
    own = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda t: own.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = part(1).union(part(0))
    # which rows are taken is settled on ids, hashes and sizes; only then do texts move, each once and FIT_BYTES of them at most
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    light = docs.select("doc_id", F.xxhash64("text").alias("h"), size).join(F.broadcast(chosen), "doc_id").filter(F.col("size") <= FIT_TEXT)  # 2 * rows ids at most: safe to broadcast
    first = light.orderBy(F.xxhash64("doc_id"), "h").limit(2 * rows).toPandas()
    first = first[first["size"].cumsum() - first["size"] < FIT_BYTES]
    chosen_keys = first[["doc_id", "h"]].drop_duplicates()
    schema = StructType([docs.schema["doc_id"], StructField("h", LongType())])
    keys = local_table(docs.sparkSession, {c: chosen_keys[c].tolist() for c in schema.names}, schema) if len(first) else light.select("doc_id", "h").limit(0)
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(keys), ["doc_id", "h"])
    texts = {(r.doc_id, r.h): r.text for r in found.groupBy("doc_id", "h").agg(F.first("text").alias("text")).collect()}
    return train([texts[k] for k in zip(first["doc_id"].tolist(), first["h"].tolist())], (first["toxic"] == 1).to_numpy())


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1. A column named as out is replaced."""
    small_batches(docs.sparkSession)
    key = uuid.uuid4().hex  # a worker keeps what it knows of tokens for all tasks of this call

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held(("toxicity", key), lambda: Scorer(model)).scores(texts.tolist()))

    return docs.withColumn(out, F.pandas_udf(score, DoubleType())(text_col))


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, columns unchanged."""
    scored = with_score(docs.select(*docs.columns, F.lit(0.0).alias("__score")), fit(docs, labels), out="__score")
    return scored.filter(F.col("__score") < THRESHOLD).select(*docs.columns)


def op1_string_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = with_score(docs, fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
