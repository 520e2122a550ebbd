"""Gap-weighted subsequence kernel, Nyström features and a linear SVM; NumPy only, no Spark."""

from __future__ import annotations

import re

import numpy as np

#: Length of subsequences, and what each character that they span, gaps included, multiplies their weight by.
ORDER, DECAY = 3, 0.6
#: Longer units are cut into windows of this many characters that overlap by half.
WIDEST = 32
#: Characters that stand for letters inside a word.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
#: Places of hashed character pairs; a word and a landmark with fewer in common than COMMON aren't alike.
PAIRS, COMMON, SHORT = 512, 3, 8
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
#: Three or more characters that stand alone.
SPACED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")


def units(token: str) -> list[str]:
    """What a token of lower-case text is compared as: without marks at its ends or inside, lookalikes as letters."""
    word = token if token.isalpha() else _INNER.sub("", _EDGES.sub("", token).translate(LOOKALIKES))
    if len(word) < ORDER:
        return []
    if len(word) <= WIDEST:
        return [word]
    return [word[i : i + WIDEST] for i in range(0, len(word) - WIDEST // 2, WIDEST // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """(n, widest) code points, 0 after a word's end."""
    wide = max(map(len, words))
    return np.array(words, f"<U{wide}").view(np.int32).reshape(len(words), wide)


def raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n,): for pairs of codes a[k], b[k], the sum over common subsequences of DECAY ** (both spans)."""
    n, wide = b.shape
    total = np.zeros(n, np.float32)
    prime = np.zeros((ORDER - 1, wide + 1, n), np.float32)  # of subsequences of 1, 2 .. characters
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for at in range(len(a)):
        same = (b == a[at]) * square
        total += (same[ORDER - 1 :] * prime[-1, ORDER - 1 : wide]).sum(0)
        prime *= decay
        for i in range(ORDER - 2, -1, -1):
            # prime[i - 1] has been multiplied by the decay already; undo it where it is read
            step = same * (prime[i - 1, :wide] / decay) if i else same
            run = step[0].copy()
            prime[i, 1] += run
            for j in range(1, wide):
                run *= decay
                run += step[j]
                prime[i, j + 1] += run
    return total


def skip_pairs(codes: np.ndarray) -> np.ndarray:
    """(n, PAIRS) 0 or 1: pairs of characters up to two apart, hashed to PAIRS places."""
    out = np.zeros((len(codes), PAIRS), np.float32)
    rows = np.arange(len(codes))
    for gap in range(1, 4):
        for i in range(codes.shape[1] - gap):
            there = np.flatnonzero(codes[:, i + gap])
            out[rows[there], (codes[there, i] * 31 + codes[there, i + gap]) % PAIRS] = 1
    return out


def self_kernel(codes: np.ndarray) -> np.ndarray:
    return raw_kernel(codes, np.where(codes == 0, -1, codes))


def similarity(words: list[str], landmarks: list[str]) -> np.ndarray:
    """(n, m) normalised kernel of the pairs that share COMMON pairs of near characters at least; others have none."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    targets, lengths = _codes(landmarks), np.array([len(x) for x in landmarks])
    own, marks = self_kernel(targets), skip_pairs(targets)
    targets = np.where(targets == 0, -1, targets)
    order = np.argsort(np.array([len(w) for w in words]), kind="stable")
    for at in range(0, len(order), 2_000):
        block = order[at : at + 2_000]
        codes = _codes([words[k] for k in block])
        r, c = np.nonzero(skip_pairs(codes) @ marks.T >= COMMON)
        if not len(r):
            continue
        raw = np.zeros(len(r), np.float32)
        for short in (True, False):  # so that little of the landmarks is padding
            pick = np.nonzero((lengths[c] <= SHORT) == short)[0]
            if len(pick):
                raw[pick] = raw_kernel(codes[r[pick]], targets[c[pick], : lengths[c[pick]].max()])
        some = raw > 0
        r, c, raw = r[some], c[some], raw[some]
        near, back = np.unique(r, return_inverse=True)
        out[block[r], c] = raw / np.sqrt(np.maximum(self_kernel(codes[near])[back] * own[c], 1e-12))
    return out


def inverse_root(k: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(k.astype(np.float64) + 1e-6 * np.eye(len(k)))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss and equal class weights; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y) * cost
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w, active = np.zeros(x.shape[1]), np.ones(len(y), bool)
    for _ in range(50):  # Newton steps; each solves the least squares of the rows inside the margin
        xa = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) with smoothed targets; y is boolean."""
    pos, neg = y.sum(), (~y).sum()
    target = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-4 * w)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])
