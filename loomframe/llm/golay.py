"""Fingerprints and Golay keys of one batch; NumPy only, no Spark."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

#: Fixed values of the perfect binary Golay code: length, message bits, generator x^11+x^10+x^6+x^5+x^4+x^2+1.
LENGTH, MESSAGE, GENERATOR = 23, 12, 0xC75
#: The fingerprint's segments: shift and width. Narrower than 23 bits means padded with zeros.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without a word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    seen = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((seen * 2 > n).ravel(), bitorder="little").view(np.uint64)[0])


def _syndromes(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        v ^= ((v >> bit) & 1) * (GENERATOR << (bit - 11))
    return v


def _errors() -> np.ndarray:
    """The error pattern of at most three bits for each of the 2048 syndromes."""
    one = 1 << np.arange(LENGTH, dtype=np.int64)
    i, j = np.triu_indices(LENGTH, 1)
    two = one[i] | one[j]
    three = np.unique((two[:, None] | one[None, :]).ravel())
    three = three[np.bitwise_count(three) == 3]
    patterns = np.concatenate([[0], one, two, three])
    table = np.empty(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


_ERRORS = _errors()
#: Each row flips one bit, the first none.
_FLIPS = np.concatenate([[0], 1 << np.arange(LENGTH, dtype=np.int64)])


def decode(v: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the one codeword within three bits of each 23-bit word."""
    return (v ^ _ERRORS[_syndromes(v)]) >> 11


def nearby(v: np.ndarray) -> np.ndarray:
    """(n, 24): indices that the word itself and its 23 neighbours decode to. Two words with two differing bits have a
    common neighbour, so they share an index."""
    return decode(v[:, None] ^ _FLIPS[None, :])


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    shift, width = SEGMENTS[k]
    return ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)


def few_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of six keys each: an exact segment with the own index of one of the others. They meet most near copies, not all."""
    seg = [_segment(fp, k) for k in range(3)]
    own = [decode(s) for s in seg]
    pairs = [(exact, other) for exact in range(3) for other in range(3) if other != exact]
    out = [(kind << 56) | (seg[exact] << 12) | own[other] for kind, (exact, other) in enumerate(pairs)]
    return np.tile(np.arange(len(fp)), len(pairs)), np.concatenate(out)


def _once(sets: np.ndarray) -> list[np.ndarray]:
    """(n, m) indices -> masks of first occurrences, as (sorted values, mask)."""
    s = np.sort(sets, axis=1)
    keep = np.ones(s.shape, bool)
    keep[:, 1:] = s[:, 1:] != s[:, :-1]
    return [s, keep]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints; any two fingerprints with at most four differing bits share one.

    Four errors over three segments fall in one of two ways. (a) One segment has none; of the other two one has at most
    two: the exact segment with a nearby codeword index of that other one. (b) Two segments have one error each, the third
    at most two: indices of the two, and one of the third's three pieces, exact. For one error, the word of even weight
    gives the indices of its neighbours and the word of odd weight its own index, as neighbours differ in parity.
    """
    rows, out = [], []
    seg = [_segment(fp, k) for k in range(3)]
    near = [nearby(s) for s in seg]
    wide = [_once(x) for x in near]
    one = []
    for s, x in zip(seg, near):
        odd = (np.bitwise_count(s) & 1).astype(bool)
        one.append(_once(np.where(odd[:, None], x[:, :1], x)))
    kind = 0
    for exact in range(3):
        for other in range(3):
            if other != exact:
                values, keep = wide[other]
                r, c = np.nonzero(keep)
                rows.append(r)
                out.append((kind << 56) | (seg[exact][r] << 12) | values[r, c])
                kind += 1
    for a, b, rest in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        (va, ka), (vb, kb) = one[a], one[b]
        # pairs of kept indices of the same row
        ra, ca = np.nonzero(ka)
        nb = kb.sum(1)
        rb, cb = np.nonzero(kb)
        first = np.concatenate([[0], np.cumsum(nb)[:-1]])
        times = nb[ra]
        at = np.repeat(np.arange(len(ra)), times)
        within = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        r = ra[at]
        pair = (va[r, ca[at]] << 12) | vb[r, cb[first[r] + within]]
        width = SEGMENTS[rest][1]
        cuts = [0, (width + 2) // 3, 2 * ((width + 2) // 3), width]
        for p in range(3):
            piece = (seg[rest] >> cuts[p]) & ((1 << (cuts[p + 1] - cuts[p])) - 1)
            rows.append(r)
            out.append((kind << 56) | (pair << 8) | piece[r])
            kind += 1
    return np.concatenate(rows), np.concatenate(out)


def one_error_keys(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for (n, m) pairs of 23-bit segments; rows whose k-th pairs differ in one bit at most share a key: one segment is
    exact, and the other's index is among the neighbours' of one of the two words and the own of the other (as above)."""
    rows, out = [], []
    for k in range(left.shape[1]):
        for kind, (exact, other) in enumerate(((left[:, k], right[:, k]), (right[:, k], left[:, k]))):
            near = nearby(other)
            odd = (np.bitwise_count(other) & 1).astype(bool)
            values, keep = _once(np.where(odd[:, None], near[:, :1], near))
            r, c = np.nonzero(keep)
            rows.append(r)
            out.append(((2 * k + kind) << 56) | (exact[r] << 12) | values[r, c])
    return np.concatenate(rows), np.concatenate(out)
