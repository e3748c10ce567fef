"""Signatures of weighted shingles: ProbMinHash.

An element of weight w sends arrivals of a Poisson process of rate w to random registers of a signature; a register
keeps the element of its earliest arrival. Two signatures agree in a register with the probability Jaccard similarity of
the weighted sets. An element stops as soon as its next arrival is later than all registers' (early termination), so a
text needs about m log m arrivals plus one per element. Texts are worked on many at a time with numpy.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, sizes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts given as word hashes one after the other: (text, hash, count), sorted by text and hash.
    A text of fewer words than ``width`` has one shingle of all its words."""
    words = words.view(np.uint64) if words.dtype == np.int64 else words
    n, starts = len(words), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    power = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(width)]
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h[: max(0, n - k)] += words[k:] * power[k]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # words from here to the end of the text
    whole = left >= width
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    for i in short.tolist():
        a = starts[i]
        h[a] = sum((int(w) * int(power[k]) for k, w in enumerate(words[a : a + sizes[i]].tolist())), int(sizes[i])) & (2**64 - 1)
    whole[starts[short]] = True
    h, owner = mix(h[whole]), owner[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def weights(count: np.ndarray) -> np.ndarray:
    """The count: a shingle weighs as often as it stands in the text."""
    return count.astype(float)


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """(texts, m) elements; a text without shingles has zeros."""
    time = np.full(texts * m, np.inf)
    kept = np.zeros(texts * m, np.uint64)
    active, now, step, block = np.arange(len(h)), np.zeros(len(h)), 0, 1
    while len(active):
        i = np.arange(step, step + block, dtype=np.uint64)
        draw = mix(h[active][:, None] + (i + np.uint64(1)) * _C1)
        gap = -np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53)
        t = now[active][:, None] + np.cumsum(gap, 1) / weight[active][:, None]
        slot = (owner[active][:, None] * m + (mix(draw ^ _C3) % np.uint64(m)).astype(np.int64)).ravel()
        flat, element = t.ravel(), np.repeat(h[active], block)
        if block > 1:  # later arrivals of a block may already be too late
            some = flat < time[slot]
            slot, flat, element = slot[some], flat[some], element[some]
        np.minimum.at(time, slot, flat)
        won = time[slot] == flat
        kept[slot[won]] = element[won]
        now[active] = t[:, -1]
        latest = time.reshape(texts, m).max(1)
        active = active[now[active] < latest[owner[active]]]
        step, block = step + block, min(2 * block, 256)
    return kept.reshape(texts, m)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of ``rows`` registers, different from band to band."""
    texts, m = signature.shape
    parts = signature.reshape(texts, m // rows, rows)
    out = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * _C1, parts.shape[:2]).copy()
    for k in range(rows):
        out = mix(out ^ parts[:, :, k]) + _C2
    return out


def probability_jaccard(a: np.ndarray, a_weight: np.ndarray, b: np.ndarray, b_weight: np.ndarray) -> float:
    """The sum over common elements of 1 / sum_j max(a_j / a_i, b_j / b_i), for sorted distinct elements with weights."""
    common, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if len(a) == len(b) == len(common) and np.array_equal(a_weight, b_weight):
        return 1.0
    x, y = a_weight[at], b_weight[bt]
    only_a, only_b = a_weight.sum() - x.sum(), b_weight.sum() - y.sum()
    # with r_i = a_i / b_i, element j counts a_j / a_i where r_j >= r_i and b_j / b_i elsewhere
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    upper = np.cumsum(x[::-1])[::-1]
    lower = np.concatenate([[0.0], np.cumsum(y)[:-1]])
    return float((1 / ((upper + only_a) / x + (lower + only_b) / y)).sum())
