"""Suffix comparison by prefix hashes, and a mergesort of suffixes built on it.

A text's prefix hashes are sums of byte codes times powers of an odd base modulo 2^64, so the hash of any substring is
one subtraction and one product. The common extension of two suffixes is found by binary search over its length, and
the next byte decides their order: a comparison takes log(depth) steps. All comparisons of a merge step run together.
"""

from __future__ import annotations

import numpy as np

from .minhash import mix

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses, kept from call to call."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) <= n:
        base = int(mix(np.array([seed + 1], np.uint64))[0]) | 5
        size = max(n + 1, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = min(done, size - done)
                p[done : done + step] = p[:step] * np.uint64(pow(b, done, 2**64))
                done += step
            out.append(p)
        have = _POWERS[seed] = tuple(out)
    return have


def codes(seed: int) -> np.ndarray:
    """64-bit codes of the byte values."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Suffixes:
    """Byte strings one after the other, with their prefix hashes."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.data = data
        power, self.inverse = powers(seed, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes(seed)[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        """Hashes of the substrings of the given length (a number or one for each)."""
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]

    def every(self, length: int) -> np.ndarray:
        """Mixed hashes of all substrings of one length."""
        n = len(self.data) - length + 1
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Length of the common extension, up to ``depth`` (both suffixes are that long)."""
        lo, step = np.zeros(len(a), np.int64), 1 << (depth.bit_length() - 1)
        while step:
            to = lo + step
            some = np.flatnonzero(to <= depth)
            same = self.hashes(a[some], to[some]) == self.hashes(b[some], to[some])
            lo[some[same]] = to[some[same]]
            step >>= 1
        return lo

    def compare(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """-1, 0 or 1 for each pair."""
        k = self.common(a, b, depth)
        at = np.minimum(k, depth - 1)
        order = np.sign(self.data[a + at].astype(np.int64) - self.data[b + at].astype(np.int64))
        return np.where(k >= depth, 0, order)

    def sort(self, starts: np.ndarray, groups: np.ndarray, depth: int) -> np.ndarray:
        """``starts`` with the suffixes of each group (equal neighbours in ``groups``) in order: bottom-up mergesort. In
        a merge step each suffix finds its place in the neighbouring run by binary search."""
        order, n = starts.copy(), len(starts)
        if not n:
            return order
        heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        sizes = np.diff(np.append(heads, n))
        first = np.repeat(heads, sizes)
        last = first + np.repeat(sizes, sizes)
        place, width = np.arange(n), 1
        while width < sizes.max():
            run = (place - first) // width
            mine = first + run * width
            other = first + (run ^ 1) * width
            busy = np.flatnonzero(other < last)
            lo, hi = other[busy].copy(), np.minimum(other + width, last)[busy]
            left = (run[busy] & 1) == 0
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                c = self.compare(order[mid], order[busy[open_]], depth)
                before = np.where(left[open_], c < 0, c <= 0)
                lo[open_[before]] = mid[before] + 1
                hi[open_[~before]] = mid[~before]
            to = place.copy()
            to[busy] = np.minimum(mine, other)[busy] + (place - mine)[busy] + lo - other[busy]
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, 2 * width
        return order

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the bytes of each pair of substrings are the same: the check against collisions."""
        out = np.ones(len(a), bool)
        for lo in range(0, len(a), 20_000):
            x, y = a[lo : lo + 20_000, None] + np.arange(length), b[lo : lo + 20_000, None] + np.arange(length)
            out[lo : lo + 20_000] = (self.data[x] == self.data[y]).all(1)
        return out


def repeated(data: np.ndarray, starts: np.ndarray, keys: np.ndarray, depth: int, prefix: int, at_once: int = 1_000_000) -> np.ndarray:
    """Which of ``starts`` begin a string of ``depth`` bytes that also begins at another start with an equal key. Suffixes
    that share key and the hash of ``prefix`` bytes are sorted; neighbours with a common extension of ``depth`` count
    after their bytes are compared. Many starts are sorted in slices of that hash. If a hash collided, all is done again
    with another base."""
    for seed in range(1, 9):
        s = Suffixes(data, seed)
        group = mix(s.hashes(starts, prefix) ^ mix(keys))
        slices = 1 + len(starts) // at_once
        found, sound = np.zeros(len(data) + 1, bool), True
        for k in range(slices):
            own = np.flatnonzero(group % np.uint64(slices) == k) if slices > 1 else np.arange(len(starts))
            by_group = own[np.argsort(group[own], kind="stable")]
            ordered = group[by_group]
            same = np.concatenate([[False], ordered[1:] == ordered[:-1], [False]])
            by_group = by_group[same[1:] | same[:-1]]
            at, g = starts[by_group], group[by_group]
            at = s.sort(at, g, depth)
            pairs = np.flatnonzero(g[1:] == g[:-1])
            hit = pairs[s.common(at[pairs], at[pairs + 1], depth) >= depth]
            sound = sound and bool(s.equal(at[hit], at[hit + 1], depth).all())
            found[at[hit]] = True
            found[at[hit + 1]] = True
        if sound:
            return found[starts]
    raise RuntimeError("hashes collide for every base")
