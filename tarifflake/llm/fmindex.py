"""A bidirectional FM-index over a delimited vocabulary, and the search with one error.

The words stand in order between delimiters; suffixes are ranked by prefix doubling over the text and over its reverse.
A pattern is a pair of rank intervals, one for each direction, kept in step, so that it can grow to the left and to the
right. Many patterns grow at once, as arrays. The delimiter is the least symbol, so the rank of a suffix that starts at a
delimiter is the place of its word.
"""

from __future__ import annotations

import numpy as np

#: Cells of a table of counts; a longer text keeps counts for some places only.
CELLS = 16_000_000


def _ranked(text: np.ndarray) -> np.ndarray:
    """The start places of all rotations, in their order."""
    n, rank, step = len(text), text.astype(np.int64), 1
    while True:
        code = rank * (n + 1) + np.roll(rank, -step)
        order = np.argsort(code, kind="stable")
        ranks = np.cumsum(np.append(False, code[order][1:] != code[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        if ranks[-1] == n - 1 or step >= n:
            return order
        step *= 2


class _Side:
    """Growth to one side: for each rank, how many of the symbols before the suffixes of smaller rank are less than c."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        self.symbols, self.step = symbols, max(1, -(-n * (symbols + 1) // CELLS))
        self.before = text[(_ranked(text) - 1) % n].astype(np.int32)
        counts = np.zeros((n // self.step + 2, symbols + 1), np.int32)
        np.add.at(counts, (np.arange(n) // self.step + 1, self.before + 1), 1)
        self.less = np.cumsum(np.cumsum(counts, 0, dtype=np.int32), 1, dtype=np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def rows(self, at: np.ndarray) -> np.ndarray:
        """For each rank and c: the symbols less than c before the suffixes of smaller rank."""
        out = self.less[at // self.step]
        for k in range(self.step - 1):
            place = at // self.step * self.step + k
            some = np.flatnonzero(place < at)
            if len(some):
                out[some] += np.arange(self.symbols + 1) > self.before[place[some]][:, None]
        return out


class FMIndex:
    """Over distinct words, which must be in the order of their code points."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        letters = np.unique(text)
        self.words, self.letters = words, letters
        coded = np.searchsorted(letters, text)
        self.size = len(coded)
        self.sides = (_Side(coded, len(letters)), _Side(coded[::-1].copy(), len(letters)))

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words one after the other, where each starts and ends)."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return np.searchsorted(self.letters, text), np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def grow(self, low: np.ndarray, other: np.ndarray, size: np.ndarray, symbol: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (start on this side, start on the other, size) after one symbol more on this side."""
        s, i = self.sides[side], np.arange(len(low))
        a, b = s.rows(low), s.rows(low + size)
        smaller = (b - a)[i, symbol]
        return s.starts[symbol] + (a[i, symbol + 1] - a[i, symbol]), other + smaller, (b - a)[i, symbol + 1] - smaller

    def children(self, low: np.ndarray, other: np.ndarray, size: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ways to grow by a letter: (which pattern, symbol, start on this side, start on the other, size)."""
        s = self.sides[side]
        a, b = s.rows(low), s.rows(low + size)
        smaller = b - a
        n = smaller[:, 1:] - smaller[:, :-1]
        n[:, 0] = 0  # no delimiter inside a word
        which, symbol = np.nonzero(n)
        return which, symbol, s.starts[symbol] + a[which, symbol + 1] - a[which, symbol], other[which] + smaller[which, symbol], n[which, symbol]

    def one_error(self, words: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, found): words that differ from a query in one inserted, deleted or replaced letter (or, at times, in
        none) and share one half of it exactly: the first half if ``left``, else the rest. The half is matched from the
        middle to the word's end; then the pattern grows over the other half."""
        symbols, bounds = self.codes(words)
        start, stop = bounds[:-1], bounds[1:]
        middle = start + (stop - start) // 2
        inner, outer = (0, 1) if left else (1, 0)  # the side to which the exact half, and then the other, is read
        n = len(words)
        query = np.arange(n)
        state = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64))
        at = middle - 1 if left else middle.copy()
        while True:  # the exact half
            here = np.flatnonzero((at >= start[query]) if left else (at < stop[query]))
            if not len(here):
                break
            grown = self.grow(*[x[here] for x in state], symbols[at[here]], inner)
            for x, y in zip(state, grown):
                x[here] = y
            at[here] += -1 if left else 1
            alive = state[2] > 0
            query, at, state = query[alive], at[alive], tuple(x[alive] for x in state)
        low, other, size = self.grow(*state, np.zeros(len(query), np.int64), inner)
        alive = size > 0
        query, state = query[alive], (other[alive], low[alive], size[alive])  # from here on the outer side leads
        # the other half: patterns without an error, all at the same distance from the middle, and those with one
        step = 1 if left else -1
        at = middle[query] if left else middle[query] - 1
        w_query, w_at, w_state = np.zeros(0, np.int64), np.zeros(0, np.int64), tuple(np.zeros(0, np.int64) for _ in range(3))
        out_q, out_w = [], []

        def ended(q, p):
            return (p >= stop[q]) if left else (p < start[q])

        while len(query) or len(w_query):
            new_q, new_at, new_state = [], [], ([], [], [])
            if len(query):
                over = ended(query, at)
                which, symbol, lo, ot, sz = self.children(*state, outer)
                q, p = query[which], at[which]
                mine = np.where(over[which], -1, symbols[np.minimum(p, len(symbols) - 1)])
                for keep, shift in (((~over[which]) & (symbol != mine), step), (np.ones(len(which), bool), 0)):  # replaced; inserted
                    new_q.append(q[keep])
                    new_at.append(p[keep] + shift)
                    for have, x in zip(new_state, (lo, ot, sz)):
                        have.append(x[keep])
                new_q.append(query[~over])  # deleted
                new_at.append(at[~over] + step)
                for have, x in zip(new_state, state):
                    have.append(x[~over])
                straight = (~over[which]) & (symbol == mine)
                query, at, state = q[straight], p[straight] + step, (lo[straight], ot[straight], sz[straight])
            if len(w_query):  # with the error behind them: to the end of the word, exactly
                over = ended(w_query, w_at)
                symbol = np.where(over, 0, symbols[np.minimum(np.maximum(w_at, 0), len(symbols) - 1)])
                lo, ot, sz = self.grow(*w_state, symbol, outer)
                done = over & (sz > 0)
                out_q.append(w_query[done])
                out_w.append((ot if left else lo)[done] - 1)  # the rank on the left side is the place of the word
                on = ~over & (sz > 0)
                new_q.append(w_query[on])
                new_at.append(w_at[on] + step)
                for have, x in zip(new_state, (lo, ot, sz)):
                    have.append(x[on])
            w_query, w_at = np.concatenate(new_q), np.concatenate(new_at)
            w_state = tuple(np.concatenate(x) for x in new_state)
        if not out_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(out_q), np.concatenate(out_w)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]
