"""Weighted acyclic automata over words: transducers from phrases to counts.

A transducer is read word by word. The arc of a phrase's last word carries the phrase's count; phrases of one and two
words lead on to longer ones. Built from sorted phrases, the states behind two words are complete one after the other;
a finished state is looked up in a register, and an equal one is used again, so the automaton is minimal there. It is
written as a few integer arrays and the sorted words of its own, for one range of prefixes at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

NONE = -1


@dataclass
class Phrases:
    """Distinct phrases as sorted rows: key (a number the caller gives a meaning), up to three words (``NONE`` where a
    phrase is shorter) and the count."""

    words: list[bytes]
    key: np.ndarray
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.count)


def summed(words: list[bytes], columns: list[np.ndarray], count: np.ndarray | None) -> Phrases:
    """Rows in order, equal phrases once with the sum of their counts (None: each row counts one)."""
    width = max(1, (len(words) + 1).bit_length())
    tall = int(columns[0].max()) + 1 if len(columns[0]) else 1
    if tall.bit_length() + 3 * width <= 63:  # all in one number
        code = columns[0].astype(np.int64)
        for c in columns[1:]:
            code <<= width
            code |= c + 1
        if count is None:
            code.sort()
            at = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
            total = np.diff(np.append(at, len(code)))
        else:
            order = np.argsort(code)
            code = code[order]
            at = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
            total = np.add.reduceat(count[order], at) if len(at) else count[:0]
        code, mask = code[at], (1 << width) - 1
        return Phrases(words, (code >> (3 * width)).astype(np.int32), *[((code >> (k * width)) & mask).astype(np.int32) - np.int32(1) for k in (2, 1, 0)], total)
    count = np.ones(len(columns[0]), np.int64) if count is None else count
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0) if len(order) > 1 else False
    at = np.flatnonzero(new)
    total = np.add.reduceat(count[order], at) if len(at) else count[:0]
    return Phrases(words, *[c[order][at].astype(np.int32) for c in columns], total)


def _register(ends: np.ndarray, last: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The states whose arcs are the rows between consecutive ``ends``: (state of each, then the arcs of the distinct
    states: offsets, words, counts). Equal states are one."""
    known: dict[bytes, int] = {}
    sizes = np.diff(ends)
    state = np.zeros(len(sizes), np.int32)
    alone = np.flatnonzero(sizes == 1)
    at = ends[:-1][alone]
    order = np.lexsort((weight[at], last[at]))
    x, y = last[at][order], weight[at][order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
    state[alone[order]] = np.cumsum(new) - 1
    pairs = np.stack([x[new], y[new]], 1).astype(np.int64)
    starts, stops = [], []
    rows = np.ascontiguousarray(np.stack([last.astype(np.int64), weight], 1))
    for i in np.flatnonzero(sizes > 1).tolist():
        arcs = rows[ends[i] : ends[i + 1]].tobytes()
        found = known.setdefault(arcs, len(known))
        if found == len(starts):
            starts.append(ends[i])
            stops.append(ends[i + 1])
        state[i] = len(pairs) + found
    lengths = np.subtract(stops, starts).astype(np.int64) if starts else np.zeros(0, np.int64)
    offsets = np.concatenate([np.arange(len(pairs) + 1), len(pairs) + np.cumsum(lengths)]).astype(np.int32)
    inner = np.concatenate([np.arange(a, b) for a, b in zip(starts, stops)]) if starts else np.zeros(0, np.int64)
    return state, offsets, np.concatenate([pairs[:, 0], last[inner]]).astype(np.int32), np.concatenate([pairs[:, 1], weight[inner]])


def _small(a: np.ndarray) -> pa.Array:
    """The narrowest whole numbers that hold the values."""
    top = int(a.max()) if len(a) else 0
    low = int(a.min()) if len(a) else 0
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and top <= np.iinfo(k).max)
    return pa.array(a.astype(kind))


def build(p: Phrases, keys: list[str]) -> bytes:
    """The transducer of sorted phrases; their key is a place in ``keys``. Each phrase of three words follows (or stands
    without) its first two."""
    long = p.third != NONE
    head = np.flatnonzero(~long)  # phrases of one or two words
    body = np.flatnonzero(long)
    new = np.zeros(len(body), bool)
    new[:1] = True
    for c in (p.key[body], p.first[body], p.second[body]):
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    state, offsets, last, weight = _register(np.append(at, len(body)), p.third[body], p.count[body])
    # a prefix row: key, first word, second word, its own count (0: it is only passed through), the state behind it
    key, first, second = (np.concatenate([c[head], c[body][at]]) for c in (p.key, p.first, p.second))
    own, behind = np.concatenate([p.count[head], np.zeros(len(at), np.int64)]), np.concatenate([np.full(len(head), NONE), state])
    named = np.concatenate([first, second, last])
    seen = np.zeros(len(p.words) + 1, bool)
    seen[named] = True  # NONE marks the last place
    used = np.flatnonzero(seen[:-1])
    number = np.full(len(seen), NONE, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    local = number[named]
    a, b = len(first), len(first) + len(second)
    parts = {
        "words": pa.array([p.words[i] for i in used.tolist()], pa.binary()), "key": _small(key), "first": _small(local[:a]), "second": _small(local[a:b]), "own": _small(own),
        "behind": _small(behind), "offsets": _small(offsets), "last": _small(local[b:]), "weight": _small(weight), "keys": pa.array(keys, pa.string()),
    }
    row = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in parts.values()], list(parts))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def read(data: bytes) -> tuple[list[bytes], list[str], list[np.ndarray], np.ndarray]:
    """All phrases of a transducer: (words, keys, [key, first, second, third], counts)."""
    row = next(iter(pa.ipc.open_stream(data)))
    words, keys = row.column(0).values.to_pylist(), row.column(9).values.to_pylist()
    key, first, second, own, behind, offsets, last, weight = (row.column(i).values.to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 9))
    counted, led = np.flatnonzero(own > 0), np.flatnonzero(behind != NONE)
    sizes = np.diff(offsets)[behind[led]]
    arcs = np.repeat(offsets[:-1][behind[led]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(led) else np.zeros(0, np.int64)
    back = np.repeat(led, sizes)
    columns = [np.concatenate([c[counted], c[back]]) for c in (key, first, second)]
    return words, keys, [*columns, np.concatenate([np.full(len(counted), NONE), last[arcs]])], np.concatenate([own[counted], weight[arcs]])


class Union:
    """The union of transducers with summed counts, read one after the other. Memory follows the distinct phrases."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.ids, self.keys, self.rows, self.waiting = most, {}, {}, [], 0

    def add(self, data: bytes) -> None:
        words, keys, columns, count = read(data)
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = len(ids)
        to = np.array([*map(ids.__getitem__, words), NONE], np.int32)
        of = np.array([self.keys.setdefault(k, len(self.keys)) for k in keys], np.int32)
        self.rows.append(([of[columns[0]], *[to[c] for c in columns[1:]]], count))
        self.waiting += len(count)
        if self.waiting > self.most:
            done = self.phrases()
            self.rows = [([done.key, done.first, done.second, done.third], done.count)]
            self.waiting, self.most = 0, max(self.most, len(done))

    def phrases(self) -> Phrases:
        words = list(self.ids)
        if not self.rows:
            return Phrases(words, *[np.zeros(0, np.int64)] * 5)
        columns = [np.concatenate([r[0][i] for r in self.rows]) for i in range(4)]
        return summed(words, columns, np.concatenate([r[1] for r in self.rows]))


class Lookup:
    """A transducer of phrases of one or two words, to be composed with the parts that are asked for."""

    def __init__(self, first: list[str], second: list[str | None], count: list[int]):
        self.states: dict[str, dict[str | None, int]] = {}
        for a, b, n in zip(first, second, count):
            self.states.setdefault(a, {})[b] = n

    def compose(self, first: list[str], second: list[str | None]) -> list[int | None]:
        """The counts of the parts, read along the arcs of both."""
        none: dict[str | None, int] = {}
        return [self.states.get(a, none).get(b) for a, b in zip(first, second)]
