"""The ledger of rate keys of moderate size, key by key.

Lines are moved once, to where the others of their key are, and come there in the order of approval. A line finds the live
rows of its key, is same, or takes its days from them; that is all there is to a ledger. What the rules look at follows
``ownership``, which has the same ledger as relations for keys of any size.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ledger import TERMS

NEEDED = ["rate_key", "document_id", "approval_seq", "line_no", "valid_from", "valid_to", "season", *TERMS]
_EPOCH = dt.date(1970, 1, 1).toordinal()


@lru_cache(maxsize=100_000)
def _a_year_on(day: int) -> int:
    d = dt.date.fromordinal(day + _EPOCH)
    return d.replace(year=d.year + 1, day=28 if (d.month, d.day) == (2, 29) else d.day).toordinal() - _EPOCH


def _codes(*columns: pa.Array) -> np.ndarray:
    """Equal numbers for rows that are equal in all ``columns``; nulls are equal to each other."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        code = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        out = np.unique(out * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1].astype(np.int64)
    return out


def _days(c: pa.Array) -> np.ndarray:
    return c.cast(pa.int32()).to_numpy(zero_copy_only=False)


def _earlier(i: int, f: int, t: int, rows: list, past: dict, seq: list, season: list) -> tuple[int, int]:
    """(rule, line) of the row that line ``i`` is compared with if it meets no live row of another sheet: one that was
    closed on shared dates, the last of the same season that ended before, or one on its dates a year before."""
    best, own = None, season[i]
    for (rf, rt, _), ri in [*past.items(), *(((r[0], r[1], 0), r[2]) for r in rows if seq[r[2]] != seq[i])]:
        if (shared := min(t, rt) - max(f, rf)) >= 0:
            score = (3, shared, ri)
        elif rt >= f:
            continue
        elif own and season[ri] == own:
            score = (2, rt, ri)
        elif (again := min(t, _a_year_on(rt)) - max(f, _a_year_on(rf))) >= 0:
            score = (1, again, ri)
        else:
            continue
        if best is None or score > best:
            best = score
    return (0, -1) if best is None else (best[0], best[2])


class Sweep:
    """What the lines of a table, which has whole keys one after the other, each in order, do to the ledger.

    ``did``: of each line 0 (repeats one of its sheet), 1 (same) or 2 (writes); ``rule`` and ``prev``: what it is compared
    with, and by which rule; ``rows``: line, first day, last day and the line that closed it (-1: live)."""

    def __init__(self, table: pa.Table, starts: np.ndarray) -> None:
        n = table.num_rows
        col = {c: table.column(c).combine_chunks() for c in NEEDED}
        first, last = _days(col["valid_from"]), _days(col["valid_to"])
        ends = np.append(starts[1:], n)
        alone = starts[ends - starts == 1]
        self.did = np.full(n, 2, dtype=np.int8)
        self.rule = np.zeros(n, dtype=np.int32)
        self.prev = np.full(n, -1, dtype=np.int64)
        self.terms = _codes(*[col[c] for c in TERMS])
        seq, season = col["approval_seq"].to_pylist(), col["season"].to_pylist()
        sheet = _codes(col["document_id"], col["currency"]).tolist()
        amount = pc.fill_null(col["amount"].dictionary_encode().indices, -1).to_pylist()
        found: list[tuple[int, int, int, int]] = []
        several = ends - starts > 1
        for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            self._key(s, e, first[s:e].tolist(), last[s:e].tolist(), self.terms[s:e].tolist(), seq[s:e], season[s:e], sheet[s:e], amount[s:e], found)
        rows = np.array(found, dtype=np.int64).reshape(-1, 4)
        lone = np.stack([alone, first[alone], last[alone], np.full(len(alone), -1)], axis=1).astype(np.int64)
        rows = np.concatenate([lone, rows])
        self.rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def _key(self, at: int, end: int, first: list, last: list, terms: list, seq: list, season: list, sheet: list, amount: list, found: list) -> None:
        live: list[list[int]] = []
        past: dict[tuple, int] = {}  # closed rows: of those with the same dates and season the last line counts
        kept: list[int] = []
        for i in range(end - at):
            f, t, q, same = first[i], last[i], seq[i], terms[i]
            if i and seq[i - 1] == q:
                if amount[i] >= 0 and any(amount[o] == amount[i] and sheet[o] == sheet[i] and first[o] <= t and f <= last[o] for o in kept):
                    self.did[at + i] = 0
                    continue
                kept.append(i)
            else:
                kept = [i]
            over = [r for r in live if r[0] <= t and f <= r[1] and seq[r[2]] != q]
            if over:
                if any(r[0] <= f and t <= r[1] and terms[r[2]] == same for r in over):
                    self.did[at + i] = 1
                    continue
                rule, prev = 3, max((min(t, r[1]) - max(f, r[0]), r[2]) for r in over)[1]
                for r in over:
                    rf, rt, ri = r
                    if rf < f:
                        r[1] = f - 1
                        if rt > t:
                            live.append([t + 1, rt, ri])
                    elif rt > t:
                        r[0] = t + 1
                    else:
                        found.append((at + ri, rf, rt, at + i))
                        dates = (rf, rt, season[ri])
                        past[dates] = max(ri, past.get(dates, -1))
                        r[2] = -1
                if past:
                    live = [r for r in live if r[2] >= 0]
            elif i:
                rule, prev = _earlier(i, f, t, live, past, seq, season)
            else:
                rule = 0
            live.append([f, t, i])
            if rule:
                self.rule[at + i], self.prev[at + i] = rule, at + prev
        found.extend((at + r[2], r[0], r[1], -1) for r in live)


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows in tables that end where a key ends, with the places where keys begin."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("rate_key")
        new = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
        if rest and rest[-1].column("rate_key")[-1] != key[0]:
            new = np.concatenate([[0], new])
        if len(new):
            cut = int(new[-1])
            yield _table([*rest, b.slice(0, cut)])
            rest = [b.slice(cut)]
        else:
            rest.append(b)
    if rest:
        yield _table(rest)


def _table(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(parts).combine_chunks()
    key = t.column("rate_key").combine_chunks()
    starts = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
    return t, np.concatenate([[0], starts])


def _facts(t: pa.Table, at: np.ndarray, more: list[str]) -> tuple[dict, np.ndarray]:
    """(the columns of the lines ``at``, which of ``at`` each row is for). The columns ``more`` come from all lines that share
    a line's sheet and number."""
    which = np.arange(len(at))
    of = at
    if more:
        new = np.ones(t.num_rows, dtype=bool)
        same = np.ones(max(0, t.num_rows - 1), dtype=bool)
        for c in ("rate_key", "approval_seq", "line_no", "document_id"):
            x = t.column(c).combine_chunks()
            same &= pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        new[1:] = ~same
        first = np.flatnonzero(new)
        if len(first) < t.num_rows:
            size, group = np.diff(np.append(first, t.num_rows)), np.cumsum(new) - 1
            which = np.repeat(which, size[group[at]])
            inside = np.arange(len(which)) - np.repeat(np.cumsum(size[group[at]]) - size[group[at]], size[group[at]])
            of = first[group[at[which]]] + inside
    own = at[which]
    return {c: t.column(c).take(pa.array(of if c in more else own)) for c in t.column_names}, which


def _earlier_facts(t: pa.Table, s: Sweep, own: np.ndarray) -> dict:
    prev = pa.array(s.prev[own], mask=s.prev[own] < 0)
    alike = (s.prev[own] >= 0) & (s.terms[own] == s.terms[s.prev[own]])
    return {"rule": pa.array(s.rule[own]), "prev_document_id": t.column("document_id").take(prev), "prev_line_no": t.column("line_no").take(prev), "prev_amount": t.column("amount").take(prev), "same_terms": pa.array(alike)}


def _batches(columns: dict, names: list[str]) -> Iterator[pa.RecordBatch]:
    yield from pa.table({c: columns[c] for c in names}).to_batches(max_chunksize=20_000)


def _changes(more: list[str], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_keys(batches):
            s = Sweep(t, starts)
            at = np.flatnonzero(s.did > 0)
            facts, which = _facts(t, at, more)
            own = at[which]
            yield from _batches({**facts, **_earlier_facts(t, s, own), "same": pa.array(s.did[own] == 1)}, names)

    return run


def _rows(more: list[str], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_keys(batches):
            s = Sweep(t, starts)
            at, run_from, run_to, by = s.rows.T
            order = np.arange(len(at))
            new = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
            piece = order - np.maximum.accumulate(np.where(new, order, 0)) if len(at) else order
            facts, which = _facts(t, at, more)
            by = by[which]
            facts["valid_from"], facts["valid_to"] = (pa.array(x[which].astype(np.int32)).cast(pa.date32()) for x in (run_from, run_to))
            taker = t.column("document_id").take(pa.array(by, mask=by < 0))
            yield from _batches({**facts, **_earlier_facts(t, s, at[which]), "piece": pa.array(piece[which].astype(np.int32)), "live": pa.array(by < 0), "replaced_by": taker}, names)

    return run


def _live(names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_keys(batches):
            s = Sweep(t, starts)
            at, f, to, by = s.rows[s.rows[:, 3] < 0].T
            key, terms = np.searchsorted(starts, at, side="right"), s.terms[at]
            order = np.lexsort((to, f, terms, key))
            at, f, to, key, terms = (x[order] for x in (at, f, to, key, terms))
            apart = np.ones(len(at), dtype=bool)
            apart[1:] = (key[1:] != key[:-1]) | (terms[1:] != terms[:-1]) | (to[:-1] < f[1:] - 1)
            first = np.flatnonzero(apart)
            if not len(first):
                continue
            out = {c: t.column(c).take(pa.array(at[first])) for c in names}
            out["valid_from"] = pa.array(f[first].astype(np.int32)).cast(pa.date32())
            out["valid_to"] = pa.array(np.maximum.reduceat(to, first).astype(np.int32)).cast(pa.date32())
            yield from _batches(out, names)

    return run


def _in_order(lines: DataFrame, more: list[str]) -> DataFrame:
    """Lines where the others of their key are, in the order of approval."""
    near = lines.select(*NEEDED, *[c for c in more if c not in NEEDED]).repartition("rate_key")
    return near.sortWithinPartitions("rate_key", "approval_seq", "line_no", "document_id", "valid_from", "valid_to", "amount")


def _typed(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + [T.StructField(k, v) for k, v in more.items()])


def _earlier_types(df: DataFrame) -> dict:
    of = lambda c: df.schema[c].dataType
    return {"rule": T.IntegerType(), "prev_document_id": of("document_id"), "prev_line_no": of("line_no"), "prev_amount": of("amount"), "same_terms": T.BooleanType()}


def changes(lines: DataFrame, more: list[str]) -> DataFrame:
    """The lines that sheets bring in, with ``same``, ``rule`` (0: nothing earlier), ``prev_document_id``, ``prev_line_no``,
    ``prev_amount`` and ``same_terms`` of the line whose row they are compared with."""
    df = _in_order(lines, more)
    out = _typed(df, **_earlier_types(df), same=T.BooleanType())
    return df.mapInArrow(_changes(more, out.fieldNames()), out)


def rows(lines: DataFrame, more: list[str]) -> DataFrame:
    """The rows of the ledger: the facts of their line with their own dates, ``piece``, ``live`` and ``replaced_by``."""
    df = _in_order(lines, more)
    out = _typed(df, **_earlier_types(df), piece=T.IntegerType(), live=T.BooleanType(), replaced_by=df.schema["document_id"].dataType)
    return df.mapInArrow(_rows(more, out.fieldNames()), out)


def live(lines: DataFrame) -> DataFrame:
    """The live rows, neighbours with equal terms joined."""
    df = _in_order(lines, [])
    names = ["rate_key", *TERMS, "valid_from", "valid_to"]
    return df.mapInArrow(_live(names), T.StructType([T.StructField(c, df.schema[c].dataType) for c in names]))
