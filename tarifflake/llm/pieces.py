"""SentencePiece encoding and decoding (merge type) by a table over prefixes.

For each prefix of a chunk of text the last token of its encoding is unique: among the pieces that end there (found by
an Aho-Corasick automaton) it is the one whose predecessor, the last token of the prefix before it, stays apart from it.
Whether two tokens stay apart is tested by undoing their merges from the latest to the earliest and asking at each step
whether the two parts that touch would have merged first. The ids are then read off the table backwards.

No piece has a space mark after another character, and line breaks are no pieces, so texts are cut there first; chunks
are remembered per worker in a table of bounded size. A chunk in which pieces of equal score can meet (runs of spaces)
is merged step by step instead. Texts are read whole, in Arrow batches without a shuffle.

Defined cases: null and empty texts give the begin and end id only; characters that are no piece become byte pieces;
rows are independent, so repeated ids do no harm; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class PieceEncoder:
    def __init__(self, path: str, limit: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.begin, self.end, self.limit = model.bos_id(), model.eos_id(), limit
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in plain)) or any("\n" in self.pieces[i] for i in plain):
            raise ValueError("pieces run across spaces or line breaks")
        self.ids = {self.pieces[i]: i for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = {i: model.get_score(i) for i in plain}
        levels = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {i: levels[s] for i, s in scores.items()}  # 0 merges first
        seen, self.tied = set(), set()
        for i in plain:
            if len(self.pieces[i]) > 1 and self.rank[i] in seen:
                self.tied.add(self.rank[i])
            seen.add(self.rank[i])
        self.tied_parts = {p[:2] for p, i in self.ids.items() if self.rank[i] in self.tied and len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.output = [b""] * n
        for i in plain:
            self.output[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.output[i] = bytes([b])
        self.known: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.made: dict[int, tuple] = {}

    def merged(self, symbols: list[str]) -> list[tuple[str, tuple | None]]:
        """Merges step by step, best score first, then leftmost; each symbol with its last merge (left, right, time)."""
        parts = [(s, None) for s in symbols]
        time = -1
        while True:
            best = min(((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k][0] + parts[k + 1][0])) is not None), default=None)
            if best is None:
                return parts
            r, k = best
            time = max(time, r)
            left, right = parts[k][0], parts[k + 1][0]
            parts[k : k + 2] = [(left + right, (left, right, time))]

    def origin(self, piece: str) -> tuple:
        """(left part, right part, time) of the piece's last merge; a character has none and stands from the start."""
        i = self.ids.get(piece, -1)
        if i not in self.made:
            parts = self.merged(list(piece))
            self.made[i] = parts[0][1] if len(piece) > 1 and len(parts) == 1 else ("", "", -1)
        return self.made[i]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of the joined pieces keeps the border between them."""
        left, right, limit, tie_loses = self.pieces[a], self.pieces[b], float("inf"), False
        while True:
            m = self.ids.get(left + right)
            if m is not None and (self.rank[m] < limit or tie_loses and self.rank[m] == limit):
                return False
            (_, a_rest, a_time), (b_rest, _, b_time) = self.origin(left), self.origin(right)
            if a_time < 0 and b_time < 0:
                return True
            if a_time > b_time:
                left, limit, tie_loses = a_rest, a_time, False
            else:  # of equal merges the left one comes first, so the right one is undone first
                right, limit, tie_loses = b_rest, b_time, True

    def chunk(self, text: str) -> list[int]:
        """Ids of one chunk by the prefix table."""
        if any(p in text for p in self.tied_parts):
            return [x for p, _ in self.merged(list(text)) for x in self.ids_of(p)]
        n, apart, width = len(text), self.apart, len(self.pieces)
        last: list[int | None] = [None] * (n + 1)  # -1: a character that is no piece
        size = [1] * (n + 1)
        done = 0  # prefixes up to here are settled
        for at, (i, length) in self.automaton.iter(text):
            end = at + 1
            while done < at:
                done += 1
                if last[done] is None:
                    last[done] = -1
            if last[end] is not None:
                continue
            before = last[end - length] if end > length else -1
            if before is not None and before >= 0:
                key = before * width + i
                ok = apart.get(key)
                if ok is None:
                    if len(apart) > 1_000_000:
                        apart.clear()
                    ok = apart[key] = self.stay_apart(before, i)
                if not ok:
                    continue
            last[end], size[end] = i, length
        out, end = [], n
        while end:
            i = last[end]
            out.append(i if i is not None and i >= 0 else text[end - 1])
            end -= size[end]
        return [x for i in reversed(out) for x in ((i,) if isinstance(i, int) else self.ids_of(i))]

    def ids_of(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        return [i] if i is not None else [self.bytes[b] for b in symbol.encode()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end id, as little-endian 32-bit integers."""
        cut = [CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = set().union(*cut)
        for c in new:
            self.known[c] = np.array(self.chunk(c), "<u4").tobytes()
        get, begin, end = self.known.__getitem__, np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        return [b"".join((begin, *map(get, chunks), end)) for chunks in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, the mark before the first word dropped, bytes read as UTF-8."""
        out = b"".join(map(self.output.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.removeprefix(b" ").decode("utf-8", "replace")


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encoded(docs: DataFrame, make: Callable[[], PieceEncoder]) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = enc.encode([t or "" for t in part.column("text").to_pylist()])
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_ids(docs: DataFrame, make: Callable[[], PieceEncoder]) -> DataFrame:
    """``docs`` with the text that its ids decode to (``text``), their number (``n_tokens``) and the ids (``ids``);
    columns of these names are replaced."""
    docs = docs.drop("n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = enc.encode([t or "" for t in part.column("text").to_pylist()])
                columns = [pa.array([enc.decode(x) for x in ids], pa.string()) if c == "text" else part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) // 4 for x in ids], pa.int64()), _lists(ids)], [*part.schema.names, "n_tokens", "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, n_tokens bigint, ids array<int>")
