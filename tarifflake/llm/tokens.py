"""Token ids in patched frame-of-reference files.

Documents are dealt to files by range of their id, so the files in order hold all ids in ascending document order. Each
task encodes its rows in batches (distinct words once) and writes one file: blocks of ``BLOCK`` ids, each as its minimum
and the differences packed at the width that holds a chosen share of them; larger differences keep their low bits in
place and their high bits, in whole bytes, in an exception list. The footer has the start of each block and the table of documents.
A file is named by its task attempt and counts only through the row its task returns, so a repeated task does no harm.

Defined cases: null and empty texts give only the end id; rows with equal ids follow each other by text; a null id comes
first; an empty table gives no files and no rows; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import filesystem, new_folder, order_key, partitions, saved

BLOCK = 512
#: Fixed value of the file format.
MAGIC = b"PFORIDS1"
HEAD = struct.Struct("<IHBBH")  # minimum, ids, width, width of high parts, exceptions
TAIL = struct.Struct("<QQQQ8s")  # places of block index and document table, blocks, documents


@lru_cache(maxsize=64)
def _places(n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` values of ``width`` bits on end: the 64-bit word where each starts, and by how far it must be moved left
    to stand there (negative: it goes on in the next word)."""
    bit = np.arange(n) * width
    return bit >> 6, 64 - width - (bit & 63)


def pack_rows(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, most significant first: a row of bytes for each row of values."""
    rows, n = values.shape
    word, left = _places(n, width)
    v = values.astype(np.uint64) & np.uint64((1 << width) - 1)
    out = np.zeros((rows, (n * width + 63) // 64), np.uint64)
    moved = np.where(left >= 0, v << np.maximum(left, 0).astype(np.uint64), v >> np.maximum(-left, 0).astype(np.uint64))
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[:, word[first]] = np.bitwise_or.reduceat(moved, first, axis=1)
    over = np.flatnonzero(left < 0)
    out[:, word[over] + 1] |= v[:, over] << (64 + left[over]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8)[:, : (n * width + 7) // 8]


def pack(values: np.ndarray, width: int) -> bytes:
    """``width`` bits of each value, most significant first."""
    return pack_rows(values[None, :], width).tobytes() if width and len(values) else b""


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    words = np.frombuffer(data[: (n * width + 7) // 8] + bytes(16), ">u8", (n * width + 63) // 64 + 1).astype(np.uint64)
    word, left = _places(n, width)
    out = np.where(left >= 0, words[word] >> np.maximum(left, 0).astype(np.uint64), words[word] << np.maximum(-left, 0).astype(np.uint64))
    over = np.flatnonzero(left < 0)
    out[over] |= words[word[over] + 1] >> (64 + left[over]).astype(np.uint64)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32)


def _high_width(high: np.ndarray) -> int:
    """Bits for the high parts of exceptions: whole bytes, 1, 2 or 4 of them."""
    bits = int(high.max()).bit_length() if len(high) else 0
    return 0 if not bits else 8 if bits <= 8 else 16 if bits <= 16 else 32


_WHOLE = {0: "u1", 8: "u1", 16: "<u2", 32: "<u4"}


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> list[bytes]:
    """The blocks of ids in order, ``BLOCK`` in each but the last; blocks of one width are packed together."""
    whole = len(ids) // BLOCK
    out: list[bytes] = [b""] * whole
    if whole:
        block = ids[: whole * BLOCK].reshape(whole, BLOCK)
        low = block.min(axis=1)
        diff = block - low[:, None]
        k = min(BLOCK - 1, int(share * BLOCK))
        width = np.frexp(np.partition(diff, k, axis=1)[:, k].astype(float))[1]  # bits of the value
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            packed = pack_rows(diff[at], w) if w else np.zeros((len(at), 0), np.uint8)
            high = diff[at] >> np.uint32(w) if w < 32 else np.zeros_like(diff[at])
            row, place = np.nonzero(high)
            ends = np.searchsorted(row, np.arange(len(at) + 1)).tolist()
            place, high = place.astype("<u2"), high[row, place]
            for i, b in enumerate(at.tolist()):
                h = high[ends[i] : ends[i + 1]]
                wide = _high_width(h)
                out[b] = b"".join((HEAD.pack(int(low[b]), BLOCK, w, wide, len(h)), packed[i].tobytes(), place[ends[i] : ends[i + 1]].tobytes(), h.astype(_WHOLE[wide]).tobytes()))
    if len(ids) > whole * BLOCK:
        out.append(encode_block(ids[whole * BLOCK :], share))
    return out


def encode_block(ids: np.ndarray, share: float = 0.9) -> bytes:
    low = int(ids.min())
    diff = (ids - np.uint32(low)).astype(np.uint32)
    k = min(len(diff) - 1, int(share * len(diff)))
    width = int(np.partition(diff, k)[k]).bit_length()
    high = diff >> np.uint32(width) if width < 32 else np.zeros_like(diff)
    at = np.flatnonzero(high)
    high_width = _high_width(high[at])
    return HEAD.pack(low, len(ids), width, high_width, len(at)) + pack(diff, width) + at.astype("<u2").tobytes() + high[at].astype(_WHOLE[high_width]).tobytes()


def decode_block(data: bytes) -> np.ndarray:
    low, n, width, high_width, exceptions = HEAD.unpack_from(data)
    at = HEAD.size + (n * width + 7) // 8
    out = unpack(data[HEAD.size : at], n, width)
    if exceptions:
        places = np.frombuffer(data, "<u2", exceptions, at)
        out[places] |= np.frombuffer(data, _WHOLE[high_width], exceptions, at + 2 * exceptions).astype(np.uint32) << np.uint32(width)
    return out + np.uint32(low)


#: Fixed value: how a tokenizer of this kind cuts a word. A run of letters ends before a mark of punctuation.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = ".,;:!?"


class _Numbers(dict):
    """Numbers words as they come, and lists those that came for the first time."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of texts (32 bits): words between plain white space, at which this kind of tokenizer always cuts and which it
    drops, are encoded once. Their ids stand on end in one array; a text is a list of word numbers, and its ids are
    gathered from there. Of a word of letters with a mark at its end, letters and mark are looked up apart, as the
    tokenizer cuts there; capitals are looked up small if it makes them so. The table is of bounded size."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark_id, self.mark = next(((i, t.content) for i, t in added.items()), (None, None))
        plan = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in ((plan["normalizer"] or {}).get("normalizers") or [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in ((plan["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        suffix = plan["model"].get("end_of_word_suffix")
        self.cut_words = cuts[:1] == [CUTS] and steps == ["NFC", "Replace", "Lowercase"] and bool(suffix)
        if self.cut_words:
            vocab = self.tokenizer.get_vocab()
            self.is_end = np.zeros(max(vocab.values()) + 1, bool)
            self.is_end[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._store(["", "\n"], np.zeros(0, np.uint32), np.zeros(2, np.int64))  # no word, and the end of a text
        self.number.new.clear()

    def _store(self, words: Sequence[str], ids: np.ndarray, size: np.ndarray) -> None:
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > len(self.starts):
            self.starts, self.lengths = (np.resize(x, 2 * len(self.number)) for x in (self.starts, self.lengths))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at], self.lengths[at] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def _marked(self, words: list[str]) -> None:
        """Encodes words many at a time, with an added token of the tokenizer between them: texts are cut there before
        anything else happens to them. Words that could hold a part of it are encoded alone."""
        plain = [w for w in words if self.mark is not None and self.mark[0] not in w and self.mark[-1] not in w]
        parts, sizes = [], []
        for lo in range(0, len(plain), 256):
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(plain[lo : lo + 256])], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            parts.append(np.delete(ids, cuts))
        rest = list(set(words).difference(plain))
        for w in rest:
            parts.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32))
            sizes.append([len(parts[-1])])
        if parts:
            self._store(plain + rest, np.concatenate(parts), np.concatenate(sizes).astype(np.int64))

    def _letters(self, words: list[str]) -> None:
        """Encodes words of letters, each of which ends with one token for ends of words."""
        for lo in range(0, len(words), 1_024):
            part = words[lo : lo + 1_024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):
                self._store(part, ids, np.diff(np.concatenate([[0], ends])))
            else:
                self._marked(part)

    def learn(self, words: list[str]) -> None:
        """Encodes words that have a number and no ids yet."""
        if not self.cut_words:
            return self._marked(words)
        cut, whole, cores = [], [], set()
        for w in words:
            core = w.rstrip(MARKS)
            # other letters are left to the tokenizer's own steps; small ones that end in a mark would join what follows
            if core.isalpha() and (core.isascii() or core.lower().isalpha()):
                low = core.lower() if core.isascii() else core
                if low == w:
                    cores.add(w)
                else:
                    cut.append((w, low, w[len(core) :]))
            else:
                whole.append(w)
        cores |= {low for _, low, _ in cut if low not in self.number}
        self._letters(list(cores))
        self._marked([*whole, *{t for _, _, t in cut if t and t not in self.number}])
        if cut:
            own, low, tail = zip(*cut)
            at = np.array([*map(self.number.__getitem__, low), *map(self.number.__getitem__, tail)]).reshape(2, -1)
            self._store(own, *self._gathered(at.T.ravel(), 2))  # letters and mark of each word in turn

    def _gathered(self, at: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words numbered ``at`` on end, and how many there are for every ``each`` words."""
        size = self.lengths[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[at] - (ends - size), size) + np.arange(int(ends[-1]))]
        return ids, size.reshape(-1, each).sum(1)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts on end, how many each text has)."""
        if len(self.number) > self.limit:
            self.forget()
        words = " \n ".join([t.replace("\n", " ").replace("\t", " ") for t in texts]).split(" ")
        words.append("\n")
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            new, self.number.new = self.number.new, []
            self.learn(new)
            self.number.new.clear()
        ids, size = self._gathered(at, 1)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)[at == 1]]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes, little-endian."""
        if not texts:
            return []
        ids, sizes = self.encode_all(texts)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_ids(parts: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]], out) -> tuple[int, int]:
    """Writes (document ids, all their token ids on end, how many each has) in the file format; returns the numbers of
    documents and of token ids."""
    tables, starts, place, total, held = [], [], 0, 0, np.zeros(0, np.uint32)

    def flush(ids: np.ndarray) -> None:
        nonlocal place
        blocks = encode_blocks(ids)
        sizes = np.cumsum([0, *map(len, blocks)])
        starts.append(place + sizes[:-1])
        out.write(b"".join(blocks))
        place += int(sizes[-1])

    for doc_ids, ids, sizes in parts:
        held = np.concatenate([held, ids.astype(np.uint32)])
        total += len(ids)
        table = np.zeros(len(doc_ids), [("known", "?"), ("id", "<i8"), ("n", "<i8")])
        table["known"], table["id"], table["n"] = [i is not None for i in doc_ids], [i or 0 for i in doc_ids], sizes
        tables.append(table)
        whole = len(held) // BLOCK * BLOCK
        if whole >= 1 << 18:
            flush(held[:whole])
            held = held[whole:]
    if len(held):
        flush(held)
    index = np.concatenate(starts).astype("<u8") if starts else np.zeros(0, "<u8")
    n = sum(map(len, tables))
    out.write(index.tobytes())
    out.write(b"".join(t.tobytes() for t in tables))
    out.write(TAIL.pack(place, place + 8 * len(index), len(index), n, MAGIC))
    return n, total


def read_ids(source, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, place of the first id in the file, ids) of every document; blocks are read by their starts, some at a time."""
    index_at, table_at, n_blocks, n_docs, magic = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    starts = np.frombuffer(source.read_at(8 * n_blocks, index_at), "<u8").tolist() + [index_at]
    table = np.frombuffer(source.read_at(size - TAIL.size - table_at, table_at), [("known", "?"), ("id", "<i8"), ("n", "<i8")])
    held, at, block, place = np.empty(0, np.uint32), 0, 0, 0
    for known, doc_id, n in table.tolist():
        while len(held) - at < n:
            last = min(block + 256, n_blocks)
            data = source.read_at(starts[last] - starts[block], starts[block])
            more = [decode_block(data[starts[i] - starts[block] : starts[i + 1] - starts[block]]) for i in range(block, last)]
            held, at, block = np.concatenate([held[at:], *more]), 0, last
        yield (doc_id if known else None), place, held[at : at + n]
        at, place = at + n, place + n


def write_token_files(docs: DataFrame, make: Callable[[], WordEncoder], end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encodes and writes all documents. Returns the stored list of files: ``part`` (their order), ``path``, ``size``,
    ``docs``, ``tokens``."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        task = TaskContext.get()

        def parts():
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    ids, sizes = encode.encode_all([t or "" for t in part.column("text").to_pylist()])
                    yield part.column("doc_id").to_pylist(), np.insert(ids, np.cumsum(sizes), end_id), sizes + 1

        path = f"{folder}/ids-{task.partitionId():06d}-{uuid.uuid4().hex}.pfor"
        fs, inside = filesystem(path)
        with fs.open_output_stream(inside) as out:
            n, total = write_ids(parts(), out)
        if n:
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path], "size": [fs.get_file_info(inside).size], "docs": [n], "tokens": [total]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(partitions(spark), order_key(F.col("doc_id"))).sortWithinPartitions("doc_id", "text")
    return saved(rows.mapInArrow(write, "part bigint, path string, size bigint, docs bigint, tokens bigint"))


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        kind = pa.schema([(n, pa.int64()) for n in names])
        for b in batches:
            for r in b.to_pylist():
                fs, inside = filesystem(r["path"])
                with fs.open_input_file(inside) as source:
                    rows = []
                    for doc_id, place, ids in read_ids(source, r["size"]):
                        rows.append((doc_id, r["base"] + place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=kind)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=kind)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = files.select("path", "size", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "part")
    dealt = listed.repartition(partitions(files.sparkSession), "part")
    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
