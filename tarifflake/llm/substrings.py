"""Suffix-array dedup: removes every byte that lies in a string of ``length`` bytes which also starts anywhere else.

Comparing all suffixes of a corpus with each other isn't needed: a string of ``length`` bytes holds an anchor, the
least of the hashes of its ``gram``-byte substrings (the leftmost of equal ones), and equal strings have equal anchors.
The starts of a text fall into runs with one anchor each. Runs whose anchor occurs nowhere else are done. Runs that are
equal as a whole to another (anchor and whole segment) are repeated as a whole. What is left (borders of shared passages,
edits) is decided byte by byte: the segments of an anchor, one for each whole segment, meet in one group and their
suffixes are sorted by hash comparisons (``suffixes``), with the bytes of equal neighbours compared against collisions.
For anchors with more than ``most`` different segments the starts are dealt out singly, by the hash of their string, and
read as a stream, so no task holds a large group.

Texts are known by a 64-bit hash; a text that stands in several rows is repeated as a whole if it is long enough, and a
task gives the runs of equal texts once. Counting an anchor begins in the map tasks.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows are documents of their
own, so each removes the other's bytes; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not
read for the figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import mix
from .shared import partitions, saved
from .suffixes import Suffixes, repeated

LENGTH, GRAM, MOST = 200, 24, 32_768
BATCH_BYTES = 1 << 20
_PLACE_BITS = 28


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of bytes, one text at least."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > BATCH_BYTES:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of starts with one anchor: text, first start, number of starts, anchor hash, hash of the whole segment."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) >= 1 << _PLACE_BITS:
        raise ValueError("a text is too long")
    if not (sizes >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    s = Suffixes(data)
    grams = s.every(gram)
    places = np.uint64((1 << _PLACE_BITS) - 1)
    least = _least((grams & ~places) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    whole = np.zeros(len(least) + 1, np.int64)  # starts whose string lies inside one text
    fit = sizes >= length
    np.add.at(whole, begins[fit], 1)
    np.add.at(whole, ends[fit] - length + 1, -1)
    inside = np.cumsum(whole[:-1]) > 0
    anchor = (least & places).astype(np.int64)
    change = np.ones(len(least), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    change[begins[fit]] = True
    first = np.flatnonzero(change & inside)
    stop = np.concatenate([[False], inside[1:] & change[1:] | ~inside[1:]])  # a run ends before here
    stops = np.append(np.flatnonzero(stop), len(least))
    n = stops[np.searchsorted(stops, first, side="right")] - first
    owner = np.searchsorted(ends, first, side="right")
    segment = mix(s.hashes(first, n - 1 + length) + n.astype(np.uint64))
    return owner, first - begins[owner], n, grams[anchor[first]].view(np.int64), segment.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches, so that few texts are held as Python objects."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _once(b: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows of a batch whose hash this task hasn't met."""
    keep = []
    for h in b.column("h").to_pylist():
        keep.append(h not in seen)
        seen.add(h)
    return b.filter(pa.array(keep, pa.bool_()))


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def text_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``h`` (hash of the text), ``lo``, ``n``, ``a`` (anchor), ``s`` (segment) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _slices(batches):
            b = _once(b, seen)
            texts, hashes = b.column("raw").to_pylist(), b.column("h").to_numpy(zero_copy_only=False)
            for x, y in _chunks(texts):
                owner, lo, n, a, s = runs(texts[x:y], length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[x:y][owner], pa.int64()), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(a, pa.int64()), pa.array(s, pa.int64())], ["h", "lo", "n", "a", "s"])

    return _raw(docs).mapInArrow(run, "h bigint, lo int, n int, a bigint, s bigint")


def _packed(docs: DataFrame, once: bool, extra: tuple = ()) -> DataFrame:
    """Texts by hash, compressed for the shuffle; ``once``: equal texts of a task only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in _slices(batches):
            b = _once(b, seen) if once else b
            names = b.schema.names
            packed = pa.array([squeeze.compress(t) for t in b.column("raw").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if c == "raw" else b.column(c) for c in names], names)

    rows = docs.select(*extra, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(run, rows.schema)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _segments(rows: DataFrame, length: int) -> DataFrame:
    """Cuts the wanted segments out of the texts: whole ones by anchor, or, for ``hot`` anchors, each start by the hash
    of its string, without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = []
            for h, packed, wanted in zip(*(b.column(c).to_pylist() for c in ("h", "raw", "wanted"))):
                text = _unpack(packed)
                single = None
                for w in wanted:
                    lo, n = w["lo"], w["n"]
                    if not w["hot"]:
                        out.append((w["a"], False, h, lo, n, w["open"], text[lo : lo + n - 1 + length]))
                        continue
                    if single is None:
                        single = Suffixes(np.frombuffer(text, np.uint8))
                    keys = mix(single.hashes(np.arange(lo, lo + n), length) ^ np.uint64(w["a"] & (2**64 - 1))).view(np.int64)
                    out += [(k, True, h, lo + i, 1, w["open"], None) for i, k in enumerate(keys.tolist())]
            for x in range(0, len(out), 2_000):
                part = list(zip(*out[x : x + 2_000]))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(part, kinds)], ["key", "single", "h", "lo", "n", "open", "segment"])

    return rows.mapInArrow(run, "key bigint, single boolean, h bigint, lo int, n int, open boolean, segment binary")


def _decide(length: int, gram: int) -> Callable:
    """Repeated starts of the open runs, as ranges, from segments sorted by kind and key."""

    def of_groups(groups: list[list[tuple]]) -> list[tuple]:
        rows = [(g, *r) for g, members in enumerate(groups) for r in members]
        if not rows:
            return []
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        sizes = np.array([len(r[5]) for r in rows])
        begins, n = np.cumsum(sizes) - sizes, np.array([r[3] for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        found = repeated(data, begins[row] + inside, np.array([r[0] for r in rows], np.uint64)[row], length, gram)
        out = []
        open_ = np.array([r[4] for r in rows])[row] & found
        at = np.flatnonzero(open_)
        if len(at):
            cut = np.flatnonzero((np.diff(at) != 1) | (row[at][1:] != row[at][:-1]))
            for a, b in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(at) - 1).tolist()):
                r = rows[row[at[a]]]
                out.append((r[1], r[2] + int(inside[at[a]]), b - a + 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32()))], ["h", "lo", "n"])

        groups, held, key, found = [], 0, None, []
        before = None  # the last single start: key, its row, whether it is out already
        for b in _slices(batches):
            for k, single, h, lo, n, is_open, segment in zip(*(b.column(c).to_pylist() for c in ("key", "single", "h", "lo", "n", "open", "segment"))):
                if single:
                    if before is not None and before[0] == k:
                        if before[1] is not None:
                            found.append(before[1])
                        if is_open:
                            found.append((h, lo, 1))
                        before = (k, None)
                    else:
                        before = (k, (h, lo, 1) if is_open else None)
                    continue
                if key != k:
                    if held > BATCH_BYTES:
                        found += of_groups(groups)
                        groups, held = [], 0
                    groups.append([])
                    key = k
                groups[-1].append((h, lo, n, is_open, segment))
                held += len(segment)
            if len(found) > 10_000:
                yield from emit(found)
                found = []
        yield from emit(found + of_groups(groups))

    return run


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``h``, ``lo``, ``n``: ranges of starts of strings that also start elsewhere; ``n`` is -1 where a whole text is
    repeated."""
    n_parts = partitions(docs.sparkSession)
    again = text_runs(docs, length, gram).groupBy("a").count().filter("count > 1").select("a")
    some = saved(text_runs(docs, length, gram).join(again, "a"))
    segments = saved(some.groupBy("a", "s").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("h", "lo", "n")).alias("first")))
    whole = some.join(segments.filter("times > 1").select("a", "s"), ["a", "s"]).select("h", "lo", "n")
    kinds = segments.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("fewest")).filter("kinds > 1 and fewest = 1")
    wanted = segments.join(kinds, "a").select("first.h", F.struct("first.lo", "first.n", "a", (F.col("times") == 1).alias("open"), (F.col("kinds") > most).alias("hot")).alias("w"))
    wanted = wanted.groupBy("h").agg(F.collect_list("w").alias("wanted"))
    cut = _segments(_packed(docs, True).join(wanted, "h").dropDuplicates(["h"]).select("h", "raw", "wanted"), length)
    decided = cut.repartition(n_parts, "key").sortWithinPartitions("single", "key").mapInArrow(_decide(length, gram), "h bigint, lo int, n int")
    copies = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).groupBy("h").count().filter("count > 1")
    return whole.union(decided).union(copies.select("h", F.lit(0).alias("lo"), F.lit(-1).alias("n")))


def _kept(text: bytes, ranges: list | None, length: int) -> tuple[bytes, int]:
    """The bytes that stay and the number of removed runs."""
    if not ranges or len(text) < length:
        return text, 0
    if any(r["n"] < 0 for r in ranges):
        return b"", 1
    change = np.zeros(len(text) + 1, np.int32)
    for r in ranges:
        change[r["lo"]] += 1
        change[r["lo"] + r["n"] - 1 + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), spans


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows = []
            for packed, ranges in zip(b.column("raw").to_pylist(), b.column("ranges").to_pylist()):
                text = _unpack(packed)
                kept, spans = _kept(text, ranges, length)
                rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            parts = list(zip(*rows)) or [()] * 4
            columns = [pa.array(list(c), k) for c, k in zip(parts, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ranges = repeated_starts(docs, length).groupBy("h").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))
    rows = _packed(docs, False, ("doc_id",)).join(ranges, "h", "left").select("doc_id", "raw", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def trimmed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the remaining text of each row; a character that lost some of its bytes goes, and rows of which
    nothing is left go. ``n_chars``, where there is one, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = [_kept(t.encode(), r, length)[0].decode("utf-8", "ignore") if t else t for t, r in zip(b.column("text").to_pylist(), b.column("__ranges").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in b.schema.names if c != "__ranges"], [c for c in b.schema.names if c != "__ranges"])

    ranges = repeated_starts(docs, length).groupBy("h").agg(F.collect_list(F.struct("lo", "n")).alias("__ranges"))
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = hashed.join(ranges.withColumnRenamed("h", "__h"), "__h", "left").select(*docs.columns, "__ranges")
    out = rows.mapInArrow(run, docs.schema).filter("text <> ''")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
