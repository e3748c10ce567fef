"""Phrase collocation mining with weighted acyclic automata.

Each task reads its texts shard by shard (a bounded number of words), sorts the shard's phrases of one to three words
and builds count transducers from them, one per range of prefixes (a range is an interval of the hash of a phrase's first
two words, so a common first word is spread over all ranges). The transducers of a range meet in one task, which unions
them one after the other and sums the counts. Frequent phrases then ask for the counts of their parts: requests and
counts are dealt by the part, and each bucket composes the two automata. A part that very many phrases share is spread
over several buckets, each with the part's one count.

Counts are those of the whole table; a phrase below the least count cannot be a candidate nor hold one, and all parts of
a candidate are at least as frequent as it.

Defined cases: a null text counts as empty; a null language is ``und``; equal rows and rows with equal ids count each;
an empty table gives no rows; columns besides ``text`` and ``lang`` are not read; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .automata import NONE, Lookup, Phrases, Union, build, summed
from .shared import partitions, saved

SHARD_WORDS = 2_000_000
#: Tasks that share the requests for one part.
SPREAD = 4
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


class _Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Words of texts, by language, until their phrases are counted."""

    def __init__(self):
        self.ids = _Ids({b"\n": 0})  # the end of a piece is no word
        self.parts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, texts: list[str]) -> None:
        """Lower-cases A-Z only: the other bytes of UTF-8 are none of these letters."""
        data = "\n".join(texts).encode("utf-8", "surrogatepass").lower().translate(_ENDS)
        words = [w for w in data.replace(b"\t", b" ").replace(b"\n", b" \n ").split(b" ") if w]
        found = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.parts.setdefault(lang, []).append(np.append(found, np.int32(0)))
        self.size += len(words)

    def phrases(self) -> tuple[list[str], Phrases]:
        """(languages, all phrases of the shard in order); the key is the place of the language."""
        names = list(self.ids)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.int32)
        rank[order] = np.arange(len(names), dtype=np.int32)
        langs, stop = sorted(self.parts), int(rank[0])
        rows = []
        for k, lang in enumerate(langs):
            x = rank[np.concatenate([*self.parts[lang], np.zeros(2, np.int32)])]
            n = len(x) - 2
            for width in (1, 2, 3):
                whole = np.ones(n, bool)
                for i in range(width):
                    whole &= x[i : n + i] != stop
                at = np.flatnonzero(whole)
                none = np.full(len(at), NONE, np.int32)
                p = summed(names, [np.full(len(at), k, np.int32), *[x[at + i] if i < width else none for i in range(3)]], None)
                rows.append(([p.key, p.first, p.second, p.third], p.count))
        words = [names[i] for i in order]
        columns = [np.concatenate([r[0][i] for r in rows]) for i in range(4)] if rows else [np.zeros(0, np.int64)] * 4
        return langs, Phrases(words, *columns, np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_codes(words: list[bytes]) -> np.ndarray:
    """A hash of each word that all tasks agree on, and of no word (last)."""
    import xxhash

    return np.array([*map(xxhash.xxh3_64_intdigest, words), 0x51ED270B], np.uint64)


def slices(langs: list[str], p: Phrases, ranges: int) -> Iterator[tuple[int, bytes]]:
    """The shard's transducers: (range, transducer). Phrases stay in order inside a range."""
    codes = _word_codes(p.words)
    h = _mixed(codes[p.first] * np.uint64(0x9E3779B97F4A7C15) + codes[p.second])
    place = (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int16 if ranges < 1 << 15 else np.int64)
    del h
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(ranges + 1))
    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            rows = order[a:b]
            yield r, build(Phrases(p.words, *[c[rows] for c in (p.key, p.first, p.second, p.third, p.count)]), langs)


_SLICE = pa.schema([("place", pa.int32()), ("automaton", pa.binary())])
_GRAM = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("f", pa.int64())])


def _shard_automata(ranges: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()

        def flush() -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for r in slices(*shard.phrases(), ranges):
                rows.append(r)
                held += len(r[1])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SLICE.types)], schema=_SLICE)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SLICE.types)], schema=_SLICE)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                by: dict[str, list[str]] = {}
                for lang, text in zip(batch.column("lang").slice(lo, 256).to_pylist(), batch.column("text").slice(lo, 256).to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    shard.add(lang, texts)
                if shard.size >= shard_words:
                    yield from flush()
                    shard = Shard()
        yield from flush()

    return run


def _range_counts(least: int):
    """Reads the slices of a task in the order of ranges; gives the frequent phrases of each, and of each language the
    number of words (in ``f`` of a row without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, union = None, Union()

        def flush() -> Iterator[pa.RecordBatch]:
            p, keys = union.phrases(), list(union.keys)
            alone = p.second == NONE
            totals = np.bincount(p.key[alone], weights=p.count[alone], minlength=len(keys)).astype(np.int64)
            often = np.flatnonzero(p.count >= least)
            names = p.words + [None]
            text = [None if w is None else w.decode("utf-8", "surrogatepass") for w in (names[i] for i in np.concatenate([p.first[often], p.second[often], p.third[often]]).tolist())]
            n, langs = len(often), [keys[i] for i in p.key[often].tolist()]
            for lo in range(0, n, 10_000):
                hi = min(lo + 10_000, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[lo:hi], pa.string()), *[pa.array(text[k * n + lo : k * n + hi], pa.string()) for k in range(3)], pa.array(p.count[often[lo:hi]])], schema=_GRAM
                )
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.nulls(len(keys), pa.string())] * 3, pa.array(totals)], schema=_GRAM)

        for batch in batches:
            for place, automaton in zip(*(c.to_pylist() for c in batch.columns)):
                if at != place:
                    if at is not None:
                        yield from flush()
                    at, union = place, Union()
                union.add(automaton)
        if at is not None:
            yield from flush()

    return run


def frequent_phrases(docs: DataFrame, least: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang``, ``w1``, ``w2``, ``w3``, ``f``: all phrases of one to three words that occur ``least`` times or more, and
    rows without words whose ``f`` add up to the number of words of a language."""
    n = partitions(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    shards = texts.mapInArrow(_shard_automata(n, shard_words), "place int, automaton binary")
    met = shards.repartitionById(n, "place").sortWithinPartitions("place")
    return met.mapInArrow(_range_counts(least), "lang string, w1 string, w2 string, w3 string, f bigint")


def _composed(requests: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """The requests (``lang``, ``p1``, ``p2``: a part, and further columns) with the part's count ``f``."""
    given = requests.columns
    kinds = ", ".join(f"{c} {t}" for c, t in [*requests.dtypes, ("f", "bigint")])

    none = to_arrow_schema(requests.withColumn("f", F.lit(0).cast("bigint")).schema).empty_table()

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[str, Lookup] = {}
        have = right.to_pydict() if right.num_rows else {"of": []}
        if not left.num_rows:
            return none
        for lang in set(have["of"]):
            rows = [i for i, x in enumerate(have["of"]) if x == lang]
            by[lang] = Lookup(*[[have[c][i] for i in rows] for c in ("p1", "p2", "f")])
        ask = left.select(given).to_pydict()
        found: list[int | None] = [None] * left.num_rows
        for lang, lookup in by.items():
            rows = [i for i, x in enumerate(ask["lang"]) if x == lang]
            for i, f in zip(rows, lookup.compose([ask["p1"][i] for i in rows], [ask["p2"][i] for i in rows])):
                found[i] = f
        return pa.table({**{c: left.column(c) for c in given}, "f": pa.array(found, pa.int64())})

    bucket = F.pmod(F.xxhash64("lang", "p1", "p2"), F.lit(4 * n)).alias("bucket")
    left = requests.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SPREAD)).cast("int"))
    right = counts.select(F.col("lang").alias("of"), "p1", "p2", "f", bucket, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(compose, kinds)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest-scoring cut of each candidate, in whole numbers of any size."""
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("l", "r", "score")}
        for a, one, rest, two, last in zip(*(b.column(c).to_pylist() for c in ("a", "l1", "r1", "l2", "r2"))):
            cuts = [(1_000_000 * a * a // (l * r), k, l, r) for k, l, r in ((1, one, rest), (2, two, last)) if l is not None]
            score, _, l, r = min(cuts)
            for c, v in (("l", l), ("r", r), ("score", score)):
                out[c].append(v)
        kept = [b.column(c) for c in ("lang", "w1", "w2", "w3", "a")]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(out[c], pa.int64()) for c in ("l", "r", "score")]], ["lang", "w1", "w2", "w3", "a", "l", "r", "score"])


def collocations(docs: DataFrame, least: int = 10, top: int | None = 2000, covered_pct: int = 50, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The phrases of two or three words of each language that hold together best: ``lang``, ``rank``, ``phrase``, ``a``
    (its count), ``l`` and ``r`` (the counts of the parts at its weakest cut), ``n`` (words of the language), ``score``.
    A phrase inside a longer candidate that accounts for ``covered_pct`` percent of it goes."""
    n_parts = partitions(docs.sparkSession)
    grams = saved(frequent_phrases(docs, least, shard_words))
    sizes = grams.filter("w1 is null and f > 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = grams.filter("w1 is not null")
    found = known.filter("w2 is not null").withColumnRenamed("f", "a")
    counts = known.filter("w3 is null").select("lang", F.col("w1").alias("p1"), F.col("w2").alias("p2"), "f")
    none = F.lit(None).cast("string")

    def part(name: str, p1: Column, p2: Column = none) -> Column:
        return F.struct(F.lit(name).alias("part"), p1.alias("p1"), p2.alias("p2"))

    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    two, three = F.array(part("l1", w1), part("r1", w2)), F.array(part("l1", w1), part("r1", w2, w3), part("l2", w1, w2), part("r2", w3))
    asked = found.select("lang", "w1", "w2", "w3", "a", F.inline(F.when(w3.isNull(), two).otherwise(three)))
    parts = _composed(asked, counts, n_parts)
    cuts = parts.groupBy("lang", "w1", "w2", "w3", "a").agg(*[F.max(F.when(F.col("part") == c, F.col("f"))).alias(c) for c in ("l1", "r1", "l2", "r2")])
    scored = cuts.mapInArrow(_scored, "lang string, w1 string, w2 string, w3 string, a bigint, l bigint, r bigint, score bigint")

    longer = found.filter("w3 is not null")
    inner = F.inline(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((w1, w2), (w2, w3))]))
    covers = longer.select(F.col("lang").alias("in_lang"), "a", inner).groupBy("in_lang", "x", "y").agg(F.max("a").alias("most"))
    inside = F.col("w3").isNull() & (F.col("lang") == F.col("in_lang")) & (F.col("w1") == F.col("x")) & (F.col("w2") == F.col("y")) & (100 * F.col("most") >= covered_pct * F.col("a"))
    kept = scored.join(covers, inside, "left_anti").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
