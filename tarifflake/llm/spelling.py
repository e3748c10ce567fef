"""Spelling variant grouping with bidirectional FM-index search schemes.

Two words one edit apart share one half exactly: the edit lies in the other. So words are dealt by side, length and
letters of a half (a word also under the halves that a partner of one letter more or less would look for), the words that
meet are indexed together, and every word searches the index for its own half, extended over the other with one error.
Buckets hold a bounded number of words. A half that very many words share is cut into blocks, and every block of searches
meets every block of found words; a pair is counted where the found word stands under the searched half, and only from the first half if both
fit, so once. No pairs leave a bucket, only each word's number of near words and the best of them.

Defined cases: a null text has no words; a null id counts as an empty string in the hash of a run; equal rows count each;
empty tables give no rows; columns besides ``doc_id`` and ``text`` are not read; runs of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .shared import saved

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words of a bucket, and letters: together they bound its index.
BUCKET_WORDS, BUCKET_LETTERS = 16_384, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``run``: every run of letters of every text, A-Z in lower case."""
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))


def with_slips(found: DataFrame, every: int = 199) -> DataFrame:
    """``word``: the runs, of which one in ``every`` (by a hash of document and run) lacks a letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    slip = F.pmod(F.col("h"), F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), slip), F.substring(F.col("run"), slip + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word`` and ``n`` of the words long and frequent enough."""
    counts = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _halves(word: Column) -> Column:
    """Where a word stands: (side, half's length, half, whether it is its own half and so searches). The half's length
    is part of the key, as a partner's may differ."""
    n = F.length(word)

    def at(side: str, length: Column, own: Column) -> Column:
        half = F.left(word, length) if side == "first" else F.right(word, length)
        return F.struct(F.lit(side == "first").alias("first"), length.alias("length"), half.alias("half"), (length == own).alias("asks"))

    first, rest = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    places = [at("first", F.floor((n + k) / 2).cast("int"), first) for k in (-1, 0, 1)] + [at("rest", F.ceil((n + k) / 2).cast("int"), rest) for k in (-1, 0, 1)]
    return F.array_distinct(F.array(*places))


_FOUND = "word string, n_near bigint, best_n bigint, best string"


def _search(bucket: pa.Table) -> pa.Table:
    """One bucket: rows (first, length, half, part, word, n, asks, holds)."""
    named = bucket.column("word").to_pylist()
    words = sorted(set(named))
    place = {w: i for i, w in enumerate(words)}
    index = FMIndex(words)
    row_word = np.array([place[w] for w in named], np.int64)
    cells: dict[tuple[str, int, int], int] = {}
    key = np.array([cells.setdefault(k, len(cells)) for k in zip(*(bucket.column(c).to_pylist() for c in ("half", "length", "part")))], np.int64)
    n = np.zeros(len(words), np.int64)
    n[row_word] = bucket.column("n").to_numpy()
    holds, ask = (bucket.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("holds", "asks"))
    stands = np.sort(key[holds] * len(words) + row_word[holds])  # (cell, word) pairs of this bucket
    asks, first = np.flatnonzero(ask), bool(bucket.column("first")[0].as_py())
    queries = [words[i] for i in row_word[asks].tolist()]
    found = []
    for lo in range(0, len(queries), 8_192):
        q, v = index.one_error(queries[lo : lo + 8_192], first)
        found.append((q + lo, v))
    q, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    u = row_word[asks][q]
    want = key[asks][q] * len(words) + v
    at = np.minimum(np.searchsorted(stands, want), max(0, len(stands) - 1))
    keep = (u != v) & ((stands[at] == want) if len(stands) else False)
    u, v = u[keep], v[keep]
    if not first and len(u):  # found from the first half as well: counted there
        both = np.fromiter((words[j].startswith(words[i][: len(words[i]) // 2]) for i, j in zip(u.tolist(), v.tolist())), bool, len(u))
        u, v = u[~both], v[~both]
    order = np.lexsort((v, -n[v], u))  # the best first: largest n, then the least word
    u, v = u[order], v[order]
    at = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    columns = {"word": [words[i] for i in u[at].tolist()], "n_near": np.diff(np.append(at, len(u))), "best_n": n[v[at]], "best": [words[i] for i in v[at].tolist()]}
    return pa.table({c: pa.array(x, t) for (c, x), t in zip(columns.items(), (pa.string(), pa.int64(), pa.int64(), pa.string()))})


def near_words(vocab: DataFrame, most: int = BUCKET_WORDS) -> DataFrame:
    """``word``, ``n_near``, ``best``, ``best_n``: the words of ``vocab`` (``word``, ``n``) that have near ones."""
    rows = saved(vocab.select("word", "n", F.inline(_halves(F.col("word")))))
    # a bucket takes words up to its bound in words and letters; one half with more than that takes several
    weight = F.greatest(F.lit(1.0), F.length("word") * (most / BUCKET_LETTERS))
    sizes = rows.groupBy("first", "length", "half").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    total = sizes.agg(F.sum("w")).first()[0] or 0.0
    buckets = max(1, -(-int(total) // most))
    parts = F.ceil(F.col("w") / most).cast("int")
    dealt = rows.join(sizes.select("first", "length", "half", parts.alias("parts")), ["first", "length", "half"])
    # a half of many parts is a square of cells: a word stands in one row of them and asks in one column
    own, k = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    asked = F.when(F.col("asks"), F.transform(k, lambda i: i * F.col("parts") + own)).otherwise(F.array().cast("array<int>"))
    cells = F.array_distinct(F.concat(F.transform(k, lambda j: own * F.col("parts") + j), asked))
    dealt = dealt.select("*", own.alias("own"), F.explode(cells).alias("part"))
    dealt = dealt.withColumn("holds", F.floor(F.col("part") / F.col("parts")) == F.col("own")).withColumn("asks", F.col("asks") & (F.col("part") % F.col("parts") == F.col("own")))
    bucket = F.pmod(F.xxhash64("length", "half", "part"), F.lit(buckets)).alias("bucket")
    met = dealt.select("first", bucket, "length", "half", "part", "word", "n", "asks", "holds")
    found = met.groupBy("first", "bucket").applyInArrow(_search, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def grouped(vocab: DataFrame, times: int = 5, most: int = BUCKET_WORDS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of ``vocab`` (``word``, ``n``). A form has at least
    ``times`` the count of its word, so chains of forms end after at most log2(2**63) / log2(times) steps; roots double
    their reach in each round."""
    near = vocab.join(near_words(vocab, most), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    words = saved(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    chain = words.filter("form is not null").select("word", F.col("form").alias("root"))
    reach, longest = 1, int(63 / np.log2(times)) + 1
    while reach < longest:
        chain = saved(chain)
        on = chain.select(F.col("word").alias("mid"), F.col("root").alias("further"))
        chain = chain.join(on, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("further", "root").alias("root"))
        reach *= 2
    out = words.join(chain, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The vocabulary of ``docs`` with the form and root of each word."""
    return grouped(saved(vocabulary(with_slips(runs(docs)))))
