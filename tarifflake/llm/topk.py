"""Exact top-k search by integer inner product: MaxScore over shards.

Components become floor(256 x). Vectors are dealt to shards of bounded size and queries to blocks of bounded size; each
(shard, block) pair is one group. In a shard a term is a component with a sign: its postings are the vectors whose
component has that sign, and its bound is the query's weight times the largest component there. A query's terms are those
that add to a score. Terms in order of their bounds are split: the non-essential ones cannot reach the k-th score so far
even together. Only the essential postings are traversed; what they gather, plus the bounds of the rest, leaves
candidates, which the other terms and at last the subtracting components are probed for while they stay competitive
(a tie stays, as it may go to a smaller id). Shards are merged by rank.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
shorter vectors count as zero in the missing components; a row never answers a query with its own id; repeated ids are
answers of their own; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved


class Shard:
    """The vectors of one shard with their postings."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        self.columns = np.ascontiguousarray(self.x.T)
        self.high = self.columns.max(1, initial=0)
        self.low = self.columns.min(1, initial=0)
        self.postings: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def posting(self, d: int, positive: bool) -> tuple[np.ndarray, np.ndarray]:
        if (d, positive) not in self.postings:
            c = self.columns[d]
            at = np.flatnonzero(c > 0 if positive else c < 0)
            self.postings[d, positive] = at, c[at]
        return self.postings[d, positive]

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best by MaxScore."""
        bounds = np.where(q > 0, q * self.high, q * self.low)
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[bounds[terms] > 0]
        others = self.ids != query_id
        if not others.any():
            return self.ids[:0], self.ids[:0]
        threshold = self.first_threshold(terms, q, others, k)
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)  # rest[i]: bound of terms i and on
        # vectors that are in no essential posting score at most the bound of the other terms
        if threshold is None or threshold <= 0:  # nothing is ruled out: a vector in no posting may be among the best
            essential, candidates = 0, np.flatnonzero(others)
            gathered = np.zeros(len(candidates), np.int64)
        else:
            essential = int(np.sum(rest[: len(terms)] >= threshold))
            sums, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
            for d in terms[:essential]:
                at, values = self.posting(int(d), q[d] > 0)
                sums[at] += q[d] * values
                seen[at] = True
            candidates = np.flatnonzero(seen & others & (sums + rest[essential] >= threshold))
            gathered = sums[candidates]
        for i in range(essential, len(terms)):
            if threshold is not None:
                keep = gathered + rest[i] >= threshold
                candidates, gathered = candidates[keep], gathered[keep]
            d = terms[i]
            values = self.columns[d][candidates]
            gathered = gathered + np.maximum(q[d] * values, 0)
        # what the signs subtract
        scores = self.x[candidates] @ q
        best = np.lexsort((self.ids[candidates], -scores))[:k]
        return self.ids[candidates][best], scores[best]

    def first_threshold(self, terms: np.ndarray, q: np.ndarray, others: np.ndarray, k: int) -> int | None:
        """The k-th score among the vectors with the largest contributions to the strongest terms."""
        some = []
        for d in terms[:8]:
            at, values = self.posting(int(d), q[d] > 0)
            if len(at) > 16:
                at = at[np.argpartition(-np.abs(values), 16)[:16]]
            some.append(at)
        at = np.unique(np.concatenate(some)) if some else np.arange(0)
        at = at[others[at]]
        if len(at) < k:
            return None
        return int(np.partition(self.x[at] @ q, len(at) - k)[len(at) - k])


def matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = frame["v"].tolist()
    x = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return frame["vec_id"].to_numpy(np.int64), x


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best of ``vectors`` for each of ``queries``; both hold
    ``vec_id`` and the integer vector ``v``."""
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    number = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = vectors.withColumn("shard", number(shards)).withColumn("block", every(blocks))
    right = queries.withColumn("block", number(blocks)).withColumn("shard", every(shards))

    def search(key, docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        (ids, x), (query_ids, q) = matrix(docs), matrix(asked)
        width = max(x.shape[1], q.shape[1])
        x, q = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, q))
        shard = Shard(ids, x)
        found = [(i, *shard.search(i, row, k)) for i, row in zip(query_ids.tolist(), q)]
        return pd.DataFrame({"query_id": np.repeat([i for i, _, _ in found], [len(a) for _, a, _ in found]), "vec_id": np.concatenate([a for _, a, _ in found]), "score": np.concatenate([s for *_, s in found])})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``, floor(256 x) of every component, of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = embeddings.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(~odd)
    return whole.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256.0).cast("bigint")).alias("v"))


def search_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k best of all other rows for each row whose id is divisible by ``every``; repeated query ids ask once."""
    rows = saved(quantised(embeddings))
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    return top_k(rows, queries, k)
