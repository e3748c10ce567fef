"""Name similarity on normalized keys, 0 to 100, and candidate pairs that lose no match.

The measure is the Indel ratio, 200 * LCS / (la + lb), on sorted tokens and on token sets. Only candidate pairs are
scored, each distinct pair once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word step per letter."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, dx, dy = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not dx or not dy):
        return 100.0
    shared = len(" ".join(both))
    gap = 1 if both else 0
    lx, ly = shared + gap + len(dx), shared + gap + len(dy)
    dist = len(dx) + len(dy) - 2 * lcs(dx, dy)
    out = 100.0 * (1 - dist / (lx + ly))
    if both:
        out = max(out, *(100.0 * (1 - (gap + len(d)) / (shared + n)) for d, n in ((dx, lx), (dy, ly))))
    return out


def name_score(a: str, b: str) -> float:
    """Token-sort ratio; names of two or more words may also match as word sets, five points lower."""
    s = token_sort(a, b)
    if min(len(a.split()), len(b.split())) >= 2:
        s = max(s, token_set(a, b) - 5)
    return s


def _udf(fn):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    # a filter on the score must stay above the distinct: each pair is scored once
    return score.asNondeterministic()


name_score_udf, token_sort_udf, token_set_udf = _udf(name_score), _udf(token_sort), _udf(token_set)


def _tokens(c: str) -> Column:
    return F.split(F.col(c), " ")


def _prepared(names: DataFrame, threshold: float) -> DataFrame:
    """block, name with: its sorted tokens, the most edits any partner may be away, and its tokens by rarity."""
    n = names.select("block", "name").filter("name <> ''").distinct()
    n = n.withColumn("sorted", F.array_join(F.array_sort(_tokens("name")), " "))
    far = (100 - threshold) / 100.0
    longest = F.floor(F.length("sorted") * (1 + far) / (1 - far))  # a longer partner cannot reach the threshold
    return n.withColumns({"len": F.length("sorted"), "edits": F.floor(F.lit(far) * (F.length("sorted") + longest)).cast("int")})


def _segments(n: DataFrame) -> DataFrame:
    """The sorted tokens cut into edits + 1 pieces: a partner keeps at least one of them whole."""
    k = F.col("edits") + 1
    piece = F.transform(
        F.sequence(F.lit(0), F.col("edits")),
        lambda i: F.struct(F.floor(i * F.col("len") / k).cast("int").alias("at"), (F.floor((i + 1) * F.col("len") / k) - F.floor(i * F.col("len") / k)).cast("int").alias("n")),
    )
    e = n.select("block", "name", "len", "edits", "sorted", F.explode(piece).alias("p")).filter("p.n > 0")
    return e.select("block", "name", "len", "edits", F.col("p.at").alias("at"), F.substring(F.col("sorted"), F.col("p.at") + 1, F.col("p.n")).alias("piece"))


def _windows(n: DataFrame, sizes: Column) -> DataFrame:
    """Every stretch of the sorted tokens that could be another name's piece."""
    e = n.select("block", "name", "len", "sorted", F.explode(sizes).alias("n")).filter("n <= len")
    e = e.select("block", "name", "len", "sorted", "n", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("n"))).alias("at"))
    return e.select("block", "name", "len", "at", F.substring(F.col("sorted"), F.col("at") + 1, F.col("n")).alias("piece"))


def _close_spelling(q: DataFrame, d: DataFrame, threshold: float) -> DataFrame:
    segs = _segments(d)
    lens = segs.select("block", F.length("piece").alias("n")).groupBy("block").agg(F.collect_set("n").alias("sizes"))
    win = _windows(q.join(lens, "block"), F.col("sizes"))
    s, w = segs.alias("s"), win.alias("w")
    ok = (
        (F.col("s.block") == F.col("w.block")) & (F.col("s.piece") == F.col("w.piece"))
        & (F.abs(F.col("s.at") - F.col("w.at")) <= F.col("s.edits"))
        & (F.lit(200.0) * F.least("s.len", "w.len") >= F.lit(threshold) * (F.col("s.len") + F.col("w.len")))
    )
    return s.join(w, ok).select(F.col("s.block").alias("block"), F.col("w.name").alias("q"), F.col("s.name").alias("d")).distinct()


def _word_frequency(q: DataFrame, d: DataFrame) -> DataFrame:
    words = q.select("block", F.explode(F.array_distinct(_tokens("name"))).alias("w")).unionByName(d.select("block", F.explode(F.array_distinct(_tokens("name"))).alias("w")))
    return words.groupBy("block", "w").agg(F.count(F.lit(1)).alias("df"))


def _rare_words(n: DataFrame, freq: DataFrame, share: float) -> DataFrame:
    """The rarest words of a name, as many as cannot all be missing from a partner that contains nearly all of it."""
    words = n.select("block", "name", F.explode(F.array_distinct(_tokens("name"))).alias("w")).join(freq, ["block", "w"])
    g = words.groupBy("block", "name").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    total = F.aggregate("ws", F.lit(0), lambda a, x: a + F.length(x["w"]))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("keep"))

    def step(a, x):
        more = a["used"] + 1 <= F.lit(share) * (total - a["used"] + F.size("ws"))
        take = (a["used"] == 0) | more
        return F.struct(F.when(take, a["used"] + F.length(x["w"])).otherwise(a["used"]).alias("used"), F.when(take, F.concat(a["keep"], F.array(x["w"]))).otherwise(a["keep"]).alias("keep"))

    return g.select("block", "name", F.explode(F.aggregate("ws", start, step)["keep"]).alias("w"))


def _contained(q: DataFrame, d: DataFrame, threshold: float) -> DataFrame:
    """One name's words are nearly all in the other."""
    far = (100 - threshold) / 100.0
    share = 2 * far / (1 - far)
    freq = _word_frequency(q, d)
    out = None
    for a, b, qa in ((q, d, True), (d, q, False)):
        sig = _rare_words(a, freq, share).alias("x")
        every = b.select("block", "name", F.explode(F.array_distinct(_tokens("name"))).alias("w")).alias("y")
        hit = sig.join(every, (F.col("x.block") == F.col("y.block")) & (F.col("x.w") == F.col("y.w")))
        x, y = F.col("x.name"), F.col("y.name")
        one = hit.select(F.col("x.block").alias("block"), (x if qa else y).alias("q"), (y if qa else x).alias("d"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _one_word_off(q: DataFrame, d: DataFrame) -> DataFrame:
    """All words but one agree and the odd ones have nearly the same length (a typo that changes the word order)."""
    def rest(n):
        words = F.array_sort(F.array_distinct(_tokens("name")))
        e = n.select("block", "name", words.alias("ws"), F.explode(words).alias("odd")).filter(F.size("ws") >= 2)
        return e.select("block", "name", F.length("odd").alias("odd_len"), F.array_join(F.array_remove("ws", F.col("odd")), " ").alias("rest"))

    x, y = rest(q).alias("x"), rest(d).alias("y")
    total = F.length("x.name") + F.length("y.name")
    ok = (F.col("x.block") == F.col("y.block")) & (F.col("x.rest") == F.col("y.rest")) & (F.abs(F.col("x.odd_len") - F.col("y.odd_len")) <= total * 0.15)
    return x.join(y, ok).select(F.col("x.block").alias("block"), F.col("x.name").alias("q"), F.col("y.name").alias("d")).distinct()


def similar_pairs(queries: DataFrame, names: DataFrame, threshold: float, how: str = "name") -> DataFrame:
    """(block, q, d, score) of all pairs of names in a block that reach the threshold.

    ``how``: name (the library's score), sort (token-sort only) or set (token-set only)."""
    q, d = _prepared(queries, threshold), _prepared(names, threshold)
    equal = (F.col("block") == F.col("b2")) & (F.col("q") == F.col("d"))
    known = d.select(F.col("block").alias("b2"), F.col("name").alias("d"))
    cand = [q.select("block", F.col("name").alias("q")).join(known, equal).drop("b2")]
    cand.append(_close_spelling(q, d, threshold))
    if how != "sort":
        cand += [_contained(q, d, threshold + (5 if how == "name" else 0)), _one_word_off(q, d)]
    pairs = cand[0]
    for c in cand[1:]:
        pairs = pairs.unionByName(c)
    fn = {"name": name_score_udf, "sort": token_sort_udf, "set": token_set_udf}[how]
    return pairs.distinct().withColumn("score", fn("q", "d")).filter(F.col("score") >= threshold)
