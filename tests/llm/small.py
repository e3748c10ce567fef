"""Small tables with the odd cases, and plain versions of the operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("h", "node", "size", "n", "x", "raw", "ranges", "uid", "block", "target")]
)


def words(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n))


def odd_texts(seed=1):
    """Nulls, empty and blank texts, repeats, near copies, shared passages, long and non-Latin texts."""
    r = random.Random(seed)
    base, passage = words(r, 120), words(r, 70)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", "", " \n\t ", "one", "one", "three short words", base, base, " ".join(near), words(r, 40) + " " + passage, passage + " " + words(r, 30),
        words(r, 20) + " " + passage + words(r, 20), "ab" * 300, "é" * 150 + base[:260], "日本語 テキスト\U0001f600 " * 40, words(r, 4000), None, words(r, 6), words(r, 55),
    ]


def documents(spark, texts=None, ids=None):
    texts = odd_texts() if texts is None else texts
    ids = [7 * i + 50 for i in range(len(texts))] if ids is None else ids
    sources = ["a", "b", None, "Z", "é"]
    rows = [(i, t, "en", sources[k % 5], None, *(["?"] * 10)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
