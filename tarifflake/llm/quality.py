"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are counted over whole texts in Arrow batches: byte classes, words, lines and repeats. Class means and
covariances come from moment sums that each task adds up over its labelled rows, so all labelled rows take part and the
driver gets a few sums per task. A class covariance is shrunk towards the pooled one and towards its own diagonal; its
Cholesky factor is inverted once and cached in the model. The score is the logistic of the difference of the Gaussian
log densities plus the log prior odds.

Defined cases: null and empty texts have statistics of zero and are scored like any other; a null id counts as an empty
string in the held-out rule; of repeated labels of one document the lowest counts, null labels don't; with fewer than
two labelled rows of either class every score is the share of label 1 (0.5 without labels). Columns besides ``doc_id``
and ``text`` are never read, so labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: The characters of each class; letters, digits and bytes beyond ASCII have classes of their own.
CLASSES = (" \t", "\n\r", ".", ",", "!?", ":;", "'\"`", "#$%&*@^~+=_\\", "|<>[]{}", "()-/")
N_CLASSES = len(CLASSES) + 6
DAMPING = 8.0
NAMES = (
    "word_length", "upper", "digits", "high", "controls", "full_stops", "commas", "exclaims", "colons", "quotes",
    "symbols", "bars", "brackets", "breaks", "distinct_words", "repeated_lines", "line_length", "plain_words", "long_words",
)


def _class_of_byte() -> np.ndarray:
    out = np.full(256, len(CLASSES), dtype=np.int64)  # controls and what is in no class
    for k, chars in enumerate(CLASSES):
        out[list(chars.encode())] = k
    base = len(CLASSES)
    out[ord("a") : ord("z") + 1] = base + 1
    out[ord("A") : ord("Z") + 1] = base + 2
    out[ord("0") : ord("9") + 1] = base + 3
    out[0xC0:] = base + 4
    out[0x80:0xC0] = base + 5
    return out


_CLASS = _class_of_byte()


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics per text, in the order of ``NAMES``."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    counts = np.bincount(owner * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    own = np.zeros((n, 6))
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split("\n")
        own[i] = len(words), len(set(words)), len(lines), len(set(lines)), sum(map(str.isalpha, words)), sum(len(w) > 16 for w in words)
    words, distinct, lines, distinct_lines, plain, long_words = own.T
    base = len(CLASSES)
    chars = counts.sum(1) - counts[:, base + 5]
    per_char, per_word = chars + 6 * DAMPING, words + DAMPING  # rates of short texts are drawn towards zero
    rate = lambda k: np.sqrt(counts[:, k] / per_word)
    columns = [
        np.log1p((chars + 6 * DAMPING) / per_word), np.sqrt(counts[:, base + 2] / per_char), np.sqrt(counts[:, base + 3] / per_char),
        np.sqrt(counts[:, base + 4] / per_char), np.sqrt(counts[:, base] / per_char), rate(2), rate(3), rate(4), rate(5), rate(6),
        rate(7), rate(8), rate(9), rate(1), np.log1p(distinct + DAMPING) / np.log1p(per_word), np.sqrt((lines - distinct_lines) / (lines + 3 * DAMPING)), np.log1p(chars / (lines + 1)),
        (plain + DAMPING) / per_word, np.sqrt(long_words / per_word),
    ]
    return np.stack(columns, 1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            x = statistics([t or "" for t in part.column("text").to_pylist()])
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "x"])


def with_statistics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    sums = {}
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y = b.column("label").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            z = np.hstack([np.ones((int((y == k).sum()), 1)), x[y == k]])
            sums[k] = sums.get(k, 0) + z.T @ z
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))], ["label", "m"])


@dataclass(frozen=True)
class Model:
    """Means, inverted Cholesky factors and log-density constants of both classes; ``prior`` is the share of label 1."""

    prior: float
    means: tuple = ()
    factors: tuple = ()
    constants: tuple = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(moments: dict[int, np.ndarray], pooled: float = 0.3, diagonal: float = 0.1, floor: float = 1e-4) -> Model:
    """``moments``: by class, the sum of (1, x) (1, x)'. ``pooled`` and ``diagonal`` are the shrinkage shares."""
    n = {k: m[0, 0] for k, m in moments.items()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.5
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return Model(prior)
    mean = {k: moments[k][0, 1:] / n[k] for k in (0, 1)}
    cov = {k: moments[k][1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
    both = (n[0] * cov[0] + n[1] * cov[1]) / total
    means, factors, constants = [], [], []
    for k in (0, 1):
        c = (1 - pooled) * cov[k] + pooled * both
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + floor * np.eye(len(c))
        low = np.linalg.cholesky(c)
        means.append(mean[k])
        factors.append(np.linalg.inv(low))
        constants.append(float(np.log(n[k] / total) - np.log(np.diag(low)).sum()))
    return Model(prior, tuple(means), tuple(factors), tuple(constants))


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Fits on all rows of ``labels`` (``doc_id``, ``label`` 0 or 1) that have statistics."""
    once = labels.filter("label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    rows = stats.join(once, "doc_id").select("label", "x").mapInArrow(_moments, "label int, m array<double>")
    d = len(NAMES) + 1
    summed = rows.select("label", F.posexplode("m")).groupBy("label", "pos").agg(F.sum("col").alias("s")).collect()  # 2 classes, d * d sums
    moments = {}
    for r in summed:
        moments.setdefault(r["label"], np.zeros(d * d))[r["pos"]] = r["s"]
    return fit({k: m.reshape(d, d) for k, m in moments.items()})


def held_out_rule():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row; learns from labels outside the held-out fold."""
    stats = saved(with_statistics(docs))
    model = train(stats, labels.filter(~held_out_rule()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    out = stats.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out_rule().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold. Statistics are worked out again beside the row, so texts
    aren't shuffled and repeated ids do no harm."""
    model = train(saved(with_statistics(docs)), labels.filter(~held_out_rule()))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                score = model.score(statistics([t or "" for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(keep, docs.schema)
