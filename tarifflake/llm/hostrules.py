"""Quality rules by host.

Every text is measured, every rule says which texts fail it, and failures are added up per host. A host's rate of each
rule is shrunk towards all hosts' with an empirical beta prior (its mean is the share of all texts that fail, its
strength follows from the spread of the hosts' rates), so a host with few texts is judged mostly by what is usual. A host
most of whose texts are to be expected to fail one rule is refused with all its texts.

Only measures are shuffled, not texts. Hosts' verdicts meet their documents in several parts per host, so a host with a
large share of all rows is spread over tasks.

Defined cases: a null text has no words; a null host is a host of its own; rows with equal or null ids are rows of their
own; an empty table gives no rows; columns besides ``doc_id``, ``text`` and the host are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PCT = 50, 50
#: Further rules, which count for hosts only: symbols per 100 words, and repeated lines per 100 words.
MOST_SYMBOLS_PCT, MOST_DUP_LINES_PCT = 10, 10
#: A host is refused from this expected rate of failures on.
REFUSED_AT = 0.5
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0
SPREAD = 16
RULES = ["short", "repeating", "symbols", "dup_lines"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows of three. White space is that of
    ASCII, which is what splits bytes."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blank = len(data) - sum(map(len, words))
    symbols = sum(map(data.count, (bytes([s]) for s in SYMBOLS)))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return len(words), len(text) - blank, symbols, dup, repeated


def measured(docs: DataFrame, host: Column) -> DataFrame:
    """``doc_id``, ``host`` and the measures of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                rows = [measure(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *[pa.array(c, pa.int64()) for c in zip(*rows)]], ["doc_id", "host", *MEASURES])

    rows = docs.select("doc_id", host.cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, host string, {', '.join(f'{m} bigint' for m in MEASURES)}")


def failures() -> dict[str, Column]:
    """Which texts fail each rule, from their measures."""
    words = F.col("n_words")
    return {
        "short": words < LEAST_WORDS,
        "repeating": 100 * F.col("n_repeat_words") > MOST_REPEATED_PCT * words,
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS_PCT * words,
        "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES_PCT * words,
    }


def host_verdicts(stats: DataFrame, refused_at: float = REFUSED_AT) -> DataFrame:
    """``host``, ``docs``, and for each rule the failures and the shrunken rate (``<rule>_rate``); ``refused``."""
    hosts = saved(stats.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(c).alias(r) for r, c in failures().items()]))
    figures = []
    for r in RULES:
        rate = F.col(r) / F.col("docs")
        figures += [(F.sum(r) / F.sum("docs")).alias(f"{r}_mean"), F.var_pop(rate).alias(f"{r}_spread")]
    prior = hosts.agg(*figures).first()
    out = hosts
    for r in RULES:
        mean, spread = prior[f"{r}_mean"] or 0.0, prior[f"{r}_spread"] or 0.0
        strength = max(WEAKEST, min(STRONGEST, mean * (1 - mean) / spread - 1)) if spread > 0 else STRONGEST
        out = out.withColumn(f"{r}_rate", (F.col(r) + mean * strength) / (F.col("docs") + strength))
    refused = F.greatest(*[F.col(f"{r}_rate") for r in RULES]) >= refused_at
    return out.select("host", "docs", *RULES, *[f"{r}_rate" for r in RULES], refused.alias("refused"))


def judged(docs: DataFrame, host: Column | None = None, refused_at: float = REFUSED_AT) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``kept``, ``host`` and ``host_refused`` of every row of ``docs``."""
    stats = saved(measured(docs, F.col("source") if host is None else host))
    refused = host_verdicts(stats, refused_at).filter("refused")
    parts = refused.select(F.col("host").alias("__host"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__part"))
    part = F.pmod(F.xxhash64("doc_id", *MEASURES), F.lit(SPREAD)).cast("int")
    met = stats.withColumn("part", part).join(parts, F.col("host").eqNullSafe(F.col("__host")) & (F.col("part") == F.col("__part")), "left")
    fails = failures()
    base = fails["short"] | fails["repeating"]
    bad_host = F.col("__part").isNotNull()
    return met.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & ~bad_host).alias("kept"), "host", bad_host.alias("host_refused"))
