"""Document fingerprints: SimHash in DataFrame operations only.

Every word of the lower-cased text votes on 128 signed bits of its hash, with its length in characters as weight, so
function words count little. Two 32-bit counters share one long: 64 sums hold the votes. They are added up in the map
tasks, so a text of any length leaves its task as one row of counters.

Defined cases: a null text counts as empty; a text without words has a fingerprint of zeros; equal texts have equal
fingerprints; rows with equal ids are ordered by text; a null id comes first; columns besides ``doc_id`` and ``text``
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucket_of, cut_points, order_key, partitions, saved

BITS = 128


def _votes() -> list[Column]:
    """64 sums: counter i in the low half, counter i + 32 in the high half of a long, for each of two hashes."""
    out = []
    for half in (0, 1):
        h = F.col(f"__h{half}")
        for i in range(32):
            low = F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1).cast("bigint"))
            high = F.shiftleft(F.shiftrightunsigned(h, i + 32).bitwiseAND(F.lit(1).cast("bigint")), 32)
            out.append(F.sum(low.bitwiseOR(high) * F.col("__w")).alias(f"__v{half}_{i}"))
    return out


def _bits(half: int) -> Column:
    """The 64 bits of one half: set where the weight for 1 is over half of all weight."""
    out = F.lit(0).cast("bigint")
    mask = F.lit(2**32 - 1).cast("bigint")
    for i in range(32):
        v = F.col(f"__v{half}_{i}")
        for j, n in ((i, v.bitwiseAND(mask)), (i + 32, F.shiftrightunsigned(v, 32))):
            bit = F.lit(1 << j if j < 63 else -(2**63)).cast("bigint")
            out = out.bitwiseOR(F.when(n * 2 > F.col("__all"), bit).otherwise(F.lit(0).cast("bigint")))
    return out


def simhash(df: DataFrame, text: str, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """``keys``, ``carry`` (fixed-width columns that depend on the keys) and the fingerprint as longs ``f0``, ``f1``."""
    words = df.select(*keys, *carry, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("__word"))
    voting = words.select(*keys, *carry, F.char_length("__word").cast("bigint").alias("__w"), F.xxhash64("__word").alias("__h0"), F.xxhash64("__word", F.lit(1)).alias("__h1"))
    sums = voting.groupBy(*keys).agg(F.sum("__w").alias("__all"), *[F.max(c).alias(c) for c in carry], *_votes())
    return sums.select(*keys, *carry, _bits(0).alias("f0"), _bits(1).alias("f1"))


def _hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def to_text(f0: str, f1: str) -> Column:
    return F.concat(_hex64(F.col(f0)), _hex64(F.col(f1)))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return 1 - distance(a0, a1, b0, b1) / F.lit(float(BITS))


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """Permuted block tables: of ``blocks`` equal blocks at least ``blocks - radius`` agree between fingerprints that
    differ in at most ``radius`` bits, so each choice of that many blocks is one table, keyed by those bits. Both inputs
    hold distinct ``f0``, ``f1``; the result has each pair (``q0``, ``q1``, ``f0``, ``f1``) once, with its distance."""
    if not radius < blocks or BITS % blocks:
        raise ValueError("blocks must be more than radius and divide the bits")
    width = BITS // blocks
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << width) - 1) << (width * b) for b in chosen)
        masks.append((m & (2**64 - 1), m >> 64))

    def signed(m: int) -> Column:
        return F.lit(m - 2**64 if m >= 2**63 else m).cast("bigint")

    def tables(df: DataFrame) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("f0").bitwiseAND(signed(a)).alias("k0"), F.col("f1").bitwiseAND(signed(b)).alias("k1")) for i, (a, b) in enumerate(masks)])
        return df.select("f0", "f1", F.explode(keys).alias("k")).select("f0", "f1", "k.*")

    asked = tables(queries).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), "t", "k0", "k1")
    d = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    found = asked.join(tables(fingerprints), ["t", "k0", "k1"]).filter(d <= radius)
    return found.groupBy("q0", "q1", "f0", "f1").agg(F.min(d).alias("distance"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with a row number ``uid``, that of the next row by ascending id (``next_uid``; after the last: the
    first) and its text. Rows are cut into ranges of the id; the first rows of a range also stand at the end of the range
    before, so each range is windowed alone and the texts move once."""
    key = order_key(F.col("doc_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("__key"))
    cuts = cut_points(rows, F.col("__key"), 4 * partitions(docs.sparkSession))
    n = max(1, len(cuts))
    b = bucket_of(F.col("__key"), cuts)
    first_of = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    is_first = F.array_contains(first_of, F.col("__key"))
    places = F.when(is_first, F.array(F.struct(b.alias("b"), F.lit(0).alias("guest")), F.struct(F.pmod(b - 1, F.lit(n)).alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(b.alias("b"), F.lit(0).alias("guest"))))
    placed = rows.withColumn("__at", F.explode(places)).select("*", "__at.b", "__at.guest").drop("__at")
    w = Window.partitionBy("b").orderBy("guest", "__key", "text")
    big = F.lit(2**40).cast("bigint")
    uid = F.col("b") * big + F.row_number().over(w)
    after = placed.select("doc_id", "text", "guest", "b", uid.alias("uid"), F.lead("text").over(w).alias("next_text"), F.lead("guest").over(w).alias("__g"))
    following = F.when(F.col("__g") == 1, F.pmod(F.col("b") + 1, F.lit(n)) * big + 1).otherwise(F.col("uid") + 1)
    return after.filter("guest = 0").select("doc_id", "uid", following.alias("next_uid"), "text", "next_text")


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The fingerprint of each text and of its edited text (its last half replaced by as much of the next document),
    with likenesses. Besides: ``class_id``, the smallest id with this fingerprint, and, for ids divisible by 50,
    ``n_near``, the number of other documents within ``radius`` bits."""
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "uid", "next_uid", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    digest = F.sha2(F.encode("edited", "UTF-8"), 256)
    words = [F.conv(F.substring(F.col("__sha"), 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"s{i}") for i in range(4)]
    rows = rows.withColumn("__sha", digest).select("doc_id", "uid", "next_uid", "n_chars", *words, F.array("text", "edited").alias("__both"))
    both = rows.select("doc_id", "uid", "next_uid", "n_chars", "s0", "s1", "s2", "s3", F.posexplode("__both").alias("kind", "text"))
    prints = simhash(both, "text", ["uid", "kind"], ["doc_id", "next_uid", "n_chars", "s0", "s1", "s2", "s3"])
    own = [F.max(F.when(F.col("kind") == k, F.col(f))).alias(f"{p}{f[1]}") for k, p in ((0, "f"), (1, "e")) for f in ("f0", "f1")]
    base = saved(prints.groupBy("uid").agg(*[F.max(c).alias(c) for c in ("doc_id", "next_uid", "n_chars", "s0", "s1", "s2", "s3")], *own))
    nexts = base.select(F.col("uid").alias("next_uid"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    classes = base.groupBy("f0", "f1").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("__members"))
    asked = base.filter("doc_id % 50 = 0").select("f0", "f1").distinct()
    pairs = within_radius(asked, classes.select("f0", "f1"), radius)
    near = pairs.join(classes.select("f0", "f1", "__members"), ["f0", "f1"]).groupBy("q0", "q1").agg((F.sum("__members") - 1).alias("__near"))
    near = near.select(F.col("q0").alias("f0"), F.col("q1").alias("f1"), "__near")
    out = base.join(nexts, "next_uid").join(classes.join(near, ["f0", "f1"], "left"), ["f0", "f1"])
    f0, f1, e0, e1, n0, n1 = (F.col(c) for c in ("f0", "f1", "e0", "e1", "n0", "n1"))
    return out.select(
        "doc_id",
        "n_chars",
        F.concat(*[_hex64(F.col(f"s{i}")) for i in range(4)]).alias("edited_sha256"),
        to_text("f0", "f1").alias("fingerprint"),
        to_text("e0", "e1").alias("edited_fingerprint"),
        likeness(f0, f1, e0, e1).alias("near_edited"),
        likeness(f0, f1, n0, n1).alias("near_next"),
        "class_id",
        F.when(F.col("doc_id") % 50 == 0, F.col("__near")).alias("n_near"),
    )
