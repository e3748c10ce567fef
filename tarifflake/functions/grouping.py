"""Group operations that stay parallel when one key holds a large share of the rows.

``first_by`` keeps one row per key with a rank limit that also runs before the shuffle, so a hot key shrinks to one
row per map task. ``maybe_in`` drops rows that cannot meet a set of keys before they are moved. ``numbered`` numbers rows inside a key through an ordered bucket of the sort column: rows are numbered
per (key, bucket) and shifted by the sizes of the earlier buckets, so no task sees a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .keys import col

#: Bits of the field in which ``maybe_in`` marks keys: at most a million words of 64 bits.
MARKS = 1 << 26
#: Parts by the hash of their key in which rows are counted first.
PARTS = 16_384


def first_by(df: DataFrame, keys: list, order: list[Column], latest: bool = False) -> DataFrame:
    """One whole row per key: the lowest (or, with ``latest``, the highest) by ``order``. The rank filter is applied
    in every map task before the shuffle, and unused columns are pruned."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[o.desc() if latest else o.asc() for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def maybe_in(df: DataFrame, keys: DataFrame, on: list[str], rest: bool = False) -> DataFrame:
    """The rows whose columns ``on`` may be among those of ``keys``: all that are, and a few that are not, so an exact
    join has to follow. With ``rest``, the other rows. The keys are marked by hash in a field of ``MARKS`` bits that every
    task has at hand; however many keys there are, it has no more than ``MARKS / 64`` words. More keys let more other rows
    through."""
    mark = F.xxhash64(*on).bitwiseAND(F.lit(MARKS - 1))
    bit = F.expr("shiftleft(1L, cast(__mark & 63 as int))")
    types = [(c, df.schema[c].dataType, keys.schema[c].dataType) for c in on]  # equal values of other types have other hashes
    same = [F.col(c) if t.simpleString() == k.simpleString() else F.col(c).cast(t).alias(c) for c, t, k in types]
    marked = keys.select(*same).select(mark.alias("__mark")).groupBy(F.shiftright("__mark", 6).alias("__at")).agg(F.bit_or(bit).alias("__bits"))
    met = (F.shiftright("__mark", 6) == F.col("__at")) & (F.col("__bits").bitwiseAND(bit) != 0)
    return df.withColumn("__mark", mark).join(F.broadcast(marked), met, "left_anti" if rest else "left_semi").drop("__mark")


def big_groups(df: DataFrame, key: str, most: int, odd: Column | None = None) -> DataFrame | None:
    """The values of ``key`` that more than ``most`` rows have, or any row that is ``odd``; None if there are none. Rows are
    counted in ``PARTS`` by the hash of their key before any key is counted, so little is moved."""
    rows = df.select(key, (F.lit(False) if odd is None else odd).alias("odd"), F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part"))
    counts = [F.count(F.lit(1)).alias("n"), F.max("odd").alias("odd")]
    apart = (F.col("n") > most) | F.col("odd")
    parts = stage(rows.groupBy("part").agg(*counts).filter(apart).select("part"))
    if parts.isEmpty():
        return None
    found = stage(rows.join(F.broadcast(parts), "part", "left_semi").groupBy(key).agg(*counts).filter(apart).select(key))
    return None if found.isEmpty() else found


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rn") -> DataFrame:
    """Adds 1..n per key. ``bucket`` must not decrease along ``order`` and should cut a big key into many parts."""
    tagged = df.withColumn("__b", bucket)
    sizes = tagged.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        *[F.col(k).alias(f"__s_{k}") for k in keys],
        F.col("__b").alias("__sb"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    local = tagged.withColumn("__rn", F.row_number().over(inside))
    same = F.col("__b").eqNullSafe(F.col("__sb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    out = local.join(shift, same, "inner").withColumn(name, F.col("__rn") + F.col("__shift"))
    return out.drop("__b", "__rn", "__sb", "__shift", *[f"__s_{k}" for k in keys])


def previous_row(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], fields: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds the ``fields`` of the row before this one in its group. Rows look back inside their own bucket; the first
    row of a bucket takes the last row of the bucket before, so a big group is cut into many small windows."""
    row = F.struct(*fields)
    tagged = df.withColumn("__b", bucket)
    ends = tagged.groupBy(*keys, "__b").agg(F.max_by(row, F.struct(*order)).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__b")
    carry = ends.select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col("__b").alias("__cb"), F.lag("__last").over(w).alias("__carry"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    local = tagged.withColumn("__lag", F.lag(row).over(inside))
    same = F.col("__b").eqNullSafe(F.col("__cb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__c_{k}"))
    prev = F.coalesce("__lag", "__carry")
    out = local.join(carry, same, "inner").withColumns({f"{prefix}{f}": prev[f] for f in fields})
    return out.drop("__b", "__lag", "__cb", "__carry", *[f"__c_{k}" for k in keys])
