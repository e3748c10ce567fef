"""The dated load of service rates.

A service is known by its supplier, kind, vehicle and basis, and by a name that sheets word a little differently. A line
is compared with the rates under its own name if an earlier sheet brought some, else with those under the closest name
that an earlier sheet brought, if it is close enough; it is stored under its own name. So what a line is compared with
depends on what is stored when it comes, and what is stored on the comparisons before: both are worked out in turn until
they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import name_key
from ..functions.similarity import similar_pairs
from ..session import stage
from .match import SERVICES
from .ownership import line_cuts, rebuild_keys, same_lines, slices

#: What makes two services comparable, the name aside.
BLOCK = ["supplier_id", "kind", "vehicle_type", "basis"]
RATE_KEY = "concat_ws('|', block, name)"


def named_lines(lines: DataFrame) -> DataFrame:
    """Service lines in the shape of the ledger. Price terms are the amount, its upper end and the currency."""
    block = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in BLOCK])
    ident = F.concat_ws("-", F.col("document_id").cast("string"), F.col("line_no").cast("string"))
    return lines.select(
        ident.alias("id"), block.alias("block"), name_key("name").alias("name"), "document_id", "approval_seq", "line_no", "valid_from", "valid_to", name_key("season_name").alias("season"),
        "amount", "currency", F.col("amount_max").cast("string").alias("upto"), F.lit(None).cast("boolean").alias("taxes_included"),
    ).withColumn("basis", F.col("upto")).drop("upto")


def compared(lines: DataFrame, stored: DataFrame, close: DataFrame) -> DataFrame:
    """``lines`` with ``rate_key`` and ``compare_key``. ``stored``: the lines that are kept; ``close``: block, name, other,
    score of the names of a block that are close enough to each other."""
    since = stored.groupBy("block", "name").agg(F.min("approval_seq").alias("since"))
    own = lines.join(since, ["block", "name"], "left")
    unknown = own.filter(F.col("since").isNull() | (F.col("since") >= F.col("approval_seq"))).select("id", "block", "name", "approval_seq")
    others = close.join(since.withColumnRenamed("name", "other"), ["block", "other"])
    met = unknown.join(others, ["block", "name"]).filter(F.col("since") < F.col("approval_seq"))
    best = met.groupBy("id").agg(F.max_by("other", F.struct("score", -F.col("since"))).alias("best"))
    j = lines.join(best, "id", "left")
    return j.withColumn("rate_key", F.expr(RATE_KEY)).withColumn("compare_key", F.concat_ws("|", "block", F.coalesce("best", "name"))).drop("best")


def _looked_at(part: DataFrame, close: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the ``asking`` lines of ``part`` with the key they are compared with, the ids of those that are same) if the lines
    that ``writes`` says are kept. ``part`` has all lines under the names that the asking ones may be compared with."""
    now = stage(compared(part.filter("asking"), part.filter("writes"), close))
    placed = now.unionByName(part.filter("not asking").withColumn("compare_key", F.col("rate_key")))
    return now, same_lines(now, line_cuts(placed, "slice", "writes"), placed.filter("writes")).distinct()


def rebuild(lines: DataFrame, threshold: float = SERVICES) -> tuple[DataFrame, DataFrame]:
    """(ledger, changes) of all service lines, as ``ownership.rebuild`` has them for hotel rates. What a line does depends
    on earlier lines only, so the rounds end and there is one answer. The first round takes all lines to write; after it
    only names whose kept lines changed in the last round, and names close to them, are looked at again."""
    every = named_lines(lines).withColumn("rate_key", F.expr(RATE_KEY))
    every = stage(every.withColumn("slice", slices(every)).repartition("id"))
    names = every.select("block", "name").distinct()
    close = similar_pairs(names, names, threshold).filter("q <> d")
    close = stage(close.select("block", F.col("q").alias("name"), F.col("d").alias("other"), "score"))
    links = close.select(F.concat_ws("|", "block", "name").alias("rate_key"), F.concat_ws("|", "block", "other").alias("other"))
    # lines without a number or a sheet may share an id under several names; flags and comparisons are by id
    several = every.groupBy("id").agg(F.min("rate_key").alias("a"), F.max("rate_key").alias("z")).filter("a <> z").select("id")
    several = stage(every.join(several, "id", "left_semi").select("id", "block", "name", "rate_key").distinct())
    more = several.select("id", "rate_key", F.col("block").alias("here")).join(several.select("id", "block", "name"), "id").join(close, ["block", "name"])
    links = stage(links.unionByName(more.select("rate_key", F.concat_ws("|", "here", "other").alias("other"))).distinct())
    yes = F.lit(True)
    first, same = _looked_at(every.withColumn("asking", yes).withColumn("writes", yes), close)
    found = stage(same.withColumn("same", yes))  # the lines that are not as the first round took them, or once were not
    dirty = stage(first.join(found, "id", "left_semi").select("rate_key").distinct())
    while dirty.take(1):
        again = stage(dirty.unionByName(links.join(dirty.withColumnRenamed("rate_key", "other"), "other", "left_semi").select("rate_key")).distinct())
        ids = stage(several.join(again, "rate_key", "left_semi").select("id").distinct())
        asked = again.unionByName(several.join(ids, "id", "left_semi").select("rate_key")).distinct()
        met = asked.unionByName(links.join(asked, "rate_key", "left_semi").select(F.col("other").alias("rate_key")))
        near = met.distinct().join(again.withColumn("asking", yes), "rate_key", "left")
        part = every.join(near, "rate_key").join(ids.withColumn("by_id", yes), "id", "left").join(found, "id", "left")
        part = part.withColumn("asking", F.coalesce("asking", "by_id", F.lit(False))).withColumn("writes", ~F.coalesce("same", F.lit(False))).drop("by_id", "same")
        now, same = _looked_at(stage(part), close)
        looked = now.groupBy("id").agg(F.first("writes").alias("wrote"), F.collect_set("rate_key").alias("keys")).join(same.withColumn("same", yes), "id", "left")
        looked = stage(looked.withColumn("same", F.coalesce("same", F.lit(False))))
        dirty = stage(looked.filter("same = wrote").select(F.explode("keys").alias("rate_key")).distinct())
        found = stage(found.join(looked, "id", "left_anti").unionByName(looked.select("id", "same")))
    same = found.filter("same").select("id")
    told = stage(compared(every, every.join(same, "id", "left_anti"), close))
    writers = stage(told.join(same, "id", "left_anti"))
    return rebuild_keys(told, (writers, stage(line_cuts(writers, "slice"))))
