"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, documents in ascending id order, are packed into blocks of ``block`` words (the last is
shorter). Each source has as many slots in the mix as its target needs. Slots are dealt to output shards by a
pseudorandom permutation of all slots, so the counts of the sources in a shard are a multinomial draw whose totals are
bound to the targets. Slot j of a source takes a block: full rounds over all blocks, each in another pseudorandom
order, and the last slot is cut where the target is reached. Documents are joined to slots by source and block number.

Defined cases: a null text has no words; a null source is a source of its own, last in order; rows with equal ids are
ordered by size; documents without words are returned with nothing taken; columns besides ``doc_id``, ``text`` and
``source`` are not read for the figures. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucket_of, cut_points, order_key, partitions, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
LIMIT = 3
ROUNDS = 12


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def permuted(df: DataFrame, x: str, n: str, key: Column, name: str) -> DataFrame:
    """Adds ``name``: the place of ``x`` in a pseudorandom permutation of 0..n-1 chosen by ``key``. Each round pairs x
    with K - x modulo n, and one bit of a hash of the pair's larger member says whether the two change places."""
    out = df.withColumn(name, F.col(x)).withColumn("__key", key.cast("bigint"))
    for r in range(ROUNDS):
        k = F.pmod(F.xxhash64("__key", F.lit(r)), F.col(n))
        out = out.withColumn("__other", F.pmod(k - F.col(name), F.col(n)))
        bit = F.xxhash64(F.greatest(F.col(name), F.col("__other")), F.col("__key"), F.lit(-1 - r)).bitwiseAND(F.lit(1).cast("bigint"))
        out = out.withColumn(name, F.when(bit == 1, F.col("__other")).otherwise(F.col(name)))
    return out.drop("__other", "__key")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``source``, ``source_no``, ``source_size``, ``target``. The targets are weight * level, or ``limit`` times the
    size where that is less; the level is the one at which they add up to all words. One row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("__w", w).withColumn("__cap", F.col("source_size") * float(limit))
    full = Window.orderBy(F.col("__cap") / F.col("__w"), "source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    rows = rows.withColumn("__left_w", F.sum("__w").over(every) - F.sum("__w").over(full) + F.col("__w"))
    rows = rows.withColumn("__left", F.sum("source_size").over(every) - F.sum("__cap").over(full) + F.col("__cap"))
    rows = rows.withColumn("__level", F.col("__left") / F.col("__left_w"))
    # in order of cap / weight, the level is the first that the source's own cap doesn't cut
    level = F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), F.col("source_no"), F.col("__level").alias("level")))).over(every)["level"]
    return rows.withColumn("target", F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.lit(0.0)))).select("source", "source_no", "source_size", "target")


def laid_out(docs: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """One row per document with its size, its source's figures, the place of its first word in the source's stream
    (``start``) and a row number ``uid``. Sums run per source and range of ids, so no task sees a whole source."""
    base = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *extra))
    aims = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    rows = base.withColumn("__key", order_key(F.col("doc_id")))
    cuts = cut_points(rows, F.col("__key"), 4 * partitions(docs.sparkSession))
    aims = aims.withColumnRenamed("source", "__source")
    rows = rows.withColumn("__b", bucket_of(F.col("__key"), cuts)).join(aims, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    sums = rows.groupBy("source_no", "__b").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source_no").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("source_no", "__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("source_no", "__b").orderBy("__key", "size")
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(running), F.lit(0))).withColumn("uid", F.col("__b") * F.lit(2**40) + F.row_number().over(inside))
    return rows.join(shift, ["source_no", "__b"]).withColumn("start", F.col("__in") + F.col("__shift")).drop("__in", "__shift", "__b", "__key")


def slots(aims: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot of the mix: ``slot`` (its place), ``shard``, ``source_no``, ``pass`` (rounds over the source
    before it), ``block`` and ``words``, the number of words that it takes from the block's start."""
    size, t = F.col("source_size"), F.col("__t")
    rows = aims.filter("source_size > 0").withColumn("__t", F.round("target").cast("bigint"))
    rows = rows.withColumn("__full", F.floor(size / block).cast("bigint")).withColumn("__n", F.ceil(size / block).cast("bigint"))
    rows = rows.withColumn("__draws", F.floor(t / size).cast("bigint") * F.col("__n") + F.ceil((t % size) / block).cast("bigint"))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__from", F.coalesce(F.sum("__draws").over(before), F.lit(0))).withColumn("__slots", F.sum("__draws").over(Window.partitionBy())).filter("__draws > 0")
    step = 16_384
    parts = rows.withColumn("__lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__draws") - 1, F.lit(step).cast("bigint"))))
    parts = parts.repartition(partitions(aims.sparkSession), "source_no", "__lo")
    draws = parts.withColumn("__j", F.explode(F.sequence(F.col("__lo"), F.least(F.col("__lo") + step, F.col("__draws")) - 1)))
    draws = draws.withColumn("__at", F.col("__from") + F.col("__j")).withColumn("pass", F.floor(F.col("__j") / F.col("__n"))).withColumn("__pos", F.col("__j") % F.col("__n"))
    draws = permuted(draws, "__at", "__slots", F.lit(seed), "slot")
    draws = draws.withColumn("__m", F.greatest(F.col("__full"), F.lit(1)))
    draws = permuted(draws, "__pos", "__m", F.xxhash64(F.lit(seed), "source_no", "pass"), "__perm")
    number = F.when(F.col("__pos") < F.col("__full"), F.col("__perm")).otherwise(F.col("__full"))
    length = F.least(F.lit(block).cast("bigint"), size - F.col("block") * block, t - F.col("pass") * size - F.col("__pos") * block)
    draws = draws.withColumn("block", number).withColumn("words", length)
    return draws.select("slot", F.floor(F.col("slot") / shard_slots).alias("shard"), "source_no", "pass", "block", "words")


def shard_counts(taken_slots: DataFrame) -> DataFrame:
    """The source counts of each output shard."""
    return taken_slots.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("blocks"), F.sum("words").alias("words"))


def pieces(rows: DataFrame, block: int = 64, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """The documents of ``laid_out`` joined to the slots by source and block number: one row per document and slot that
    takes words of it (``at``: first word inside the document, ``n``: how many); one with nulls where none does."""
    aims = rows.groupBy("source_no").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    mix = saved(slots(aims, block, shard_slots, seed))
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    held = rows.withColumn("block", F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), last)))
    held = held.withColumn("block", F.explode_outer("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    out = held.join(mix, ["source_no", "block"], "left").withColumn("n", F.when(F.col("words").isNotNull(), F.greatest(hi - lo, F.lit(0))))
    return out.withColumn("at", lo - F.col("start"))


def mix_figures(docs: DataFrame, block: int = 64, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """Per document: its size, its source's size and target, the words taken (repeats counted) and the first slot that
    holds words of it."""
    rows = saved(laid_out(docs))
    out = pieces(rows, block, shard_slots, seed).groupBy("source_no", "uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("size").alias("size"),
        F.max("source_size").alias("source_size"),
        F.max("target").alias("target"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("taken"),
        F.min(F.when(F.col("n") > 0, F.col("slot"))).alias("first_slot"),
    )
    return out.drop("source_no", "uid")


def mixed_documents(docs: DataFrame, block: int = 64, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """The mix as documents: one row for each pass over a document that takes words of it, with the columns of ``docs``.
    A pass that takes all words keeps the text as it is; another has the words of its blocks, in order, with one space
    between. ``n_chars``, where there is one, follows the text."""
    rows = saved(laid_out(docs, [F.xxhash64("text").alias("__h")]))
    same = Window.partitionBy("doc_id", "source", "__h").orderBy("__h")
    held = pieces(rows, block, shard_slots, seed).filter("n > 0").groupBy("source_no", "uid", "pass").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("parts"))
    twin = rows.select("source_no", "uid", "doc_id", "source", "__h", F.row_number().over(same).alias("__twin"))
    held = held.join(twin, ["source_no", "uid"]).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__h").alias("__g"), F.col("__twin").alias("__t"), F.col("n").alias("__n"), F.col("size").alias("__size"), F.col("parts").alias("__parts"))
    texts = docs.withColumn("__h", F.xxhash64("text")).withColumn("__twin", F.row_number().over(same))
    match = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__h") == F.col("__g")) & (F.col("__twin") == F.col("__t"))
    out = texts.join(held, match)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(F.col("__words"), (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
    whole = F.col("__n") == F.col("__size")
    out = out.withColumn("__words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    changed = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(changed).select(*docs.columns)
