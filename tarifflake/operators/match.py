"""Suppliers, hotels, rooms and services recognised by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fill, name_key
from ..functions.similarity import similar_pairs, token_sort_udf

NAMES, SERVICES, PACKAGES, DUPLICATES = 88, 92, 86, 85


def best_match(queries: DataFrame, known: DataFrame, threshold: float = NAMES, how: str = "name") -> DataFrame:
    """The known row each query means: the best score at or above the threshold, lowest id among equals.

    ``queries``: query_id, block, name_key (several blocks per query are allowed). ``known``: id, block, name_key.
    Nothing scores above the same words, so names are compared only for queries that no known name has the words of."""
    k = known.groupBy("block", F.col("name_key").alias("name")).agg(F.min("id").alias("id"))
    if how == "set":  # sets of words may be equal in other ways
        return _closest(queries, k, threshold, how)
    words = F.array_join(F.array_sort(F.split("name", " ")), " ").alias("words")
    plain = k.filter("name <> ''").groupBy("block", words).agg(F.min("id").alias("id"))
    asked = queries.filter("name_key <> ''").select("query_id", "block", F.col("name_key").alias("name")).select("query_id", "block", words)
    equal = asked.join(plain, ["block", "words"]).groupBy("query_id").agg(F.min("id").alias("id"), F.lit(100.0).alias("score"))
    others = queries.join(equal.select("query_id"), "query_id", "left_anti")
    return equal.unionByName(_closest(others, k.join(others.select("block").distinct(), "block", "left_semi"), threshold, how))


def _closest(queries: DataFrame, k: DataFrame, threshold: float, how: str) -> DataFrame:
    q = queries.select("block", F.col("name_key").alias("name")).distinct()
    pairs = similar_pairs(q, k, threshold, how)
    top = pairs.join(k.withColumnRenamed("name", "d"), ["block", "d"]).groupBy("block", F.col("q").alias("name_key")).agg(
        F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("best")
    )
    j = queries.join(top, ["block", "name_key"]).groupBy("query_id").agg(F.max("best").alias("best"))
    out = queries.select("query_id").distinct().join(j, "query_id", "left")
    return out.select("query_id", (-F.col("best.neg")).alias("id"), F.col("best.score").alias("score"))


def city_blocks(df: DataFrame, city: str, known: bool) -> DataFrame:
    """Hotels meet within a city. A known hotel without a city meets every query; a query without one meets all."""
    c = F.lower(F.trim(F.coalesce(F.col(city), F.lit(""))))
    own = F.when(c == "", "(none)").otherwise(c)
    blocks = F.array(own, F.lit("*")) if known else F.when(c == "", F.array(F.lit("*"))).otherwise(F.array(own, F.lit("(none)")))
    return df.withColumn("block", F.explode(blocks))


def match_hotels(queries: DataFrame, hotels: DataFrame) -> DataFrame:
    """``queries``: query_id, name, city."""
    q = city_blocks(queries, "city", False).select("query_id", "block", name_key("name").alias("name_key"))
    k = city_blocks(hotels, "city", True).select("id", "block", name_key("name").alias("name_key"))
    return best_match(q, k)


def match_in(queries: DataFrame, known: DataFrame, keys: list[str], threshold: float = NAMES) -> DataFrame:
    """Names matched among rows that agree on ``keys`` (missing agrees with missing): rooms of a hotel, services of a
    supplier, kind, vehicle and basis."""
    block = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys])
    q = queries.select("query_id", block.alias("block"), name_key("name").alias("name_key"))
    k = known.select("id", block.alias("block"), name_key("name").alias("name_key"))
    return best_match(q, k, threshold)


def resolve(incoming: DataFrame, known: DataFrame, matched: DataFrame, fields: list[str], new_key: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(query_id -> id, the known table after the load). Matched rows fill the blanks of known ones; the others
    become new rows, one per distinct key, with ids derived from that key."""
    m = incoming.join(matched.select("query_id", "id"), "query_id", "left")
    new_id = -F.abs(F.xxhash64(*new_key))
    m = m.withColumn("final_id", F.coalesce("id", new_id))
    first = [F.min_by(F.nullif(F.col(f).cast("string"), F.lit("")), F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull(), F.col("query_id"))).alias(f"in_{f}") for f in fields]
    agg = m.groupBy(F.col("final_id").alias("fid")).agg(F.min_by("name", "query_id").alias("in_name"), *first)
    j = known.join(agg, known["id"] == agg["fid"], "full")
    out = j.select(F.coalesce("id", "fid").alias("id"), F.coalesce("name", "in_name").alias("name"), *[fill(F.col(f).cast("string"), f"in_{f}").alias(f) for f in fields])
    return m.select("query_id", F.col("final_id").alias("id")), out


def core_title_pairs(uploads: DataFrame, packages: DataFrame, threshold: float | None) -> DataFrame:
    """The score step of family matching: core titles of one supplier, token-sort only. Without a threshold every pair of
    titles whose nights agree is scored."""
    if threshold is None:
        p = uploads.join(packages, "supplier_id").filter(F.col("nights").isNull() | F.col("c_nights").isNull() | (F.col("nights") == F.col("c_nights")))
        return p.select("supplier_id", "core", "c_core").distinct().withColumn("score", token_sort_udf("core", "c_core"))
    a = uploads.select(F.col("supplier_id").cast("string").alias("block"), F.col("core").alias("name"))
    b = packages.select(F.col("supplier_id").cast("string").alias("block"), F.col("c_core").alias("name"))
    p = similar_pairs(a, b, threshold, "sort")
    return p.select(F.col("block").alias("supplier_id"), F.col("q").alias("core"), F.col("d").alias("c_core"), "score")


def similar_suppliers(suppliers: DataFrame) -> DataFrame:
    """Pairs of different supplier names that may be one company (names, not records: copies of a name are one)."""
    n = suppliers.select(F.lit("*").alias("block"), name_key("name").alias("name")).distinct()
    p = similar_pairs(n, n, DUPLICATES, "set")
    return p.filter("q < d").select(F.col("q").alias("name_a"), F.col("d").alias("name_b"), F.round("score", 1).alias("score"))
