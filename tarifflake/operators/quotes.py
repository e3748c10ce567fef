"""Quotations as frozen trip documents: one nested record per trip, and back to rows without loss.

A snapshot holds the trip, its days and its items in order, and the totals of that moment. Rows that come out of one are
numbered inside their trip; trips that come out of one get ids above all that exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a snapshot keeps of a trip; customers and the like go over to a trip that continues it, not to a copy.
PLAN = ["title", "destination", "start_date", "adults", "children_with_bed", "children_without_bed", "extra_beds", "currency", "markup_pct", "gst_pct", "chosen_option"]
PEOPLE = ["customer_name", "customer_phone", "customer_email", "lead_source", "assigned_to"]
DAY = ["position", "title", "overnight", "source_package_id"]
ITEM = ["id", "kind", "ref_id", "day_position", "description", "quantity", "amount", "currency", "optional", "option_label"]
TOTALS = ["cost", "markup", "gst", "sell", "per_person", "travellers", "currency", "options"]


def snapshots(trips: DataFrame, days: DataFrame, items: DataFrame, totals: DataFrame) -> DataFrame:
    """``trip_id`` and ``snapshot``: the trip as one record, with its days by position and its items by id."""
    d = days.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(*DAY))).alias("days"))
    i = items.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(*ITEM))).alias("items"))
    t = trips.select(F.col("id").alias("trip_id"), F.struct(*PLAN, *PEOPLE).alias("trip"))
    v = totals.select("trip_id", F.struct(*TOTALS).alias("totals"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    j = t.join(v, "trip_id").join(d, "trip_id", "left").join(i, "trip_id", "left")
    kinds = dict(d.dtypes) | dict(i.dtypes)
    return j.select("trip_id", F.struct("trip", none("days", kinds["days"]).alias("days"), none("items", kinds["items"]).alias("items"), "totals").alias("snapshot"))


def _money_text(currency: Column, amount: Column) -> Column:
    return F.concat_ws(" ", currency, F.format_number(F.round(F.coalesce(amount, F.lit(0)).cast("decimal(20,2)"), 0), 0))


def save(trips: DataFrame, days: DataFrame, items: DataFrame, totals: DataFrame, quotes: DataFrame, today, valid_days: int = 7, prefix: str = "Q") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A quotation of every trip that can be quoted (no template, and with days or items). Returns (quotations with their
    snapshot, the status of trips that it changes, note rows). Versions go on from the trip's ``quotes``."""
    last = quotes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    before = quotes.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    s = snapshots(trips.filter("not is_template"), days, items, totals)
    s = s.filter((F.size("snapshot.days") > 0) | (F.size("snapshot.items") > 0)).join(before, "trip_id", "left")
    ident = F.col("trip_id") + F.lit(last)
    q = s.select(
        ident.alias("id"), "trip_id", (F.coalesce("n", F.lit(0)) + 1).alias("version"), F.lit("draft").alias("status"), F.format_string(prefix + "-%d-%04d", F.year(F.lit(today)), ident).alias("number"),
        F.date_add(F.lit(today), valid_days).alias("valid_until"), *[F.col(f"snapshot.trip.{c}").alias(c) for c in ("title", "customer_name", "destination", "start_date")],
        F.col("snapshot.totals.travellers").alias("travellers"), F.col("snapshot.totals.currency").alias("currency"), F.col("snapshot.totals.sell").alias("total"), F.col("snapshot.totals.per_person").alias("per_person"), "snapshot",
    )
    moved = trips.filter("status = 'enquiry'").join(q.select(F.col("trip_id").alias("id")), "id", "left_semi").select("id", F.lit("quoted").alias("status"))
    text = F.concat(F.lit("Quotation "), "number", F.lit(" (v"), F.col("version").cast("string"), F.lit(") saved: "), _money_text(F.col("currency"), F.col("total")))
    return q, moved, q.select("trip_id", text.alias("text"))


def rows_of(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(days, items) of the snapshots, under the quotation's ``trip_id``."""
    days = quotes.select("trip_id", F.inline("snapshot.days"))
    return days, quotes.select("trip_id", F.inline("snapshot.items"))


def restore(quotes: DataFrame, trips: DataFrame, days: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips, days, items) after each quotation (one per trip) is put back into its trip. Other trips stay as they are; a
    quotation whose trip is gone is left to ``new_trips``."""
    q = quotes.join(trips.select(F.col("id").alias("trip_id")), "trip_id", "left_semi")
    told = q.select(F.col("trip_id").alias("__t"), "snapshot")
    j = trips.join(told, F.col("id") == F.col("__t"), "left")
    known = F.col("snapshot").isNotNull()
    kept = {c: F.when(known, F.col(f"snapshot.trip.{c}") if c == "start_date" else F.coalesce(f"snapshot.trip.{c}", c)).otherwise(F.col(c)) for c in PLAN}
    head = j.withColumns(kept).drop("__t", "snapshot")
    own_days, own_items = rows_of(q)
    gone = q.select("trip_id")
    return head, days.join(gone, "trip_id", "left_anti").select("trip_id", *DAY).unionByName(own_days), items.join(gone, "trip_id", "left_anti").select("trip_id", *ITEM).unionByName(own_items)


def new_trips(quotes: DataFrame, trips: DataFrame, title: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(trips, days, items, notes): a fresh enquiry from each quotation. A copy under another ``title`` starts without the
    customer."""
    last = trips.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    q = quotes.withColumn("trip_id", F.col("id") + F.lit(last))
    people = [(F.col(f"snapshot.trip.{c}") if title is None else F.lit(None).cast("string")).alias(c) for c in PEOPLE]
    plan = [(F.lit(title) if c == "title" and title else F.col(f"snapshot.trip.{c}")).alias(c) for c in PLAN]
    head = q.select(F.col("trip_id").alias("id"), *plan, *people, F.lit("enquiry").alias("status"), F.lit(False).alias("is_template"))
    days, items = rows_of(q)
    return head, days, items, q.select("trip_id", F.concat(F.lit("Started from quotation "), "number").alias("text"))


def status_notes(quotes: DataFrame, trips: DataFrame) -> DataFrame:
    """``trip_id``, ``quote_id``, ``text``: the note that saving a quotation leaves, and the one when it is accepted.
    ``quotes`` have their number and version."""
    t = trips.select(F.col("id").alias("trip_id"), F.col("chosen_option").alias("__own"))
    q = quotes.join(t, "trip_id")
    saved = F.concat(F.lit("Quotation "), "number", F.lit(" (v"), F.col("version").cast("string"), F.lit(") saved: "), _money_text(F.lit("INR"), F.col("total")))
    chosen = F.coalesce("chosen_option", "__own")
    accepted = F.concat(F.lit("Quotation "), "number", F.lit(" accepted"), F.coalesce(F.concat(F.lit(" ("), chosen, F.lit(")")), F.lit("")))
    return q.select("trip_id", F.col("id").alias("quote_id"), saved.alias("text")).unionByName(q.filter("status = 'accepted'").select("trip_id", F.col("id").alias("quote_id"), accepted.alias("text")))
