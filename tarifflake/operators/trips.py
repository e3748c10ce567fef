"""Trip totals, dashboards, repricing and plan copies over all trips at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import numbered
from ..session import stage

# The stages of a trip and of a quotation.
TRIP_STATUSES = ["enquiry", "quoted", "confirmed", "completed", "lost"]
QUOTE_STATUSES = ["draft", "sent", "accepted", "declined", "expired"]
HUNDREDTH = "0.01"


def _times(c: Column, factor: Column, p: int) -> Column:
    """c * factor / 100 without a division, so no digits are lost."""
    return c * factor.cast(f"decimal({p},2)") * F.lit(HUNDREDTH).cast("decimal(3,2)")


def priced(cost, markup_pct, gst_pct) -> dict[str, Column]:
    c = F.coalesce(F.col(cost), F.lit(0)).cast("decimal(18,2)")
    m, g = F.coalesce(markup_pct, F.lit(0)), F.coalesce(gst_pct, F.lit(0))
    markup = _times(c, F.col(m) if isinstance(m, str) else m, 6)
    gross = _times(c, (F.lit(100) + m).cast("decimal(7,2)"), 7)
    gst = _times(gross, F.col(g) if isinstance(g, str) else g, 5)
    return {"cost": c, "markup": F.round(markup, 2), "gst": F.round(gst, 2), "sell_x": gross + gst}


def option_costs(items: DataFrame) -> DataFrame:
    """Per trip and option label (null = shared): the cost of its lines that count, and its first line."""
    included = F.when(~F.col("optional"), F.col("amount"))
    cur = F.when(~F.col("optional"), F.col("currency"))
    return items.groupBy("trip_id", "option_label").agg(
        F.coalesce(F.sum(included), F.lit(0)).cast("decimal(18,2)").alias("own"), F.min("id").alias("first_id"),
        F.min(cur).alias("cur_min"), F.max(cur).alias("cur_max"), F.count(F.lit(1)).alias("n_items"),
    )


def totals(trips: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Cost, markup, GST, selling price, paid and balance per trip. The headline is the chosen option, else the
    cheapest; lines without a label are in every option."""
    t = trips.select(F.col("id").alias("trip_id"), "chosen_option", "markup_pct", "gst_pct", F.col("currency").alias("own_currency"),
                     (F.col("adults") + F.col("children_with_bed") + F.col("children_without_bed")).alias("travellers"))
    per_option = option_costs(items).join(t.select("trip_id", "chosen_option"), "trip_id")
    label = F.col("option_label")
    cand = F.when(label.isNotNull(), F.struct(F.col("own"), F.col("first_id"), label.alias("label")))
    per_trip = per_option.groupBy("trip_id").agg(
        F.coalesce(F.sum(F.when(label.isNull(), F.col("own"))), F.lit(0)).alias("shared"),
        F.min(cand).alias("cheapest"),
        F.max(F.when(label == F.col("chosen_option"), cand)).alias("picked"),
        F.count(label).alias("options"),
        F.min("cur_min").alias("cur_min"), F.max("cur_max").alias("cur_max"), F.sum("n_items").alias("n_items"),
    )
    paid = payments.groupBy("trip_id").agg(F.sum("amount").alias("paid"))
    j = t.join(per_trip, "trip_id", "left").join(paid, "trip_id", "left")
    head = F.coalesce("picked", "cheapest")
    j = j.withColumn("head", head).withColumn("total_cost", F.coalesce("shared", F.lit(0)) + F.coalesce("head.own", F.lit(0)))
    p = priced("total_cost", F.col("markup_pct"), F.col("gst_pct"))
    j = j.withColumns(p)
    paid_c = F.coalesce("paid", F.lit(0)).cast("decimal(18,2)")
    return j.select(
        "trip_id", "cost", "markup", "gst", F.round("sell_x", 2).alias("sell"),
        F.round(F.col("sell_x") / F.nullif(F.col("travellers"), F.lit(0)), 2).alias("per_person"), "travellers",
        paid_c.alias("paid"), F.round(F.col("sell_x") - paid_c, 2).alias("balance"),
        F.coalesce("options", F.lit(0)).alias("options"), F.col("head.label").alias("option"),
        F.col("picked.label").alias("chosen_option"),
        (F.col("options") > 0).eqNullSafe(F.lit(True)).__and__(F.col("picked").isNull()).alias("is_from_price"),
        F.when(F.col("cur_min") == F.col("cur_max"), F.col("cur_min")).otherwise(F.col("own_currency")).alias("currency"),
        F.coalesce(F.col("cur_min") != F.col("cur_max"), F.lit(False)).alias("mixed_currency"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
    )


def option_prices(trips: DataFrame, items: DataFrame) -> DataFrame:
    """The selling price of every option of every trip."""
    c = option_costs(items)
    shared = c.filter("option_label is null").select("trip_id", F.col("own").alias("shared"))
    t = trips.select(F.col("id").alias("trip_id"), "markup_pct", "gst_pct", "chosen_option", (F.col("adults") + F.col("children_with_bed") + F.col("children_without_bed")).alias("travellers"))
    o = c.filter("option_label is not null").join(shared, "trip_id", "left").join(t, "trip_id")
    o = o.withColumn("total_cost", F.col("own") + F.coalesce("shared", F.lit(0))).withColumns(priced("total_cost", F.col("markup_pct"), F.col("gst_pct")))
    return o.select(
        "trip_id", F.col("option_label").alias("label"), "cost", F.round("sell_x", 2).alias("sell"),
        F.round(F.col("sell_x") / F.nullif(F.col("travellers"), F.lit(0)), 2).alias("per_person"),
        (F.col("option_label") == F.col("chosen_option")).eqNullSafe(F.lit(True)).alias("chosen"),
    )


def renumber(days: DataFrame, order: list[Column], bucket: Column, name: str = "position") -> DataFrame:
    """Positions 1, 2, 3 ... within each trip."""
    return numbered(days, ["trip_id"], bucket, order, name)


def insert_days(days: DataFrame, picks: DataFrame, after: DataFrame) -> DataFrame:
    """Library days put into trips after a position: later days move down. ``picks``: trip_id, pick_no, title,
    overnight; ``after``: trip_id, after_position, n_picks."""
    old = days.join(after, "trip_id", "left")
    shift = F.when(F.col("position") > F.col("after_position"), F.col("n_picks")).otherwise(0)
    old = old.select("trip_id", (F.col("position") + F.coalesce(shift, F.lit(0))).alias("position"), "title", "overnight")
    new = picks.join(after, "trip_id").select("trip_id", (F.col("after_position") + F.col("pick_no")).alias("position"), "title", "overnight")
    return old.unionByName(new)


def copy_plan(trips: DataFrame, days: DataFrame, items: DataFrame, new_id: Column, as_template: bool = False):
    """Fresh trips with the same days and costs: no customer, no payments, back to an enquiry. A template also drops
    its dates."""
    t = trips.withColumns({"new_id": new_id, "source_id": F.col("id")})
    head = t.select(
        F.col("new_id").alias("id"), "source_id",
        F.col("title") if as_template else F.concat(F.lit("Copy of "), "title").alias("title"),
        F.lit("enquiry").alias("status"), F.lit(None).cast("string").alias("customer_name"), "lead_source",
        (F.lit(None).cast("date") if as_template else F.col("start_date")).alias("start_date"),
        "adults", "children_with_bed", "children_without_bed", "extra_beds", "markup_pct", "gst_pct", "currency",
        "chosen_option", F.lit(as_template).alias("is_template"),
    )
    ids = t.select(F.col("source_id").alias("trip_id"), "new_id")

    def moved(df: DataFrame) -> DataFrame:
        return df.join(ids, "trip_id").withColumn("trip_id", F.col("new_id")).drop("new_id")

    return head, moved(days), moved(items)


def status_after(trips: DataFrame, events: DataFrame) -> DataFrame:
    """Trip status after quotation events: an accepted quotation confirms an open trip and sets its option, saving
    one turns an enquiry into a quoted trip. ``events``: trip_id, at, quote_id, status, chosen_option."""
    last = events.groupBy("trip_id").agg(
        F.bool_or(F.col("status") == "accepted").alias("accepted"),
        F.count(F.lit(1)).alias("quotes"),
        F.max_by(F.col("chosen_option"), F.when((F.col("status") == "accepted") & F.col("chosen_option").isNotNull(), F.struct("at", "quote_id"))).alias("picked"),
    )
    j = trips.join(last, trips["id"] == last["trip_id"], "left").drop("trip_id")
    open_ = F.col("status").isin("enquiry", "quoted")
    new = (
        F.when(open_ & F.coalesce("accepted", F.lit(False)), "confirmed")
        .when((F.col("status") == "enquiry") & (F.col("quotes") > 0), "quoted")
        .otherwise(F.col("status"))
    )
    return j.select("id", F.col("status").alias("status_before"), new.alias("status"), F.coalesce("picked", "chosen_option").alias("chosen_option"))


def service_quantity(basis, seats, adults, children) -> Column:
    """How often a service is charged for a group: vehicles by seats, heads by kind, once per group or when unknown."""
    pax = F.col(adults) + F.col(children)
    s = F.coalesce(F.col(seats), F.lit(0))
    return (
        F.when(F.col(basis) == "per_vehicle", F.when(s > 0, F.ceil(pax / s)).otherwise(1))
        .when(F.col(basis) == "per_adult", F.col(adults))
        .when(F.col(basis) == "per_child", F.col(children))
        .when(F.col(basis).isin("per_group", "unknown"), 1)
        .otherwise(pax)
    )


def reprice(items: DataFrame, trips: DataFrame, package_prices: DataFrame, services: DataFrame, library: tuple) -> DataFrame:
    """Every trip line priced again from the live rates, all trips at once.

    ``items`` carry their inputs: category, room_type_id, meal_plan, nights, set_quantity and manual_unit (a negotiated
    unit price, which sticks while quantities follow the group). ``library``: hotel rates, surcharges, rooms, hotels.
    Custom lines stay as they are; a hotel line without a date cannot be priced."""
    from .packages import price_packages
    from .stays import default_rooms, price_stays

    t = trips.select(F.col("id").alias("trip_id"), "adults", "extra_beds", "children_with_bed", "children_without_bed", "start_date", F.col("currency").alias("own_currency"))
    j = items.join(t, "trip_id").withColumn("request_id", F.concat_ws("-", "trip_id", "id"))
    none = F.array().cast("array<string>")

    p = j.filter("kind = 'package'")
    ask = p.select("request_id", F.col("ref_id").alias("package_id"), "category", "adults", "extra_beds", "children_with_bed", "children_without_bed", F.lit(0).alias("single_rooms"), F.col("start_date").alias("travel_date"), F.lit(None).cast("int").alias("pax_tier"))
    got = price_packages(ask, package_prices).select("request_id", F.col("total").cast("decimal(14,2)").alias("unit"), "currency", "errors").withColumn("auto_quantity", F.lit(1))

    h = j.filter("kind = 'hotel'").withColumn("check_in", F.date_add("start_date", F.coalesce("day_position", F.lit(1)) - 1)).filter("check_in is not null")
    h = h.select("request_id", F.col("ref_id").alias("hotel_id"), "room_type_id", "meal_plan", "check_in", F.date_add("check_in", F.coalesce("nights", F.lit(1))).alias("check_out"),
                 default_rooms("adults", "extra_beds", "children_with_bed", "children_without_bed").alias("rooms"), F.lit(True).alias("prefer_net"), F.lit(0).cast("decimal(6,2)").alias("markup_pct"))
    stay = stage(price_stays(stage(h), *library).select("request_id", F.col("cost").cast("decimal(14,2)").alias("unit"), "currency", "errors")).withColumn("auto_quantity", F.lit(1))

    s = services.select(F.col("id").alias("ref_id"), "basis", "pax_max", F.col("amount").cast("decimal(14,2)").alias("unit"), F.col("currency").alias("s_currency"))
    v = j.filter("kind = 'service'").withColumn("kids", F.col("children_with_bed") + F.col("children_without_bed")).join(s, "ref_id")
    v = v.select("request_id", "unit", F.col("s_currency").alias("currency"), none.alias("errors"), service_quantity("basis", "pax_max", "adults", "kids").cast("int").alias("auto_quantity"))

    new = got.unionByName(stay).unionByName(v).withColumnRenamed("currency", "new_currency")
    out = j.join(new, "request_id", "left")
    custom, manual = F.col("kind") == "custom", F.col("manual_unit").isNotNull()
    unit = F.when(custom, F.col("amount") / F.nullif(F.col("quantity"), F.lit(0))).otherwise(F.coalesce("manual_unit", "unit"))
    quantity = F.when(custom, F.col("quantity")).otherwise(F.coalesce("set_quantity", "auto_quantity", F.lit(1)))
    amount = F.when(custom, F.col("amount")).otherwise(unit * quantity)
    failed = F.when((F.col("kind") == "hotel") & F.col("unit").isNull() & F.col("start_date").isNull(), F.array(F.lit("Set the trip start date (or a check-in date) to price a hotel")))
    return out.select(
        "trip_id", "id", "kind", quantity.cast("decimal(10,2)").alias("quantity"), F.round(unit, 2).alias("unit_amount"), F.round(amount, 2).alias("amount"),
        F.when(custom, F.col("currency")).otherwise(F.coalesce("new_currency", "own_currency")).alias("currency"), manual.alias("manual"), F.coalesce(failed, "errors", none).alias("errors"),
    )
