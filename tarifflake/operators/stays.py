"""Hotel stays priced night by night, for a whole table of requests.

Rates meet requests through a price calendar: one row per (room type, meal plan, night) that any request asks for,
holding the winning rate of every occupancy. A popular room adds no more calendar rows than there are nights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import first_by
from ..functions.keys import name_key, sold_on_weekday
from ..functions.money import money
from ..session import stage

RATE = ["amount", "currency", "basis", "is_net", "taxes_included", "min_nights", "season_name"]


def price_calendar(nights: DataFrame, rates: DataFrame) -> DataFrame:
    """``picks``: occupancy -> struct(net, rack), the best rate on that night for requests that prefer either.

    Day-specific beats general, the preferred price type beats the other, then the newest sheet."""
    wanted = nights.select("room_type_id", "meal_plan", "night").distinct()
    rooms = wanted.select("room_type_id", "meal_plan").distinct()
    live = first_by(
        rates.filter("status = 'active'").join(rooms, ["room_type_id", "meal_plan"], "left_semi"),
        ["room_type_id", "meal_plan", "occupancy", "weekdays", "is_net", "valid_from", "valid_to"],
        [F.col("document_id"), F.col("id")], latest=True,
    )
    on_night = live.join(wanted, ["room_type_id", "meal_plan"]).filter(
        F.col("night").between(F.col("valid_from"), F.col("valid_to")) & sold_on_weekday("weekdays", "night")
    )
    rate = F.struct(*RATE)
    net = F.coalesce("is_net", F.lit(False))

    def best(prefer: Column) -> Column:
        return F.max_by(rate, F.struct(F.col("weekdays").isNotNull(), prefer, F.col("document_id"), F.col("id")))

    per_occ = on_night.groupBy("room_type_id", "meal_plan", "night", "occupancy").agg(best(net).alias("net"), best(~net).alias("rack"))
    return per_occ.groupBy("room_type_id", "meal_plan", "night").agg(
        F.map_from_entries(F.collect_list(F.struct("occupancy", F.struct("net", "rack")))).alias("picks")
    )


def stay_nights(stays: DataFrame) -> DataFrame:
    return stays.select("*", F.explode(F.sequence("check_in", F.date_sub("check_out", 1))).alias("night"))


def _pick(occ: str) -> Column:
    both = F.try_element_at("picks", F.lit(occ))
    return F.when(F.col("prefer_net"), both["net"]).otherwise(both["rack"])


def night_lines(stays: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per request, night, room and charged guest group; ``missing`` where nothing is on sale."""
    nights = stay_nights(stays)
    occs = ["single", "double", "triple", "extra_adult", "child_with_bed", "child_without_bed", "per_person"]
    n = nights.join(stage(price_calendar(nights, rates)), ["room_type_id", "meal_plan", "night"], "left")
    n = n.withColumns({f"p_{o}": _pick(o) for o in occs}).drop("picks")
    n = n.select("*", F.posexplode("rooms").alias("room_no", "room")).withColumn("room_no", F.col("room_no") + 1)
    a = F.coalesce("room.adults", F.lit(2))
    cwb, cnb = F.coalesce("room.children_with_bed", F.lit(0)), F.coalesce("room.children_without_bed", F.lit(0))
    has_single, has_triple = F.col("p_single").isNotNull(), F.col("p_triple").isNotNull()
    base = F.when((a <= 1) & has_single, "single").when((a == 3) & has_triple, "triple").otherwise("double")
    extra = F.when((a > 3) | ((a == 3) & ~has_triple), a - 2).otherwise(0)

    def line(occ: Column, qty: Column, seq: int) -> Column:
        return F.struct(occ.alias("occ"), qty.cast("int").alias("qty"), F.lit(seq).alias("seq"))

    plan = F.filter(
        F.array(
            line(base, F.lit(1), 1),
            line(F.lit("extra_adult"), extra, 2),
            line(F.lit("child_with_bed"), cwb, 3),
            line(F.lit("child_without_bed"), cnb, 4),
        ),
        lambda x: x["qty"] > 0,
    )
    n = n.withColumns(
        {
            "warn_single": (a <= 1) & ~has_single,
            "warn_adults": F.when(a > 3, a),
            "min_stay": F.coalesce("p_double", "p_single")["min_nights"],
            "adults_here": a,
        }
    ).select("*", F.explode(plan).alias("l"))
    occ = F.col("l.occ")
    own = F.coalesce(*[F.when(occ == o, F.col(f"p_{o}")) for o in occs[:6]])
    per_person = own.isNull() & (occ == "double") & F.col("p_per_person").isNotNull()
    as_extra = own.isNull() & (occ == "child_with_bed") & F.col("p_extra_adult").isNotNull()
    rate = F.coalesce(own, F.when(occ == "double", F.col("p_per_person")), F.when(occ == "child_with_bed", F.col("p_extra_adult")))
    n = n.withColumns({"rate": rate, "per_person": per_person, "as_extra": as_extra})
    heads = F.when(occ == "single", 1).when(occ == "double", 2).when(occ == "triple", 3)
    qty = (
        F.when(F.col("per_person"), F.col("adults_here"))
        .when((F.col("rate.basis") == "per_person_per_night") & heads.isNotNull(), heads)
        .otherwise(F.col("l.qty"))
    )
    return n.select(
        "request_id", "night", "room_no", F.col("l.seq").alias("seq"),
        F.when(F.col("per_person"), "per_person").otherwise(occ).alias("occupancy"),
        qty.alias("qty"),
        F.col("rate.amount").alias("unit"),
        money(F.col("rate.amount") * qty).alias("amount"),
        F.col("rate.currency").alias("currency"), F.col("rate.is_net").alias("is_net"),
        F.col("rate.taxes_included").alias("taxes_included"), F.col("rate.season_name").alias("season"),
        F.col("rate").isNull().alias("missing"), "as_extra", "warn_single", "warn_adults",
        F.when(F.col("min_stay") > F.datediff("check_out", "check_in"), F.col("min_stay")).alias("short_of"),
    )


def blackout_nights(stays: DataFrame, surcharges: DataFrame, rooms: DataFrame) -> DataFrame:
    """(request, night, room text) where a stop sale applies; a named room must be the one that was asked for."""
    stop = (
        surcharges.filter("status = 'active' and kind = 'blackout'")
        .select("hotel_id", F.col("room_type").alias("stop_room"), F.explode(F.sequence("date_from", "date_to")).alias("night"))
        .distinct()
    )
    asked = stay_nights(stays).select("request_id", "hotel_id", "room_type_id", "night")
    hit = asked.join(stop, ["hotel_id", "night"]).join(rooms.select(F.col("id").alias("room_type_id"), name_key("name").alias("room_key")), "room_type_id")
    k = name_key("stop_room")
    return hit.filter((k == "") | F.contains("room_key", k) | F.contains(k, F.col("room_key"))).select("request_id", "night", "stop_room")


def supplement_lines(stays: DataFrame, surcharges: DataFrame) -> DataFrame:
    """Mandatory supplements whose dates meet a stay. Equal supplements of a hotel are charged as often as they are
    on file."""
    terms = ["hotel_id", "name", "date_from", "date_to", "amount", "currency", "basis"]
    s = surcharges.filter("status = 'active' and kind = 'supplement' and mandatory").groupBy(*terms).agg(F.count(F.lit(1)).alias("times"))
    heads = F.aggregate("rooms", F.lit(0), lambda acc, r: acc + F.coalesce(r["adults"], F.lit(0)))
    kids = F.aggregate("rooms", F.lit(0), lambda acc, r: acc + F.coalesce(r["children_with_bed"], F.lit(0)) + F.coalesce(r["children_without_bed"], F.lit(0)))
    asked = stays.select("request_id", "hotel_id", "check_in", F.date_sub("check_out", 1).alias("last"), heads.alias("heads"), kids.alias("kids"), F.size("rooms").alias("n_rooms"))
    j = asked.join(s, "hotel_id").filter((F.col("date_from") <= F.col("last")) & (F.col("check_in") <= F.col("date_to")))
    hit = F.datediff(F.least("date_to", "last"), F.greatest("date_from", "check_in")) + 1
    qty = (
        F.when(F.col("basis") == "per_adult", F.col("heads"))
        .when(F.col("basis") == "per_person", F.col("heads") + F.col("kids"))
        .when(F.col("basis") == "per_child", F.col("kids"))
        .when(F.col("basis") == "per_room", F.col("n_rooms"))
        .when(F.col("basis") == "per_room_per_night", F.col("n_rooms") * hit)
        .when(F.col("basis") == "per_booking", 1)
    )
    return j.select(
        "request_id", "name", F.col("amount").alias("unit"), F.coalesce(qty, F.col("heads")).alias("qty"), "times",
        F.when(F.col("amount").isNotNull(), F.col("currency")).alias("currency"),
        (money(F.col("amount") * F.coalesce(qty, F.col("heads"))) * F.col("times")).alias("amount"),
        F.when(F.col("amount").isNull(), F.concat(F.lit("Supplement '"), "name", F.lit("' applies but has no amount - check with the hotel")))
        .when(qty.isNull(), F.concat(F.lit("Supplement '"), "name", F.lit("' basis not stated - charged per adult"))).alias("warning"),
    )


def price_stays(stays: DataFrame, rates: DataFrame, surcharges: DataFrame, rooms: DataFrame, hotels: DataFrame) -> DataFrame:
    """One priced answer per stay request. The price calendar and the nights of the requests are written when they are known,
    so that what was moved for one is dropped before the next is worked out."""
    lines = night_lines(stays, rates)
    day = F.col("night").cast("string")
    occ_text = F.concat(F.translate("occupancy", "_", " "), F.lit(" (room "), "room_no", F.lit(")"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("warn_single"), F.concat(day, F.lit(": no single rate, used double rate for room "), "room_no")),
            F.when(F.col("warn_adults").isNotNull(), F.concat(F.lit("Room "), "room_no", F.lit(" has "), "warn_adults", F.lit(" adults - check the hotel allows it"))),
            F.when(F.col("as_extra"), F.concat(day, F.lit(": no child-with-bed rate, used extra adult rate"))),
            F.when(F.col("short_of").isNotNull(), F.concat(day, F.lit(": minimum stay is "), "short_of", F.lit(" nights"))),
        )
    )
    lines = lines.withColumn("notes", notes)
    per_night = lines.groupBy("request_id", "night").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("missing"), F.struct("room_no", "seq", occ_text.alias("t"))))).alias("missing"),
        F.array_distinct(F.flatten(F.collect_list("notes"))).alias("notes"),
        F.collect_set("currency").alias("currencies"),
        F.collect_set(F.when(~F.col("missing"), F.coalesce(F.col("is_net").cast("string"), F.lit("unknown")))).alias("nets"),
        F.collect_set(F.when(~F.col("missing"), F.coalesce(F.col("taxes_included").cast("string"), F.lit("unknown")))).alias("taxes"),
    )
    per_night = stage(per_night)
    gap = F.when(
        F.size("missing") > 0,
        F.concat(day, F.lit(": no valid rate for "), F.array_join(F.transform("missing", lambda m: m["t"]), ", ")),
    )
    nights = per_night.groupBy("request_id").agg(
        F.sum("total").alias("nights_total"),
        F.array_compact(F.collect_list(gap)).alias("gaps"),
        F.flatten(F.collect_list("notes")).alias("notes"),
        F.array_distinct(F.flatten(F.collect_list("currencies"))).alias("currencies"),
        F.array_distinct(F.flatten(F.collect_list("nets"))).alias("nets"),
        F.array_distinct(F.flatten(F.collect_list("taxes"))).alias("taxes"),
    )
    nights = stage(nights)
    supp = supplement_lines(stays, surcharges).groupBy("request_id").agg(
        F.sum("amount").alias("supplements"), F.collect_set("warning").alias("s_notes"), F.collect_set("currency").alias("s_currencies")
    )
    names = stays.select("request_id", "hotel_id").join(hotels.select(F.col("id").alias("hotel_id"), F.col("name").alias("hotel")), "hotel_id", "left")
    stops = blackout_nights(stays, surcharges, rooms).join(names, "request_id")
    stop_text = F.concat(day, F.lit(": blackout / stop sale at "), F.coalesce("hotel", F.lit("?")), F.coalesce(F.concat(F.lit(" ("), "stop_room", F.lit(")")), F.lit("")))
    stops = stops.groupBy("request_id").agg(F.collect_set(stop_text).alias("stops"))
    none = F.array().cast("array<string>")
    j = stays.join(nights, "request_id").join(supp, "request_id", "left").join(stops, "request_id", "left")
    cur = F.array_sort(F.array_union("currencies", F.coalesce("s_currencies", none)))
    j = j.withColumn("cur", cur)
    mixed = F.when(F.size("cur") > 1, F.array(F.concat(F.lit("Rates are in different currencies: "), F.array_join("cur", ", ")))).otherwise(none)
    j = j.withColumn("errors", F.array_sort(F.concat("gaps", F.coalesce("stops", none), mixed)))
    cost = F.col("nights_total") + F.coalesce("supplements", F.lit(0))
    markup = cost * F.coalesce("markup_pct", F.lit(0)) / 100

    def only(c: str) -> Column:
        v = F.when(F.size(c) == 1, F.col(c)[0])
        return F.when(v == "true", True).when(v == "false", False)

    return j.select(
        "request_id", "hotel_id", "room_type_id", "meal_plan", F.datediff("check_out", "check_in").alias("nights_count"),
        money(cost).alias("cost"), money(markup).alias("markup"), money(cost + markup).alias("sell"),
        F.when(F.size("cur") == 1, F.col("cur")[0]).alias("currency"),
        only("nets").alias("rates_are_net"), only("taxes").alias("taxes_included"),
        (F.size("errors") == 0).alias("ok"), "errors",
        F.array_sort(F.array_distinct(F.concat("notes", F.coalesce("s_notes", none)))).alias("warnings"),
    )


def find_rooms(asked: DataFrame, rooms: DataFrame) -> DataFrame:
    """The room type a text means: the same name, else one that contains it or is contained in it; lowest id."""
    k = asked.select("*", name_key("room_text").alias("ask_key")).alias("a")
    distinct = k.select("hotel_id", "ask_key").distinct().alias("d")
    r = rooms.select("id", "hotel_id", name_key("name").alias("room_key")).alias("r")
    fit = (F.col("d.hotel_id") == F.col("r.hotel_id")) & (
        F.contains("room_key", "ask_key") | F.contains("ask_key", "room_key")
    )
    best = distinct.join(r, fit).groupBy(F.col("d.hotel_id").alias("h"), F.col("ask_key").alias("k")).agg(
        F.min_by("r.id", F.struct(F.col("room_key") != F.col("ask_key"), F.col("r.id"))).alias("room_type_id")
    )
    return k.join(best, (F.col("a.hotel_id") == F.col("h")) & (F.col("ask_key") == F.col("k")), "left").drop("h", "k", "ask_key")


def default_rooms(adults, extra_beds, cwb, cnb) -> Column:
    """Twin rooms, a third adult on an extra bed while there are beds, the children with the first room."""
    a, x = F.col(adults), F.greatest(F.col(extra_beds), F.lit(0))
    threes = F.least(x, F.floor(a / 3)).cast("int")
    left = a - threes * 3
    twos = F.floor(left / 2).cast("int")
    sizes = F.concat(F.array_repeat(F.lit(3), threes), F.array_repeat(F.lit(2), twos), F.array_repeat(F.lit(1), (left % 2).cast("int")))
    return F.transform(
        sizes,
        lambda s, i: F.struct(
            s.alias("adults"),
            F.when(i == 0, F.col(cwb)).otherwise(0).alias("children_with_bed"),
            F.when(i == 0, F.col(cnb)).otherwise(0).alias("children_without_bed"),
        ),
    )
