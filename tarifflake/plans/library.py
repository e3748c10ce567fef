"""Catalogue views, history, expiry alerts and housekeeping of the library."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.money import pct_change
from ..operators import ledger, ownership, search
from .ledger import EXACT, RK
from .registry import query
from .scalars import KEY_SQL, pct_sql

ON = dt.date(1998, 6, 12)
TODAY = "date '1998-06-12'"
STATE = f"case when status <> 'active' then 'replaced' when valid_to < {TODAY} then 'expired' when valid_from > {TODAY} then 'upcoming' else 'current' end"


@query(
    "a01_library_summary",
    """select (select count(*) from b_hotel) as hotels, (select count(distinct hotel_id) from b_rate where status = 'active') as hotels_with_rates, (select count(*) from b_rate where status = 'active') as hotel_rates,
      (select count(distinct family_id) from b_package where status = 'active') as packages, (select count(*) from b_service where status = 'active') as services, (select count(*) from b_place) as places,
      (select count(*) from b_supplier) as suppliers, (select count(*) from b_trip) as trips, (select count(*) from b_document where status = 'needs_review') as documents_to_review""",
    ["b_hotel", "b_rate", "b_package", "b_service", "b_place", "b_supplier", "b_trip", "b_document"],
)
def a01(lib):
    def n(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))

    live = lib.b_rate.filter("status = 'active'")
    # distinct hotels: one row per hotel first, so no task gathers all of them
    parts = [
        n(lib.b_hotel, "hotels"), n(live.select("hotel_id").distinct(), "hotels_with_rates"), n(live, "hotel_rates"),
        n(lib.b_package.filter("status = 'active'").select("family_id").distinct(), "packages"), n(lib.b_service.filter("status = 'active'"), "services"),
        n(lib.b_place, "places"), n(lib.b_supplier, "suppliers"), n(lib.b_trip, "trips"), n(lib.b_document.filter("status = 'needs_review'"), "documents_to_review"),
    ]
    # single-row results side by side, joined on a constant
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("one", F.lit(1))), "one")
    return out.drop("one")


@query(
    "a02_hotel_counts",
    """select h.id, h.name, h.city, coalesce(r.n, 0) as rates, coalesce(p.n, 0) as in_packages, coalesce(rt.n, 0) as room_types from b_hotel h left join (select hotel_id, count(*) as n from b_rate where status = 'active' group by 1) r on r.hotel_id = h.id
       left join (select hotel_id, count(distinct package_id) as n from b_pkg_hotel group by 1) p on p.hotel_id = h.id left join (select hotel_id, count(*) as n from b_room group by 1) rt on rt.hotel_id = h.id where coalesce(r.n, 0) > 0""",
    ["b_hotel", "b_rate", "b_pkg_hotel", "b_room"],
)
def a02(lib):
    return hotel_counts(lib).filter("rates > 0").select("id", "name", "city", "rates", "in_packages", "room_types")


def hotel_counts(lib):
    def per_hotel(df, name):
        return df.groupBy(F.col("hotel_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    r = per_hotel(lib.b_rate.filter("status = 'active'"), "rates")
    p = per_hotel(lib.b_pkg_hotel.select("hotel_id", "package_id").distinct(), "in_packages")
    j = lib.b_hotel.join(r, "id", "left").join(p, "id", "left").join(per_hotel(lib.b_room, "room_types"), "id", "left")
    return j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rates", "in_packages", "room_types")})


@query(
    "a03_supplier_counts",
    """select s.id, s.name, (select count(*) from b_rate r where r.supplier_id = s.id and status = 'active') as hotel_rates, (select count(*) from b_package r where r.supplier_id = s.id and status = 'active') as packages,
       (select count(*) from b_service r where r.supplier_id = s.id and status = 'active') as services, (select count(*) from b_document r where r.supplier_id = s.id) as documents from b_supplier s""",
    ["b_supplier", "b_rate", "b_package", "b_service", "b_document"],
)
def a03(lib):
    live = "status = 'active'"
    out = lib.b_supplier.select("id", "name")
    for df, name in ((lib.b_rate.filter(live), "hotel_rates"), (lib.b_package.filter(live), "packages"), (lib.b_service.filter(live), "services"), (lib.b_document, "documents")):
        out = out.join(df.groupBy(F.col("supplier_id").alias("id")).agg(F.count(F.lit(1)).alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query(
    "a07_rates_valid_until",
    """select supplier_id, cast(max(d) as varchar) as valid_until from (select supplier_id, valid_to as d from b_rate where status = 'active' union all select supplier_id, valid_to from b_service where status = 'active'
       union all select supplier_id, valid_to from b_package where status = 'active') group by 1""",
    ["b_rate", "b_service", "b_package"],
)
def a07(lib):
    parts = [df.filter("status = 'active'").select("supplier_id", "valid_to") for df in (lib.b_rate, lib.b_service, lib.b_package)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("supplier_id").agg(F.max("valid_to").alias("valid_until"))


@query(
    "a26_sheets_to_ask_for",
    "select coalesce(s.name, '(unknown)') as supplier, h.name as hotel, h.id as hotel_id, cast(max(r.valid_to) as varchar) as last_valid from b_rate r join b_hotel h on h.id = r.hotel_id left join b_supplier s on s.id = r.supplier_id where r.status = 'active' group by 1, 2, 3, s.id having max(r.valid_to) <= date '1998-07-27'",
    ["b_rate", "b_hotel", "b_supplier"],
)
def a26(lib):
    r = lib.b_rate.filter("status = 'active'").groupBy("supplier_id", "hotel_id").agg(F.max("valid_to").alias("last_valid"))
    r = r.filter(F.col("last_valid") <= F.date_add(F.lit(ON), 45))
    h = lib.b_hotel.select(F.col("id").alias("hotel_id"), F.col("name").alias("hotel"))
    s = lib.b_supplier.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier"))
    return r.join(h, "hotel_id").join(s, "supplier_id", "left").select(F.coalesce("supplier", F.lit("(unknown)")).alias("supplier"), "hotel", "hotel_id", "last_valid")


@query(
    "j01_rates_hotels_rooms",
    "select r.id, h.name as hotel, h.city, rt.name as room, r.meal_plan, r.occupancy, cast(r.amount as double) as amount from b_rate r join b_hotel h on h.id = r.hotel_id join b_room rt on rt.id = r.room_type_id where r.status = 'active'",
    ["b_rate", "b_hotel", "b_room"],
)
def j01(lib):
    return rates_with_names(lib).select("id", "hotel", "city", "room", "meal_plan", "occupancy", "amount")


def rates_with_names(lib):
    h = lib.b_hotel.select(F.col("id").alias("hotel_id"), F.col("name").alias("hotel"), "city", "destination")
    rt = lib.b_room.select(F.col("id").alias("room_type_id"), F.col("name").alias("room"))
    return lib.b_rate.filter("status = 'active'").join(h, "hotel_id").join(rt, "room_type_id")


@query(
    "j02_usage_documents",
    "select u.id, u.model, d.filename from b_usage u left join b_document d on d.id = u.document_id",
    ["b_usage", "b_document"],
)
def j02(lib):
    d = lib.b_document.select(F.col("id").alias("document_id"), "filename")
    return lib.b_usage.select("id", "model", "document_id").join(d, "document_id", "left").select("id", "model", "filename")


@query(
    "j03_services_of_region",
    "select id, name from b_service where status = 'active' and document_id in (select document_id from b_package where lower(region) like '%region 2%' or lower(title) like '%region 2%')",
    ["b_service", "b_package"],
)
def j03(lib):
    docs = lib.b_package.filter(keys.contains_text("Region 2", "region", "title")).select("document_id")
    return lib.b_service.filter("status = 'active'").join(docs, "document_id", "left_semi").select("id", "name")


EXP = f"""select 'hotel' as type, h.id as ref_id, h.name, cast(max(r.valid_to) as varchar) as last_valid_date from b_rate r join b_hotel h on h.id = r.hotel_id
   where r.status = 'active' and r.valid_to between {{d}} and {{d}} + 30 and not exists (select 1 from b_rate x where x.hotel_id = r.hotel_id and x.status = 'active' and x.valid_to > {{d}} + 30) group by 1, 2, 3"""


def expiring(rates, services, hotels, today, within=30):
    """Hotels whose last live rate runs out soon and that have nothing later, and services that run out soon."""
    day, limit = F.lit(today), F.date_add(F.lit(today), within)
    live = rates.filter("status = 'active'")
    # "nothing later" is a property of the hotel's last date: one aggregate answers both questions
    last = live.groupBy("hotel_id").agg(F.max("valid_to").alias("last")).filter(F.col("last").between(day, limit))
    h = hotels.select(F.col("id").alias("hotel_id"), "name")
    a = last.join(h, "hotel_id").select(F.lit("hotel").alias("type"), F.col("hotel_id").alias("ref_id"), "name", F.col("last").alias("last_valid_date"))
    b = services.filter((F.col("status") == "active") & F.col("valid_to").between(day, limit))
    label = F.concat("name", F.lit(" ("), F.coalesce("vehicle_type", F.lit("")), F.lit(")"))
    return a.unionByName(b.select(F.col("kind").alias("type"), F.col("id").alias("ref_id"), label.alias("name"), F.col("valid_to").alias("last_valid_date")))


LATE = dt.date(2002, 1, 20)
LATE_SQL = "date '2002-01-20'"


@query("j04_expiring_hotels", EXP.format(d=LATE_SQL), ["b_rate", "b_hotel"])
def j04(lib):
    return expiring(lib.b_rate, lib.b_service, lib.b_hotel, LATE).filter("type = 'hotel'")


@query(
    "c20_expiring_soon",
    f"{EXP.format(d=LATE_SQL)} union all select kind, id, name || ' (' || coalesce(vehicle_type, '') || ')', cast(valid_to as varchar) from b_service where status = 'active' and valid_to between {LATE_SQL} and {LATE_SQL} + 30",
    ["b_rate", "b_hotel", "b_service"],
)
def c20(lib):
    return expiring(lib.b_rate, lib.b_service, lib.b_hotel, LATE).orderBy("last_valid_date", "ref_id")


@query(
    "u01_expiry_union",
    f"{EXP.format(d=TODAY)} union all select kind, id, name || ' (' || coalesce(vehicle_type, '') || ')', cast(valid_to as varchar) from b_service where status = 'active' and valid_to between {TODAY} and {TODAY} + 30",
    ["b_rate", "b_hotel", "b_service"],
)
def u01(lib):
    return expiring(lib.b_rate, lib.b_service, lib.b_hotel, ON)


@query(
    "j05_orphan_hotels",
    """with keep as (select id from b_document where approved_on >= date '2001-08-01')
      select id, name from b_hotel h where not exists (select 1 from b_rate r where r.hotel_id = h.id and r.document_id in (select id from keep)) and not exists (select 1 from b_pkg_hotel p where p.hotel_id = h.id and p.package_id in (select id from keep))
       and not exists (select 1 from b_surcharge s where s.hotel_id = h.id and s.document_id in (select id from keep)) and not exists (select 1 from b_item i where i.kind = 'hotel' and i.ref_id = h.id and i.trip_id in (select id from keep))""",
    ["b_hotel", "b_rate", "b_pkg_hotel", "b_surcharge", "b_item", "b_document"],
)
def j05(lib):
    """Hotels that nothing refers to once every sheet approved before a date is taken out."""
    keep = lib.b_document.filter(F.col("approved_on") >= F.lit(dt.date(2001, 8, 1))).select(F.col("id").alias("document_id"))
    refs = lib.b_rate.select("hotel_id", "document_id")
    refs = refs.unionByName(lib.b_pkg_hotel.select("hotel_id", F.col("package_id").alias("document_id")))
    refs = refs.unionByName(lib.b_surcharge.select("hotel_id", "document_id"))
    refs = refs.unionByName(lib.b_item.filter("kind = 'hotel'").select(F.col("ref_id").alias("hotel_id"), F.col("trip_id").alias("document_id")))
    used = refs.join(keep, "document_id", "left_semi").select(F.col("hotel_id").alias("id")).distinct()
    return lib.b_hotel.select("id", "name").join(used, "id", "left_anti")


CHAIN = f"""{EXACT},
 chain as (select t.*, o.amount as prev_amount from told t left join told o on o.id = t.previous_rate_id)"""


def rate_chain(lib, *more):
    """(ledger rows, loaded lines with the amount of the rate each one followed): the links that the load stored. Both have
    the columns ``more`` of their lines."""
    led, told = ownership.rebuild(lib.b_line, [*more])
    return led, told.filter("change <> 'same'")


@query(
    "j12_rate_changes",
    f"with recursive {CHAIN} select id, previous_rate_id as prev_id, cast(prev_amount as double) as old, cast(amount as double) as now, change_pct as pct from chain where change_pct <> 0",
    ["b_line"],
)
def j12(lib):
    """Every price move: a rate with the one it followed, where the amounts differ."""
    _, c = rate_chain(lib)
    return c.filter("change_pct <> 0").select("id", F.col("previous_rate_id").alias("prev_id"), F.col("prev_amount").alias("old"), F.col("amount").alias("now"), F.col("change_pct").alias("pct"))


@query(
    "c31_hotel_history",
    f"""with recursive {CHAIN} select t.hotel_id, t.room_type_id, t.meal_plan, t.occupancy, t.weekdays, t.is_net, case when piece = 0 then p.id else p.id || '/' || piece end as id, cast(p.f as varchar) as valid_from, cast(p.t as varchar) as valid_to, cast(t.amount as double) as amount,
      t.currency, t.season_name, case when p.taken is not null then 'replaced' when p.t < {TODAY} then 'expired' when p.f > {TODAY} then 'upcoming' else 'current' end as state, t.previous_rate_id as prev_id, t.change_pct, t.document_id
      from pieces p join told t on t.id = p.id""",
    ["b_line"],
)
def c31(lib):
    """The series of every rate key, point by point: each row of the ledger with its state, its link and its change."""
    led, _ = rate_chain(lib, "hotel_id", *ledger.KEY, "season_name")
    state = keys.rate_state("status", "valid_from", "valid_to", F.lit(ON)).alias("state")
    return led.select("hotel_id", *ledger.KEY, "id", "valid_from", "valid_to", "amount", "currency", "season_name", state, F.col("previous_rate_id").alias("prev_id"), "change_pct", "document_id")


@query(
    "a17_avg_change_per_supplier",
    f"with recursive {CHAIN} select supplier_id, count(*) as changes, (case when sum(p) >= 0 then 1 else -1 end * ((abs(sum(p)) * 2 + count(*)) // (2 * count(*)))) / 10.0 as avg_pct from (select supplier_id, cast(change_pct * 10 as bigint) as p from chain where change_pct is not null and valid_from >= date '1998-01-01') group by 1",
    ["b_line"],
)
def a17(lib):
    _, c = rate_chain(lib, "supplier_id")
    c = c.filter(F.col("change_pct").isNotNull() & (F.col("valid_from") >= F.lit(dt.date(1998, 1, 1))))
    return c.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("changes"), F.round(F.sum("change_pct") / F.count(F.lit(1)), 1).alias("avg_pct"))


@query(
    "c17_search_services",
    f"""select r.request_id, s.id, s.kind, s.name, s.destination, cast(s.amount as double) as amount from b_service_request r join b_service s on s.status = 'active' and r.on_date between s.valid_from and s.valid_to
        where (r.kind is null or s.kind = r.kind) and (r.text is null or {KEY_SQL.format('s.name')} like '%' || {KEY_SQL.format('r.text')} || '%')
          and (r.destination is null or lower(s.destination) like '%' || lower(r.destination) || '%' or {KEY_SQL.format('s.name')} like '%' || {KEY_SQL.format('r.destination')} || '%'
            or s.document_id in (select document_id from b_package p where lower(p.region) like '%' || lower(r.destination) || '%' or lower(p.title) like '%' || lower(r.destination) || '%'))""",
    ["b_service", "b_package", "b_service_request"],
)
def c17(lib):
    return search.search_services(lib.b_service_request, lib.b_service, lib.b_package).select("request_id", "id", "kind", "name", "destination", "amount")


@query(
    "c33_browse_hotels",
    f"""select h.id, h.name, h.city, h.category, coalesce(r.n, 0) as rates from b_hotel h left join (select hotel_id, count(*) as n from b_rate where status = 'active' group by 1) r on r.hotel_id = h.id
        where ({KEY_SQL.format('h.name')} like '%gear%' or lower(h.city) like '%gear%') and lower(h.category) = 'deluxe' order by h.city nulls first, h.name, h.id""",
    ["b_hotel", "b_rate"],
)
def c33(lib):
    """Hotels by name or place, with their live rate counts, by city and name."""
    h = lib.b_hotel.filter((F.contains(keys.name_key("name"), F.lit("gear")) | keys.contains_text("gear", "city")) & (F.lower("category") == "deluxe"))
    page = h.orderBy(F.col("city").asc_nulls_first(), "name", "id")
    r = lib.b_rate.filter("status = 'active'").join(page.select(F.col("id").alias("hotel_id")), "hotel_id", "left_semi").groupBy("hotel_id").agg(F.count(F.lit(1)).alias("rates"))
    return page.join(r, page["id"] == r["hotel_id"], "left").select("id", "name", "city", "category", F.coalesce("rates", F.lit(0)).alias("rates"))


@query(
    "c33_places",
    "select id, name, destination, region from b_place where (lower(name) like '%lake 1%' or lower(description) like '%lake 1%') and (lower(destination) like '%building%' or lower(region) like '%district 2%')",
    ["b_place"],
)
def c33p(lib):
    return lib.b_place.filter(keys.contains_text("lake 1", "name", "description") & (keys.contains_text("building", "destination") | keys.contains_text("district 2", "region"))).select("id", "name", "destination", "region").orderBy("destination", "name")


@query(
    "c33_supplier_detail",
    """select s.id, s.name, (select count(distinct hotel_id) from b_rate r where r.supplier_id = s.id) as hotels, (select count(*) from b_package p where p.supplier_id = s.id and status = 'active') as packages,
       (select count(*) from b_document d where d.supplier_id = s.id and status = 'needs_review') as to_review, (select cast(max(valid_to) as varchar) from b_rate r where r.supplier_id = s.id and status = 'active') as hotel_rates_until from b_supplier s""",
    ["b_supplier", "b_rate", "b_package", "b_document"],
)
def c33s(lib):
    hotels = lib.b_rate.groupBy("supplier_id", "hotel_id").agg(F.max(F.when(F.col("status") == "active", F.col("valid_to"))).alias("until"))
    hotels = hotels.groupBy(F.col("supplier_id").alias("id")).agg(F.count(F.lit(1)).alias("hotels"), F.max("until").alias("hotel_rates_until"))
    p = lib.b_package.filter("status = 'active'").groupBy(F.col("supplier_id").alias("id")).agg(F.count(F.lit(1)).alias("packages"))
    d = lib.b_document.filter("status = 'needs_review'").groupBy(F.col("supplier_id").alias("id")).agg(F.count(F.lit(1)).alias("to_review"))
    j = lib.b_supplier.select("id", "name").join(hotels, "id", "left").join(p, "id", "left").join(d, "id", "left")
    return j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("hotels", "packages", "to_review")})


@query(
    "t02_rate_card_order",
    "select hotel_id, id, coalesce(list_position(['single','double','triple','extra_adult','child_with_bed','child_without_bed','per_person'], occupancy) - 1, 9) as occupancy_rank from b_rate where status = 'active'",
    ["b_rate"],
)
def t02(lib):
    """Rate cards in reading order: room, plan, occupancy, dates, weekdays."""
    r = rates_with_names(lib).withColumn("occupancy_rank", keys.occupancy_rank("occupancy").cast("bigint"))
    return r.orderBy("hotel_id", "room", "meal_plan", "occupancy_rank", "valid_from", F.coalesce("weekdays", F.lit("")), "id").select("hotel_id", "id", "occupancy_rank")


@query(
    "t01_cheapest_rates",
    f"select id, cast(amount as double) as amount from b_rate where status = 'active' and valid_from <= {TODAY} and valid_to >= {TODAY} and occupancy = 'double' and (weekdays is null or list_contains(string_split(weekdays, ','), 'fri')) order by amount, id",
    ["b_rate"],
)
def t01(lib):
    r = lib.b_rate.filter(keys.active_on(F.lit(ON)) & (F.col("occupancy") == "double") & keys.sold_on_weekday("weekdays", F.lit(ON)))
    return r.select("id", "amount").orderBy("amount", "id")


@query(
    "t05_day_library",
    """select d.id, p.id as package_id, p.title as package, d.day_number, d.title from b_day d join b_package p on p.id = d.package_id where p.status = 'active' and (lower(d.title) like '%visit 1%' or lower(d.description) like '%visit 1%' or lower(d.overnight) like '%visit 1%')
        and contains(lower(concat_ws(' ', coalesce(p.region, ''), array_to_string(p.destinations, ' '), d.title, d.overnight)), 'city 3') order by p.title, d.day_number, d.id""",
    ["b_day", "b_package"],
)
def t05(lib):
    """Days of live packages by text and place, by package and day."""
    p = lib.b_package.filter("status = 'active'").select(F.col("id").alias("package_id"), F.col("title").alias("package"), "region", "destinations")
    d = lib.b_day.filter(keys.contains_text("visit 1", "title", "description", "overnight")).join(p, "package_id")
    hay = F.lower(F.concat_ws(" ", F.coalesce("region", F.lit("")), F.array_join("destinations", " "), "title", "overnight"))
    return d.filter(F.contains(hay, F.lit("city 3"))).select("id", "package_id", "package", "day_number", "title").orderBy("package", "day_number", "id")


@query("w12_recent_trips", "select id, title from b_trip where not is_template order by id desc limit 8", ["b_trip"])
def w12(lib):
    return lib.b_trip.filter("not is_template").select("id", "title").orderBy(F.desc("id")).limit(8)


@query(
    "j19_place_upsert",
    f"""with inc as (select c_custkey as id, upper(c_name) as c_name, 'LAKE - ' || cast(floor(c_custkey / 4) as bigint) as name, case when c_custkey % 2 = 0 then lower(c_mktsegment) end as destination from customer)
      select i.id as incoming_id, min(p.id) as place_id from inc i left join b_place p on {KEY_SQL.format('p.name')} = {KEY_SQL.format('i.name')} and (i.destination is null or p.destination is null or lower(p.destination) = i.destination) group by 1""",
    ["b_place"],
)
def j19(lib):
    """Which known place each incoming one is: the same name, and destinations that agree or are not given."""
    inc = lib.customer.select(F.col("c_custkey").alias("incoming_id"), F.expr("'LAKE - ' || cast(floor(c_custkey / 4) as bigint)").alias("name"), F.expr("case when c_custkey % 2 = 0 then lower(c_mktsegment) end").alias("destination"))
    return match_places(inc, lib.b_place)


def match_places(incoming, known):
    """Known places shrink to one row (the lowest id) per name and destination, so a name with many copies stays small."""
    k = known.groupBy(keys.name_key("name").alias("k"), F.nullif(keys.name_key("destination"), F.lit("")).alias("kd")).agg(F.min("id").alias("id"))
    i = incoming.select("incoming_id", keys.name_key("name").alias("k"), F.nullif(keys.name_key("destination"), F.lit("")).alias("d"))
    pairs = i.select("k", "d").distinct().join(k, "k").filter(F.col("d").isNull() | F.col("kd").isNull() | (F.col("d") == F.col("kd")))
    best = pairs.groupBy(F.col("k").alias("bk"), F.col("d").alias("bd")).agg(F.min("id").alias("place_id"))
    return i.join(best, (F.col("k") == F.col("bk")) & F.col("d").eqNullSafe(F.col("bd")), "left").select("incoming_id", "place_id")


DUP = f"""
 keysx as (select id, 'same GSTIN' as reason, upper(trim(gst_number)) as k from b_supplier where gst_number is not null
   union all select id, 'same email', lower(trim(e)) from (select id, unnest(string_split(email, ',')) as e from b_supplier)
   union all select id, 'same phone', right(regexp_replace(phone, '\\D', '', 'g'), 10) from b_supplier),
 grp as (select *, count(*) over (partition by reason, k) as n, min(id) over (partition by reason, k) as first_id from keysx)
"""


def duplicate_groups(suppliers):
    """Suppliers that share a tax number, an e-mail or a phone: one row per member of each group, linked to the
    group's first supplier. A group of n has n rows, not n squared pairs."""
    k = F.array(
        F.struct(F.lit("same GSTIN").alias("reason"), F.array_compact(F.array(F.upper(F.trim("gst_number")))).alias("ks")),
        F.struct(F.lit("same email").alias("reason"), keys.emails("email").alias("ks")),
        F.struct(F.lit("same phone").alias("reason"), keys.phone_keys("phone").alias("ks")),
    )
    x = suppliers.select("id", F.explode(k).alias("r")).select("id", "r.reason", F.explode("r.ks").alias("k")).distinct()
    g = x.groupBy("reason", "k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")
    return x.join(g, ["reason", "k"])


@query("j20_duplicate_suppliers", f"with {DUP} select distinct reason, k, id, n, first_id from grp where n > 1", ["b_supplier"])
def j20(lib):
    return duplicate_groups(lib.b_supplier)


@query(
    "u03_shared_contacts",
    f"with {DUP} select distinct id, first_id as same_as, reason from grp where n > 1 and id <> first_id and reason <> 'same GSTIN'",
    ["b_supplier"],
)
def u03(lib):
    return duplicate_groups(lib.b_supplier).filter("id <> first_id and reason <> 'same GSTIN'").select("id", F.col("first_id").alias("same_as"), "reason").distinct()


@query(
    "c14_merge_suppliers",
    f"""with {DUP}, m as (select id, coalesce(min(first_id) filter (reason = 'same GSTIN' and n > 1), id) as keep from (select s.id, reason, n, first_id from b_supplier s left join grp on grp.id = s.id) group by id)
      select m.keep as id, coalesce(max(s.type) filter (s.id = m.keep), min_by(s.type, s.id) filter (s.type is not null)) as type, coalesce(max(s.address) filter (s.id = m.keep), min_by(s.address, s.id) filter (s.address is not null)) as address,
        count(*) as records, cast(sum((select count(*) from b_rate r where r.supplier_id = s.id)) as bigint) as hotel_rates, cast(sum((select count(*) from b_document r where r.supplier_id = s.id)) as bigint) as documents
      from m join b_supplier s on s.id = m.id group by 1""",
    ["b_supplier", "b_rate", "b_document"],
)
def c14(lib):
    """Suppliers with the same tax number become one: every table is re-keyed, blanks are filled from the merged ones."""
    merges = duplicate_groups(lib.b_supplier).filter("reason = 'same GSTIN' and id <> first_id").select(F.col("id").alias("merge_id"), F.col("first_id").alias("keep_id")).distinct()
    s = merge_suppliers(lib.b_supplier, merges, ["type", "address"])
    out = s
    for df, name in ((lib.b_rate, "hotel_rates"), (lib.b_document, "documents")):
        n = rekey(df, merges).groupBy(F.col("supplier_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def rekey(facts, merges):
    m = merges.select(F.col("merge_id").alias("supplier_id"), "keep_id")
    return facts.join(m, "supplier_id", "left").withColumn("supplier_id", F.coalesce("keep_id", "supplier_id")).drop("keep_id")


def merge_suppliers(suppliers, merges, fields):
    m = merges.select(F.col("merge_id").alias("id"), "keep_id")
    j = suppliers.join(m, "id", "left").withColumn("keep", F.coalesce("keep_id", "id"))

    def value(f):
        v = F.nullif(F.col(f), F.lit(""))
        rank = F.struct(F.col("id") != F.col("keep"), F.col("id"))
        return F.min_by(v, F.when(v.isNotNull(), rank)).alias(f)

    return j.groupBy(F.col("keep").alias("id")).agg(*[value(f) for f in fields], F.count(F.lit(1)).alias("records"))


@query(
    "c15_rate_corrections",
    """select id, cast(case when occupancy in ('triple', 'single') then amount else amount * 2 end as double) as amount, case when occupancy = 'triple' then 'superseded' else status end as status,
        case occupancy when 'single' then '''Valid from'' is after ''valid to''' end as rejected,
        case when occupancy = 'triple' then 'Retired by ana on 12 Jun 1998' when occupancy <> 'single' then 'Edited by ana on 12 Jun 1998: amount ' || amount || ' -> ' || cast(amount * 2 as decimal(12,2)) else '' end as notes from b_rate where currency = 'USD'""",
    ["b_rate"],
)
def c15(lib):
    """Corrections to every USD rate: triples are retired, singles get dates the wrong way round (rejected), the
    others are doubled."""
    e = lib.b_rate.filter("currency = 'USD'").select(
        F.col("id").alias("rate_id"), F.when(F.col("occupancy") == "triple", "retired").alias("new_status"),
        F.when(~F.col("occupancy").isin("triple", "single"), F.col("amount") * 2).cast("decimal(12,2)").alias("new_amount"),
        F.when(F.col("occupancy") == "single", F.date_sub("valid_from", 1)).alias("new_to"), F.lit("ana").alias("by"),
    )
    rates = lib.b_rate.withColumn("notes", F.lit(None).cast("string"))
    return edit_rates(rates, e, ON).filter("edited").select("id", "amount", "status", "rejected", "notes")


def edit_rates(rates, edits, today):
    """Hand corrections with an audit note. An edit that would leave bad dates or a non-positive amount is rejected
    and changes nothing."""
    j = rates.join(edits, rates["id"] == edits["rate_id"], "left")
    to = F.coalesce("new_to", "valid_to")
    bad = (
        F.when(F.col("new_status").eqNullSafe(F.lit("retired")), F.lit(None))
        .when(F.col("new_amount") <= 0, "Amount must be more than 0")
        .when(F.col("valid_from") > to, "'Valid from' is after 'valid to'")
    )
    j = j.withColumns({"rejected": bad, "edited": F.col("rate_id").isNotNull()})
    ok = F.col("edited") & F.col("rejected").isNull()
    retire = ok & F.col("new_status").eqNullSafe(F.lit("retired"))
    day = F.date_format(F.lit(today), "dd MMM yyyy")

    def moved(name, old, new):
        return F.when(ok & F.col(new).isNotNull() & (F.col(new) != F.col(old)), F.concat(F.lit(name + " "), F.col(old).cast("string"), F.lit(" -> "), F.col(new).cast("string")))

    list_ = F.concat_ws(", ", moved("amount", "amount", "new_amount"), moved("valid_to", "valid_to", "new_to"))
    note = F.when(retire, F.concat(F.lit("Retired by "), "by", F.lit(" on "), day)).when(list_ != "", F.concat(F.lit("Edited by "), "by", F.lit(" on "), day, F.lit(": "), list_))
    plain = ok & ~retire
    return j.withColumns(
        {
            "notes": F.concat_ws(" | ", F.nullif("notes", F.lit("")), note),
            "status": F.when(retire, "superseded").otherwise(F.col("status")),
            "amount_": F.when(plain, F.coalesce("new_amount", "amount")).otherwise(F.col("amount")),
            "valid_to": F.when(plain, to).otherwise(F.col("valid_to")),
        }
    ).drop("amount", "new_amount", "new_to", "new_status", "rate_id", "by").withColumnRenamed("amount_", "amount")


@query(
    "j21_supplier_from_filename",
    f"""with w as (select id, list_filter(string_split({KEY_SQL.format('name')}, ' '), lambda x: not list_contains([{", ".join(f"'{x}'" for x in keys.GENERIC_WORDS)}], x) and length(x) >= 3) as own from b_supplier),
       f as (select id, string_split({KEY_SQL.format("fname")}, ' ') as words from (select id, 'supplier_' || lpad(cast(supplier_id as varchar), 9, '0') || '-rates_2026.pdf' as fname from b_document))
       select f.id as document_id, min(w.id) as supplier_id from f left join w on len(own) >= 2 and list_has_all(f.words, w.own) group by 1""",
    ["b_supplier", "b_document"],
)
def j21(lib):
    files = lib.b_document.select(F.col("id").alias("document_id"), F.expr("'supplier_' || lpad(supplier_id, 9, '0') || '-rates_2026.pdf'").alias("filename"))
    return supplier_from_filename(files, lib.b_supplier)


def supplier_from_filename(files, suppliers):
    """The supplier whose distinctive words all appear in the file name, most words first, then lowest id. Files and
    suppliers meet on each supplier's rarest word only."""
    generic = F.array(*[F.lit(w) for w in keys.GENERIC_WORDS])
    own = F.filter(F.split(keys.name_key("name"), " "), lambda w: ~F.array_contains(generic, w) & (F.length(w) >= 3))
    s = suppliers.select("id", own.alias("own")).filter((F.size("own") >= 2) | (F.length(F.try_element_at("own", F.lit(1))) >= 6))
    words = s.select("id", "own", F.explode(F.array_distinct("own")).alias("w"))
    freq = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    sig = words.join(freq, "w").groupBy("id").agg(F.min_by("w", F.struct("df", "w")).alias("w"), F.any_value("own").alias("own"))
    names = files.select("document_id", F.array_distinct(F.split(keys.name_key("filename"), " ")).alias("words"))
    hit = names.select("document_id", "words", F.explode("words").alias("w")).join(sig, "w").filter(F.size(F.array_except("own", "words")) == 0)
    best = hit.groupBy("document_id").agg(F.min_by("id", F.struct(-F.size("own"), F.col("id"))).alias("supplier_id"))
    return files.select("document_id").join(best, "document_id", "left")


@query(
    "a25_naming_context",
    """with p as (select supplier_id, title, id from b_package where status = 'active'),
       v as (select supplier_id, name, id from b_service where status = 'active')
       select s.id, 'Packages: ' || string_agg(x.title, '; ' order by i) as line from (select supplier_id, title, min(-id) as i from p group by 1, 2) x join b_supplier s on s.id = x.supplier_id group by 1
       union all select s.id, 'Services: ' || string_agg(x.name, '; ' order by i) from (select supplier_id, name, min(id) as i from v group by 1, 2) x join b_supplier s on s.id = x.supplier_id group by 1""",
    ["b_package", "b_service", "b_supplier"],
)
def a25(lib):
    """Names a supplier's earlier sheets used: package titles from the newest, service names from the first, each once."""
    def named(df, name, place, label):
        once = df.filter("status = 'active'").groupBy("supplier_id", name).agg(F.min(place).alias("place"))
        g = once.groupBy("supplier_id").agg(F.array_sort(F.collect_list(F.struct("place", name))).alias("xs"))
        return g.select(F.col("supplier_id").alias("id"), F.concat(F.lit(label + ": "), F.array_join(F.transform("xs", lambda x: x[name]), "; ")).alias("line"))

    lines = named(lib.b_package, "title", -F.col("id"), "Packages").unionByName(named(lib.b_service, "name", F.col("id"), "Services"))
    return lines.join(lib.b_supplier.select("id"), "id", "left_semi")


@query(
    "c37_document_queue",
    "select d.id, d.filename, d.status, s.name as supplier, coalesce(l.n, 0) as lines from b_document d left join b_supplier s on s.id = d.supplier_id left join (select document_id, count(*) as n from b_line group by 1) l on l.document_id = d.id where d.status = 'needs_review'",
    ["b_document", "b_supplier", "b_line"],
)
def c37(lib):
    s = lib.b_supplier.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier"))
    n = lib.b_line.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("lines"))
    d = lib.b_document.filter("status = 'needs_review'").join(s, "supplier_id", "left").join(n, "id", "left")
    return d.select("id", "filename", "status", "supplier", F.coalesce("lines", F.lit(0)).alias("lines")).orderBy(F.desc("id"))


@query(
    "c02_period_checks",
    f"""select id, case when valid_from > valid_to then 'error' else 'warning' end as level, case when valid_from > valid_to then 'Valid from ' || valid_from || ' is after valid to ' || valid_to when valid_to < {TODAY} then 'Rate expired on ' || valid_to end as message from b_rate
        where valid_from > valid_to or valid_to < {TODAY}
        union all select id, 'warning', 'Validity longer than 2 years (' || valid_from || ' to ' || valid_to || ') - check the dates' from b_service_span where valid_to - valid_from > 730""".replace("b_service_span", "(select cast(id as varchar) as id, valid_from, valid_to from b_service)"),
    ["b_rate", "b_service"],
)
def c02(lib):
    from ..operators.normalize import period_issues

    r = lib.b_rate.select("id", F.explode(period_issues("valid_from", "valid_to", F.lit(ON))).alias("i"))
    s = lib.b_service.select(F.col("id").cast("string").alias("id"), F.explode(period_issues("valid_from", "valid_to", F.lit(dt.date(1990, 1, 1)))).alias("i"))
    return r.unionByName(s).select("id", "i.level", "i.message")


