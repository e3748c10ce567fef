"""Trips, quotations and dashboards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import keys, money
from ..functions.grouping import numbered
from ..operators import packages, quotes, trips
from .packages import COVERS, trend_points  # noqa: F401
from .registry import query

ON = dt.date(1998, 6, 12)
TODAY = "date '1998-06-12'"
TT_VIEWS = ["b_trip", "b_item", "b_payment"]
TT = """
 oc as (select trip_id, option_label, coalesce(sum(amount) filter (not optional), 0) as own, min(id) as fid, count(*) as n from b_item group by 1, 2),
 cu as (select trip_id, min(currency) filter (not optional) as c1, max(currency) filter (not optional) as c2, count(*) as n_items from b_item group by 1),
 sh as (select trip_id, sum(own) filter (option_label is null) as shared, count(option_label) as options from oc group by 1),
 hd as (select o.trip_id, o.option_label, o.own, o.option_label = t.chosen_option as picked from oc o join b_trip t on t.id = o.trip_id where o.option_label is not null
    qualify row_number() over (partition by o.trip_id order by coalesce(o.option_label = t.chosen_option, false) desc, o.own, o.fid) = 1),
 pd as (select trip_id, sum(amount) as paid from b_payment group by 1),
 base as (select t.*, cast(coalesce(sh.shared, 0) + coalesce(hd.own, 0) as decimal(16,2)) as cost, coalesce(options, 0) as n_options, hd.option_label as head, coalesce(hd.picked, false) as picked,
     cast(coalesce(pd.paid, 0) as decimal(16,2)) as paid, t.adults + t.children_with_bed + t.children_without_bed as travellers, c1, c2, coalesce(n_items, 0) as n_items
   from b_trip t left join sh on sh.trip_id = t.id left join hd on hd.trip_id = t.id left join pd on pd.trip_id = t.id left join cu on cu.trip_id = t.id),
 tx as (select *, cost * cast(100 + markup_pct as decimal(6,2)) * cast(100 + gst_pct as decimal(5,2)) * cast(0.0001 as decimal(5,4)) as sx from base),
 tt as (select id as trip_id, cost, round(cost * markup_pct * cast(0.01 as decimal(3,2)), 2) as markup, round(cost * cast(100 + markup_pct as decimal(6,2)) * gst_pct * cast(0.0001 as decimal(5,4)), 2) as gst,
     round(sx, 2) as sell, ((2 * cast(cast(sx as decimal(18,6)) * 1000000 as hugeint) + travellers * 10000) // nullif(2 * travellers * 10000, 0)) / 100.0 as per_person, cast(travellers as bigint) as travellers, paid, round(sx - paid, 2) as balance, n_options as options, head as option,
     case when picked then head end as chosen_option, n_options > 0 and not picked as is_from_price, case when c1 = c2 then c1 else currency end as currency, coalesce(c1 <> c2, false) as mixed_currency, n_items from tx)
"""
MONEY = "cast(cost as double) as cost, cast(markup as double) as markup, cast(gst as double) as gst, cast(sell as double) as sell, per_person, travellers, cast(paid as double) as paid, cast(balance as double) as balance, options, option, chosen_option, is_from_price, currency, mixed_currency"


def tt(lib):
    return trips.totals(lib.b_trip, lib.b_item, lib.b_payment)


@query("a08_trip_totals", f"with {TT} select trip_id, {MONEY} from tt", TT_VIEWS)
def a08(lib):
    return tt(lib).drop("n_items")


@query(
    "a08_option_prices",
    f"""with {TT} select o.trip_id, o.option_label as label, cast(o.own + coalesce(s.shared, 0) as double) as cost,
        cast(round(cast(o.own + coalesce(s.shared, 0) as decimal(16,2)) * cast(100 + markup_pct as decimal(6,2)) * cast(100 + gst_pct as decimal(5,2)) * cast(0.0001 as decimal(5,4)), 2) as double) as sell, coalesce(o.option_label = t.chosen_option, false) as chosen
      from oc o join b_trip t on t.id = o.trip_id left join sh s on s.trip_id = o.trip_id where o.option_label is not null""",
    TT_VIEWS,
)
def a08o(lib):
    return trips.option_prices(lib.b_trip, lib.b_item).drop("per_person")


DASH = f"with {TT}, x as (select t.*, tt.sell, tt.balance, tt.markup from b_trip t join tt on tt.trip_id = t.id where not t.is_template)"


def dash_rows(lib):
    t = lib.b_trip.filter("not is_template")
    return t.drop("chosen_option", "currency").join(tt(lib).select(F.col("trip_id").alias("id"), "sell", "balance", "markup", "currency"), "id")


@query(
    "a09_pipeline",
    f"{DASH} select s.status, count(x.id) as trips, cast(coalesce(sum(x.sell), 0) as double) as value from (select unnest(['enquiry','quoted','confirmed','completed','lost']) as status) s left join x on x.status = s.status group by 1",
    TT_VIEWS,
)
def a09(lib):
    """Count and value per stage; stages without trips show as zero."""
    got = dash_rows(lib).groupBy("status").agg(F.count(F.lit(1)).alias("trips"), F.sum("sell").alias("value"))
    stages = lib.spark.createDataFrame([(s,) for s in trips.TRIP_STATUSES], "status string")
    return stages.join(F.broadcast(got), "status", "left").select("status", F.coalesce("trips", F.lit(0)).alias("trips"), F.coalesce("value", F.lit(0)).alias("value"))


@query(
    "a09_lead_sources",
    f"{DASH} select coalesce(lead_source, 'Not set') as source, count(*) as trips, count(*) filter (status in ('confirmed', 'completed')) as confirmed, cast(coalesce(sum(sell) filter (status in ('confirmed', 'completed')), 0) as double) as value from x group by 1",
    TT_VIEWS,
)
def a09s(lib):
    won = F.col("status").isin("confirmed", "completed")
    return dash_rows(lib).groupBy(F.coalesce("lead_source", F.lit("Not set")).alias("source")).agg(
        F.count(F.lit(1)).alias("trips"), F.count_if(won).alias("confirmed"), F.coalesce(F.sum(F.when(won, F.col("sell"))), F.lit(0)).alias("value")
    ).orderBy(F.desc("trips"), "source")


@query(
    "a09_dashboard_figures",
    f"""{DASH}, m as (select * from x where created_on >= date '1998-06-01')
      select (select count(*) from m) as enquiries, (select cast(coalesce(sum(sell), 0) as double) from m where status <> 'enquiry') as quoted_value,
        (select count(*) from m where status in ('confirmed', 'completed')) as confirmed, (select cast(coalesce(sum(sell), 0) as double) from m where status in ('confirmed', 'completed')) as confirmed_value,
        (select cast(coalesce(sum(markup), 0) as double) from m where status in ('confirmed', 'completed')) as profit,
        (select cast(coalesce(sum(greatest(balance, 0)), 0) as double) from x where status in ('confirmed', 'completed')) as balance_due,
        (select round(100.0 * count(*) filter (status in ('confirmed', 'completed')) / count(*) filter (status in ('confirmed', 'completed', 'lost')), 1) from x) as conversion_pct""",
    TT_VIEWS,
)
def a09f(lib):
    x = dash_rows(lib)
    won, month = F.col("status").isin("confirmed", "completed"), F.col("created_on") >= F.lit(ON.replace(day=1))

    def value(test, c="sell"):
        return F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))

    return x.agg(
        F.count_if(month).alias("enquiries"), value(month & (F.col("status") != "enquiry")).alias("quoted_value"),
        F.count_if(month & won).alias("confirmed"), value(month & won).alias("confirmed_value"), value(month & won, "markup").alias("profit"),
        F.coalesce(F.sum(F.when(won, F.greatest(F.col("balance"), F.lit(0)))), F.lit(0)).alias("balance_due"),
        F.round(F.count_if(won) * 100 / F.nullif(F.count_if(won | (F.col("status") == "lost")), F.lit(0)), 1).alias("conversion_pct"),
    )


@query(
    "t06_follow_ups_and_departures",
    f"""{DASH} select 'follow_up' as list, id, cast(follow_up_date as varchar) as on_date, cast({TODAY} - follow_up_date as bigint) as overdue_days, cast(sell as double) as sell from x where follow_up_date <= {TODAY} and status in ('enquiry', 'quoted')
      union all select 'departure', id, cast(start_date as varchar), null, cast(sell as double) from x where start_date between {TODAY} and {TODAY} + 30 and status = 'confirmed'""",
    TT_VIEWS,
)
def t06(lib):
    x, day = dash_rows(lib), F.lit(ON)
    follow = x.filter((F.col("follow_up_date") <= day) & F.col("status").isin("enquiry", "quoted"))
    leave = x.filter(F.col("start_date").between(day, F.date_add(day, 30)) & (F.col("status") == "confirmed"))
    a = follow.select(F.lit("follow_up").alias("list"), "id", F.col("follow_up_date").alias("on_date"), F.datediff(day, "follow_up_date").cast("bigint").alias("overdue_days"), "sell")
    b = leave.select(F.lit("departure").alias("list"), "id", F.col("start_date").alias("on_date"), F.lit(None).cast("bigint").alias("overdue_days"), "sell")
    return a.unionByName(b).orderBy("list", "on_date", "id")


@query(
    "a10_trip_list",
    f"""with {TT} select t.id, t.title, t.status, tt.travellers, cast(tt.sell as double) as sell, cast(tt.balance as double) as balance, tt.currency, tt.is_from_price, tt.options, coalesce(q.n, 0) as quotations, coalesce(d.n, 0) as days
      from b_trip t join tt on tt.trip_id = t.id left join (select trip_id, count(*) as n from b_quote group by 1) q on q.trip_id = t.id left join (select trip_id, count(*) as n from b_trip_day group by 1) d on d.trip_id = t.id where not t.is_template""",
    [*TT_VIEWS, "b_quote", "b_trip_day"],
)
def a10(lib):
    q = lib.b_quote.groupBy(F.col("trip_id").alias("id")).agg(F.count(F.lit(1)).alias("quotations"))
    d = lib.b_trip_day.groupBy(F.col("trip_id").alias("id")).agg(F.count(F.lit(1)).alias("days"))
    t = lib.b_trip.filter("not is_template").select("id", "title", "status")
    v = tt(lib).select(F.col("trip_id").alias("id"), "travellers", "sell", "balance", "currency", "is_from_price", "options")
    j = t.join(v, "id").join(q, "id", "left").join(d, "id", "left")
    return j.withColumns({"quotations": F.coalesce("quotations", F.lit(0)), "days": F.coalesce("days", F.lit(0))})


@query(
    "a17_trips_per_stage",
    "select status, count(*) as trips from b_trip group by 1",
    ["b_trip"],
)
def a17s(lib):
    return lib.b_trip.groupBy("status").agg(F.count(F.lit(1)).alias("trips")).orderBy(F.desc("trips"))


@query(
    "p13_shown_items",
    f"with {TT} select i.trip_id, i.id from b_item i join tt on tt.trip_id = i.trip_id where i.option_label is null or i.option_label is not distinct from tt.chosen_option",
    TT_VIEWS,
)
def p13(lib):
    t = lib.b_trip.select(F.col("id").alias("trip_id"), "chosen_option")
    j = lib.b_item.join(t, "trip_id")
    return j.filter(F.col("option_label").isNull() | F.col("option_label").eqNullSafe(F.col("chosen_option"))).select("trip_id", "id")


@query(
    "a23_options_display",
    """with lines as (select i.trip_id, i.option_label as label, i.id, coalesce(i.day_position, 0) as pos, i.description as line from b_item i where i.option_label is not null and not i.optional and i.kind <> 'package'),
      h as (select i.trip_id, i.option_label as label, p.city, p.hotel_name, p.id, row_number() over (partition by i.trip_id, i.option_label, p.city order by p.id) as n
            from (select distinct trip_id, option_label, ref_id from b_item where option_label is not null and not optional and kind = 'package') i join b_pkg_hotel p on p.package_id = i.ref_id)
      select trip_id, label, line from lines union all
      select trip_id, label, city || ': ' || string_agg(hotel_name, ', ' order by n) || ' or similar' from h where n <= 3 group by trip_id, label, city""",
    ["b_item", "b_pkg_hotel"],
)
def a23(lib):
    """What each option contains: its lines, and for packages the first three hotels of each city."""
    from pyspark.sql import Window

    own = lib.b_item.filter("option_label is not null and not optional")
    lines = own.filter("kind <> 'package'").select("trip_id", F.col("option_label").alias("label"), F.col("description").alias("line"))
    used = own.filter("kind = 'package'").select("trip_id", F.col("option_label").alias("label"), F.col("ref_id").alias("package_id")).distinct()
    city = Window.partitionBy("package_id", "city").orderBy("id")
    h = lib.b_pkg_hotel.select("package_id", "city", "hotel_name", "id", F.row_number().over(city).alias("n")).filter("n <= 3")
    j = used.join(h, "package_id").groupBy("trip_id", "label", "city").agg(F.array_sort(F.collect_list(F.struct("id", "hotel_name"))).alias("hs"))
    names = F.array_join(F.transform(F.slice("hs", 1, 3), lambda x: x["hotel_name"]), ", ")
    return lines.unionByName(j.select("trip_id", "label", F.concat("city", F.lit(": "), names, F.lit(" or similar")).alias("line")))


@query(
    "a24_merge_terms",
    """select t.id, array_to_string(list_distinct_ordered, '|') as inclusions from (select t.id, list_filter(list_concat(['Guide', 'Breakfast'], p.inclusions), lambda x, i: list_position(list_concat(['Guide', 'Breakfast'], p.inclusions), x) = i) as list_distinct_ordered
       from b_trip t join b_package p on p.id = t.id) t""",
    ["b_trip", "b_package"],
)
def a24(lib):
    """A trip's own inclusions and its package's, first mention kept."""
    p = lib.b_package.select("id", "inclusions")
    own = F.array(F.lit("Guide"), F.lit("Breakfast"))
    return lib.b_trip.select("id").join(p, "id").select("id", F.array_join(F.array_distinct(F.concat(own, "inclusions")), "|").alias("inclusions"))


@query(
    "j06_suggested_addons",
    """with d as (select distinct trip_id, source_package_id from b_trip_day where source_package_id is not null),
       fd as (select distinct d.trip_id, m.document_id from d join b_package p on p.id = d.source_package_id join b_package m on m.family_id = p.family_id)
       select f.trip_id, s.id as service_id, cast(s.amount as double) as amount from fd f join b_service s on s.document_id = f.document_id and s.status = 'active'
       where not exists (select 1 from b_item i where i.trip_id = f.trip_id and i.kind = 'service' and i.ref_id = s.id)""",
    ["b_trip_day", "b_package", "b_service", "b_item"],
)
def j06(lib):
    """Live services from any sheet of a trip's package families that the trip does not use yet."""
    p = lib.b_package.select(F.col("id").alias("source_package_id"), "family_id")
    fams = lib.b_trip_day.select("trip_id", "source_package_id").distinct().join(p, "source_package_id").select("trip_id", "family_id").distinct()
    # which families have live services, before families meet trips
    svc = lib.b_service.filter("status = 'active'").select("document_id", F.col("id").alias("service_id"), "amount")
    offers = lib.b_package.select("family_id", "document_id").distinct().join(svc, "document_id").select("family_id", "service_id", "amount").distinct()
    used = lib.b_item.filter("kind = 'service'").select("trip_id", F.col("ref_id").alias("service_id")).distinct()
    return fams.join(offers, "family_id").select("trip_id", "service_id", "amount").distinct().join(used, ["trip_id", "service_id"], "left_anti")


@query(
    "j07_uncovered_days",
    """select d.trip_id, d.source_package_id as package_id, count(*) as days from b_trip_day d where d.source_package_id is not null
       and not exists (select 1 from b_item i where i.trip_id = d.trip_id and i.kind = 'package' and i.ref_id = d.source_package_id) group by 1, 2""",
    ["b_trip_day", "b_item"],
)
def j07(lib):
    priced = lib.b_item.filter("kind = 'package'").select("trip_id", F.col("ref_id").alias("package_id")).distinct()
    d = lib.b_trip_day.filter("source_package_id is not null").groupBy("trip_id", F.col("source_package_id").alias("package_id")).agg(F.count(F.lit(1)).alias("days"))
    return d.join(priced, ["trip_id", "package_id"], "left_anti")


@query(
    "u04_used_packages",
    """select trip_id, package_id, package_id in (select ref_id from b_item i where i.trip_id = u.trip_id and kind = 'package') as priced from (
        select trip_id, ref_id as package_id from b_item where kind = 'package' union select trip_id, source_package_id from b_trip_day where source_package_id is not null) u""",
    ["b_trip_day", "b_item"],
)
def u04(lib):
    return used_packages(lib)


def used_packages(lib):
    a = lib.b_item.filter("kind = 'package'").select("trip_id", F.col("ref_id").alias("package_id"), F.lit(True).alias("priced"))
    b = lib.b_trip_day.filter("source_package_id is not null").select("trip_id", F.col("source_package_id").alias("package_id"), F.lit(False).alias("priced"))
    return a.unionByName(b).groupBy("trip_id", "package_id").agg(F.bool_or("priced").alias("priced"))


NEWER_T = f"""
 used as (select trip_id, ref_id as package_id from b_item where kind = 'package' union select trip_id, source_package_id from b_trip_day where source_package_id is not null),
 ask as (select u.trip_id, t.start_date as on_date, a.id as from_id, a.version as from_version, a.family_id, a.status, a.valid_from, a.valid_to from used u join b_trip t on t.id = u.trip_id join b_package a on a.id = u.package_id),
 cand as (select a.trip_id, a.from_id, a.from_version, a.on_date, p.id as to_id, p.version as to_version, case when a.on_date is not null then {COVERS.format(d='a.on_date')} else false end as sold, a.status <> 'active' as repl,
     a.valid_from is null or a.valid_to is null or p.valid_from is null or p.valid_to is null or (p.valid_from <= a.valid_from and p.valid_to >= a.valid_to) as wider
   from ask a join b_package p on p.family_id = a.family_id and p.version > a.from_version and p.status = 'active'),
 nv as (select trip_id, from_id, from_version, to_id, to_version from cand where case when on_date is not null then sold or repl else repl or wider end
   qualify row_number() over (partition by trip_id, from_id order by sold desc, to_version desc, to_id desc) = 1)
"""


def trip_upgrades(lib):
    t = lib.b_trip.select(F.col("id").alias("trip_id"), F.col("start_date").alias("on_date"))
    asks = used_packages(lib).join(t, "trip_id")
    newer = packages.newer_version(lib.b_package, lib.b_price, asks.select("package_id", "on_date")).alias("n")
    a = asks.alias("a")
    j = a.join(newer, (F.col("a.package_id") == F.col("n.package_id")) & F.col("a.on_date").eqNullSafe(F.col("n.on_date")))
    own = lib.b_package.select(F.col("id").alias("from_id"), F.col("version").alias("from_version"))
    j = j.select("trip_id", F.col("a.package_id").alias("from_id"), F.col("newer_id").alias("to_id"), F.col("newer_version").alias("to_version"))
    return j.join(own, "from_id")


@query("c24_newer_versions", f"with {NEWER_T} select * from nv", ["b_trip", "b_item", "b_trip_day", "b_package", "b_price"])
def c24(lib):
    return trip_upgrades(lib)


@query(
    "c24_upgrade_days",
    f"""with {NEWER_T} select d.trip_id, d.position, n.to_id as source_package_id, coalesce(case when d.title = o.title then w.title end, d.title) as title, coalesce(case when d.title = o.title then w.overnight end, d.overnight) as overnight, w.id as source_day_id
      from b_trip_day d join nv n on n.trip_id = d.trip_id and n.from_id = d.source_package_id left join b_day o on o.package_id = n.from_id and o.day_number = d.position left join b_day w on w.package_id = n.to_id and w.day_number = d.position and o.id is not null""",
    ["b_trip", "b_item", "b_trip_day", "b_package", "b_price", "b_day"],
)
def c24u(lib):
    """Days copied from a package that has a newer version: edited ones keep their text, the others take the new one."""
    n = trip_upgrades(lib).select("trip_id", F.col("from_id").alias("source_package_id"), "to_id")
    o = lib.b_day.select(F.col("package_id").alias("source_package_id"), F.col("day_number").alias("position"), F.col("title").alias("o_title"))
    w = lib.b_day.select(F.col("package_id").alias("to_id"), F.col("day_number").alias("position"), F.col("title").alias("w_title"), F.col("overnight").alias("w_overnight"), F.col("id").alias("w_id"))
    d = lib.b_trip_day.join(n, ["trip_id", "source_package_id"]).join(o, ["source_package_id", "position"], "left").join(w, ["to_id", "position"], "left")
    known = F.col("o_title").isNotNull()
    same = known & F.col("title").eqNullSafe(F.col("o_title"))
    return d.select(
        "trip_id", "position", F.col("to_id").alias("source_package_id"),
        F.coalesce(F.when(same, F.col("w_title")), "title").alias("title"),
        F.coalesce(F.when(same, F.col("w_overnight")), "overnight").alias("overnight"),
        F.when(known, F.col("w_id")).alias("source_day_id"),
    )


@query(
    "c34_trip_problems",
    f"""with {TT}, {NEWER_T}, un as (select d.trip_id, d.source_package_id as package_id, count(*) as n from b_trip_day d where d.source_package_id is not null and not exists (select 1 from b_item i where i.trip_id = d.trip_id and i.kind = 'package' and i.ref_id = d.source_package_id) group by 1, 2)
      select trip_id, error as problem from b_item where error is not null union all select trip_id, 'Items are in different currencies' from tt where mixed_currency
      union all select trip_id, 'A newer version (v' || to_version || ') of ''' || p.title || ''' has been uploaded - this trip still uses v' || from_version from nv join b_package p on p.id = nv.to_id
      union all select trip_id, n || ' day(s) come from ''' || coalesce(p.title, cast(package_id as varchar)) || ''' but nothing in the costing covers them' from un left join b_package p on p.id = un.package_id""",
    [*TT_VIEWS, "b_trip_day", "b_package", "b_price"],
)
def c34(lib):
    names = lib.b_package.select(F.col("id").alias("package_id"), F.col("title").alias("p_title"))
    errors = lib.b_item.filter("error is not null").select("trip_id", F.col("error").alias("problem"))
    mixed = tt(lib).filter("mixed_currency").select("trip_id", F.lit("Items are in different currencies").alias("problem"))
    newer = trip_upgrades(lib).join(names, F.col("to_id") == F.col("package_id"))
    newer = newer.select("trip_id", F.concat(F.lit("A newer version (v"), "to_version", F.lit(") of '"), "p_title", F.lit("' has been uploaded - this trip still uses v"), "from_version").alias("problem"))
    bare = j07(lib).join(names, "package_id", "left")
    bare = bare.select("trip_id", F.concat("days", F.lit(" day(s) come from '"), F.coalesce("p_title", F.col("package_id").cast("string")), F.lit("' but nothing in the costing covers them")).alias("problem"))
    return errors.unionByName(mixed).unionByName(newer).unionByName(bare)


@query(
    "w10_renumber_days",
    "select trip_id, position as old_position, row_number() over (partition by trip_id order by position desc) as position from b_trip_day",
    ["b_trip_day"],
)
def w10(lib):
    """Trips turned around: positions counted again from the last day."""
    d = lib.b_trip_day.select("trip_id", F.col("position").alias("old_position"))
    return trips.renumber(d, [-F.col("old_position")], F.floor(-F.col("old_position") / 100))


@query(
    "c26_insert_library_days",
    """with pick as (select t.id as trip_id, d.day_number as n, d.title, d.overnight from b_trip t join b_day d on d.package_id = t.id),
       pn as (select *, row_number() over (partition by trip_id order by n) as pick_no, count(*) over (partition by trip_id) as k from pick),
       ks as (select distinct trip_id, k from pn)
       select d.trip_id, row_number() over (partition by d.trip_id order by pos) as position, title from (
         select d.trip_id, d.position + case when d.position > 1 then coalesce(k, 0) else 0 end as pos, d.title from b_trip_day d left join ks on ks.trip_id = d.trip_id
         union all select trip_id, 1 + pick_no, title from pn) d""",
    ["b_trip", "b_day", "b_trip_day"],
)
def c26(lib):
    """The days of the package of the same number go in after day 1 of each trip."""
    pick = lib.b_day.select(F.col("package_id").alias("trip_id"), "day_number", "title", "overnight")
    pick = numbered(pick, ["trip_id"], F.col("day_number"), [F.col("day_number")], "pick_no").drop("day_number")
    after = pick.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_picks")).withColumn("after_position", F.lit(1))
    all_days = trips.insert_days(lib.b_trip_day.select("trip_id", "position", "title", "overnight"), pick, after)
    out = trips.renumber(all_days.withColumnRenamed("position", "pos"), [F.col("pos")], F.floor(F.col("pos") / 100))
    return out.select("trip_id", "position", "title")


@query(
    "c27_copy_plans",
    """select t.id + (select max(id) from b_trip) as id, 'Copy of ' || title as title, 'enquiry' as status, cast(start_date as varchar) as start_date, (select count(*) from b_trip_day d where d.trip_id = t.id) as days,
        (select coalesce(cast(sum(amount) as double), 0) from b_item i where i.trip_id = t.id) as amount from b_trip t""",
    ["b_trip", "b_trip_day", "b_item"],
)
def c27(lib):
    return _copied(lib, lib.b_trip)


@query(
    "c27_trips_from_templates",
    """select t.id + (select max(id) from b_trip) as id, title, 'enquiry' as status, cast(null as varchar) as start_date, (select count(*) from b_trip_day d where d.trip_id = t.id) as days,
        (select coalesce(cast(sum(amount) as double), 0) from b_item i where i.trip_id = t.id) as amount from b_trip t where is_template""",
    ["b_trip", "b_trip_day", "b_item"],
)
def c27t(lib):
    """A trip started from every template: its days and costs, without dates and customer."""
    return _copied(lib, lib.b_trip.filter("is_template"), template=True)


def _copied(lib, source, template=False):
    last = lib.b_trip.agg(F.max("id").alias("m")).first()["m"]
    head, days, items = trips.copy_plan(source, lib.b_trip_day, lib.b_item, F.col("id") + F.lit(last), as_template=template)
    d = days.groupBy(F.col("trip_id").alias("id")).agg(F.count(F.lit(1)).alias("days"))
    a = items.groupBy(F.col("trip_id").alias("id")).agg(F.sum("amount").cast("double").alias("amount"))
    j = head.join(d, "id", "left").join(a, "id", "left")
    return j.select("id", "title", "status", "start_date", F.coalesce("days", F.lit(0)).alias("days"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


@query(
    "c25_trip_from_package",
    f"""with used as (select id as trip_id, id as package_id from b_trip where not is_template), cats as (select package_id, category from b_price where category is not null group by 1, 2)
      select u.trip_id, 'day' as part, cast(coalesce(m.last, 0) + d.day_number as bigint) as seq, d.title as text from used u join b_day d on d.package_id = u.package_id left join (select trip_id, max(position) as last from b_trip_day group by 1) m on m.trip_id = u.trip_id
      union all select u.trip_id, 'option', null, c.category from used u join cats c on c.package_id = u.package_id""",
    ["b_trip", "b_day", "b_trip_day", "b_price"],
)
def c25(lib):
    """Package days go after a trip's own days; every category becomes an option line to price."""
    t = lib.b_trip.filter("not is_template").select(F.col("id").alias("trip_id"))
    last = lib.b_trip_day.groupBy("trip_id").agg(F.max("position").alias("last"))
    d = t.join(lib.b_day.withColumnRenamed("package_id", "trip_id").drop("id"), "trip_id").join(last, "trip_id", "left")
    days = d.select("trip_id", F.lit("day").alias("part"), (F.coalesce("last", F.lit(0)) + F.col("day_number")).cast("bigint").alias("seq"), F.col("title").alias("text"))
    c = lib.b_price.filter("category is not null").select(F.col("package_id").alias("trip_id"), "category").distinct()
    opts = t.join(c, "trip_id").select("trip_id", F.lit("option").alias("part"), F.lit(None).cast("bigint").alias("seq"), F.col("category").alias("text"))
    return days.unionByName(opts)


# ---------------------------------------------------------------- quotations
@query(
    "w09_quotation_numbers",
    "select id, trip_id, row_number() over (partition by trip_id order by id) as version, 'Q-' || year(created_on) || '-' || lpad(cast(id as varchar), cast(greatest(4, length(cast(id as varchar))) as int), '0') as number from b_quote",
    ["b_quote"],
)
def w09(lib):
    return quotation_numbers(lib.b_quote, "Q").select("id", "trip_id", "version", "number")


def quotation_numbers(quotes, prefix):
    q = numbered(quotes, ["trip_id"], F.floor(F.col("id") / 100000), [F.col("id")], "version")
    return q.withColumn("number", F.format_string(prefix + "-%d-%04d", F.year("created_on"), F.col("id")))


@query(
    "c28_quotation_snapshots",
    f"""with {TT} select t.id as trip_id, cast(tt.sell as double) as total, tt.per_person, tt.currency, tt.travellers, tt.options, cast(tt.n_items as bigint) as items, coalesce(d.n, 0) as days, cast({TODAY} + 7 as varchar) as valid_until
      from b_trip t join tt on tt.trip_id = t.id left join (select trip_id, count(*) as n from b_trip_day group by 1) d on d.trip_id = t.id where not t.is_template and (tt.n_items > 0 or d.n > 0)""",
    [*TT_VIEWS, "b_trip_day"],
)
def c28(lib):
    """A frozen copy of every quotable trip: totals, options and counts as they are today."""
    d = lib.b_trip_day.groupBy("trip_id").agg(F.count(F.lit(1)).alias("days"))
    t = lib.b_trip.filter("not is_template").select(F.col("id").alias("trip_id"))
    j = t.join(tt(lib), "trip_id").join(d, "trip_id", "left").withColumn("days", F.coalesce("days", F.lit(0)))
    return j.filter("n_items > 0 or days > 0").select(
        "trip_id", F.col("sell").alias("total"), "per_person", "currency", "travellers", "options", F.col("n_items").alias("items"), "days", F.date_add(F.lit(ON), 7).alias("valid_until")
    )


_LAST_QUOTE = "(select max(id) from b_quote)"
_QUOTABLE = f"""saved as (select t.id + {_LAST_QUOTE} as id, t.id as trip_id, coalesce(o.n, 0) + 1 as version, 'Q-' || year({TODAY}) || '-' || lpad(cast(t.id + {_LAST_QUOTE} as varchar), cast(greatest(4, length(cast(t.id + {_LAST_QUOTE} as varchar))) as int), '0') as number
      from b_trip t left join (select trip_id, count(*) as n from b_quote group by 1) o on o.trip_id = t.id where not t.is_template and (exists (select 1 from b_trip_day d where d.trip_id = t.id) or exists (select 1 from b_item i where i.trip_id = t.id)))"""


def _saved(lib):
    return quotes.save(lib.b_trip, lib.b_trip_day, lib.b_item, tt(lib), lib.b_quote, ON)


@query(
    "c28_save_quotations",
    f"""with {TT}, {_QUOTABLE} select s.id, s.trip_id, s.version, s.number, cast({TODAY} + 7 as varchar) as valid_until, t.title, t.customer_name, t.destination, cast(t.start_date as varchar) as start_date, tt.travellers, tt.currency, cast(tt.sell as double) as total,
      case when t.status = 'enquiry' then 'quoted' else t.status end as trip_status, 'Quotation ' || s.number || ' (v' || s.version || ') saved: ' || tt.currency || ' ' || format('{{:,}}', cast(round(tt.sell, 0) as bigint)) as note
      from saved s join b_trip t on t.id = s.trip_id join tt on tt.trip_id = t.id""",
    [*TT_VIEWS, "b_trip_day", "b_quote"],
)
def c28s(lib):
    """Every quotable trip saved as a quotation: number, version, totals, what becomes of the trip, and its note."""
    q, moved, notes = _saved(lib)
    status = lib.b_trip.select(F.col("id").alias("trip_id"), F.col("status").alias("own")).join(moved.select(F.col("id").alias("trip_id"), F.col("status").alias("after")), "trip_id", "left")
    j = q.join(status, "trip_id").join(notes.withColumnRenamed("text", "note"), "trip_id")
    return j.select("id", "trip_id", "version", "number", "valid_until", "title", "customer_name", "destination", "start_date", "travellers", "currency", "total", F.coalesce("after", "own").alias("trip_status"), "note")


@query(
    "c28_trips_from_quotations",
    f"""with {_QUOTABLE}, n as (select s.id + (select max(id) from b_trip) as new_id, s.* from saved s)
      select n.new_id as trip_id, 'day' as part, cast(d.position as bigint) as seq, d.title as text, cast(null as double) as amount, d.source_package_id as ref_id from n join b_trip_day d on d.trip_id = n.trip_id
      union all select n.new_id, i.kind, i.id, i.description, cast(i.amount as double), i.ref_id from n join b_item i on i.trip_id = n.trip_id
      union all select n.new_id, 'trip', null, t.title || ' for ' || t.customer_name || ' from ' || n.number, cast(t.markup_pct as double), null from n join b_trip t on t.id = n.trip_id""",
    ["b_trip", "b_trip_day", "b_item", "b_quote"],
)
def c28n(lib):
    """New trips from the frozen copies: the rows that come out of the snapshots are those that went in."""
    q, _, _ = _saved(lib)
    head, days, items, notes = quotes.new_trips(q, lib.b_trip)
    none = F.lit(None)
    d = days.select("trip_id", F.lit("day").alias("part"), F.col("position").cast("bigint").alias("seq"), F.col("title").alias("text"), none.cast("double").alias("amount"), F.col("source_package_id").cast("bigint").alias("ref_id"))
    i = items.select("trip_id", F.col("kind").alias("part"), F.col("id").alias("seq"), F.col("description").alias("text"), F.col("amount").cast("double").alias("amount"), F.col("ref_id").cast("bigint").alias("ref_id"))
    number = notes.select("trip_id", F.regexp_replace("text", "^Started from quotation ", "").alias("number"))
    h = head.withColumnRenamed("id", "trip_id").join(number, "trip_id")
    t = h.select("trip_id", F.lit("trip").alias("part"), none.cast("bigint").alias("seq"), F.concat("title", F.lit(" for "), "customer_name", F.lit(" from "), "number").alias("text"), F.col("markup_pct").cast("double").alias("amount"), none.cast("bigint").alias("ref_id"))
    return d.unionByName(i).unionByName(t)


@query(
    "c30_trip_notes",
    """with n as (select q.*, row_number() over (partition by q.trip_id order by q.id) as version, 'Q-' || year(created_on) || '-' || lpad(cast(q.id as varchar), cast(greatest(4, length(cast(q.id as varchar))) as int), '0') as number from b_quote q)
      select trip_id, n.id as quote_id, 'Quotation ' || number || ' (v' || version || ') saved: INR ' || format('{:,}', cast(round(coalesce(total, 0), 0) as bigint)) as text from n join b_trip t on t.id = n.trip_id
      union all select trip_id, n.id, 'Quotation ' || number || ' accepted' || coalesce(' (' || coalesce(n.chosen_option, t.chosen_option) || ')', '') from n join b_trip t on t.id = n.trip_id where n.status = 'accepted'""",
    ["b_quote", "b_trip"],
)
def c30n(lib):
    """The notes that saved and accepted quotations leave in their trips' logs."""
    return quotes.status_notes(quotation_numbers(lib.b_quote, "Q"), lib.b_trip)


@query(
    "c29_expire_quotations",
    f"""select id, case when status in ('draft', 'sent') and valid_until < {TODAY} then 'expired' else status end as status, cast(valid_until as varchar) as valid_until from b_quote where contains(lower(title), 'plan 1') or contains(lower(customer_name), 'plan 1') or contains(lower(destination), 'plan 1')""",
    ["b_quote"],
)
def c29(lib):
    q = lib.b_quote.filter(keys.contains_text("PLAN 1", "title", "customer_name", "destination"))
    late = F.col("status").isin("draft", "sent") & (F.col("valid_until") < F.lit(ON))
    return q.select("id", F.when(late, "expired").otherwise(F.col("status")).alias("status"), "valid_until")


@query(
    "a17_quotations_by_month",
    "select strftime(created_on, '%Y-%m') as month, status, count(*) as quotations, cast(sum(total) as double) as total from b_quote group by 1, 2",
    ["b_quote"],
)
def a17q(lib):
    return lib.b_quote.groupBy(F.date_format("created_on", "yyyy-MM").alias("month"), "status").agg(F.count(F.lit(1)).alias("quotations"), F.sum("total").alias("total"))


@query(
    "c30_status_consequences",
    """with e as (select trip_id, bool_or(status = 'accepted') as acc, count(*) as n, max_by(chosen_option, (created_on, id)) filter (status = 'accepted' and chosen_option is not null) as pick from b_quote group by 1)
      select t.id, t.status as status_before, case when t.status in ('enquiry', 'quoted') and coalesce(acc, false) then 'confirmed' when t.status = 'enquiry' and n > 0 then 'quoted' else t.status end as status,
        coalesce(pick, t.chosen_option) as chosen_option from b_trip t left join e on e.trip_id = t.id""",
    ["b_trip", "b_quote"],
)
def c30(lib):
    ev = lib.b_quote.select("trip_id", F.col("created_on").alias("at"), F.col("id").alias("quote_id"), "status", "chosen_option")
    return trips.status_after(lib.b_trip, ev)


@query(
    "c36_detach_quotations",
    "select q.id, case when t.id is null then q.trip_id end as trip_id from b_quote q left join (select id from b_trip where status = 'lost') t on t.id = q.trip_id",
    ["b_quote", "b_trip"],
)
def c36(lib):
    """Quotations of deleted (lost) trips stay, without their trip."""
    gone = lib.b_trip.filter("status = 'lost'").select(F.col("id").alias("gone"))
    j = lib.b_quote.join(gone, F.col("trip_id") == F.col("gone"), "left")
    return j.select("id", F.when(F.col("gone").isNull(), F.col("trip_id")).alias("trip_id"))


@query(
    "c23_reprice_services",
    """select i.trip_id, i.id, cast(case s.basis when 'per_vehicle' then case when coalesce(pax_max, 0) > 0 then ceil((adults + children_with_bed + children_without_bed) / pax_max) else 1 end
        when 'per_adult' then adults when 'per_child' then children_with_bed + children_without_bed when 'per_group' then 1 when 'unknown' then 1 else adults + children_with_bed + children_without_bed end as bigint) as quantity,
        cast(s.amount as double) as unit, s.currency,
        concat_ws('; ', case when s.amount_max is not null then 'Price range: low end used, edit the unit price if needed' end,
           case when coalesce(t.start_date + i.day_position - 1, t.start_date) not between s.valid_from and s.valid_to then 'Rate valid ' || s.valid_from || ' to ' || s.valid_to || ', not on ' || coalesce(t.start_date + i.day_position - 1, t.start_date) end) as warnings
      from b_item i join b_trip t on t.id = i.trip_id join b_service s on s.id = i.ref_id where i.kind = 'service'""",
    ["b_item", "b_trip", "b_service"],
)
def c23(lib):
    service_quantity = trips.service_quantity
    t = lib.b_trip.select(F.col("id").alias("trip_id"), "adults", (F.col("children_with_bed") + F.col("children_without_bed")).alias("children"), "start_date")
    s = lib.b_service.select(F.col("id").alias("ref_id"), "basis", "pax_max", F.col("amount").alias("unit"), "amount_max", F.col("currency").alias("s_currency"), "valid_from", "valid_to")
    j = lib.b_item.filter("kind = 'service'").select("trip_id", "id", "ref_id", "day_position").join(s, "ref_id").join(t, "trip_id")
    on = F.coalesce(F.date_add("start_date", F.col("day_position") - 1), "start_date")
    off = ~on.between(F.col("valid_from"), F.col("valid_to"))
    warn = F.concat_ws(
        "; ",
        F.when(F.col("amount_max").isNotNull(), "Price range: low end used, edit the unit price if needed"),
        F.when(off, F.concat(F.lit("Rate valid "), F.col("valid_from").cast("string"), F.lit(" to "), F.col("valid_to").cast("string"), F.lit(", not on "), on.cast("string"))),
    )
    return j.select("trip_id", "id", service_quantity("basis", "pax_max", "adults", "children").cast("bigint").alias("quantity"), "unit", F.col("s_currency").alias("currency"), warn.alias("warnings"))


@query(
    "s19_item_descriptions",
    """select i.trip_id, i.id, p.title || ' - ' || 'Deluxe' || ' (' || t.adults || ' adult' || case when t.adults <> 1 then 's' else '' end || case when t.children_with_bed + t.children_without_bed > 0 then ', ' || (t.children_with_bed + t.children_without_bed) || ' child' else '' end || ')' as description
       from b_item i join b_trip t on t.id = i.trip_id join b_package p on p.id = i.ref_id where i.kind = 'package'""",
    ["b_item", "b_trip", "b_package"],
)
def s19(lib):
    t = lib.b_trip.select(F.col("id").alias("trip_id"), "adults", (F.col("children_with_bed") + F.col("children_without_bed")).alias("kids"))
    p = lib.b_package.select(F.col("id").alias("ref_id"), "title")
    j = lib.b_item.filter("kind = 'package'").select("trip_id", "id", "ref_id").join(t, "trip_id").join(p, "ref_id")
    return j.select("trip_id", "id", package_line("title", F.lit("Deluxe"), "adults", "kids").alias("description"))


def package_line(title, category, adults, kids):
    a, k = F.col(adults), F.col(kids)
    return F.concat(
        F.col(title), F.lit(" - "), category, F.lit(" ("), a.cast("string"), F.lit(" adult"), F.when(a != 1, "s").otherwise(""),
        F.when(k > 0, F.concat(F.lit(", "), k.cast("string"), F.lit(" child"))).otherwise(""), F.lit(")"),
    )


@query(
    "s22_itinerary_text",
    f"""with {TT} select t.id as trip_id, 1 as section, cast(0 as bigint) as seq, '*' || t.title || '*' as line from b_trip t
      union all select t.id, 2, 0, 'For: ' || customer_name from b_trip t
      union all select d.trip_id, 3, d.position, '*Day ' || d.position || coalesce(' (' || strftime(t.start_date + d.position - 1, '%d %b %Y') || ')', '') || ': ' || d.title || '*' from b_trip_day d join b_trip t on t.id = d.trip_id
      union all select d.trip_id, 3, d.position, 'Overnight: ' || overnight from b_trip_day d
      union all select trip_id, 4, 0, '*Package cost: ' || currency || ' ' || format('{{:,}}', cast(round(sell, 0) as bigint)) || '*' from tt""",
    [*TT_VIEWS, "b_trip_day"],
)
def s22(lib):
    """The plain-text itinerary of every trip, line by line in (section, seq) order."""
    t = lib.b_trip
    none = F.lit(0).cast("bigint").alias("seq")
    a = t.select(F.col("id").alias("trip_id"), F.lit(1).alias("section"), none, F.concat(F.lit("*"), "title", F.lit("*")).alias("line"))
    b = t.select(F.col("id").alias("trip_id"), F.lit(2).alias("section"), none, F.concat(F.lit("For: "), "customer_name").alias("line"))
    d = lib.b_trip_day.join(t.select(F.col("id").alias("trip_id"), "start_date"), "trip_id")
    when = F.coalesce(F.concat(F.lit(" ("), F.date_format(F.date_add("start_date", F.col("position") - 1), "dd MMM yyyy"), F.lit(")")), F.lit(""))
    seq = F.col("position").cast("bigint").alias("seq")
    c = d.select("trip_id", F.lit(3).alias("section"), seq, F.concat(F.lit("*Day "), "position", when, F.lit(": "), "title", F.lit("*")).alias("line"))
    n = d.select("trip_id", F.lit(3).alias("section"), seq, F.concat(F.lit("Overnight: "), "overnight").alias("line"))
    west = F.regexp_replace(money.grouped_amount("sell", F.lit(None).cast("string")), "^ ", "")
    p = tt(lib).select("trip_id", F.lit(4).alias("section"), none, F.concat(F.lit("*Package cost: "), "currency", F.lit(" "), west, F.lit("*")).alias("line"))
    return a.unionByName(b).unionByName(c).unionByName(n).unionByName(p)


def item_inputs(lib):
    """Cost lines with the inputs they were priced with: hotels take their first room, dear lines were negotiated."""
    i = lib.b_item
    return i.select(
        "trip_id", "id", "kind", "ref_id", "day_position", "quantity", "amount", "currency",
        F.lit(None).cast("string").alias("category"), (F.col("ref_id") * 2).alias("room_type_id"), F.lit("CP").alias("meal_plan"), F.lit(1).alias("nights"),
        F.lit(None).cast("int").alias("set_quantity"), F.when((F.col("kind") != "custom") & (F.col("amount") > 90000), F.col("amount")).cast("decimal(14,2)").alias("manual_unit"),
    )


@query(
    "c23_reprice_trips",
    """with s as (select i.trip_id, i.id, i.amount, i.quantity, i.currency, i.kind, x.amount as u, x.currency as xc, cast(case x.basis when 'per_vehicle' then case when coalesce(pax_max, 0) > 0 then ceil((adults + children_with_bed + children_without_bed) / pax_max) else 1 end
        when 'per_adult' then adults when 'per_child' then children_with_bed + children_without_bed when 'per_group' then 1 when 'unknown' then 1 else adults + children_with_bed + children_without_bed end as bigint) as q
      from b_item i join b_trip t on t.id = i.trip_id left join b_service x on x.id = i.ref_id and i.kind = 'service')
      select trip_id, id, kind, cast(amount as double) as amount, currency from s where kind = 'custom'
      union all select trip_id, id, kind, cast(case when amount > 90000 then amount * q else u * q end as double), xc from s where kind = 'service'""",
    ["b_item", "b_trip", "b_service"],
)
def c23_all(lib):
    """All lines are repriced; custom and service lines are compared here, package and stay prices have their own
    checks."""
    out = trips.reprice(item_inputs(lib), lib.b_trip, lib.b_price, lib.b_service, (lib.b_rate, lib.b_surcharge, lib.b_room, lib.b_hotel))
    return out.filter("kind in ('custom', 'service')").select("trip_id", "id", "kind", "amount", "currency")


@query("c23_reprice_packages_and_hotels")
def c23_rest(lib):
    out = trips.reprice(item_inputs(lib), lib.b_trip, lib.b_price, lib.b_service, (lib.b_rate, lib.b_surcharge, lib.b_room, lib.b_hotel))
    return out.filter("kind in ('package', 'hotel')").select("trip_id", "id", "kind", "quantity", "unit_amount", "amount", "currency", "manual", F.array_join("errors", "; ").alias("errors"))
