"""Stay, package and service pricing over whole request tables."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import packages, stays
from ..operators.trips import service_quantity
from .registry import query
from .scalars import DOW_SQL, KEY_SQL


def stay_requests(lib):
    room = F.struct(
        F.col("adults").alias("adults"),
        F.lit(0).alias("children_with_bed"),
        F.col("children_without_bed").alias("children_without_bed"),
    )
    first = F.struct(F.col("adults").alias("adults"), F.col("children_with_bed").alias("children_with_bed"), F.col("children_without_bed").alias("children_without_bed"))
    return lib.b_stay.withColumn("rooms", F.transform(F.sequence(F.lit(1), "rooms"), lambda i: F.when(i == 1, first).otherwise(room))).drop("adults", "children_with_bed", "children_without_bed")


STAY = f"""
 act as (select * from b_rate where status = 'active'),
 nts as (select *, check_in + cast(k as int) as d from (select *, unnest(generate_series(0, nights - 1)) as k from b_stay)),
 picks as (select n.request_id, n.d, r.occupancy as occ, r.amount, r.currency, r.basis, r.is_net, r.taxes_included, r.min_nights, r.id as rate_id
   from nts n join act r on r.room_type_id = n.room_type_id and r.meal_plan = n.meal_plan and n.d between r.valid_from and r.valid_to
    and (r.weekdays is null or list_contains(string_split(r.weekdays, ','), {DOW_SQL.format('n.d')}))
   qualify row_number() over (partition by n.request_id, n.d, r.occupancy order by r.weekdays is not null desc, (coalesce(r.is_net, false) = n.prefer_net) desc, r.document_id desc, r.id desc) = 1),
 has as (select request_id, d, bool_or(occ = 'single') as hs, bool_or(occ = 'triple') as ht from picks group by 1, 2),
 rm as (select n.*, coalesce(hs, false) as hs, coalesce(ht, false) as ht from (select *, unnest(generate_series(1, rooms)) as ri from nts) n left join has h on h.request_id = n.request_id and h.d = n.d),
 plan as (select *, case when adults <= 1 and hs then 'single' when adults = 3 and ht then 'triple' else 'double' end as occ, 1 as qty, 1 as seq from rm
   union all select *, 'extra_adult', adults - 2, 2 from rm where adults > 3 or (adults = 3 and not ht)
   union all select *, 'child_with_bed', children_with_bed, 3 from rm where ri = 1 and children_with_bed > 0
   union all select *, 'child_without_bed', children_without_bed, 4 from rm where ri = 1 and children_without_bed > 0),
 res as (select p.request_id, p.d, p.ri, p.seq, p.occ, p.adults, p.hs, p.nights,
    case when coalesce(a.basis, b.basis, '') = 'per_person_per_night' and p.occ in ('single', 'double', 'triple') then case p.occ when 'single' then 1 when 'double' then 2 else 3 end else p.qty end as qty,
    coalesce(a.amount, b.amount) as unit, coalesce(a.currency, b.currency) as currency, case when a.amount is not null then a.is_net else b.is_net end as is_net,
    case when a.amount is not null then a.taxes_included else b.taxes_included end as taxes, a.amount is null and b.amount is null as missing, a.amount is null and b.amount is not null as as_extra
   from plan p left join picks a on a.request_id = p.request_id and a.d = p.d and a.occ = p.occ
   left join picks b on b.request_id = p.request_id and b.d = p.d and p.occ = 'child_with_bed' and b.occ = 'extra_adult')
"""
COST = """
 sur as (select * from b_surcharge where status = 'active'),
 sup as (select s.request_id, x.name, x.amount * case x.basis when 'per_adult' then adults * rooms when 'per_person' then adults * rooms + children_with_bed + children_without_bed * rooms
      when 'per_child' then children_with_bed + children_without_bed * rooms when 'per_room' then rooms
      when 'per_room_per_night' then rooms * (least(x.date_to, s.check_out - 1) - greatest(x.date_from, s.check_in) + 1) else adults * rooms end as amount,
      case when x.amount is not null then x.currency end as currency,
      case when x.amount is null then 'Supplement ''' || x.name || ''' applies but has no amount - check with the hotel' when x.basis is null then 'Supplement ''' || x.name || ''' basis not stated - charged per adult' end as warning
   from b_stay s join sur x on x.hotel_id = s.hotel_id and x.kind = 'supplement' and x.mandatory and x.date_from <= s.check_out - 1 and s.check_in <= x.date_to),
 stop as (select distinct n.request_id, cast(n.d as varchar) || ': blackout / stop sale at ' || coalesce(h.name, '?') || coalesce(' (' || x.room_type || ')', '') as e
   from nts n join sur x on x.kind = 'blackout' and x.hotel_id = n.hotel_id and n.d between x.date_from and x.date_to join b_room r on r.id = n.room_type_id left join b_hotel h on h.id = n.hotel_id
   where x.room_type is null or contains(lower(r.name), lower(x.room_type)) or contains(lower(x.room_type), lower(r.name))),
 gaps as (select request_id, cast(d as varchar) || ': no valid rate for ' || string_agg(replace(occ, '_', ' ') || ' (room ' || ri || ')', ', ' order by ri, seq) as e from res where missing group by request_id, d),
 cur as (select request_id, currency from res where currency is not null union select request_id, currency from sup where currency is not null),
 mixed as (select request_id, 'Rates are in different currencies: ' || string_agg(currency, ', ' order by currency) as e from cur group by request_id having count(*) > 1),
 errs as (select request_id, string_agg(e, '; ' order by e) as errors from (select * from stop union all select * from gaps union all select * from mixed) group by 1),
 wrn as (select distinct request_id, w from (
   select request_id, cast(d as varchar) || ': no single rate, used double rate for room ' || ri as w from res where adults <= 1 and not hs
   union all select request_id, 'Room ' || ri || ' has ' || adults || ' adults - check the hotel allows it' from res where adults > 3
   union all select request_id, cast(d as varchar) || ': no child-with-bed rate, used extra adult rate' from res where as_extra
   union all select r.request_id, cast(r.d as varchar) || ': minimum stay is ' || p.min_nights || ' nights' from res r join (
       select request_id, d, min_nights from picks where occ in ('double', 'single') qualify row_number() over (partition by request_id, d order by occ) = 1) p on p.request_id = r.request_id and p.d = r.d where p.min_nights > r.nights
   union all select request_id, warning from sup where warning is not null)),
 tot as (select request_id, coalesce(sum(unit * qty), 0) as t, count(distinct case when not missing then coalesce(cast(is_net as varchar), 'u') end) as nn, bool_and(is_net) as net,
     count(*) filter (not missing and is_net is null) as nu, count(distinct case when not missing then coalesce(cast(taxes as varchar), 'u') end) as nt, bool_and(taxes) as tax, count(*) filter (not missing and taxes is null) as tu
   from res group by 1),
 fin as (select s.request_id, s.hotel_id, s.room_type_id, s.meal_plan, s.nights, s.markup_pct, t.t + coalesce(u.a, 0) as cost, nn, net, nu, nt, tax, tu
   from b_stay s join tot t on t.request_id = s.request_id left join (select request_id, sum(amount) as a from sup group by 1) u on u.request_id = s.request_id)
"""


@query(
    "j08_night_rates",
    f"with {STAY} select request_id, cast(d as varchar) as night, occ as occupancy, cast(amount as double) as amount, is_net from picks",
    ["b_stay", "b_rate"],
)
def j08(lib):
    """Each night of each stay with the winning rate of every occupancy on sale."""
    n = stays.stay_nights(stay_requests(lib))
    cal = stays.price_calendar(n, lib.b_rate).select("room_type_id", "meal_plan", "night", F.explode("picks").alias("occupancy", "both"))
    j = n.join(cal, ["room_type_id", "meal_plan", "night"])
    best = F.when(F.col("prefer_net"), F.col("both.net")).otherwise(F.col("both.rack"))
    return j.select("request_id", "night", "occupancy", best["amount"].alias("amount"), best["is_net"].alias("is_net"))


@query(
    "j09_stay_surcharges",
    f"with {STAY}, {COST} select 'stop' as what, request_id, e as text, cast(0 as double) as amount from stop union all select 'supplement', request_id, name, cast(sum(coalesce(amount, 0)) as double) from sup group by request_id, name",
    ["b_stay", "b_rate", "b_surcharge", "b_room", "b_hotel"],
)
def j09(lib):
    req = stay_requests(lib)
    names = req.select("request_id", "hotel_id").join(lib.b_hotel.select(F.col("id").alias("hotel_id"), "name"), "hotel_id", "left")
    stop = stays.blackout_nights(req, lib.b_surcharge, lib.b_room).join(names, "request_id")
    text = F.concat(F.col("night").cast("string"), F.lit(": blackout / stop sale at "), F.coalesce("name", F.lit("?")), F.coalesce(F.concat(F.lit(" ("), "stop_room", F.lit(")")), F.lit("")))
    a = stop.select(F.lit("stop").alias("what"), "request_id", text.alias("text"), F.lit(0.0).alias("amount")).distinct()
    s = stays.supplement_lines(req, lib.b_surcharge).groupBy("request_id", "name").agg(F.sum(F.coalesce("amount", F.lit(0))).cast("double").alias("amount"))
    return a.unionByName(s.select(F.lit("supplement").alias("what"), "request_id", F.col("name").alias("text"), "amount"))


@query(
    "w01_best_rate_per_night",
    f"""with {STAY} select request_id, cast(d as varchar) as night, rate_id from picks where occ = 'double'""",
    ["b_stay", "b_rate"],
)
def w01(lib):
    n = stays.stay_nights(stay_requests(lib))
    rates = lib.b_rate.filter("occupancy = 'double'").withColumn("season_name", F.col("id"))
    cal = stays.price_calendar(n, rates)
    both = F.col("picks")["double"]
    j = n.join(cal, ["room_type_id", "meal_plan", "night"])
    return j.select("request_id", "night", F.when(F.col("prefer_net"), both["net"]).otherwise(both["rack"])["season_name"].alias("rate_id"))


@query(
    "s13_stay_quantities",
    f"with {STAY} select request_id, cast(d as varchar) as night, ri as room_no, seq, occ as occupancy, qty, missing, cast(unit as double) as unit from res",
    ["b_stay", "b_rate"],
)
def s13(lib):
    lines = stays.night_lines(stay_requests(lib), lib.b_rate)
    return lines.select("request_id", "night", F.col("room_no").cast("bigint"), "seq", "occupancy", "qty", "missing", "unit")


@query(
    "s15_supplement_quantity",
    "with s as (select * from b_surcharge where kind = 'supplement' and amount is not null) select document_id, line_no, cast(amount * case basis when 'per_adult' then 3 when 'per_person' then 4 when 'per_child' then 1 when 'per_room' then 2 when 'per_room_per_night' then 2 * (date_to - date_from + 1) else 3 end as double) as charge from s where mandatory and status = 'active'",
    ["b_surcharge"],
)
def s15(lib):
    """What every supplement costs a party of three adults and a child in two rooms that stays through all its dates."""
    s = lib.b_surcharge.withColumn("request_id", F.concat_ws("-", "document_id", "line_no"))
    party = F.array(
        F.struct(F.lit(2).alias("adults"), F.lit(1).alias("children_with_bed"), F.lit(0).alias("children_without_bed")),
        F.struct(F.lit(1).alias("adults"), F.lit(0).alias("children_with_bed"), F.lit(0).alias("children_without_bed")),
    )
    # each surcharge is its own hotel here, so a request meets exactly the supplement it was made for
    req = s.select("request_id", F.col("request_id").alias("hotel_id"), F.col("date_from").alias("check_in"), F.date_add("date_to", 1).alias("check_out"), party.alias("rooms"))
    lines = stays.supplement_lines(req, s.withColumn("hotel_id", F.col("request_id"))).filter("amount is not null")
    parts = F.split("request_id", "-")
    return lines.select(parts[0].cast("bigint").alias("document_id"), parts[1].cast("bigint").alias("line_no"), F.col("amount").alias("charge"))


@query(
    "c21_price_hotel_stays",
    f"""with {STAY}, {COST} select f.request_id, f.hotel_id, f.room_type_id, f.meal_plan, f.nights as nights_count, cast(round(cost, 2) as double) as cost,
       cast(cost * markup_pct as double) / 100 as markup, cast(cost * 100 + cost * markup_pct as double) / 100 as sell, c.currency, case when nn = 1 and nu = 0 then net end as rates_are_net, case when nt = 1 and tu = 0 then tax end as taxes_included,
       e.errors is null as ok, coalesce(e.errors, '') as errors, coalesce(w.warnings, '') as warnings
     from fin f left join errs e on e.request_id = f.request_id left join (select request_id, string_agg(w, '; ' order by w) as warnings from wrn group by 1) w on w.request_id = f.request_id
     left join (select request_id, min(currency) as currency from cur group by 1 having count(*) = 1) c on c.request_id = f.request_id""",
    ["b_stay", "b_rate", "b_surcharge", "b_room", "b_hotel"],
)
def c21(lib):
    p = stays.price_stays(stay_requests(lib), lib.b_rate, lib.b_surcharge, lib.b_room, lib.b_hotel)
    return p.select(
        "request_id", "hotel_id", "room_type_id", "meal_plan", "nights_count", "cost", "markup", "sell",
        "currency", "rates_are_net", "taxes_included", "ok", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"),
    )


@query(
    "j16_room_lookup",
    f"""with a as (select request_id, s.hotel_id, case request_id % 3 when 0 then 'deluxe  ROOM' when 1 then 'Premium' else 'Premium Suite' end as t from b_stay s)
      select request_id, t as room_text, (select min_by(r.id, (case when {KEY_SQL.format('r.name')} = {KEY_SQL.format('t')} then 0 else 1 end, r.id)) from b_room r where r.hotel_id = a.hotel_id
        and (contains({KEY_SQL.format('r.name')}, {KEY_SQL.format('t')}) or contains({KEY_SQL.format('t')}, {KEY_SQL.format('r.name')}))) as room_type_id from a""",
    ["b_stay", "b_room"],
)
def j16(lib):
    t = F.expr("case request_id % 3 when 0 then 'deluxe  ROOM' when 1 then 'Premium' else 'Premium Suite' end")
    return stays.find_rooms(lib.b_stay.select("request_id", "hotel_id", t.alias("room_text")), lib.b_room).select("request_id", "room_text", "room_type_id")


@query(
    "s17_default_rooms",
    """with recursive x as (select id, 1 as n, adults as left_, extra_beds as ex, '' as rooms from b_trip
        union all select id, n + 1, left_ - case when ex > 0 and left_ >= 3 then 3 else least(2, left_) end, ex - case when ex > 0 and left_ >= 3 then 1 else 0 end,
          rooms || case when ex > 0 and left_ >= 3 then 3 else least(2, left_) end from x where left_ > 0)
      select id, rooms from x where left_ = 0""",
    ["b_trip"],
)
def s17(lib):
    r = stays.default_rooms("adults", "extra_beds", "children_with_bed", "children_without_bed")
    return lib.b_trip.select("id", F.array_join(F.transform(r, lambda x: x["adults"].cast("string")), "").alias("rooms"))


# ---------------------------------------------------------------- packages
def package_requests(lib):
    """Every trip asks for the package of the same number, on its start date."""
    t = lib.b_trip
    return t.select(
        F.col("id").alias("request_id"), F.col("id").alias("package_id"),
        F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, "Standard").otherwise("Deluxe")).alias("category"),
        "adults", "extra_beds", "children_with_bed", "children_without_bed", F.col("extra_beds").alias("single_rooms"),
        F.col("start_date").alias("travel_date"), F.when(F.col("id") % 10 == 0, 4).alias("pax_tier"),
    )


PKG = """
 req0 as (select id as request_id, case id % 3 when 1 then 'Standard' when 2 then 'Deluxe' end as category, adults, extra_beds, children_with_bed, children_without_bed, extra_beds as single_rooms,
    start_date as travel_date, case when id % 10 = 0 then 4 end as pax_tier, adults - extra_beds as twin from b_trip),
 req as (select r.* replace (coalesce(r.category, (select min_by(p.category, p.id) from b_price p where p.package_id = r.request_id)) as category) from req0 r),
 val as (select r.request_id, p.*, coalesce(r.travel_date between p.valid_from and p.valid_to, true) as ok from req r join b_price p on p.package_id = r.request_id and p.category = r.category),
 anyok as (select request_id, bool_or(ok) as any_ok from val group by 1),
 pr as (select v.* from val v join anyok a on a.request_id = v.request_id where ok or not any_ok),
 t as (select request_id, pax_min, max_by(amount, id) as amount from pr where occupancy = 'double' and pax_min > 0 group by 1, 2),
 tr as (select r.request_id, coalesce(max(case when t.pax_min <= r.twin then t.pax_min end), min(t.pax_min)) as auto from req r join t on t.request_id = r.request_id group by 1),
 o as (select request_id, min_by(amount, id) filter (occupancy = 'double') as dbl, min_by(amount, id) filter (occupancy = 'extra_adult') as ex, min_by(amount, id) filter (occupancy = 'child_with_bed') as cwb,
    min_by(amount, id) filter (occupancy = 'child_without_bed') as cnb, min_by(amount, id) filter (occupancy = 'single_supplement') as sg, min(currency) as c1, max(currency) as c2,
    bool_or(is_net) filter (is_net is not null) as x, arg_min_null(is_net, id) as is_net from pr group by 1),
 j as (select r.*, a.any_ok, coalesce(r.pax_tier, tr.auto) as tier, o.*exclude(request_id) from req r left join anyok a on a.request_id = r.request_id left join tr on tr.request_id = r.request_id left join o on o.request_id = r.request_id),
 k as (select j.*, case when tier is not null then t.amount else dbl end as base, coalesce(cwb, ex) as rc,
    case when any_ok is null then 'Category ''' || coalesce(category, '-') || ''' not in this package'
         when twin < 1 then 'At least one adult must be on twin sharing' when pax_tier is not null and t.amount is null then 'No ' || pax_tier || ' pax rate' end as refused
   from j left join t on t.request_id = j.request_id and t.pax_min = j.tier)
"""


@query(
    "c22_price_packages",
    f"""with {PKG} select request_id, category, case when refused is null then tier end as pax_tier,
     case when refused is null then cast(coalesce(base * twin, 0) + coalesce(ex * extra_beds, 0) + coalesce(rc * children_with_bed, 0) + coalesce(cnb * children_without_bed, 0) + coalesce(sg * single_rooms, 0) as double) end as total,
     case when refused is null and c1 = c2 then c1 end as currency, case when refused is null then is_net end as is_net,
     coalesce(refused, concat_ws('; ', case when not any_ok then 'Package prices are not valid on ' || travel_date end, case when twin > 0 and base is null then 'No per-person twin sharing rate for ' || category end,
       case when extra_beds > 0 and ex is null then 'No Extra bed (adult) rate for ' || category end, case when children_with_bed > 0 and rc is null then 'No Child with bed rate for ' || category end,
       case when children_without_bed > 0 and cnb is null then 'No Child without bed rate for ' || category end, case when single_rooms > 0 and sg is null then 'No Single supplement rate for ' || category end)) as errors,
     case when refused is null then concat_ws('; ', case when pax_tier is null and tier <> twin then 'No exact ' || twin || ' pax rate - used the ' || tier || ' pax rate' end,
       case when twin % 2 = 1 and single_rooms = 0 then twin || ' adults on twin sharing is an odd number - add an extra bed or a single room' end) else '' end as warnings from k""".replace("arg_min_null", "arg_min_null"),
    ["b_trip", "b_price"],
)
def c22(lib):
    p = packages.price_packages(package_requests(lib), lib.b_price)
    return p.select("request_id", "category", "pax_tier", "total", "currency", "is_net", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("w13_pax_tier", f"with {PKG} select request_id, pax_tier from (select request_id, case when refused is null then tier end as pax_tier from k) where pax_tier is not null", ["b_trip", "b_price"])
def w13(lib):
    return packages.price_packages(package_requests(lib), lib.b_price).filter("pax_tier is not null").select("request_id", "pax_tier")


@query(
    "u05_validity_ranges",
    "select package_id, string_agg(f || ' to ' || t, ', ' order by f, t) as ranges from (select distinct package_id, cast(valid_from as varchar) as f, cast(valid_to as varchar) as t from b_price) group by 1",
    ["b_price"],
)
def u05(lib):
    r = lib.b_price.select("package_id", "valid_from", "valid_to").distinct()
    text = F.transform(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to"))), lambda x: F.concat(x["valid_from"].cast("string"), F.lit(" to "), x["valid_to"].cast("string")))
    return r.groupBy("package_id").agg(F.array_join(text, ", ").alias("ranges"))


@query(
    "s14_service_quantity",
    """select i.trip_id, i.id, case s.basis when 'per_vehicle' then case when coalesce(pax_max, 0) > 0 then cast(ceil((adults + children_with_bed + children_without_bed) / pax_max) as bigint) else 1 end
        when 'per_adult' then adults when 'per_child' then children_with_bed + children_without_bed when 'per_group' then 1 when 'unknown' then 1 else adults + children_with_bed + children_without_bed end as quantity
      from b_item i join b_trip t on t.id = i.trip_id join b_service s on s.id = i.ref_id where i.kind = 'service'""",
    ["b_item", "b_trip", "b_service"],
)
def s14(lib):
    t = lib.b_trip.select(F.col("id").alias("trip_id"), "adults", (F.col("children_with_bed") + F.col("children_without_bed")).alias("children"))
    s = lib.b_service.select(F.col("id").alias("ref_id"), "basis", "pax_max")
    j = lib.b_item.filter("kind = 'service'").select("trip_id", "id", "ref_id").join(s, "ref_id").join(t, "trip_id")
    return j.select("trip_id", "id", service_quantity("basis", "pax_max", "adults", "children").cast("bigint").alias("quantity"))


