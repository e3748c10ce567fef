"""Column functions and predicates over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, keys, money
from .registry import query

ON = dt.date(1998, 6, 12)  # the day the example reports are drawn up
KEY_SQL = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def pct_sql(old: str, new: str) -> str:
    """Percent change to one decimal, half away from zero, in whole-number arithmetic."""
    o, n = f"cast(({old}) * 100 as hugeint)", f"cast(({new}) * 100 as hugeint)"
    return f"(case when {n} >= {o} then 1 else -1 end * ((abs({n} - {o}) * 2000 + {o}) // nullif(2 * {o}, 0)) / 10.0)"


DOW_SQL = "['mon','tue','wed','thu','fri','sat','sun'][isodow({0})]"


@query("s01_name_key", f"select doc_id, md5({KEY_SQL.format('text')}) as key_hash, length({KEY_SQL.format('text')}) as n from b_text", ["b_text"])
def s01(lib):
    k = keys.name_key("text")
    return lib.b_text.select("doc_id", F.md5(k).alias("key_hash"), F.length(k).alias("n"))


_STOP_SQL = ", ".join(f"'{w}'" for w in keys.EDITION_WORDS)


@query(
    "s11_core_title",
    rf"""select id, case when len(w) > 0 then array_to_string(w, ' ') else {KEY_SQL.format('title')} end as core from (
       select id, title, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(
         {KEY_SQL.format('title')}, '\b(19|20)\d{{2}}(\s*\d{{2,4}})?\b', ' ', 'g'),
         '\b\d+\s*n\s*\d+\s*d\b|\b\d+\s*[nd]\b|\bv\d+\b|\b\d+(st|nd|rd|th)?\b', ' ', 'g'), ' +', ' ', 'g')), ' '),
         lambda x: x <> '' and not list_contains([{_STOP_SQL}], x)) as w from b_package)""",
    ["b_package"],
)
def s11(lib):
    return lib.b_package.select("id", keys.core_title("title").alias("core"))


@query(
    "s06_parse_range",
    """select id, cast(s as varchar) as start_date, cast(case when e < s then e + interval 1 year else e end as date)::varchar as end_date
       from (select id, valid_from as s, cast(make_date(year(valid_from), month(valid_to), 1) + interval 1 month - interval 1 day as date) as e
             from b_rate where valid_to - valid_from < 365)""",
    ["b_rate"],
)
def s06(lib):
    """'12 Mar 1998' to 'May': the end has neither a day nor a year."""
    raw = lib.b_rate.filter("datediff(valid_to, valid_from) < 365").select(
        "id", F.date_format("valid_from", "d MMM yyyy").alias("s"), F.date_format("valid_to", "MMM").alias("e")
    )
    r = dates.parse_ranges(raw, [("s", "e", F.lit(None).cast("date"), "range")])
    return r.select("id", F.col("range.start").alias("start_date"), F.col("range.end").alias("end_date"))


@query(
    "s05_parse_date",
    "select id, cast(valid_from as varchar) as d1, cast(valid_from as varchar) as d2, cast(valid_from as varchar) as d3, cast(valid_from as varchar) as d4, cast(valid_from as varchar) as d5 from b_rate",
    ["b_rate"],
)
def s05(lib):
    """The same day written five ways."""
    ways = ["d/M/yyyy", "dd.MM.yyyy", "d MMM yy", "yyyy-MM-dd", "MMMM d, yyyy"]
    df = lib.b_rate.select("id", *[F.date_format("valid_from", p).alias(f"t{i}") for i, p in enumerate(ways, 1)])
    df = dates.parse_dates(df, [f"t{i}" for i in range(1, 6)], F.lit(ON))
    return df.select("id", *[F.col(f"t{i}_parsed.day").alias(f"d{i}") for i in range(1, 6)])


@query(
    "s07_weekday_sets",
    """select line_no, document_id, raw, case raw when 'Fri-Mon' then 'mon,fri,sat,sun' when 'Sun to Thu' then 'mon,tue,wed,thu,sun'
         when 'weekdays' then 'mon,tue,wed,thu,sun' when 'Weekend' then 'fri,sat' when 'Tue, Thu' then 'tue,thu' end as days,
         raw <> 'sometimes' as understood
       from (select *, case line_no % 7 when 0 then 'Fri-Mon' when 1 then 'Sun to Thu' when 2 then 'weekdays' when 3 then 'Weekend'
              when 4 then 'Tue, Thu' when 5 then 'daily' else 'sometimes' end as raw from b_line)""",
    ["b_line"],
)
def s07(lib):
    raw = F.expr(
        "case line_no % 7 when 0 then 'Fri-Mon' when 1 then 'Sun to Thu' when 2 then 'weekdays' when 3 then 'Weekend' "
        "when 4 then 'Tue, Thu' when 5 then 'daily' else 'sometimes' end"
    )
    df = lib.b_line.select("line_no", "document_id", raw.alias("raw"))
    p = dates.parse_weekdays("raw")
    return df.select("line_no", "document_id", "raw", p["days"].alias("days"), p["understood"].alias("understood"))


@query("s08_year_later", "select id, cast(cast(valid_from + interval 1 year as date) as varchar) as later from b_rate", ["b_rate"])
def s08(lib):
    return lib.b_rate.select("id", keys.year_later("valid_from").alias("later"))


@query(
    "s09_pct_change",
    f"select id, {pct_sql('500 * (id % 9)', 'total - 500 * (id % 9)')} as pct from "
    "(select id, cast(floor(total) as bigint) as total from b_quote)",
    ["b_quote"],
)
def s09(lib):
    q = lib.b_quote.select("id", F.floor("total").alias("total"), (F.lit(500) * (F.col("id") % 9)).alias("old"))
    return q.select("id", money.pct_change("old", F.col("total") - F.col("old")).alias("pct"))


@query("s10_money_rounding", "select id, cast(round(amount * 1.05 * 1.1, 2) as double) as sell from b_item", ["b_item"])
def s10(lib):
    return lib.b_item.select("id", money.money(F.col("amount") * F.lit("1.05").cast("decimal(4,2)") * F.lit("1.1").cast("decimal(4,2)")).alias("sell"))


@query(
    "s16_token_cost",
    """select id, ((((input_tokens - hit) * 10 + hit) * 3 + output_tokens * 150 + 5) // 10) / 1000000.0 as cost
       from (select *, least(cached_tokens, input_tokens) as hit from b_usage)""",
    ["b_usage"],
)
def s16(lib):
    c = money.token_cost("input_tokens", "output_tokens", F.col("cached_tokens"), 3, 15)
    return lib.b_usage.select("id", F.round(c, 6).alias("cost"))


@query(
    "s18_day_dates",
    """select d.trip_id, d.position, cast(t.start_date + d.position - 1 as varchar) as day_date,
         cast(t.start_date + cast(greatest(n - 1, 0) as int) as varchar) as end_date
       from b_trip_day d join b_trip t on t.id = d.trip_id
       join (select trip_id, count(*) as n from b_trip_day group by trip_id) c on c.trip_id = d.trip_id""",
    ["b_trip_day", "b_trip"],
)
def s18(lib):
    counts = lib.b_trip_day.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    trips = lib.b_trip.select(F.col("id").alias("trip_id"), "start_date").join(counts, "trip_id")
    d = lib.b_trip_day.select("trip_id", "position").join(trips, "trip_id")
    return d.select(
        "trip_id",
        "position",
        F.date_add("start_date", F.col("position") - 1).alias("day_date"),
        F.date_add("start_date", F.greatest(F.col("n") - 1, F.lit(0)).cast("int")).alias("end_date"),
    )


@query(
    "s20_contact_keys",
    r"""select id, array_to_string(list_distinct(list_filter(list_transform(string_split(email, ','), lambda e: lower(trim(e))), lambda e: e <> '')).list_sort(), '|') as emails,
          right(regexp_replace(phone, '\D', '', 'g'), 10) as phone_key from b_supplier""",
    ["b_supplier"],
)
def s20(lib):
    return lib.b_supplier.select(
        "id",
        F.array_join(F.array_sort(keys.emails("email")), "|").alias("emails"),
        F.array_join(keys.phone_keys("phone"), "|").alias("phone_key"),
    )


@query(
    "s21_grouped_amounts",
    r"""select id, case when length(w) > 3 then 'INR ' || regexp_replace(case when length(left(w, -3)) % 2 = 0 then regexp_replace(left(w, -3), '(\d\d)', '\1,', 'g')
            else left(w, 1) || ',' || regexp_replace(substr(left(w, -3), 2), '(\d\d)', '\1,', 'g') end, ',$', '') || ',' || right(w, 3) else 'INR ' || w end as inr,
          format('USD {:,}', cast(w as bigint)) as usd
        from (select id, cast(cast(round(total, 0) as bigint) as varchar) as w from b_quote)""",
    ["b_quote"],
)
def s21(lib):
    return lib.b_quote.select(
        "id",
        money.grouped_amount("total", F.lit("INR")).alias("inr"),
        money.grouped_amount("total", F.lit("USD")).alias("usd"),
    )


@query(
    "s23_cell_text",
    r"""select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as cell, cast(n_chars as varchar) as whole,
          case when n_chars % 2 = 0 then cast(cast(n_chars / 2 as bigint) as varchar) else cast(n_chars / 2.0 as double)::varchar end as half from b_text""",
    ["b_text"],
)
def s23(lib):
    return lib.b_text.select(
        "doc_id",
        F.md5(keys.cell_text("text")).alias("cell"),
        keys.number_text(F.col("n_chars").cast("double")).alias("whole"),
        keys.number_text(F.col("n_chars") / 2).alias("half"),
    )


# ---------------------------------------------------------------- predicates
@query("p01_active_on_date", "select id, room_type_id from b_rate where status = 'active' and valid_from <= date '1998-06-12' and valid_to >= date '1998-06-12'", ["b_rate"])
def p01(lib):
    return lib.b_rate.filter(keys.active_on(F.lit(ON))).select("id", "room_type_id")


@query("p02_text_search", "select id, name from b_hotel where lower(name) like '%blue%' or lower(city) like '%brand#2%' or lower(destination) like '%blue%'", ["b_hotel"])
def p02(lib):
    h = lib.b_hotel
    return h.filter(keys.contains_text("BLUE", "name", "destination") | keys.contains_text("brand#2", "city")).select("id", "name")


@query("p03_key_search", f"select id, name from b_service where {KEY_SQL.format('name')} like '%ring standard%'", ["b_service"])
def p03(lib):
    return lib.b_service.filter(F.contains(keys.name_key("name"), keys.name_key(F.lit("Ring, Standard")))).select("id", "name")


@query(
    "p04_null_safe_match",
    """select kind, vehicle_type, basis, count(*) as n, count(distinct a.supplier_id) as suppliers from b_service a
       where exists (select 1 from b_service b where b.id = a.id + 30 and b.vehicle_type is not distinct from a.vehicle_type)
       group by all""",
    ["b_service"],
)
def p04(lib):
    a = lib.b_service
    b = lib.b_service.select((F.col("id") - 30).alias("bid"), F.col("vehicle_type").alias("bv"))
    hit = a.join(b, (a.id == b.bid) & a.vehicle_type.eqNullSafe(b.bv), "left_semi")
    return hit.groupBy("kind", "vehicle_type", "basis").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("supplier_id").alias("suppliers"))


@query(
    "p05_weekday_restriction",
    f"select id, weekdays, {DOW_SQL.format('valid_from')} as dow from b_rate where weekdays is null or list_contains(string_split(weekdays, ','), {DOW_SQL.format('valid_from')})",
    ["b_rate"],
)
def p05(lib):
    return lib.b_rate.filter(keys.sold_on_weekday("weekdays", "valid_from")).select("id", "weekdays", keys.weekday("valid_from").alias("dow"))


@query(
    "p06_interval_overlap",
    """select id, greatest(0, least(valid_to, date '1998-12-31') - greatest(valid_from, date '1998-01-01') + 1) as days
       from b_rate where valid_from <= date '1998-12-31' and date '1998-01-01' <= valid_to""",
    ["b_rate"],
)
def p06(lib):
    a, b = F.lit(dt.date(1998, 1, 1)), F.lit(dt.date(1998, 12, 31))
    return lib.b_rate.filter(keys.overlaps("valid_from", "valid_to", a, b)).select(
        "id", keys.overlap_days("valid_from", "valid_to", a, b).alias("days")
    )


@query(
    "p07_rate_state",
    """select id, case when status <> 'active' then 'replaced' when valid_to < date '1998-06-12' then 'expired'
         when valid_from > date '1998-06-12' then 'upcoming' else 'current' end as state from b_rate""",
    ["b_rate"],
)
def p07(lib):
    return lib.b_rate.select("id", keys.rate_state("status", "valid_from", "valid_to", F.lit(ON)).alias("state"))


@query(
    "p08_destination_haystack",
    """select id, title, len(list_filter(destinations, lambda x: contains(lower(x), 'city 3'))) > 0 as by_place,
         contains(lower(concat_ws(' ', title, coalesce(region, ''), array_to_string(destinations, ' '))), 'region 4') as by_text
       from b_package where len(list_filter(destinations, lambda x: contains(lower(x), 'city 3'))) > 0
          or contains(lower(concat_ws(' ', title, coalesce(region, ''), array_to_string(destinations, ' '))), 'region 4')""",
    ["b_package"],
)
def p08(lib):
    p = lib.b_package
    by_place = F.exists("destinations", lambda x: F.contains(F.lower(x), F.lit("city 3")))
    hay = F.lower(F.concat_ws(" ", "title", F.coalesce("region", F.lit("")), F.array_join("destinations", " ")))
    return (
        p.select("id", "title", by_place.alias("by_place"), F.contains(hay, F.lit("region 4")).alias("by_text"))
        .filter("by_place or by_text")
    )


@query("p09_net_amount_filters", "select id, cast(amount as double) as amount from b_rate where is_net and amount <= 3000 and occupancy = 'double' and meal_plan = 'MAP'", ["b_rate"])
def p09(lib):
    return lib.b_rate.filter("is_net and amount <= 3000 and occupancy = 'double' and meal_plan = 'MAP'").select("id", "amount")


@query(
    "p11_range_repair",
    """select id, cast(lo as double) as amount, cast(nullif(hi, lo) as double) as amount_max from (
         select id, least(amount, coalesce(x, amount)) as lo, greatest(x, amount) as hi from
           (select id, amount, case when id % 3 = 0 then amount_max - 400 else amount_max end as x from b_service)) where true""",
    ["b_service"],
)
def p11(lib):
    s = lib.b_service.withColumn("x", F.when(F.col("id") % 3 == 0, F.col("amount_max") - 400).otherwise(F.col("amount_max")))
    return s.select("id", *repair_range("amount", "x"))


def repair_range(low, high):
    lo = F.least(low, F.coalesce(high, low))
    hi = F.when(F.col(high).isNotNull(), F.greatest(low, high))
    return lo.alias("amount"), F.when(hi != lo, hi).alias("amount_max")


@query(
    "p12_fill_empty",
    """select h.id, coalesce(nullif(h.city, ''), r.p_brand) as city, coalesce(nullif(h.destination, ''), r.p_name) as destination
       from b_hotel h join part r on r.p_partkey = h.id * 2 + 1""",
    ["b_hotel"],
)
def p12(lib):
    newer = lib.part.filter("p_partkey % 2 = 1").select(F.expr("cast((p_partkey - 1) / 2 as bigint)").alias("id"), "p_brand", "p_name")
    h = lib.b_hotel.select("id", "city", "destination").join(newer, "id")
    return h.select("id", keys.fill("city", "p_brand").alias("city"), keys.fill("destination", "p_name").alias("destination"))


@query(
    "io03_content_dedup",
    """select min(doc_id) as doc_id, sha256(text) as sha, count(*) as copies from b_text group by sha256(text)""",
    ["b_text"],
)
def io03(lib):
    return dedup_by_content(lib.b_text, "text", "doc_id").select("doc_id", "sha", "copies")


def dedup_by_content(df, content, arrival):
    """One row per distinct content: the first to arrive, with the number of copies."""
    hashed = df.select(F.sha2(F.encode(F.col(content), "UTF-8"), 256).alias("sha"), arrival)
    return hashed.groupBy("sha").agg(F.min(arrival).alias(arrival), F.count(F.lit(1)).alias("copies"))

