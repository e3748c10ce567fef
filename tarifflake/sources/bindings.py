"""Domain tables derived from the star-schema test tables.

Each view is one SELECT that both Spark SQL and ANSI engines accept, so a query and its check run on the same
rows. ``{name}`` stands for another view or a parquet table. Money is cast to decimal before any arithmetic.
Ids and versions are computed from stored columns, never by numbering a whole group.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# A line's stable number inside its order: unique with the order key at every scale.
_ROW = "(((cast(l_linenumber as bigint) * 16777216 + l_partkey) * 131072 + l_suppkey) * 64 + cast(l_quantity as bigint))"
# Approval order differs from document order, as it does when sheets wait for review.
_SEQ = "((cast({c} as bigint) * 7919) % 1000003) * 4294967296 + {c}"

VIEWS: dict[str, str] = {
    "b_supplier": """
        select s_suppkey as id, s_name as name,
               case when s_suppkey % 3 = 0 then 'hotel' when s_suppkey % 3 = 1 then 'dmc' end as type,
               n_name as city, r_name as country,
               'sales' || cast(floor(s_suppkey / 4) as bigint) || '@example.com'
                 || case when s_suppkey % 2 = 0 then ', Desk' || s_suppkey || '@example.com' else '' end as email,
               '+91 98470 ' || lpad(cast(cast(floor(s_suppkey / 2) as bigint) as varchar(12)), 5, '0') as phone,
               case when s_suppkey % 4 > 0 then 'gst' || cast(floor(s_suppkey / 5) as bigint) end as gst_number,
               case when s_suppkey % 5 = 0 then cast(null as varchar(20)) else 'Street ' || s_suppkey end as address,
               case when s_suppkey % 3 > 0 then 'Manager ' || s_suppkey end as contact_person,
               case when s_suppkey % 2 = 0 then 'www' || s_suppkey || '.example.com' end as website
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "b_hotel": """
        select cast(floor(p_partkey / 2) as bigint) as id, p_name as name,
               case when p_size % 10 > 0 then p_brand end as city, p_type as destination,
               case p_size % 4 when 0 then 'Standard' when 1 then 'Deluxe' when 2 then 'Premium' else 'Luxury' end
                 as category,
               p_size % 5 + 1 as star_rating, p_partkey % 100 as supplier_id,
               case when p_size % 6 > 0 then case p_size % 3 when 0 then 'resort' when 1 then 'hotel' else 'houseboat' end end as property_type,
               case when p_size % 7 > 0 then p_size || ' Lake Road' end as address
        from {part} where p_partkey % 2 = 0""",
    "b_room": """
        select p_partkey as id, cast(floor(p_partkey / 2) as bigint) as hotel_id,
               case when p_partkey % 2 = 0 then 'Deluxe Room' else 'Premium ' || p_type || ' View' end as name
        from {part}""",
    "b_document": """
        select o_orderkey as id, 'sheet_' || o_orderkey || '.pdf' as filename, o_custkey % 100 as supplier_id,
               case o_orderstatus when 'P' then 'needs_review' else 'approved' end as status,
               cast(o_orderdate as date) as approved_on, {seq_o} as approval_seq
        from {orders}""",
    # lines of price sheets as they arrive, before the per-sheet check
    # a sheet gives a rate for one or more periods; some lines are repeated in the same sheet, some with another amount
    "b_line": """
        select l_orderkey as document_id, {seq_l} as approval_seq, {row} + period as line_no, l_suppkey as supplier_id,
               cast(floor(l_partkey / 2) as bigint) as hotel_id, l_partkey as room_type_id,
               case l_returnflag when 'A' then 'CP' when 'N' then 'MAP' else 'AP' end as meal_plan,
               case l_linenumber when 4 then 'single' when 5 then 'extra_adult' when 6 then 'child_with_bed'
                 when 7 then 'triple' else 'double' end as occupancy,
               case when l_discount >= 0.09 then 'fri,sat' end as weekdays,
               case when l_tax < 0.06 then true when l_tax < 0.08 then false end as is_net,
               case when l_suppkey % 7 = 0 then 'per_person_per_night' else 'per_room_per_night' end as basis,
               cast(floor(l_extendedprice / 20000) * 1000 + 1000 + case when period = 2 and l_partkey % 2 = 0 then 500 else 0 end
                 as decimal(12,2)) as amount,
               case when l_suppkey % 20 = 0 then 'USD' else 'INR' end as currency,
               case when l_suppkey % 10 > 0 then false end as taxes_included,
               case when l_suppkey % 9 = 0 then 2 end as min_nights,
               case when l_partkey % 3 = 0 then 'Season ' || (l_linenumber % 2) end as season_name,
               cast(l_shipdate as date) + cast(case when period = 1 then l_quantity * 7 + 30 else 0 end as int) as valid_from,
               cast(l_shipdate as date) + cast(case when period = 1 then l_quantity * 14 + 30 else l_quantity * 7 end as int) as valid_to
        from (select *, 0 as period from {lineitem} union all select *, 1 as period from {lineitem} where l_partkey % 5 = 0
              union all select *, 2 as period from {lineitem} where l_partkey % 25 < 2) as periods""",
    # the library's rate table: first line per sheet and rate key, with a status and a link to an earlier row
    "b_rate": """
        select *, concat_ws('-', cast(document_id as varchar(20)), cast(line_no as varchar(20))) as id,
               case when (document_id + room_type_id) % 5 = 0 then 'superseded' else 'active' end as status
        from {b_line}""",
    "b_surcharge": """
        select {row} as line_no, l_orderkey as document_id, cast(floor(l_partkey / 2) as bigint) as hotel_id,
               case when l_linenumber % 2 = 0 then 'supplement' else 'blackout' end as kind,
               case when l_linenumber % 2 = 0 then 'Gala Dinner ' || (l_suppkey % 3) else 'Blackout / stop sale' end as name,
               case when l_suppkey % 4 = 0 then 'Deluxe' when l_suppkey % 4 = 1 then 'premium' end as room_type,
               cast(l_shipdate as date) as date_from,
               cast(l_shipdate as date) + cast(l_quantity % 9 as int) as date_to,
               case when l_linenumber % 2 = 0 and l_suppkey % 8 > 0
                 then cast(floor(l_extendedprice / 100) as decimal(12,2)) end as amount,
               case when l_linenumber % 2 = 0 then 'INR' end as currency,
               case l_suppkey % 6 when 0 then 'per_adult' when 1 then 'per_person' when 2 then 'per_child'
                 when 3 then 'per_room' when 4 then 'per_room_per_night' end as basis,
               l_suppkey % 11 > 0 as mandatory,
               case when l_suppkey % 13 = 0 then 'superseded' else 'active' end as status
        from {lineitem} where l_discount <= 0.01""",
    "b_service": """
        select p_partkey as id, p_partkey % 100 as supplier_id, (p_partkey * 7) % 1500 as document_id,
               case p_size % 4 when 0 then 'transfer' when 1 then 'activity' when 2 then 'sightseeing'
                 else 'entry_ticket' end as kind,
               p_name || ' ' || p_type as name, p_type as destination,
               case when p_size % 3 > 0 then 'Cab ' || (p_size % 3) end as vehicle_type,
               case p_size % 6 when 0 then 'per_vehicle' when 1 then 'per_person' when 2 then 'per_adult'
                 when 3 then 'per_child' when 4 then 'per_group' else 'unknown' end as basis,
               case when p_size % 2 = 0 then p_size % 7 + 2 end as pax_max,
               cast(floor(p_retailprice) as decimal(12,2)) as amount,
               case when p_size % 5 = 0 then cast(floor(p_retailprice) + 200 as decimal(12,2)) end as amount_max,
               p_size % 3 = 0 as optional, case when p_size % 9 = 0 then 'USD' else 'INR' end as currency,
               case when p_size % 7 > 0 then p_size % 2 = 0 end as is_net,
               date '1996-01-01' + cast(p_size * 10 as int) as valid_from,
               date '1998-01-01' + cast(p_size * 20 as int) as valid_to,
               case when p_size % 8 = 0 then 'Pick up at ' || p_brand end as notes,
               case when p_size % 11 = 0 then 'superseded' else 'active' end as status
        from {part}""",
    # service lines of price sheets; a sheet may word a service a little differently
    "b_service_line": """
        select l_orderkey as document_id, {seq_l} as approval_seq, {row} as line_no, l_partkey % 100 as supplier_id,
               case p_size % 4 when 0 then 'transfer' when 1 then 'activity' when 2 then 'sightseeing' else 'entry_ticket' end as kind,
               p_name || ' ' || left(md5(cast(p_partkey as varchar(20))), 12) || case when l_linenumber % 4 = 1 then 's' else '' end as name,
               case when p_size % 3 > 0 then 'Cab ' || (p_size % 3) end as vehicle_type,
               case p_size % 3 when 0 then 'per_vehicle' when 1 then 'per_person' else 'per_group' end as basis,
               cast(floor(l_extendedprice / 30000) * 500 + 500 as decimal(12,2)) as amount,
               case when l_suppkey % 9 = 0 then cast(floor(l_extendedprice / 30000) * 500 + 700 as decimal(12,2)) end as amount_max,
               case when l_suppkey % 20 = 0 then 'USD' else 'INR' end as currency,
               case when l_partkey % 3 = 0 then 'Season ' || (l_linenumber % 2) end as season_name,
               cast(l_shipdate as date) as valid_from, cast(l_shipdate as date) + cast(l_quantity * 5 as int) as valid_to
        from {lineitem} join {part} on p_partkey = l_partkey""",
    "b_package": """
        select o_orderkey as id, o_custkey as family_id, o_custkey % 100 as supplier_id, o_orderkey as document_id,
               'Tour ' || (o_custkey % 50) || ' ' || o_orderpriority || ' ' || year(o_orderdate) as title,
               case when o_custkey % 5 > 0 then 'Region ' || (o_custkey % 5) end as region,
               split('City ' || (o_custkey % 7) || ',City ' || (o_orderkey % 9), ',') as destinations,
               cast(o_custkey % 4 + 3 as int) as nights, cast(o_custkey % 4 + 4 as int) as days,
               nullif(min(o_orderkey) over (partition by o_custkey), o_orderkey) as previous_version_id,
               case when o_orderkey % 17 > 0 then cast(o_orderdate as date) end as valid_from,
               case when o_orderkey % 17 > 0
                 then cast(o_orderdate as date) + cast(60 + o_orderkey % 3 * 60 as int) end as valid_to,
               case when o_orderstatus = 'F' then 'superseded' else 'active' end as status,
               cast(year(o_orderdate) - 1990 as int) * 100 + month(o_orderdate) as version,
               split('Breakfast,Cab ' || (o_custkey % 3) || ',Guide', ',') as inclusions,
               split('Flights,Guide', ',') as exclusions, split('Advance 30%,No refund', ',') as terms
        from {orders}""",
    "b_price": """
        select l_orderkey as package_id, {row} as id,
               case l_returnflag when 'A' then 'Standard' when 'N' then 'Deluxe' else 'Luxury' end as category,
               case when l_linenumber <= 4 then l_linenumber * 2 end as pax_min,
               case when l_linenumber <= 4 then l_linenumber * 2 + l_suppkey % 3 % 2 end as pax_max,
               case when l_suppkey % 7 = 0 then 'per_package' else 'per_person' end as basis,
               case when l_linenumber <= 4 then 'double' when l_linenumber = 5 then 'extra_adult'
                 when l_linenumber = 6 then 'child_with_bed' else 'child_without_bed' end as occupancy,
               cast(floor(l_extendedprice / 5000) * 500 + 5000 as decimal(12,2)) as amount,
               case when l_suppkey % 50 = 0 then 'USD' else 'INR' end as currency,
               case when l_suppkey % 6 > 0 then l_suppkey % 6 < 4 end as is_net,
               case when l_suppkey % 8 = 0 then 'Peak' end as season_name,
               make_date(year(l_shipdate), 1, 1) as valid_from,
               make_date(year(l_shipdate), 1, 1) + cast(90 + l_quantity * 7 as int) as valid_to
        from {lineitem}""",
    "b_day": """
        select l_orderkey * 10 + l_linenumber as id, l_orderkey as package_id, l_linenumber as day_number,
               'Visit ' || (min(l_partkey) % 40) as title, 'See sights of City ' || (min(l_suppkey) % 9) as description,
               'City ' || (min(l_suppkey) % 9) as overnight, 'B/D' as meals
        from {lineitem} group by l_orderkey, l_linenumber""",
    "b_pkg_hotel": """
        select l_orderkey as package_id, {row} as id, cast(floor(l_partkey / 2) as bigint) as hotel_id,
               'City ' || (l_suppkey % 9) as city, 'Hotel ' || l_partkey as hotel_name,
               case l_returnflag when 'A' then 'Standard' when 'N' then 'Deluxe' else 'Luxury' end as category,
               l_linenumber % 3 + 1 as nights
        from {lineitem} where l_linenumber <= 3""",
    "b_place": """
        select c_custkey as id, 'Lake ' || cast(floor(c_custkey / 3) as bigint) as name,
               case when c_custkey % 3 > 0 then c_mktsegment end as destination,
               'District ' || c_nationkey as region, 'lake' as kind,
               case when c_custkey % 2 = 0 then 'Boating at ' || c_name end as description,
               case when c_custkey % 4 > 0 then 'Apr to ' || c_mktsegment end as availability
        from {customer}""",
    "b_trip": """
        select o_orderkey as id, 'Trip ' || o_orderkey as title, 'Customer ' || o_custkey as customer_name,
               case when o_custkey % 3 > 0 then '+91 ' || o_custkey end as customer_phone,
               case when o_custkey % 2 = 0 then 'c' || o_custkey || '@example.com' end as customer_email,
               case when o_orderkey % 5 > 0 then 'Agent ' || (o_orderkey % 5) end as assigned_to,
               case when o_orderpriority <> '5-LOW' then o_orderpriority end as lead_source,
               case when o_orderstatus = 'F' then case when o_orderkey % 2 = 0 then 'completed' else 'confirmed' end
                    when o_orderstatus = 'O' then case when o_orderkey % 3 = 0 then 'lost' else 'quoted' end
                    else 'enquiry' end as status,
               case when o_orderkey % 6 > 0 then cast(o_orderdate as date) + 30 end as start_date,
               case when o_orderkey % 4 > 0 then cast(o_orderdate as date) + 10 end as follow_up_date,
               cast(o_orderdate as date) as created_on,
               cast(1 + o_orderkey % 4 as int) as adults, cast(o_orderkey % 2 as int) as children_with_bed,
               cast(o_orderkey % 3 % 2 as int) as children_without_bed, cast(o_orderkey % 9 % 2 as int) as extra_beds,
               cast(o_orderkey % 20 as decimal(6,2)) as markup_pct, cast(5 as decimal(5,2)) as gst_pct,
               'INR' as currency, o_orderkey % 40 = 0 as is_template,
               case o_orderkey % 7 when 0 then 'A' when 1 then 'Z' end as chosen_option,
               case when o_orderkey % 3 > 0 then 'Region ' || (o_custkey % 5) end as destination
        from {orders}""",
    "b_item": """
        select l_orderkey as trip_id, {row} as id,
               case l_linenumber % 4 when 0 then 'package' when 1 then 'hotel' when 2 then 'service'
                 else 'custom' end as kind,
               case l_linenumber % 4 when 0 then l_orderkey + l_suppkey % 3 when 1 then cast(floor(l_partkey / 2) as bigint)
                 when 2 then l_partkey end as ref_id,
               case when l_linenumber <= 5 then l_linenumber end as day_position,
               cast(l_quantity as decimal(10,2)) as quantity, cast(l_extendedprice as decimal(12,2)) as amount,
               l_returnflag = 'R' as optional,
               case l_linenumber % 3 when 1 then 'A' when 2 then 'B' end as option_label,
               case when l_suppkey % 25 = 0 then 'USD' else 'INR' end as currency,
               case when l_suppkey % 30 = 0 then 'no valid rate for double (room 1)' end as error,
               'Line ' || l_linenumber as description
        from {lineitem}""",
    "b_trip_day": """
        select l_orderkey as trip_id, l_linenumber as position, 'Visit ' || (min(l_partkey) % 40) as title,
               'City ' || (min(l_suppkey) % 9) as overnight,
               case when l_linenumber % 4 > 0 then l_orderkey + l_linenumber % 2 end as source_package_id
        from {lineitem} group by l_orderkey, l_linenumber""",
    "b_payment": """
        select event_id as id, event_id % 1500 as trip_id, cast(value as decimal(12,2)) as amount,
               cast(ts as date) as paid_on
        from {events} where event_type = 'purchase'""",
    "b_quote": """
        select o_orderkey as id, o_custkey as trip_id,
               case o_orderstatus when 'F' then 'sent' when 'O' then 'draft'
                 else case when o_orderkey % 2 = 0 then 'accepted' else 'declined' end end as status,
               cast(o_orderdate as date) as created_on, cast(o_orderdate as date) + 7 as valid_until,
               'Plan ' || (o_orderkey % 90) as title, 'Customer ' || o_custkey as customer_name,
               'Region ' || (o_custkey % 5) as destination, cast(o_totalprice as decimal(12,2)) as total,
               case when o_orderkey % 4 = 0 then 'B' end as chosen_option
        from {orders}""",
    "b_usage": """
        select event_id as id, ts as called_at, event_type as provider, 'm' || (user_id % 3) as model,
               case when user_id % 4 > 0 then user_id end as document_id,
               cast(floor(value * 100) as bigint) as input_tokens, cast(floor(value * 10) as bigint) as output_tokens,
               cast(floor(value * 20) as bigint) as cached_tokens,
               case when user_id % 5 > 0 then cast(value as decimal(12,4)) end as cost,
               cast(floor(value * 1000) as bigint) as duration_ms, event_type <> 'error' as ok
        from {events}""",
    # tables of requests: who asks for what, where and on which day
    "b_rate_request": """
        select s_suppkey as request_id,
               case when s_suppkey % 9 > 0 then 'brand#' || (s_suppkey % 5 + 1) || case when s_suppkey % 2 = 0 then s_suppkey % 4 + 1 || '' else '' end end as destination,
               case when s_suppkey % 6 = 0 then 'Gear' when s_suppkey % 6 = 1 then ' BOX ' end as hotel,
               date '1997-01-01' + cast(s_suppkey * 37 % 700 as int) as on_date,
               case s_suppkey % 4 when 0 then 'CP' when 1 then 'MAP' when 2 then 'AP' end as meal_plan,
               case when s_suppkey % 5 > 0 then 'double' when s_suppkey % 10 = 0 then 'single' end as occupancy,
               case when s_suppkey % 3 = 0 then cast(2000 + s_suppkey % 3000 as decimal(12,2)) end as max_amount,
               s_suppkey % 8 = 0 as net_only
        from {supplier}""",
    "b_service_request": """
        select s_suppkey as request_id,
               case s_suppkey % 5 when 0 then 'economy' when 1 then 'Tin' when 2 then 'region 2' when 3 then 'red' end as destination,
               case s_suppkey % 3 when 0 then 'transfer' when 1 then 'activity' end as kind,
               case when s_suppkey % 4 = 0 then 'Blue' when s_suppkey % 4 = 1 then 'ox m' end as text,
               date '1997-01-01' + cast(s_suppkey * 53 % 900 as int) as on_date
        from {supplier}""",
    "b_package_request": """
        select s_suppkey as request_id,
               case when s_suppkey % 6 > 0 then 'CITY ' || (s_suppkey % 9) when s_suppkey % 12 = 0 then 'tour 1' end as destination,
               date '1993-01-01' + cast(s_suppkey * 71 % 2000 as int) as on_date
        from {supplier}""",
    "b_text": "select doc_id, text, lang, source, n_chars from {documents}",
    "b_page": "select page_id, url, html from {pages}",
    # one stay request per order: the order's lowest line names the room, the plan and the dates
    "b_stay": """
        select request_id, hotel_id, room_type_id, meal_plan, check_in, check_in + nights as check_out, nights,
               adults, children_with_bed, children_without_bed, rooms, prefer_net, markup_pct
        from (select l_orderkey as request_id, cast(floor(min(l_partkey) / 2) as bigint) as hotel_id,
                     min(l_partkey) as room_type_id,
                     case l_orderkey % 3 when 0 then 'CP' when 1 then 'MAP' else 'AP' end as meal_plan,
                     date '1997-06-01' + cast(l_orderkey % 700 as int) as check_in,
                     cast(1 + l_orderkey % 4 as int) as nights, cast(1 + l_orderkey % 5 as int) as adults,
                     cast(l_orderkey % 2 as int) as children_with_bed, cast(0 as int) as children_without_bed,
                     cast(1 + l_orderkey % 2 as int) as rooms, l_orderkey % 4 > 0 as prefer_net,
                     cast(l_orderkey % 15 as decimal(6,2)) as markup_pct
              from {lineitem} group by l_orderkey) s""",
}

_CONST = {"row": _ROW, "seq_l": _SEQ.format(c="l_orderkey"), "seq_o": _SEQ.format(c="o_orderkey")}


def _needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n not in _CONST]


def _render(text: str, names: dict[str, str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: _CONST.get(m[1]) or names.get(m[1], m[1]), text)


def oracle(body: str, *views: str) -> str:
    """``body`` preceded by the views it reads (and theirs) as common table expressions."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in seen or name in TABLES:
            return
        for other in _needs(VIEWS[name]):
            add(other)
        seen[name] = _render(VIEWS[name], {}).strip()

    for v in views:
        add(v)
    ctes = ",\n".join(f"{k} as ({v})" for k, v in seen.items())
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


class Library:
    """The derived tables of one data directory, read lazily. ``lib.b_rate`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._frames:
            if name in TABLES:
                self._frames[name] = self.table(name)
            else:
                need = _needs(VIEWS[name])
                text = _render(VIEWS[name], {n: "{" + n + "}" for n in need})
                self._frames[name] = self.spark.sql(text, **{n: getattr(self, n) for n in need})
        return self._frames[name]
