"""Package editions, grids and detail views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import packages, search
from .registry import query
from .scalars import KEY_SQL, pct_sql

ON = dt.date(1998, 6, 12)
TODAY = "date '1998-06-12'"
COVERS = ("(p.valid_from is null or p.valid_to is null or {d} between p.valid_from and p.valid_to) and (exists (select 1 from b_price q where q.package_id = p.id "
          "and {d} between q.valid_from and q.valid_to) or not exists (select 1 from b_price q where q.package_id = p.id))")
STATE = f"case when status <> 'active' then 'replaced' when valid_to < {TODAY} then 'expired' when valid_from > {TODAY} then 'upcoming' else 'current' end"


@query(
    "w02_newest_edition_on_date",
    f"""select family_id, max_by(id, (version, id)) as package_id, max(version) as version, '1998-06-12' as on_date from b_package p
      where status = 'active' and {COVERS.format(d=TODAY)} group by family_id""",
    ["b_package", "b_price"],
)
def w02(lib):
    dates = lib.b_package.select("family_id").distinct().withColumn("on_date", F.lit(ON))
    return packages.newest_edition(lib.b_package, lib.b_price, dates)


PRIMARY = f"""
 pool as (select p.*, bool_or(status = 'active') over (partition by family_id) as al from b_package p),
 prim as (select family_id, id as package_id, case when now_ then 0 when valid_from > {TODAY} then 1 else 2 end as choice from (
     select p.*, p.status = 'active' and {COVERS.format(d=TODAY)} as now_ from pool p where status = 'active' or not al)
   qualify row_number() over (partition by family_id order by case when now_ then 0 when valid_from > {TODAY} then 1 else 2 end,
     case when not now_ and valid_from > {TODAY} then valid_from - {TODAY} else 0 end, version desc, id desc) = 1)
"""


@query("w03_primary_edition", f"with {PRIMARY} select * from prim", ["b_package", "b_price"])
def w03(lib):
    return packages.primary_edition(lib.b_package, lib.b_price, ON)


@query(
    "w08_version_numbers",
    "select id, family_id, row_number() over (partition by family_id order by version, id) as number from b_package",
    ["b_package"],
)
def w08(lib):
    """Versions of each family counted from its first upload."""
    from ..functions.grouping import numbered

    p = lib.b_package.select("id", "family_id", "version")
    return numbered(p, ["family_id"], F.col("version"), [F.col("version"), F.col("id")], "number").drop("version")


UPLOADS = """
 up as (select p.*, d.approval_seq as seq from b_package p join b_document d on d.id = p.document_id where d.status = 'needs_review'),
 lib as (select p.*, cast(null as bigint) as seq from b_package p join b_document d on d.id = p.document_id where d.status = 'approved'),
 numbered as (select u.id, u.family_id, u.valid_from, u.valid_to, u.seq, coalesce((select max(l.version) from lib l where l.family_id = u.family_id), 0) + row_number() over (partition by u.family_id order by u.seq) as number from up u),
 member as (select id, family_id, valid_from, valid_to, seq, version as number, status = 'active' as active from lib union all select id, family_id, valid_from, valid_to, seq, number, true from numbered),
 covered as (select m.id, min_by(u.id, u.seq) filter (wide) as by_id, min(u.seq) filter (wide) as at, bool_or(coalesce(least(m.valid_to, u.valid_to) >= greatest(m.valid_from, u.valid_from), false)) filter (m.valid_from is not null and m.valid_to is not null and u.valid_from is not null and u.valid_to is not null) as shared, count(*) as later
   from (select m.*, u.id as u_id, u.seq as u_seq, u.valid_from is null or u.valid_to is null or m.valid_from is null or m.valid_to is null or (u.valid_from <= m.valid_from and u.valid_to >= m.valid_to) as wide
     from member m join numbered u on u.family_id = m.family_id and (m.seq is null or u.seq > m.seq)) x join member m on m.id = x.id join numbered u on u.id = x.u_id group by m.id)
"""


def _split(lib):
    """(packages of waiting documents, packages of approved ones)."""
    d = lib.b_document.select(F.col("id").alias("document_id"), F.col("status").alias("ds"))
    p = lib.b_package.join(d, "document_id")
    return p.filter("ds = 'needs_review'"), p.filter("ds = 'approved'")


def _in_order(lib):
    """The same, with the place of each upload in the order of approval."""
    up, old = _split(lib)
    order = lib.b_document.select(F.col("id").alias("document_id"), F.col("approval_seq").alias("seq"))
    return up.join(order, "document_id"), old


@query(
    "c10_package_versioning",
    f"""with {UPLOADS} select m.id, m.family_id, case when c.at is not null then 'replaced' when c.shared then 'overlaps (newer wins on shared dates)' else 'kept (other dates)' end as action, c.by_id as replaced_by
       from member m join covered c on c.id = m.id where m.active""",
    ["b_package", "b_document"],
)
def c10(lib):
    """What the waiting uploads, one after the other, do to the live versions of their families."""
    up, old = _in_order(lib)
    return packages.version_effects(up, old)


@query(
    "w08_version_base",
    f"""with {UPLOADS} select u.id as upload_id, u.family_id, any_value(u.number) as version,
         max_by(m.id, (m.active and (c.at is null or c.at >= u.seq), coalesce(case when u.valid_to is not null and u.valid_from is not null and m.valid_from is not null and m.valid_to is not null then greatest(0, least(m.valid_to, u.valid_to) - greatest(m.valid_from, u.valid_from) + 1) end, 0), m.number, m.id)) as base_id
       from numbered u left join member m on m.family_id = u.family_id and (m.seq is null or m.seq < u.seq) left join covered c on c.id = m.id group by u.id, u.family_id""",
    ["b_package", "b_document"],
)
def w08b(lib):
    up, old = _in_order(lib)
    return packages.load_versions(up, old)


NEWER = f"""
 ask as (select p.*, case when id % 3 > 0 then valid_from + 20 end as on_date from b_package p),
 cand as (select a.id as package_id, a.on_date, p.id, p.version, case when a.on_date is not null then {COVERS.format(d='a.on_date')} else false end as sold, a.status <> 'active' as repl,
     a.valid_from is null or a.valid_to is null or p.valid_from is null or p.valid_to is null or (p.valid_from <= a.valid_from and p.valid_to >= a.valid_to) as wider
   from ask a join b_package p on p.family_id = a.family_id and p.version > a.version and p.status = 'active'),
 newer as (select package_id, cast(on_date as varchar) as on_date, id as newer_id, version as newer_version from cand
   where case when on_date is not null then sold or repl else repl or wider end
   qualify row_number() over (partition by package_id order by sold desc, version desc, id desc) = 1)
"""


@query("w11_newer_version", f"with {NEWER} select * from newer", ["b_package", "b_price"])
def w11(lib):
    asked = lib.b_package.select(F.col("id").alias("package_id"), F.when(F.col("id") % 3 > 0, F.date_add("valid_from", 20)).alias("on_date"))
    return packages.newer_version(lib.b_package, lib.b_price, asked)


GRID = f"""
 pairs as (select p.id as new_id, p.previous_version_id as old_id from b_package p where exists (select 1 from b_package o where o.id = p.previous_version_id)),
 cell as (select package_id, {KEY_SQL.format('category')} as cat, pax_min, pax_max, occupancy, min_by(amount, id) as amount from b_price group by all),
 n as (select p.*, c.* exclude(package_id) from pairs p join cell c on c.package_id = p.new_id),
 o as (select p.*, c.* exclude(package_id) from pairs p join cell c on c.package_id = p.old_id),
 cmp as (select coalesce(n.old_id, o.old_id) as old_id, coalesce(n.new_id, o.new_id) as new_id, coalesce(n.cat, o.cat) as cat, coalesce(n.pax_min, o.pax_min) as pax_min, coalesce(n.pax_max, o.pax_max) as pax_max, coalesce(n.occupancy, o.occupancy) as occupancy,
     o.amount as old, n.amount as new, case when o.amount is null then 'new' when n.amount is null then 'removed' when o.amount = n.amount then 'same' when n.amount > o.amount then 'up' else 'down' end as change,
     {pct_sql('o.amount', 'n.amount')} as pct
   from n full join o on o.new_id = n.new_id and o.old_id = n.old_id and o.cat = n.cat and o.pax_min is not distinct from n.pax_min and o.pax_max is not distinct from n.pax_max and o.occupancy = n.occupancy),
 summ as (select old_id, new_id, count(*) filter (change = 'up') as up, count(*) filter (change = 'down') as down, count(*) filter (change = 'same') as same, count(*) filter (change = 'new') as "new", count(*) filter (change = 'removed') as removed,
     coalesce(case when sum(pct) filter (pct <> 0) >= 0 then 1 else -1 end * ((abs(sum(cast(pct * 10 as bigint)) filter (pct <> 0)) * 2 + count(*) filter (pct <> 0)) // nullif(2 * count(*) filter (pct <> 0), 0)) / 10.0, 0.0) as avg_change_pct
   from cmp group by 1, 2)
"""


@query(
    "a20_compare_price_grids",
    f"with {GRID} select * from summ",
    ["b_package", "b_price"],
)
def a20(lib):
    return packages.grid_summary(packages.compare_grids(packages.version_pairs(lib.b_package), lib.b_price))


@query(
    "u02_removed_cells",
    f"with {GRID} select old_id, new_id, cat, pax_min, pax_max, occupancy, cast(old as double) as old from cmp where change = 'removed'",
    ["b_package", "b_price"],
)
def u02(lib):
    cells = packages.compare_grids(packages.version_pairs(lib.b_package), lib.b_price)
    return cells.filter("change = 'removed'").select("old_id", "new_id", "cat", "pax_min", "pax_max", "occupancy", "old")


@query(
    "a21_place_overlap",
    """with pairs as (select p.id as new_id, p.destinations as nd, o.id as old_id, o.destinations as od from b_package p join b_package o on o.id = p.previous_version_id)
      select new_id, old_id, round(len(list_intersect(list_distinct(nd), list_distinct(od))) / cast(len(list_distinct(list_concat(nd, od))) as double), 6) as overlap from pairs""",
    ["b_package"],
)
def a21(lib):
    d = lib.b_package.select("id", "destinations")
    pairs = packages.version_pairs(lib.b_package)
    j = pairs.join(d.select(F.col("id").alias("new_id"), F.col("destinations").alias("nd")), "new_id").join(d.select(F.col("id").alias("old_id"), F.col("destinations").alias("od")), "old_id")
    return j.select("new_id", "old_id", F.round(packages.place_overlap(F.col("nd"), F.col("od")), 6).alias("overlap"))


TREND = """
 dbl as (select * from b_price where occupancy = 'double' and pax_min is not null),
 tier as (select package_id, case when bool_or(pax_min = 2) then 2 else min(pax_min) end as tier from dbl group by 1)"""


def trend_points(lib):
    d = lib.b_price.filter("occupancy = 'double' and pax_min > 0")
    tier = d.groupBy("package_id").agg(F.coalesce(F.max(F.when(F.col("pax_min") == 2, 2)), F.min("pax_min")).alias("tier"))
    p = lib.b_package.select(F.col("id").alias("package_id"), "family_id", "version")
    return d.join(tier, "package_id").filter("pax_min = tier").join(p, "package_id")


@query(
    "a22_price_trend",
    f"with {TREND} select p.family_id, coalesce(d.category, '-') as category, p.version, d.id as price_id, d.package_id, t.tier as pax, cast(d.amount as double) as amount from dbl d join tier t on t.package_id = d.package_id and d.pax_min = t.tier join b_package p on p.id = d.package_id",
    ["b_package", "b_price"],
)
def a22(lib):
    return trend_points(lib).select("family_id", F.coalesce("category", F.lit("-")).alias("category"), "version", F.col("id").alias("price_id"), "package_id", F.col("tier").alias("pax"), "amount")


@query(
    "c32_package_versions",
    f"""with {GRID}, tw as (select package_id, min(amount) filter (occupancy = 'double') as m, min_by(currency, id) as cur from b_price group by 1)
      select p.id, p.family_id, p.version, p.title, {STATE.replace('status', 'p.status').replace('valid_', 'p.valid_')} as state, cast(tw.m as double) as from_price, tw.cur as currency,
        s.old_id as compared_with, s.up, s.down, s.avg_change_pct from b_package p left join tw on tw.package_id = p.id left join summ s on s.new_id = p.id""",
    ["b_package", "b_price"],
)
def c32(lib):
    """Every version of every family with its state, lowest twin price and comparison with the version it followed."""
    twin = lib.b_price.groupBy("package_id").agg(
        F.min(F.when(F.col("occupancy") == "double", F.col("amount"))).alias("from_price"), F.min_by("currency", "id").alias("currency")
    )
    comp = packages.grid_summary(packages.compare_grids(packages.version_pairs(lib.b_package), lib.b_price))
    p = lib.b_package.withColumn("state", keys.rate_state("status", "valid_from", "valid_to", F.lit(ON)))
    j = p.join(twin, p["id"] == twin["package_id"], "left").join(comp, p["id"] == comp["new_id"], "left")
    return j.select("id", "family_id", "version", "title", "state", "from_price", "currency", F.col("old_id").alias("compared_with"), "up", "down", "avg_change_pct")


CATS = "cats as (select package_id, string_agg(category, '|' order by a) as categories from (select package_id, category, min(id) as a from b_price where category is not null group by 1, 2) group by 1)"


@query(
    "a04_package_cards",
    f"""with {PRIMARY}, {CATS}, fam as (select family_id, count(*) as versions from b_package group by 1), tw as (select package_id, min(amount) as m from b_price where occupancy = 'double' group by 1),
      dc as (select package_id, count(*) as n from b_day group by 1), hc as (select package_id, count(*) as n from b_pkg_hotel group by 1)
      select p.id, p.family_id, p.title, p.region, s.name as supplier, coalesce(c.categories, '') as categories, cast(tw.m as double) as from_price, coalesce(dc.n, 0) as day_count, coalesce(hc.n, 0) as hotel_options, fam.versions,
        {STATE.replace('status', 'p.status').replace('valid_', 'p.valid_')} as state
      from prim join b_package p on p.id = prim.package_id join fam on fam.family_id = p.family_id left join cats c on c.package_id = p.id left join tw on tw.package_id = p.id left join dc on dc.package_id = p.id
      left join hc on hc.package_id = p.id left join b_supplier s on s.id = p.supplier_id where p.family_id in (select family_id from b_package where status = 'active')""",
    ["b_package", "b_price", "b_day", "b_pkg_hotel", "b_supplier"],
)
def a04(lib):
    """One card per family: its primary edition with prices, categories and counts."""
    live = lib.b_package.filter("status = 'active'").select("family_id").distinct()
    prim = packages.primary_edition(lib.b_package, lib.b_price, ON).join(live, "family_id", "left_semi").select(F.col("package_id").alias("id"))
    p = lib.b_package.join(prim, "id")
    fam = lib.b_package.groupBy("family_id").agg(F.count(F.lit(1)).alias("versions"))
    twin = lib.b_price.filter("occupancy = 'double'").groupBy(F.col("package_id").alias("id")).agg(F.min("amount").alias("from_price"))
    days = lib.b_day.groupBy(F.col("package_id").alias("id")).agg(F.count(F.lit(1)).alias("day_count"))
    hot = lib.b_pkg_hotel.groupBy(F.col("package_id").alias("id")).agg(F.count(F.lit(1)).alias("hotel_options"))
    cats = packages.first_categories(lib.b_price).select(F.col("package_id").alias("id"), F.array_join("categories", "|").alias("categories"))
    sup = lib.b_supplier.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier"))
    j = p.join(fam, "family_id").join(twin, "id", "left").join(days, "id", "left").join(hot, "id", "left").join(cats, "id", "left").join(sup, "supplier_id", "left")
    return j.select(
        "id", "family_id", "title", "region", "supplier", F.coalesce("categories", F.lit("")).alias("categories"), "from_price",
        F.coalesce("day_count", F.lit(0)).alias("day_count"), F.coalesce("hotel_options", F.lit(0)).alias("hotel_options"), "versions",
        keys.rate_state("status", "valid_from", "valid_to", F.lit(ON)).alias("state"),
    )


@query(
    "a05_price_grid",
    """with c as (select package_id, case when occupancy = 'double' and pax_min is not null then pax_min || ' pax' else replace(occupancy, '_', ' ') end || coalesce(' (' || season_name || ')', '') as label,
         category, max_by(amount, id) as amount from b_price group by 1, 2, 3)
       select package_id, label, string_agg(category || '=' || amount, '|' order by category) as cells from c group by 1, 2""",
    ["b_price"],
)
def a05(lib):
    """Rows are group sizes and occupancies, columns the package's own categories (the last line of a cell counts)."""
    label = F.concat(
        F.when((F.col("occupancy") == "double") & (F.col("pax_min") > 0), F.concat("pax_min", F.lit(" pax"))).otherwise(F.translate("occupancy", "_", " ")),
        F.coalesce(F.concat(F.lit(" ("), "season_name", F.lit(")")), F.lit("")),
    )
    cells = lib.b_price.groupBy("package_id", label.alias("label"), "category").agg(F.max_by("amount", "id").alias("amount"))
    one = F.concat("category", F.lit("="), F.col("amount").cast("string"))
    return cells.groupBy("package_id", "label").agg(F.array_join(F.array_sort(F.collect_list(one)), "|").alias("cells"))


@query(
    "a06_hotels_by_city",
    "select package_id, city, nights, category, hotel_name, id as seq, count(*) over (partition by package_id, city, nights) as in_city from b_pkg_hotel",
    ["b_pkg_hotel"],
)
def a06(lib):
    h = lib.b_pkg_hotel
    n = h.groupBy("package_id", "city", "nights").agg(F.count(F.lit(1)).alias("in_city"))
    return h.join(n, ["package_id", "city", "nights"]).select("package_id", "city", "nights", "category", "hotel_name", F.col("id").alias("seq"), "in_city")


@query(
    "j17_family_members",
    "select p.id, m.n as members, m.newest from b_package p join (select family_id, count(*) as n, max_by(id, (version, id)) as newest from b_package group by 1) m on m.family_id = coalesce(p.family_id, p.id)",
    ["b_package"],
)
def j17(lib):
    fam = F.coalesce("family_id", "id")
    m = lib.b_package.groupBy(fam.alias("fam")).agg(F.count(F.lit(1)).alias("members"), F.max_by("id", F.struct("version", "id")).alias("newest"))
    return lib.b_package.select("id", fam.alias("fam")).join(m, "fam").drop("fam")


@query(
    "c18_search_packages",
    f"""with days as (select distinct on_date from b_package_request),
      best as (select d.on_date, p.family_id, max_by(p.id, (p.version, p.id)) as id from days d join b_package p on p.status = 'active' and {COVERS.format(d='d.on_date')} group by 1, 2),
      q as (select d.on_date, package_id, count(*) as prices, min(amount) as cheapest from days d join b_price on d.on_date between valid_from and valid_to group by 1, 2)
      select r.request_id, p.id, p.title, q.prices, cast(q.cheapest as double) as cheapest from b_package_request r join best b on b.on_date = r.on_date join b_package p on p.id = b.id join q on q.package_id = p.id and q.on_date = r.on_date
      where r.destination is null or contains(lower(p.title), lower(r.destination)) or len(list_filter(p.destinations, lambda x: contains(lower(x), lower(r.destination)))) > 0""",
    ["b_package", "b_price", "b_package_request"],
)
def c18(lib):
    found = search.search_packages(lib.b_package_request, lib.b_package, lib.b_price)
    return found.select("request_id", F.col("package_id").alias("id"), "title", "prices", "cheapest")


@query(
    "c19_package_detail",
    """select package_id, 'day' as section, cast(day_number as bigint) as seq, title as text, cast(null as double) as amount from b_day
       union all select package_id, 'hotel', id, city || ': ' || hotel_name, null from b_pkg_hotel
       union all select package_id, 'price', id, concat_ws(' ', category, occupancy, pax_min), cast(amount as double) from b_price""",
    ["b_day", "b_pkg_hotel", "b_price"],
)
def c19(lib):
    """A package's days, hotels and prices as one list, in reading order by section and seq."""
    none = F.lit(None).cast("double").alias("amount")
    d = lib.b_day.select("package_id", F.lit("day").alias("section"), F.col("day_number").cast("bigint").alias("seq"), F.col("title").alias("text"), none)
    h = lib.b_pkg_hotel.select("package_id", F.lit("hotel").alias("section"), F.col("id").alias("seq"), F.concat("city", F.lit(": "), "hotel_name").alias("text"), none)
    q = lib.b_price.select("package_id", F.lit("price").alias("section"), F.col("id").alias("seq"), F.concat_ws(" ", "category", "occupancy", F.col("pax_min").cast("string")).alias("text"), F.col("amount").cast("double").alias("amount"))
    return d.unionByName(h).unionByName(q)


@query(
    "w05_group_price_rise",
    """with t as (select package_id, category, occupancy, valid_from, currency, pax_min, max(amount) as amount from b_price where pax_min is not null group by all),
       l as (select *, lag(amount) over w as a0, lag(pax_min) over w as p0 from t window w as (partition by package_id, category, occupancy, valid_from, currency order by pax_min))
       select package_id, category, cast(valid_from as varchar) as valid_from, currency, p0 as smaller, pax_min as larger from l where amount > a0""",
    ["b_price"],
)
def w05(lib):
    """Larger groups that pay more per head: a tier against the next smaller one (tiers of a grid are few)."""
    from pyspark.sql import Window

    grid = ["package_id", "category", "occupancy", "valid_from", "currency"]
    t = lib.b_price.filter("pax_min is not null").groupBy(*grid, "pax_min").agg(F.max("amount").alias("amount"))
    w = Window.partitionBy(*grid).orderBy("pax_min")
    t = t.withColumns({"a0": F.lag("amount").over(w), "smaller": F.lag("pax_min").over(w)})
    return t.filter("amount > a0").select("package_id", "category", "valid_from", "currency", "smaller", F.col("pax_min").alias("larger"))


@query(
    "w07_first_seen_hotels",
    f"select package_id, {KEY_SQL.format('hotel_name')} as name_key, city, category, min(id) as kept from (select package_id, id, case when hotel_id % 2 = 0 then hotel_name else upper(hotel_name) || '.' end as hotel_name, city, category from b_pkg_hotel) group by 1, 2, 3, 4",
    ["b_pkg_hotel"],
)
def w07(lib):
    from ..functions.grouping import first_by

    h = lib.b_pkg_hotel.withColumn("raw", F.when(F.col("hotel_id") % 2 == 0, F.col("hotel_name")).otherwise(F.concat(F.upper("hotel_name"), F.lit("."))))
    h = h.withColumn("name_key", keys.name_key("raw"))
    kept = first_by(h.select("package_id", "name_key", "city", "category", "id"), ["package_id", "name_key", keys.name_key("city"), keys.name_key("category")], [F.col("id")])
    return kept.select("package_id", "name_key", "city", "category", F.col("id").alias("kept"))


@query(
    "c03_package_checks",
    """select p.id, p.nights, coalesce(n, 0) as itinerary_days, case when coalesce(n, 0) = 0 then 'Package has no day-wise itinerary' when n not in (p.nights, p.nights + 1) then p.nights || ' nights but ' || n || ' itinerary days' end as warning
       from b_package p left join (select package_id, count(*) as n from b_day group by 1) d on d.package_id = p.id where coalesce(n, 0) not in (p.nights, p.nights + 1)""",
    ["b_package", "b_day"],
)
def c03(lib):
    d = lib.b_day.groupBy(F.col("package_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    j = lib.b_package.select("id", "nights").join(d, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    text = F.when(F.col("n") == 0, "Package has no day-wise itinerary").otherwise(F.concat("nights", F.lit(" nights but "), "n", F.lit(" itinerary days")))
    return j.filter((F.col("n") != F.col("nights")) & (F.col("n") != F.col("nights") + 1)).select("id", "nights", F.col("n").alias("itinerary_days"), text.alias("warning"))
