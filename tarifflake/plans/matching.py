"""Name matching over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import name_key
from ..operators import match, packages
from .packages import _split
from .registry import query
from .scalars import KEY_SQL


def hotel_queries(lib):
    """Names as another sheet would spell them."""
    p = lib.part.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("s"))).otherwise(F.concat(F.lit("The "), "p_name")).alias("name"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("city"))
    return p


def sorted_key(c):
    """Equal sorted words score 100."""
    return f"array_to_string(list_sort(string_split({KEY_SQL.format(c)}, ' ')), ' ')"


@query("j13_fuzzy_hotel_match")
def j13(lib):
    m = match.match_hotels(hotel_queries(lib), lib.b_hotel)
    return m.select("query_id", "id", F.round("score", 2).alias("score"))


@query(
    "j14_city_blocked_exact_match",
    f"""with q as (select p_partkey as query_id, {sorted_key('p_name')} as k, lower(p_brand) as city from part where p_size % 4 > 0)
      select q.query_id, min(h.id) as id from q join b_hotel h on {sorted_key('h.name')} = q.k and (h.city is null or lower(h.city) = q.city) group by 1""",
    ["b_hotel"],
)
def j14(lib):
    q = lib.part.filter("p_size % 4 > 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("city"))
    m = match.match_hotels(q, lib.b_hotel)
    return m.filter("score = 100").select("query_id", "id")


@query(
    "j15_room_and_service_match",
    f"""select 'room' as what, q.id as query_id, min(r.id) as id from b_room q join b_room r on r.hotel_id = q.hotel_id and {sorted_key('r.name')} = {sorted_key('q.name')} group by 1, 2
      union all select 'service', q.id, min(s.id) from b_service q join b_service s on s.supplier_id = q.supplier_id and s.kind = q.kind and s.vehicle_type is not distinct from q.vehicle_type and s.basis = q.basis and {sorted_key('s.name')} = {sorted_key('q.name')} group by 1, 2""",
    ["b_room", "b_service"],
)
def j15(lib):
    rooms = lib.b_room.select(F.col("id").alias("query_id"), "hotel_id", F.upper("name").alias("name"))
    a = match.match_in(rooms, lib.b_room, ["hotel_id"])
    keys = ["supplier_id", "kind", "vehicle_type", "basis"]
    svc = lib.b_service.select(F.col("id").alias("query_id"), *keys, F.upper("name").alias("name"))
    b = match.match_in(svc, lib.b_service, keys, match.SERVICES)
    return a.select(F.lit("room").alias("what"), "query_id", "id").unionByName(b.select(F.lit("service").alias("what"), "query_id", "id"))


@query("s12_name_similarity")
def s12(lib):
    """Scores of all similar names of the catalogue, each distinct pair once."""
    n = lib.part.select(F.lit("*").alias("block"), name_key("p_name").alias("name")).distinct()
    from ..functions.similarity import similar_pairs

    return similar_pairs(n, n, match.NAMES).filter("q < d").select("q", "d", F.round("score", 2).alias("score"))


@query("j20_similar_suppliers")
def j20s(lib):
    """Similar supplier names, from the part brands and types that stand in for company names."""
    n = lib.part.select(F.concat_ws(" ", "p_name", "p_type", F.lit("travels")).alias("name"))
    return match.similar_suppliers(n)


@query("j18_package_hotels_in_catalogue")
def j18(lib):
    """Every hotel a package names, linked to the catalogue or added to it without rates."""
    ph = lib.b_pkg_hotel.select(F.concat_ws("-", "package_id", "id").alias("query_id"), F.col("hotel_name").alias("name"), "city", "category")
    names = ph.groupBy("name", "city").agg(F.min("query_id").alias("query_id"), F.min("category").alias("category"))
    m = match.match_hotels(names.select("query_id", "name", "city"), lib.b_hotel)
    ids, after = match.resolve(names, lib.b_hotel, m, ["city", "category"], [name_key("name"), F.lower(F.coalesce("city", F.lit("")))])
    return after.select("id", "name", "city", "category")


@query(
    "c04_resolve_suppliers",
    """select s.id, s.name, coalesce(nullif(s.address, ''), 'New street') as address, s.city from b_supplier s union all
       select null, name, 'New street', null from (select 'Newcomer ' || n_name as name from nation)""",
    ["b_supplier"],
)
def c04(lib):
    """Suppliers named by new sheets: known ones get their blanks filled, unknown ones are added (their ids are
    derived from the name, so only their names are compared here)."""
    old = lib.b_supplier.select(F.concat(F.lit("a"), "id").alias("query_id"), F.upper("name").alias("name"), F.lit("New street").alias("address"), F.lit(None).cast("string").alias("city"))
    new = lib.nation.select(F.concat(F.lit("b"), "n_nationkey").alias("query_id"), F.concat(F.lit("Newcomer "), "n_name").alias("name"), F.lit("New street").alias("address"), F.lit(None).cast("string").alias("city"))
    inc = old.unionByName(new)
    q = inc.select("query_id", F.lit("*").alias("block"), name_key("name").alias("name_key"))
    k = lib.b_supplier.select("id", F.lit("*").alias("block"), name_key("name").alias("name_key"))
    m = match.best_match(q, k)
    _, after = match.resolve(inc, lib.b_supplier, m, ["address", "city"], [name_key("name")])
    return after.select(F.when(F.col("id") >= 0, F.col("id")).alias("id"), "name", "address", "city")


@query("c09_package_families")
def c09(lib):
    """The family of every upload that waits for review."""
    up, old = _split(lib)
    return packages.match_families(up, old, match.core_title_pairs, match.PACKAGES).select("upload_id", "family_id", F.round("score", 2).alias("score"))


@query("t04_family_candidates")
def t04(lib):
    """The eight closest families of each upload, however far away."""
    from pyspark.sql import Window

    up, old = _split(lib)
    c = packages.match_families(up, old, match.core_title_pairs, None, best=8)
    w = Window.partitionBy("upload_id").orderBy(F.desc("score"), "family_id")
    return c.withColumn("rank", F.row_number().over(w)).filter("rank <= 8").select("upload_id", "family_id", "rank")


