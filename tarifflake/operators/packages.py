"""Packages: group prices, editions of a family, price-grid comparison, matching new uploads to families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import core_title, name_key, overlap_days
from ..functions.money import money, pct_change
from ..session import stage


def first_categories(prices: DataFrame) -> DataFrame:
    """Distinct categories per package in the order the sheet lists them."""
    seen = prices.filter("category is not null").groupBy("package_id", "category").agg(F.min("id").alias("at"))
    return seen.groupBy("package_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x["category"]).alias("categories")
    )


def price_book(asked: DataFrame, prices: DataFrame) -> DataFrame:
    """Per (package, category, travel date) asked for: the amount of each group-size tier and occupancy.

    Only prices valid on the date count, or all of them when none is. Tiers take the last row of the sheet, other
    occupancies the first."""
    p = prices.select("package_id", "category", "id", "pax_min", "occupancy", "amount", "currency", "is_net", "valid_from", "valid_to")
    j = asked.join(p, ["package_id", "category"])
    ok = F.col("travel_date").isNull() | F.col("travel_date").between(F.col("valid_from"), F.col("valid_to"))
    tier = F.when((F.col("occupancy") == "double") & (F.col("pax_min") > 0), F.col("pax_min"))
    row = F.struct("amount", "currency", "is_net", "id")
    cells = j.groupBy("package_id", "category", "travel_date", "occupancy", tier.alias("tier"), ok.alias("ok")).agg(
        F.min_by(row, "id").alias("first"),
        F.max_by(row, "id").alias("last"),
        F.min("currency").alias("cur_min"),
        F.max("currency").alias("cur_max"),
    )
    cell = F.struct("ok", "occupancy", "tier", "first", "last", "cur_min", "cur_max")
    book = cells.groupBy("package_id", "category", "travel_date").agg(F.collect_list(cell).alias("cells"), F.bool_or("ok").alias("any_ok"))
    return book.select("package_id", "category", "travel_date", "any_ok", F.filter("cells", lambda c: c["ok"] | ~F.col("any_ok")).alias("cells"))


def price_packages(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """One priced answer per group request."""
    cats = first_categories(prices)
    r = requests.join(cats, "package_id", "left")
    r = r.withColumn("category", F.coalesce("category", F.try_element_at("categories", F.lit(1))))
    book = price_book(r.select("package_id", "category", "travel_date").distinct(), prices).alias("b")
    same = (F.col("r.package_id") == F.col("b.package_id")) & (F.col("r.category") == F.col("b.category")) & F.col("r.travel_date").eqNullSafe(F.col("b.travel_date"))
    j = r.alias("r").join(book, same, "left").select("r.*", "b.any_ok", "b.cells")
    twin = F.col("adults") - F.col("extra_beds")
    tiers = F.array_sort(F.transform(F.filter("cells", lambda c: c["tier"].isNotNull()), lambda c: c["tier"]))
    j = j.withColumns({"twin": twin, "tiers": tiers})
    fitting = F.filter("tiers", lambda t: t <= F.col("twin"))
    auto = F.coalesce(F.array_max(fitting), F.array_min("tiers"))
    j = j.withColumn("tier", F.coalesce("pax_tier", auto))

    def rate(occ: str) -> Column:
        rows = F.filter("cells", lambda c: c["occupancy"] == occ)
        return F.array_min(F.transform(rows, lambda c: F.struct(c["first"]["id"].alias("id"), c["first"]["amount"].alias("amount"))))["amount"]

    at_tier = F.try_element_at(F.filter("cells", lambda c: c["tier"] == F.col("tier")), F.lit(1))["last"]["amount"]
    j = j.withColumns(
        {
            "base": F.when(F.col("tier").isNotNull(), at_tier).otherwise(rate("double")),
            "r_extra": rate("extra_adult"),
            "r_cwb": F.coalesce(rate("child_with_bed"), rate("extra_adult")),
            "r_cnb": rate("child_without_bed"),
            "r_single": rate("single_supplement"),
        }
    )
    parts = [
        ("twin", "base", "per-person twin sharing"),
        ("extra_beds", "r_extra", "Extra bed (adult)"),
        ("children_with_bed", "r_cwb", "Child with bed"),
        ("children_without_bed", "r_cnb", "Child without bed"),
        ("single_rooms", "r_single", "Single supplement"),
    ]
    total = sum(
        (F.when((F.col(q) > 0) & F.col(a).isNotNull(), money(F.col(a) * F.col(q))).otherwise(F.lit(0).cast("decimal(22,2)")) for q, a, _ in parts[1:]),
        F.coalesce(money(F.col("base") * F.col("twin")), F.lit(0).cast("decimal(22,2)")),
    )
    known = F.array_contains("categories", F.col("category"))
    refused = (
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("Category '"), F.coalesce("category", F.lit("-")), F.lit("' not in this package")))
        .when(F.col("twin") < 1, "At least one adult must be on twin sharing")
        .when(F.col("pax_tier").isNotNull() & ~F.array_contains("tiers", F.col("pax_tier")), F.concat(F.lit("No "), "pax_tier", F.lit(" pax rate")))
    )
    missing = [
        F.when((F.col(q) > 0) & F.col(a).isNull(), F.concat(F.lit(f"No {label} rate for "), "category")) for q, a, label in parts
    ]
    errors = F.array_compact(
        F.array(
            F.when(~F.col("any_ok"), F.concat(F.lit("Package prices are not valid on "), F.col("travel_date").cast("string"))), *missing
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("pax_tier").isNull() & (F.col("tier") != F.col("twin")), F.concat(F.lit("No exact "), "twin", F.lit(" pax rate - used the "), "tier", F.lit(" pax rate"))),
            F.when((F.col("twin") % 2 == 1) & (F.col("single_rooms") == 0), F.concat("twin", F.lit(" adults on twin sharing is an odd number - add an extra bed or a single room"))),
        )
    )
    cur_min = F.array_min(F.transform("cells", lambda c: c["cur_min"]))
    cur_max = F.array_max(F.transform("cells", lambda c: c["cur_max"]))
    first_net = F.array_min(F.transform("cells", lambda c: F.struct(c["first"]["id"].alias("id"), c["first"]["is_net"].alias("n"))))["n"]
    return j.withColumn("refused", refused).select(
        "request_id", "package_id", "category", F.when(F.col("refused").isNull(), F.col("tier")).alias("pax_tier"),
        F.when(F.col("refused").isNull(), total).alias("total"),
        F.when(F.col("refused").isNull() & (cur_min == cur_max), cur_min).alias("currency"),
        F.when(F.col("refused").isNull(), first_net).alias("is_net"),
        F.when(F.col("refused").isNotNull(), F.array("refused")).otherwise(errors).alias("errors"),
        F.when(F.col("refused").isNull(), warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


# ---------------------------------------------------------------- editions of a family
def sold_on(members: DataFrame, prices: DataFrame, dates: DataFrame) -> DataFrame:
    """(member, date) pairs on which an edition is sold: inside its validity and with a price that day, or without
    any prices at all. ``dates`` holds (family_id, on_date) pairs."""
    m = members.alias("m").join(dates.distinct().alias("d"), "family_id")
    inside = F.col("valid_from").isNull() | F.col("valid_to").isNull() | F.col("on_date").between(F.col("valid_from"), F.col("valid_to"))
    m = m.filter(inside)
    spans = prices.select(F.col("package_id").alias("pid"), F.col("valid_from").alias("pf"), F.col("valid_to").alias("pt")).distinct()
    priced = m.join(spans, (F.col("id") == F.col("pid")) & F.col("on_date").between(F.col("pf"), F.col("pt")), "left_semi")
    unpriced = m.join(spans.select("pid").distinct(), F.col("id") == F.col("pid"), "left_anti")
    return priced.unionByName(unpriced)


def newest_edition(members: DataFrame, prices: DataFrame, dates: DataFrame) -> DataFrame:
    """The newest live edition of each family sold on each asked date."""
    on = sold_on(members.filter("status = 'active'"), prices, dates)
    return on.groupBy("family_id", "on_date").agg(F.max_by("id", F.struct("version", "id")).alias("package_id"), F.max(F.struct("version", "id"))["version"].alias("version"))


def primary_edition(members: DataFrame, prices: DataFrame, today) -> DataFrame:
    """The edition a family shows: sold today, else the next to start, else the newest; live ones if there are any."""
    day = F.lit(today)
    any_live = members.groupBy("family_id").agg(F.bool_or(F.col("status") == "active").alias("any_live"))
    pool = members.join(any_live, "family_id").filter((F.col("status") == "active") | ~F.col("any_live")).drop("any_live")
    dates = pool.select("family_id", day.alias("on_date")).distinct()
    now = sold_on(pool.filter("status = 'active'"), prices, dates).select(F.col("id").alias("now_id")).distinct()
    j = pool.join(now, F.col("id") == F.col("now_id"), "left")
    starts = F.datediff("valid_from", day)
    rank = (
        F.when(F.col("now_id").isNotNull(), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), (-F.col("version")).alias("c"), (-F.col("id")).alias("d")))
        .when(starts > 0, F.struct(F.lit(1).alias("a"), starts.alias("b"), (-F.col("version")).alias("c"), (-F.col("id")).alias("d")))
        .otherwise(F.struct(F.lit(2).alias("a"), F.lit(0).alias("b"), (-F.col("version")).alias("c"), (-F.col("id")).alias("d")))
    )
    return j.groupBy("family_id").agg(F.min_by("id", rank).alias("package_id"), F.min(rank)["a"].alias("choice"))


def newer_version(packages: DataFrame, prices: DataFrame, asked: DataFrame) -> DataFrame:
    """For (package_id, on_date) asks: a newer live edition to use instead, if any.

    With a date: the newest edition sold that day, else (when the package was replaced) the newest. Without: the
    newest if it was replaced, else the newest whose dates are the same or wider."""
    p = packages.select(F.col("id").alias("package_id"), "family_id", F.col("version").alias("own"), (F.col("status") != "active").alias("replaced"), F.col("valid_from").alias("f"), F.col("valid_to").alias("t"))
    asks = asked.distinct().join(p, "package_id")
    live = packages.filter("status = 'active'")
    top = F.max(F.struct("version", "id"))
    # on a date: the newest edition sold that day, looked up per family and day
    sold = newest_edition(packages, prices, asks.filter("on_date is not null").select("family_id", "on_date"))
    sold = sold.select("family_id", "on_date", F.struct("version", F.col("package_id").alias("id")).alias("sold"))
    newest = live.groupBy("family_id").agg(top.alias("newest"))
    # without a date: the newest edition whose dates are the same or wider, per distinct date range
    spans = live.groupBy("family_id", "valid_from", "valid_to").agg(top.alias("cand"))
    own = asks.filter("on_date is null and not replaced").select("family_id", "f", "t").distinct().alias("o")
    unknown = F.col("f").isNull() | F.col("t").isNull() | F.col("valid_from").isNull() | F.col("valid_to").isNull()
    wider = unknown | ((F.col("valid_from") <= F.col("f")) & (F.col("valid_to") >= F.col("t")))
    wide = own.join(spans, "family_id").filter(wider).groupBy("family_id", "f", "t").agg(F.max("cand").alias("wide"))
    wide = wide.select(F.col("family_id").alias("wf"), F.col("f").alias("w_from"), F.col("t").alias("w_to"), "wide")
    j = asks.join(sold, ["family_id", "on_date"], "left").join(newest, "family_id", "left")
    j = j.join(wide, (F.col("family_id") == F.col("wf")) & F.col("f").eqNullSafe(F.col("w_from")) & F.col("t").eqNullSafe(F.col("w_to")), "left")

    def above(c: str) -> Column:
        return F.when(F.col(f"{c}.version") > F.col("own"), F.col(c))

    best = F.when(F.col("on_date").isNotNull(), F.coalesce(above("sold"), F.when(F.col("replaced"), above("newest")))).otherwise(
        F.when(F.col("replaced"), above("newest")).otherwise(above("wide"))
    )
    j = j.withColumn("b", best).filter("b is not null")
    return j.select("package_id", "on_date", F.col("b.id").alias("newer_id"), F.col("b.version").alias("newer_version"))


def version_pairs(packages: DataFrame) -> DataFrame:
    """(new_id, old_id): each package with the version it was compared with when it was loaded."""
    known = packages.select(F.col("id").alias("old_id"))
    p = packages.filter("previous_version_id is not null").select(F.col("id").alias("new_id"), F.col("previous_version_id").alias("old_id"))
    return p.join(known, "old_id").select("new_id", "old_id")


def shared_days(a_from: str, a_to: str, b_from: str, b_to: str) -> Column:
    """Days in common; none where a date is unknown."""
    known = F.col(a_from).isNotNull() & F.col(a_to).isNotNull() & F.col(b_from).isNotNull() & F.col(b_to).isNotNull()
    return F.when(known, overlap_days(a_from, a_to, b_from, b_to)).otherwise(0)


def covering_upload(members: DataFrame, uploads: DataFrame) -> DataFrame:
    """``members`` (id, family_id, valid_from, valid_to, seq) with ``covered_at``, ``covered_by``: the first of the
    family's later ``uploads`` whose dates cover theirs; and ``shared``: whether a later upload has days in common.
    Members that were there before the batch have no seq; of these, each date range is looked up once."""
    u = uploads.select(F.col("family_id").alias("u_family"), F.col("valid_from").alias("nf"), F.col("valid_to").alias("nt"), F.col("seq").alias("u_seq"), F.col("id").alias("u_id"))
    first = u.groupBy("u_family", "nf", "nt").agg(F.min(F.struct("u_seq", "u_id")).alias("u"))
    first = first.select("u_family", "nf", "nt", "u.u_seq", "u.u_id")
    asks = members.select("family_id", "valid_from", "valid_to", "seq").distinct()
    wide, meets = covers("nf", "nt", "valid_from", "valid_to"), shared_days("valid_from", "valid_to", "nf", "nt") > 0
    found = [F.min(F.when(wide, F.struct("u_seq", "u_id"))).alias("cover"), F.bool_or(meets).alias("shared")]
    old = asks.filter("seq is null").join(first, F.col("family_id") == F.col("u_family")).groupBy("family_id", "valid_from", "valid_to", "seq").agg(*found)
    new = asks.filter("seq is not null").join(u, (F.col("family_id") == F.col("u_family")) & (F.col("u_seq") > F.col("seq"))).groupBy("family_id", "valid_from", "valid_to", "seq").agg(*found)
    f = old.unionByName(new).alias("f")
    on = F.lit(True)
    for c in ("family_id", "valid_from", "valid_to", "seq"):
        on = on & F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}"))
    return members.alias("m").join(f, on, "left").select("m.*", F.col("f.cover.u_seq").alias("covered_at"), F.col("f.cover.u_id").alias("covered_by"), F.col("f.shared").alias("shared"))


def load_versions(uploads: DataFrame, library: DataFrame) -> DataFrame:
    """For each upload (with its place ``seq`` in the order of approval): its version number, counted on from upload to
    upload, and the member it is compared with: a live one where there is one, with the most shared days, then the
    highest version. A member is live for an upload until an earlier upload covers its dates."""
    top = library.groupBy("family_id").agg(F.max("version").alias("top"))
    number = F.row_number().over(Window.partitionBy("family_id").orderBy("seq", "id"))
    u = uploads.select("id", "family_id", "valid_from", "valid_to", "seq").withColumn("nth", number).join(top, "family_id", "left")
    u = stage(u.select("id", "family_id", "valid_from", "valid_to", "seq", (F.coalesce("top", F.lit(0)) + F.col("nth")).alias("version")))
    none = F.lit(None).cast("bigint").alias("seq")
    old = library.join(u.select("family_id").distinct(), "family_id", "left_semi").select("id", "family_id", "valid_from", "valid_to", none, "version", (F.col("status") == "active").alias("active"))
    members = covering_upload(old.unionByName(u.withColumn("active", F.lit(True))), u)
    # of equal dates and fate the highest version is enough
    by = ["family_id", "valid_from", "valid_to", "seq", "active", "covered_at"]
    m = members.groupBy(*by).agg(F.max(F.struct("version", "id")).alias("m")).select(*[F.col(c).alias(f"m_{c}") for c in by], "m")
    pairs = u.join(m, (F.col("family_id") == F.col("m_family_id")) & (F.col("m_seq").isNull() | (F.col("m_seq") < F.col("seq"))))
    live = F.col("m_active") & (F.col("m_covered_at").isNull() | (F.col("m_covered_at") >= F.col("seq")))
    shared = shared_days("valid_from", "valid_to", "m_valid_from", "m_valid_to")
    base = pairs.groupBy("id").agg(F.max_by("m.id", F.struct(live, shared, "m.version", "m.id")).alias("base_id"))
    return u.join(base, "id", "left").select(F.col("id").alias("upload_id"), "family_id", "version", "base_id")


def version_effects(uploads: DataFrame, library: DataFrame) -> DataFrame:
    """What the uploads (in the order of ``seq``) do to the live members of their families, earlier uploads of the batch
    included: replaced (by the first that covers its dates), overlapped, or kept."""
    new = uploads.select("id", "family_id", "valid_from", "valid_to", "seq")
    live = library.filter("status = 'active'").select("id", "family_id", "valid_from", "valid_to", F.lit(None).cast("bigint").alias("seq"))
    last = new.groupBy("family_id").agg(F.max("seq").alias("last"))
    members = live.unionByName(new).join(last, "family_id").filter("seq is null or seq < last").drop("last")
    m = covering_upload(members, new)
    action = F.when(F.col("covered_at").isNotNull(), "replaced").when(F.col("shared"), "overlaps (newer wins on shared dates)").otherwise("kept (other dates)")
    return m.select("id", "family_id", action.alias("action"), F.col("covered_by").alias("replaced_by"))


# ---------------------------------------------------------------- comparing price grids
def _cells(prices: DataFrame, side: str, package: str) -> DataFrame:
    cell = prices.select(F.col("package_id").alias(package), name_key("category").alias("cat"), "pax_min", "pax_max", "occupancy", "id", "amount")
    return cell.groupBy(package, "cat", "pax_min", "pax_max", "occupancy").agg(F.min_by("amount", "id").alias(side))


def compare_grids(pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """Cells of (old_id, new_id) package pairs, matched by category, group size and occupancy; the first row of a
    cell counts on both sides."""
    used_new = pairs.select(F.col("new_id").alias("package_id")).distinct()
    used_old = pairs.select(F.col("old_id").alias("package_id")).distinct()
    new = _cells(prices.join(used_new, "package_id", "left_semi"), "new", "new_id").join(pairs, "new_id")
    old = _cells(prices.join(used_old, "package_id", "left_semi"), "old", "old_id").join(pairs, "old_id")
    n, o = new.alias("n"), old.alias("o")
    on = F.lit(True)
    for c in ("old_id", "new_id", "cat", "pax_min", "pax_max", "occupancy"):
        on = on & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    j = n.join(o, on, "full")
    kind = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old") == F.col("new"), "same")
        .when(F.col("new") > F.col("old"), "up")
        .otherwise("down")
    )
    return j.select(
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("old_id", "new_id", "cat", "pax_min", "pax_max", "occupancy")],
        "old", "new", kind.alias("change"), pct_change("old", "new").alias("pct"),
    )


def grid_summary(cells: DataFrame) -> DataFrame:
    moved = F.when(F.col("pct") != 0, F.col("pct"))
    return cells.groupBy("old_id", "new_id").agg(
        *[F.count_if(F.col("change") == k).alias(k) for k in ("up", "down", "same", "new", "removed")],
        F.coalesce(F.round(F.sum(moved) / F.nullif(F.count(moved), F.lit(0)), 1), F.lit(0)).alias("avg_change_pct"),
    )


def place_overlap(a, b) -> Column:
    """Shared share of two place lists; null when a side is empty."""
    return _shared_share(place_keys(a), place_keys(b))


def place_keys(x) -> Column:
    """The distinct names of a place list, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(x, name_key), lambda k: k != "")))


def _shared_share(ka, kb) -> Column:
    return F.when((F.size(ka) > 0) & (F.size(kb) > 0), F.size(F.array_intersect(ka, kb)) / F.size(F.array_union(ka, kb)))


def covers(new_from, new_to, old_from, old_to) -> Column:
    """Unknown dates on either side count as covered."""
    unknown = F.col(new_from).isNull() | F.col(new_to).isNull() | F.col(old_from).isNull() | F.col(old_to).isNull()
    return unknown | ((F.col(new_from) <= F.col(old_from)) & (F.col(new_to) >= F.col(old_to)))


def match_families(uploads: DataFrame, packages: DataFrame, score, threshold: int | None = 86, best: int | None = None) -> DataFrame:
    """The family each upload belongs to: same supplier and nights (where both are known), the closest core title,
    20 points off when the places differ. ``score(pairs, a, b)`` adds a column ``score`` for two core titles. Without a
    threshold: all families that it may be, with a score of 0 at least. ``best``: only so many of each upload, the lowest
    ids among equals.

    Supplier, nights, core title and places decide the score: each distinct combination of them is compared once, and a
    combination stands for all its uploads and all its families (for its ``best`` first ones, as no more can be asked for)."""
    core = lambda df: F.coalesce(core_title("title", "base_name") if "base_name" in df.columns else core_title("title"), F.lit(""))
    of = F.coalesce(F.col("supplier_id").cast("string"), F.lit("none")).alias("supplier_id")  # unknown suppliers meet each other
    mine, theirs = ["supplier_id", "nights", "core", "places"], ["supplier_id", "c_nights", "c_core", "c_places"]
    u = uploads.select(F.col("id").alias("upload_id"), of, "nights", core(uploads).alias("core"), place_keys(F.col("destinations")).alias("places"))
    c = packages.select("family_id", of, F.col("nights").alias("c_nights"), core(packages).alias("c_core"), place_keys(F.col("destinations")).alias("c_places")).distinct()
    uk, ck = u.select(*mine).distinct(), c.select(*theirs).distinct()
    known = score(uk.select("supplier_id", "nights", "core").distinct(), ck.select("supplier_id", "c_nights", "c_core").distinct(), threshold)
    pairs = uk.join(known, ["supplier_id", "core"]).join(ck, ["supplier_id", "c_core"])
    pairs = pairs.filter(F.col("nights").isNull() | F.col("c_nights").isNull() | (F.col("nights") == F.col("c_nights")))
    far = F.coalesce(_shared_share(F.col("places"), F.col("c_places")) < 0.5, F.lit(False))
    s = F.col("score") - F.when(far, 20).otherwise(0)
    pairs = pairs.withColumn("score", F.greatest(s, F.lit(0.0)) if threshold is None else s)
    if threshold is not None:
        pairs = pairs.filter(F.col("score") >= threshold)
    if best is not None:
        first = F.row_number().over(Window.partitionBy(*theirs).orderBy("family_id"))
        c = c.withColumn("__n", first).filter(F.col("__n") <= best).drop("__n")

    def same(a: str, b: str, columns: list[str]) -> Column:
        on = F.lit(True)
        for x in columns:
            on = on & F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}"))
        return on

    met = pairs.alias("p").join(c.alias("c"), same("p", "c", theirs)).select(*[f"p.{x}" for x in mine], "c.family_id", "p.score")
    met = met.groupBy(*mine, "family_id").agg(F.max("score").alias("score"))
    if best is not None:
        top = F.row_number().over(Window.partitionBy(*mine).orderBy(F.desc("score"), "family_id"))
        met = met.withColumn("__n", top).filter(F.col("__n") <= best).drop("__n")
    found = u.alias("u").join(met.alias("m"), same("u", "m", mine)).select("u.upload_id", "m.family_id", "m.score")
    return found.groupBy("upload_id", "family_id").agg(F.max("score").alias("score"))
