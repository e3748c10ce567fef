"""The dated rate library: what is live, what a new sheet changes, and how earlier rates give way.

A *rate key* is one sellable thing (room type, meal plan, occupancy, weekdays, net flag). All jobs first collapse
rows of a key that have the same dates and terms. What is left per key is bounded by the calendar, not by the
number of sheets, so a key that holds a large share of all rows is small before anything is grouped by key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouping import big_groups, first_by, maybe_in
from ..functions.keys import name_key, overlap_days, overlaps, year_later
from ..functions.money import pct_change
from ..session import stage

KEY = ["room_type_id", "meal_plan", "occupancy", "weekdays", "is_net"]
TERMS = ["amount", "currency", "basis", "taxes_included"]
#: Rates and incoming lines that a key may have together to be compared in one row.
FEW = 100
#: Lines of a key that are settled in one place.
MANY = 10_000


def rate_key(parts: list[str] = KEY) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in parts])


def keyed(df: DataFrame, parts: list[str] = KEY) -> DataFrame:
    return df.withColumn("rate_key", rate_key(parts))


def _kept(rows: Column) -> Column:
    """Of a sheet's lines for one key and currency, in order: those that do not repeat the amount of a kept line on
    dates that overlap. A line that was dropped is not compared with later ones; another amount is no repetition."""

    def add(kept: Column, r: Column) -> Column:
        repeats = F.exists(kept, lambda o: (o["amount"] == r["amount"]) & overlaps(o["valid_from"], o["valid_to"], r["valid_from"], r["valid_to"]))
        return F.when(repeats, kept).otherwise(F.concat(kept, F.array(r)))

    return F.when(F.size(rows) == 1, rows).otherwise(F.aggregate(rows, F.slice(rows, 1, 0), add))


def _sheet_groups(lines: DataFrame) -> DataFrame:
    """``rows``: the lines of each sheet, key and currency in their order."""
    rest = [c for c in lines.columns if c not in ("line_no", "currency", "document_id", "rate_key")]
    k = lines if "rate_key" in lines.columns else keyed(lines)
    rows = F.array_sort(F.collect_list(F.struct("line_no", *rest))).alias("rows")
    return k.groupBy("document_id", "rate_key", "currency").agg(rows)


def loaded_lines(lines: DataFrame) -> DataFrame:
    """The lines that a sheet brings into the library, with their key: all but repetitions."""
    g = _sheet_groups(lines)
    return g.select("document_id", "rate_key", "currency", F.inline(_kept(F.col("rows"))))


def sheet_findings(lines: DataFrame) -> DataFrame:
    """``document_id``, ``line_no``: lines that overlap an earlier kept line of their sheet, key and currency, with the
    same amount (``dup``: the line is dropped) or with another (``conflict``: both stay, and the sheet has an error)."""
    g = _sheet_groups(lines.select("document_id", "line_no", *KEY, "currency", "amount", "valid_from", "valid_to")).filter(F.size("rows") > 1)
    g = g.select("document_id", _kept(F.col("rows")).alias("kept"), F.explode("rows").alias("r"))

    def earlier(test):
        meets = lambda o: overlaps(o["valid_from"], o["valid_to"], F.col("r.valid_from"), F.col("r.valid_to"))
        return F.exists("kept", lambda o: (o["line_no"] < F.col("r.line_no")) & meets(o) & test(o))

    flags = g.select("document_id", F.col("r.line_no").alias("line_no"), earlier(lambda o: o["amount"] == F.col("r.amount")).alias("dup"), earlier(lambda o: o["amount"] != F.col("r.amount")).alias("conflict"))
    return flags.filter("dup or conflict")


def live_rates(lines: DataFrame) -> DataFrame:
    """The whole library as of its last sheet: per key, each day carries the lines of the newest sheet that covers it, and
    days with equal terms in a row are one rate. The lines of a key are moved once, to one place; those of keys with more
    than ``MANY`` lines are settled step by step: year by year, on the newest lines per date range, so that a key that holds
    a large share of all lines is small before its lines meet."""
    every = keyed(lines.select("document_id", "line_no", "approval_seq", *KEY, *TERMS, "valid_from", "valid_to"))
    big = big_groups(every, "rate_key", MANY)
    if big is None:
        return _live(every.repartition("rate_key"))
    return _live(maybe_in(every, big, ["rate_key"], rest=True).repartition("rate_key")).unionByName(_live(maybe_in(every, big, ["rate_key"])))


def _live(lines: DataFrame) -> DataFrame:
    """``live_rates`` of lines that have their key."""
    from .ownership import cut_at, year_pieces

    parts = [*KEY, *TERMS]
    rows = year_pieces(loaded_lines(lines))
    newest = Window.partitionBy("rate_key", "year", "valid_from", "valid_to").orderBy(F.desc("approval_seq"))
    rows = rows.withColumn("__r", F.rank().over(newest)).filter("__r = 1")
    year = Window.partitionBy("rate_key", "year")
    edges = F.array_sort(F.array_distinct(F.concat(F.collect_set("valid_from").over(year), F.collect_set(F.date_add("valid_to", 1)).over(year))))
    seg = rows.withColumn("edges", edges).select("rate_key", "year", "approval_seq", *parts, F.inline(cut_at(F.col("edges"))))
    top = Window.partitionBy("rate_key", "year", "seg_from").orderBy(F.desc("approval_seq"))
    seg = seg.withColumn("__r", F.rank().over(top)).filter("__r = 1")
    w = Window.partitionBy("rate_key", *TERMS).orderBy("seg_from")
    apart = F.coalesce(F.lag("seg_to").over(w) < F.date_sub("seg_from", 1), F.lit(True))
    run = seg.withColumn("__run", F.sum(apart.cast("int")).over(w))
    merged = run.groupBy("rate_key", *TERMS, "__run").agg(*[F.first(k).alias(k) for k in KEY], F.min("seg_from").alias("valid_from"), F.max("seg_to").alias("valid_to"))
    return merged.select(*parts, "valid_from", "valid_to")


# ---------------------------------------------------------------- comparing new sheets with the library
def _quarters(rows: DataFrame, name: str = "quarter") -> DataFrame:
    """Each row once per quarter that its dates touch."""
    first, last = F.trunc("valid_from", "quarter"), F.trunc("valid_to", "quarter")
    return rows.withColumn(name, F.explode(F.sequence(first, last, F.expr("interval 3 months"))))


def _spans_met(spans: DataFrame, old: DataFrame, order: list[Column], keep: Column) -> DataFrame:
    """For each of ``spans`` (key and dates) the best of the ``old`` rows (same columns, ``o_`` before them) that share
    days with it. Spans and rows meet in the first quarter that both touch; both are distinct date ranges of a key, so
    what meets is bounded by the calendar."""
    o = _quarters(old).select(*[F.col(c).alias(f"o_{c}") for c in [*old.columns, "quarter"]])
    first = F.trunc(F.greatest("valid_from", "o_valid_from"), "quarter")
    on = (F.col("rate_key") == F.col("o_rate_key")) & (F.col("quarter") == F.col("o_quarter")) & (F.col("quarter") == first)
    met = _quarters(spans).join(o, on & overlaps("valid_from", "valid_to", "o_valid_from", "o_valid_to"))
    days = overlap_days("valid_from", "valid_to", "o_valid_from", "o_valid_to")
    best = F.max_by(keep, F.struct(*order[:1], days.alias("days"), *order[1:]))
    return met.groupBy("rate_key", "valid_from", "valid_to").agg(best.alias("prev"))


def covered_lines(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """Key, dates and terms of the incoming lines whose days one live rate with equal terms covers. A rate that covers a
    line covers its first day, so lines look in one quarter each."""
    by = ["rate_key", *TERMS, "valid_from", "valid_to"]
    plain = {t: F.coalesce(F.col(t).cast("string"), F.lit("")).alias(f"k_{t}") for t in TERMS}
    keys = [f"k_{t}" for t in TERMS]
    asks = incoming.select(*by).distinct().select("*", *plain.values(), F.trunc("valid_from", "quarter").alias("quarter"))
    live = library.filter("status = 'active'").select(*by).distinct().select("rate_key", *plain.values(), "valid_from", "valid_to")
    live = _quarters(live).withColumnsRenamed({"valid_from": "o_from", "valid_to": "o_to"})
    found = asks.join(live, ["rate_key", *keys, "quarter"]).filter((F.col("o_from") <= F.col("valid_from")) & (F.col("o_to") >= F.col("valid_to")))
    return found.select(*by).distinct()


def previous_rates(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """Key, dates and season of incoming lines with the earlier rate they are compared with: ``prev`` (id and terms) and
    ``rule``: 3 the one they share most days with (live first), 2 the latest of the same season that ended before, 1 the
    one that shares most days a year on. Each rule looks at the newest row per date range only, by an interval join in
    quarters (3, 1) or as of the line's first day (2)."""
    payload = F.struct("id", *TERMS).alias("row")
    lib = library.select("rate_key", "valid_from", "valid_to", "season", "status", "approval_seq", "id", payload)
    latest = [F.col("approval_seq"), F.col("id")]
    spans = incoming.select("rate_key", "valid_from", "valid_to", "season").distinct()
    bare = spans.select("rate_key", "valid_from", "valid_to").distinct()
    live = (F.col("o_status") == "active").cast("int").alias("live")
    newest = [F.col("o_approval_seq").alias("seq"), F.col("o_id").alias("no")]
    shared = _spans_met(bare, first_by(lib, ["rate_key", "valid_from", "valid_to", "status"], latest, latest=True), [live, *newest], F.col("o_row"))

    rest = spans.join(shared, ["rate_key", "valid_from", "valid_to"], "left_anti")
    ends = first_by(lib.filter("season <> ''"), ["rate_key", "season", "valid_to"], latest, latest=True)
    nothing = F.lit(None)
    events = ends.select("rate_key", "season", F.col("valid_to").alias("day"), F.lit(1).alias("old"), F.struct("valid_to", "approval_seq", "id", "row").alias("v"))
    asked = rest.filter("season <> ''").select("rate_key", "season", F.col("valid_from").alias("day")).distinct()
    events = events.unionByName(asked.withColumn("old", F.lit(0)).withColumn("v", nothing.cast(events.schema["v"].dataType)))
    before = Window.partitionBy("rate_key", "season").orderBy("day", "old").rowsBetween(Window.unboundedPreceding, -1)
    same_season = events.withColumn("last", F.max("v").over(before)).filter("old = 0 and last is not null")
    same_season = same_season.select("rate_key", "season", F.col("day").alias("valid_from"), F.col("last.row").alias("prev"))

    rest = rest.join(same_season, ["rate_key", "season", "valid_from"], "left_anti")
    moved = first_by(lib, ["rate_key", "valid_from", "valid_to"], latest, latest=True).withColumn("ended", F.col("valid_to"))
    moved = moved.withColumn("valid_from", year_later("valid_from")).withColumn("valid_to", year_later("valid_to"))
    ended = F.when(F.col("o_ended") < F.col("valid_from"), 1).otherwise(0).alias("ended")
    year = _spans_met(rest.select("rate_key", "valid_from", "valid_to").distinct(), moved, [ended, *newest], F.when(F.col("o_ended") < F.col("valid_from"), F.col("o_row"))).filter("prev is not null")

    named = spans.join(shared.withColumn("rule", F.lit(3)), ["rate_key", "valid_from", "valid_to"]).select(*spans.columns, "prev", "rule")
    second = spans.join(same_season.withColumn("rule", F.lit(2)), ["rate_key", "season", "valid_from"]).join(shared, ["rate_key", "valid_from", "valid_to"], "left_anti").select(*spans.columns, "prev", "rule")
    third = rest.join(year.withColumn("rule", F.lit(1)), ["rate_key", "valid_from", "valid_to"]).select(*spans.columns, "prev", "rule")
    return named.unionByName(second).unionByName(third)


def _earlier_in_key(inc: DataFrame, lib: DataFrame) -> DataFrame:
    """``inc`` with ``covered``, ``prev`` and ``rule`` as of ``covered_lines`` and ``previous_rates``, for keys of few rows:
    each line looks through the rates of its key, which lie in one array."""
    row = ["approval_seq", "id", *TERMS]
    rates = lib.groupBy("rate_key").agg(F.collect_list(F.struct("valid_from", "valid_to", "season", "status", *row)).alias("rates"))
    f, t = F.col("valid_from"), F.col("valid_to")
    dated = f.isNotNull() & t.isNotNull()

    def same(o: Column, c: str) -> Column:
        text = [F.coalesce(x.cast("string"), F.lit("")) for x in (o[c], F.col(c))]
        return text[0] == text[1]

    def covers(o: Column) -> Column:
        terms = (o["valid_from"] <= f) & (o["valid_to"] >= t) & (o["status"] == "active")
        for c in TERMS:
            terms = terms & same(o, c)
        return F.coalesce(terms, F.lit(False))

    def best(which, *order) -> Column:
        least = lambda o: (-o["amount"]).alias("least")  # noqa: E731 rows under one id: the lowest amount
        fields = lambda o: [*[x(o).alias(f"__{i}") for i, x in enumerate(order)], o["approval_seq"].alias("approval_seq"), o["id"].alias("id"), least(o), *[o[c].alias(c) for c in TERMS]]
        found = F.filter("rates", lambda o: F.coalesce(dated & which(o), F.lit(False)))
        return F.array_max(F.transform(found, lambda o: F.struct(*fields(o))))

    live = lambda o: (o["status"] == "active").cast("int")
    moved = lambda o: (f, t, year_later(o["valid_from"]), year_later(o["valid_to"]))
    shared = best(lambda o: overlaps(f, t, o["valid_from"], o["valid_to"]), live, lambda o: overlap_days(f, t, o["valid_from"], o["valid_to"]))
    season = best(lambda o: (F.col("season") != "") & (o["season"] == F.col("season")) & (o["valid_to"].isNull() | (o["valid_to"] < f)), lambda o: o["valid_to"])
    again = best(lambda o: (o["valid_to"] < f) & overlaps(*moved(o)), lambda o: overlap_days(*moved(o)))
    j = inc.join(rates, "rate_key", "left").withColumns({"covered": F.exists("rates", covers), "__3": shared})
    j = j.withColumn("__2", F.when(F.col("__3").isNull(), season))
    j = j.withColumn("__1", F.when(F.col("__3").isNull() & F.col("__2").isNull(), again))
    prev = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), F.struct(*[F.col(f"__{n}.{c}").alias(c) for c in ["id", *TERMS]])) for n in (3, 2, 1)])
    rule = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), n) for n in (3, 2, 1)])
    return j.withColumns({"prev": prev, "rule": rule}).drop("rates", "__3", "__2", "__1")


def _earlier_in_quarters(inc: DataFrame, lib: DataFrame) -> DataFrame:
    """The same for keys of any size: date ranges of a key meet in quarters."""
    covered = covered_lines(inc, lib).withColumn("covered", F.lit(True))
    prev = previous_rates(inc, lib)
    k = inc.alias("k")

    def equal(columns: list[str]) -> Column:
        on = F.lit(True)
        for c in columns:
            on = on & (F.col(f"k.{c}").eqNullSafe(F.col(f"b.{c}")) if c in TERMS else F.col(f"k.{c}") == F.col(f"b.{c}"))
        return on

    j = k.join(covered.alias("b"), equal(["rate_key", "valid_from", "valid_to", *TERMS]), "left").select("k.*", "b.covered").alias("k")
    return j.join(prev.alias("b"), equal(["rate_key", "valid_from", "valid_to", "season"]), "left").select("k.*", "b.prev", "b.rule")


def classify(incoming: DataFrame, library: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """What each line of a waiting sheet would change. Of ``library`` only the rows of ``documents`` (document_id; all, if
    missing) count: they are picked among the rates of the incoming keys. Rates of other keys are dropped before anything is
    moved, but for a few. Lines and rates of a key meet in one place; keys with more than ``FEW`` of them are cut by
    quarters.

    same: a live rate with the same terms already covers its dates. Otherwise the line is compared with one earlier
    rate: the one it overlaps (live first, most days), else the latest of the same season that ended before it, else
    the one that covers its dates a year earlier.
    """
    season = name_key("season_name")
    inc = stage(keyed(incoming).withColumn("season", season))
    lib = maybe_in(keyed(library), inc, ["rate_key"])
    size = inc.select("rate_key").unionByName(lib.select("rate_key")).groupBy(F.xxhash64("rate_key").alias("k")).count()
    many = stage(size.filter(F.col("count") > FEW).select("k"))
    if documents is not None:
        lib = lib.join(documents, "document_id", "left_semi")
    lib = lib.withColumn("season", season).select("rate_key", "valid_from", "valid_to", "season", "status", "approval_seq", "id", *TERMS)
    if many.isEmpty():
        j = _earlier_in_key(inc, lib)
    else:
        inc, lib = (x.withColumn("k", F.xxhash64("rate_key")) for x in (inc, lib))
        few = _earlier_in_key(*(maybe_in(x, many, ["k"], rest=True).drop("k") for x in (inc, lib)))
        asked = maybe_in(inc, many, ["k"]).drop("k")
        had = maybe_in(lib, many, ["k"]).drop("k").join(asked.select("rate_key").distinct(), "rate_key", "left_semi")
        j = few.unionByName(_earlier_in_quarters(stage(asked), stage(had)))
    same_terms = F.lit(True)
    for t in TERMS:
        same_terms = same_terms & F.col(t).eqNullSafe(F.col(f"prev.{t}"))
    kind = (
        F.when(F.col("covered"), "same")
        .when(F.col("rule").isNull(), "new")
        .when(F.col("rule") < 3, "new_season")
        .when(same_terms, "extended")
        .when(F.col("amount") > F.col("prev.amount"), "up")
        .otherwise("down")
    )
    known = F.col("rule").isNotNull() & ~F.coalesce("covered", F.lit(False))
    return j.select(
        *incoming.columns,
        "rate_key",
        kind.alias("change"),
        F.when(known, F.element_at(F.array(F.lit("a year earlier"), F.lit("earlier season"), F.lit("same dates")), F.col("rule"))).alias("compared_with"),
        F.when(known, F.col("prev.id")).alias("previous_rate_id"),
        F.when(known, F.col("prev.amount")).alias("old_amount"),
        F.when(known, pct_change("prev.amount", "amount")).alias("change_pct"),
    )


def trim(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """Live rates after new ones took over their dates. A rate keeps its id on its first remaining stretch, further
    stretches are pieces 1, 2, ... of it, and one with nothing left is superseded with its dates unchanged. The dates
    taken from a key are joined to disjoint stretches first, so a rate meets one short list."""
    new = keyed(incoming).select("rate_key", "valid_from", "valid_to").distinct()
    w = Window.partitionBy("rate_key").orderBy("valid_from", "valid_to").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.max("valid_to").over(w) < F.date_sub("valid_from", 1), F.lit(True))
    upto = Window.partitionBy("rate_key").orderBy("valid_from", "valid_to")
    taken = new.withColumn("__new", apart.cast("int")).withColumn("__run", F.sum("__new").over(upto)).groupBy("rate_key", "__run").agg(F.min("valid_from").alias("cut_from"), F.max("valid_to").alias("cut_to"))
    taken = taken.groupBy("rate_key").agg(F.array_sort(F.collect_list(F.struct("cut_from", "cut_to"))).alias("taken"))
    live = keyed(library).filter("status = 'active'")
    taken = stage(taken)
    # rates of keys that nothing was taken from are not moved
    rest = maybe_in(live, taken, ["rate_key"], rest=True).withColumn("taken", F.lit(None).cast(taken.schema["taken"].dataType))
    live = maybe_in(live, taken, ["rate_key"]).join(taken, "rate_key", "left").unionByName(rest)
    cuts = F.filter("taken", lambda c: overlaps("valid_from", "valid_to", c["cut_from"], c["cut_to"]))
    j = live.withColumn("cuts", F.when(F.size(cuts) > 0, cuts))
    # the stretch before each cut, and the one after the last
    starts = F.concat(F.array("valid_from"), F.transform("cuts", lambda c: F.date_add(c["cut_to"], 1)))
    ends = F.concat(F.transform("cuts", lambda c: F.date_sub(c["cut_from"], 1)), F.array("valid_to"))
    left = F.filter(F.arrays_zip(starts.alias("f"), ends.alias("t")), lambda p: p["f"] <= p["t"])
    pieces = F.when(F.col("cuts").isNull(), F.array(F.struct(F.col("valid_from").alias("f"), F.col("valid_to").alias("t")))).otherwise(left)
    gone = F.size("pieces") == 0
    out = j.withColumn("pieces", pieces).withColumn("gone", gone)
    own = F.array(F.struct(F.col("valid_from").alias("f"), F.col("valid_to").alias("t")))
    out = out.select("*", F.posexplode(F.when(F.col("gone"), own).otherwise(F.col("pieces"))).alias("piece", "p"))
    return out.select(
        "id", "piece", "rate_key", *TERMS, F.col("p.f").alias("valid_from"), F.col("p.t").alias("valid_to"),
        F.when(F.col("gone"), "superseded").otherwise("active").alias("status"),
        F.col("cuts").isNotNull().alias("touched"),
    )


def surcharge_changes(incoming: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what happens to each incoming surcharge, the library's surcharges with their new status)."""
    def ident(df):
        return df.withColumn(
            "skey", F.concat_ws("|", F.col("hotel_id").cast("string"), "kind", name_key("name"), name_key("room_type"))
        )

    inc, lib = ident(incoming), ident(library)
    live = lib.filter("status = 'active'").select("skey", "date_from", "date_to", "amount").distinct().alias("o")
    exact = (
        (F.col("n.skey") == F.col("o.skey")) & (F.col("n.date_from") == F.col("o.date_from"))
        & (F.col("n.date_to") == F.col("o.date_to")) & F.col("n.amount").eqNullSafe(F.col("o.amount"))
    )
    same = inc.alias("n").join(live, exact, "left_semi").withColumn("action", F.lit("same"))
    fresh = inc.alias("n").join(live, exact, "left_anti").withColumn("action", F.lit("new"))
    spans = fresh.select("skey", "date_from", "date_to").distinct().alias("n")
    over = (F.col("l.skey") == F.col("n.skey")) & (F.col("l.date_from") <= F.col("n.date_to")) & (F.col("n.date_from") <= F.col("l.date_to"))
    act = lib.filter("status = 'active'").alias("l")
    hit = act.join(spans, over, "left_semi").withColumn("status", F.lit("superseded"))
    rest = act.join(spans, over, "left_anti")
    after = hit.unionByName(rest).unionByName(lib.filter("status <> 'active'"))
    return same.unionByName(fresh).drop("skey"), after.drop("skey")


def change_summary(changes: DataFrame) -> DataFrame:
    """Counts per kind and the average move, per document."""
    kinds = ["new", "up", "down", "same", "extended", "new_season"]
    moved = F.when(F.col("change").isin("up", "down", "new_season"), F.col("change_pct"))
    return changes.groupBy("document_id").agg(
        *[F.count_if(F.col("change") == k).alias(k) for k in kinds],
        F.round(F.sum(moved) / F.nullif(F.count(moved), F.lit(0)), 1).alias("avg_change_pct"),
    )


def change_rank() -> Column:
    order = F.array(*[F.lit(k) for k in ("up", "down", "new_season", "extended", "new", "same")])
    return F.array_position(order, F.col("change"))
