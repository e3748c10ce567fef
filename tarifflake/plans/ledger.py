"""Library maintenance over all sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grouping import maybe_in
from ..operators import ledger, ownership, search, services
from .registry import query
from .scalars import DOW_SQL, KEY_SQL, pct_sql

RK = ("concat_ws('|', cast(room_type_id as varchar), meal_plan, occupancy, coalesce(weekdays, '-'), "
      "coalesce(cast(is_net as varchar), '-'))")
_REPEATS = "len(list_filter(f.kept, lambda o: o.a = x.amount and o.f <= x.valid_to and x.valid_from <= o.t)) > 0"
_PACKED = "struct_pack(no := x.line_no, a := x.amount, f := x.valid_from, t := x.valid_to)"
# a sheet's lines for a key and currency one after the other, with what was kept so far (the text starts in a recursive WITH)
SHEET = f"""
 sheet_x as (select *, {RK} as rate_key, row_number() over (partition by document_id, {RK}, currency order by line_no) as i from b_line),
 sheet_fold as (select x.document_id, x.rate_key, x.currency, x.i, true as ok, [{_PACKED}] as kept from sheet_x x where i = 1
   union all select x.document_id, x.rate_key, x.currency, x.i, not {_REPEATS}, case when {_REPEATS} then f.kept else list_append(f.kept, {_PACKED}) end
   from sheet_fold f join sheet_x x on x.document_id = f.document_id and x.rate_key = f.rate_key and x.currency = f.currency and x.i = f.i + 1)
"""
LOADED = f"""{SHEET},
 loaded as (select x.* exclude (i) from sheet_x x join sheet_fold f on x.document_id = f.document_id and x.rate_key = f.rate_key and x.currency = f.currency and x.i = f.i where f.ok)
"""
_TERMS = "amount, currency, basis, taxes_included"
LIVE = f"""{LOADED},
 edges as (select rate_key, valid_from as b from loaded union select rate_key, valid_to + 1 from loaded),
 seg as (select rate_key, b as f, lead(b) over (partition by rate_key order by b) - 1 as t from edges),
 cov as (select seg.rate_key, f, t, room_type_id, meal_plan, occupancy, weekdays, is_net, {_TERMS}
         from seg join loaded inc on inc.rate_key = seg.rate_key and seg.f between inc.valid_from and inc.valid_to where t is not null
         qualify rank() over (partition by seg.rate_key, f order by approval_seq desc) = 1),
 mark as (select *, case when lag(t) over (partition by rate_key, {_TERMS} order by f) = f - 1 then 0 else 1 end as s from cov),
 run as (select *, sum(s) over (partition by rate_key, {_TERMS} order by f) as g from mark),
 live as (select room_type_id, meal_plan, occupancy, weekdays, is_net, {_TERMS}, min(f) as valid_from, max(t) as valid_to
          from run group by rate_key, g, room_type_id, meal_plan, occupancy, weekdays, is_net, {_TERMS})
"""
# every line in turn with the lines that have written so far; then who took each day, and the rows as they stood
_WRITE = "struct_pack(seq := k.approval_seq, f := k.valid_from, t := k.valid_to, terms := (k.amount, k.currency, k.basis, coalesce(cast(k.taxes_included as varchar), '-')))"
EXACT = f"""{LOADED},
 kl as (select *, concat_ws('-', cast(document_id as varchar), cast(line_no as varchar)) as id, {KEY_SQL.format("coalesce(season_name, '')")} as season,
   row_number() over (partition by rate_key order by approval_seq, line_no) as n from loaded),
 kfold as (select rate_key, n, false as same, [{_WRITE}] as w from kl k where n = 1
   union all select rate_key, n, same, case when same then w else list_append(w, line) end from (
     select rate_key, n, w, line, newest is distinct from seq and len(list_filter(met, lambda o: o.seq = newest and o.f <= line.f and o.t >= line.t and o.terms = line.terms)) > 0 as same
     from (select *, line.seq as seq, list_max(list_transform(met, lambda o: o.seq)) as newest
       from (select k.rate_key, k.n, f.w, {_WRITE} as line, list_filter(f.w, lambda o: o.f <= k.valid_to and k.valid_from <= o.t) as met
             from kfold f join kl k on k.rate_key = f.rate_key and k.n = f.n + 1)))),
 wr as (select kl.* from kl join kfold using (rate_key, n) where not same),
 own as (select id, rate_key, cast(unnest(generate_series(valid_from, valid_to, interval 1 day)) as date) as d from wr),
 lost as (select id, d, min(n) as taken from (
   select o.id, w.n, cast(unnest(generate_series(greatest(o.valid_from, w.valid_from), least(o.valid_to, w.valid_to), interval 1 day)) as date) as d
   from wr o join wr w on w.rate_key = o.rate_key and w.approval_seq > o.approval_seq and w.valid_from <= o.valid_to and o.valid_from <= w.valid_to) group by 1, 2),
 day as (select own.*, taken from own left join lost using (id, d)),
 day_run as (select *, sum(s) over (partition by id order by d) as g from (select *, case when lag(taken) over w is distinct from taken or row_number() over w = 1 then 1 else 0 end as s from day window w as (partition by id order by d))),
 taken_run as (select id, rate_key, g, min(d) as f, max(d) as t, min(taken) as taken from day_run group by 1, 2, 3),
 held as (select *, taken is null or ((before_g is null or before_taken < taken) and (after_g is null or after_taken < taken)) as is_row from (
   select *, lag(g) over w as before_g, lag(taken) over w as before_taken, lead(g) over w as after_g, lead(taken) over w as after_taken from taken_run window w as (partition by id order by f))),
 stood as (select id, o_id, n, o_n, live, min(f) as f, max(t) as t from (
   select *, sum(s) over (partition by id, o_id order by f) as g from (
     select *, case when live and lag(live) over w and lag(t) over w = f - 1 then 0 else 1 end as s from (
       select x.id, o.id as o_id, x.n, o.n as o_n, h.f, h.t, h.is_row, h.taken is null or h.taken >= x.n as live
       from wr x join wr o on o.rate_key = x.rate_key and o.approval_seq < x.approval_seq join held h on h.id = o.id) where live or is_row
     window w as (partition by id, o_id order by f))) group by id, o_id, n, o_n, live, g),
 ranked as (select s.*, x.valid_to, x.valid_from, x.season = o.season and x.season <> '' as one_season,
   greatest(0, least(s.t, x.valid_to) - greatest(s.f, x.valid_from) + 1) as shared,
   greatest(0, least(cast(s.t + interval 1 year as date), x.valid_to) - greatest(cast(s.f + interval 1 year as date), x.valid_from) + 1) as again
   from stood s join wr x on x.id = s.id join wr o on o.id = s.o_id),
 follows as (select * from (select *, case when shared > 0 then 3 when t < valid_from and one_season then 2 when t < valid_from and again > 0 then 1 end as rule from ranked) where rule is not null
   qualify row_number() over (partition by id order by rule desc, case when rule = 3 then live else false end desc, case rule when 3 then shared when 2 then t - date '1970-01-01' else again end desc, o_n desc) = 1),
 told as (select x.*, p.o_id as previous_rate_id, case when p.rule is not null then {pct_sql('o.amount', 'x.amount')} end as change_pct,
   case when p.rule is null then 'new' when p.rule < 3 then 'new_season' when (x.amount, x.currency, x.basis, coalesce(cast(x.taxes_included as varchar), '-')) = (o.amount, o.currency, o.basis, coalesce(cast(o.taxes_included as varchar), '-')) then 'extended'
     when x.amount > o.amount then 'up' else 'down' end as change
   from wr x left join follows p on p.id = x.id left join wr o on o.id = p.o_id),
 pieces as (select h.*, row_number() over (partition by h.id order by h.f) - 1 as piece from held h where is_row)
"""
LIVE_COLS = "room_type_id, meal_plan, occupancy, weekdays, is_net, cast(amount as double) as amount, currency, basis, taxes_included, cast(valid_from as varchar) as valid_from, cast(valid_to as varchar) as valid_to"


@query("c7a_live_rates", f"with recursive {LIVE} select {LIVE_COLS} from live", ["b_line"])
def c7a(lib):
    return ledger.live_rates(lib.b_line)


_MET = "len(list_filter(d.kept, lambda o: o.no < x.line_no and o.f <= x.valid_to and x.valid_from <= o.t and o.a {} x.amount)) > 0"


@query(
    "w04_sheet_duplicates",
    f"""with recursive {SHEET},
     done as (select * from sheet_fold qualify row_number() over (partition by document_id, rate_key, currency order by i desc) = 1)
     select * from (select x.document_id, x.line_no, {_MET.format('=')} as dup, {_MET.format('<>')} as conflict
       from sheet_x x join done d on d.document_id = x.document_id and d.rate_key = x.rate_key and d.currency = x.currency) where dup or conflict""",
    ["b_line"],
)
def w04(lib):
    """Lines that repeat a kept line of their sheet, and lines that contradict one."""
    return ledger.sheet_findings(lib.b_line)


CHG = f"""{LOADED},
 lib as (select r.*, {RK.replace('room_type_id', 'r.room_type_id')} as rate_key from b_rate r join b_document d on d.id = r.document_id where d.status = 'approved'),
 inc as (select x.* from loaded x join b_document d on d.id = x.document_id where d.status = 'needs_review'),
 cand as (select n.document_id, n.line_no, o.id, o.amount as old_amount,
    o.amount = n.amount and o.currency = n.currency and o.basis = n.basis and o.taxes_included is not distinct from n.taxes_included as same_terms,
    o.status = 'active' as live, o.approval_seq as seq, o.valid_from <= n.valid_from and o.valid_to >= n.valid_to as contains,
    greatest(0, least(o.valid_to, n.valid_to) - greatest(o.valid_from, n.valid_from) + 1) as ov,
    greatest(0, least(cast(o.valid_to + interval 1 year as date), n.valid_to) - greatest(cast(o.valid_from + interval 1 year as date), n.valid_from) + 1) as ly,
    o.valid_to < n.valid_from as ended, o.valid_to as old_to, o.season_name = n.season_name as one_season
   from inc n join lib o on o.rate_key = n.rate_key),
 cov as (select distinct document_id, line_no from cand where live and same_terms and contains),
 ranked as (select *, case when ov > 0 then 3 when ended and one_season then 2 when ended and ly > 0 then 1 end as rule from cand),
 prev as (select * from ranked where rule is not null
   qualify row_number() over (partition by document_id, line_no order by rule desc, case when rule = 3 then live else false end desc,
     case rule when 3 then ov when 2 then old_to - date '1970-01-01' else ly end desc, seq desc, id desc) = 1),
 chg as (select n.document_id, n.line_no, n.rate_key, n.amount, n.valid_from, n.valid_to,
    case when c.line_no is not null then 'same' when p.rule is null then 'new' when p.rule < 3 then 'new_season'
         when p.same_terms then 'extended' when n.amount > p.old_amount then 'up' else 'down' end as change,
    case when c.line_no is null then p.id end as previous_rate_id,
    case when c.line_no is null then case p.rule when 3 then 'same dates' when 2 then 'earlier season' when 1 then 'a year earlier' end end as compared_with,
    case when c.line_no is null then p.old_amount end as old_amount,
    case when c.line_no is null then {pct_sql('p.old_amount', 'n.amount')} end as change_pct
   from inc n left join cov c on c.document_id = n.document_id and c.line_no = n.line_no
   left join prev p on p.document_id = n.document_id and p.line_no = n.line_no)
"""
CHG_VIEWS = ["b_rate", "b_document"]


def _approved(lib):
    return lib.b_document.filter("status = 'approved'").select(F.col("id").alias("document_id"))


def _waiting(lib):
    todo = lib.b_document.filter("status = 'needs_review'").select(F.col("id").alias("document_id"))
    lines = lib.b_line.select("document_id", "line_no", *ledger.KEY, *ledger.TERMS, "season_name", "valid_from", "valid_to")
    return ledger.loaded_lines(maybe_in(lines, todo, ["document_id"]).join(todo, "document_id", "left_semi")).drop("rate_key")


def changes(lib):
    return ledger.classify(_waiting(lib), lib.b_rate, _approved(lib))


@query("j10_covering_rate", f"with recursive {CHG} select document_id, line_no from cov", CHG_VIEWS)
def j10(lib):
    return changes(lib).filter("change = 'same'").select("document_id", "line_no")


@query("j11_previous_rate", f"with recursive {CHG} select document_id, line_no, previous_rate_id, compared_with from chg where compared_with is not null", CHG_VIEWS)
def j11(lib):
    return changes(lib).filter("compared_with is not null").select("document_id", "line_no", "previous_rate_id", "compared_with")


@query(
    "c05_dated_rate_load",
    f"with recursive {CHG} select document_id, line_no, rate_key, cast(amount as double) as amount, change, compared_with, previous_rate_id, cast(old_amount as double) as old_amount, change_pct from chg",
    CHG_VIEWS,
)
def c05(lib):
    return changes(lib).select("document_id", "line_no", "rate_key", "amount", "change", "compared_with", "previous_rate_id", "old_amount", "change_pct")


@query(
    "c06_trim_overlaps",
    f"""with recursive {CHG},
     newr as (select distinct rate_key, valid_from, valid_to from chg where change <> 'same'),
     e as (select rate_key, valid_from as b from newr union select rate_key, valid_to + 1 from newr),
     s as (select rate_key, b as f, lead(b) over (partition by rate_key order by b) - 1 as t from e),
     c as (select s.* from s where t is not null and exists (select 1 from newr where newr.rate_key = s.rate_key and s.f between newr.valid_from and newr.valid_to)),
     m as (select *, case when lag(t) over (partition by rate_key order by f) = f - 1 then 0 else 1 end as st from c),
     g as (select *, sum(st) over (partition by rate_key order by f) as grp from m),
     isl as (select rate_key, min(f) as cf, max(t) as ct from g group by rate_key, grp),
     act as (select * from lib where status = 'active'),
     hits as (select a.id, a.valid_from, a.valid_to, cf, ct, row_number() over (partition by a.id order by cf) as n, count(*) over (partition by a.id) as k
              from act a join isl on isl.rate_key = a.rate_key and a.valid_from <= ct and cf <= a.valid_to),
     gaps as (select id, coalesce(lag(ct) over (partition by id order by cf) + 1, valid_from) as f, cf - 1 as t from hits
              union all select id, ct + 1, valid_to from hits where n = k),
     pieces as (select id, f, t, row_number() over (partition by id order by f) - 1 as piece from gaps where f <= t)
     select a.id, coalesce(p.piece, 0) as piece, cast(coalesce(p.f, a.valid_from) as varchar) as valid_from, cast(coalesce(p.t, a.valid_to) as varchar) as valid_to,
       case when h.id is not null and p.id is null then 'superseded' else 'active' end as status, h.id is not null as touched
     from act a left join (select distinct id from hits) h on h.id = a.id left join pieces p on p.id = a.id""",
    CHG_VIEWS,
)
def c06(lib):
    new = changes(lib).filter("change <> 'same'")
    library = lib.b_rate.join(_approved(lib), "document_id", "left_semi")
    return ledger.trim(library, new).select("id", "piece", "valid_from", "valid_to", "status", "touched")


_SUR = """
 x as (select *, concat_ws('|', cast(hotel_id as varchar), kind, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), coalesce(lower(room_type), '')) as k from b_surcharge),
 inc as (select x.* from x join b_document d on d.id = x.document_id where d.status = 'needs_review'),
 lib as (select x.* from x join b_document d on d.id = x.document_id where d.status = 'approved'),
 act as (select * from inc n where exists (select 1 from lib o where o.status = 'active' and o.k = n.k and o.date_from = n.date_from and o.date_to = n.date_to and o.amount is not distinct from n.amount)),
 fresh as (select * from inc n where not exists (select 1 from lib o where o.status = 'active' and o.k = n.k and o.date_from = n.date_from and o.date_to = n.date_to and o.amount is not distinct from n.amount))
"""


@query(
    "c08_surcharge_load",
    f"""with {_SUR} select 'incoming' as side, document_id, line_no, 'same' as state from act union all select 'incoming', document_id, line_no, 'new' from fresh
     union all select 'library', document_id, line_no, case when status = 'active' and exists (select 1 from fresh n where n.k = lib.k and n.date_from <= lib.date_to and lib.date_from <= n.date_to)
       then 'superseded' else status end from lib""",
    ["b_surcharge", "b_document"],
)
def c08(lib):
    docs = lib.b_document.select(F.col("id").alias("document_id"), F.col("status").alias("doc_status"))
    s = lib.b_surcharge.join(docs, "document_id")
    inc, after = ledger.surcharge_changes(s.filter("doc_status = 'needs_review'"), s.filter("doc_status = 'approved'"))
    a = inc.select(F.lit("incoming").alias("side"), "document_id", "line_no", F.col("action").alias("state"))
    return a.unionByName(after.select(F.lit("library").alias("side"), "document_id", "line_no", F.col("status").alias("state")))


SUMMARY = f"""select document_id, count(*) filter (change = 'new') as "new", count(*) filter (change = 'up') as up, count(*) filter (change = 'down') as down,
  count(*) filter (change = 'same') as same, count(*) filter (change = 'extended') as extended, count(*) filter (change = 'new_season') as new_season,
  (case when sum(m) >= 0 then 1 else -1 end * ((abs(sum(cast(m * 10 as bigint))) * 2 + count(m)) // nullif(2 * count(m), 0))) / 10.0 as avg_change_pct
  from (select *, case when change in ('up', 'down', 'new_season') then change_pct end as m from chg) group by document_id"""


@query("a11_change_summary", f"with recursive {CHG} {SUMMARY}", CHG_VIEWS)
def a11(lib):
    return ledger.change_summary(changes(lib))


@query(
    "c11_preview_changes",
    f"with recursive {CHG} select c.document_id, d.filename, line_no, change, cast(amount as double) as amount, cast(old_amount as double) as old_amount, change_pct from chg c join b_document d on d.id = c.document_id where change <> 'same'",
    CHG_VIEWS,
)
def c11(lib):
    """What approving each waiting sheet would do. Nothing is written: the load is a pure function of its inputs."""
    names = lib.b_document.select(F.col("id").alias("document_id"), "filename")
    return changes(lib).filter("change <> 'same'").join(names, "document_id").select("document_id", "filename", "line_no", "change", "amount", "old_amount", "change_pct")


@query(
    "t03_change_items_sorted",
    f"""with recursive {CHG} select document_id, line_no, change, row_number() over (partition by document_id order by list_position(['up','down','new_season','extended','new','same'], change),
        abs(coalesce(change_pct, 0)) desc, line_no) as rank from chg""",
    CHG_VIEWS,
)
def t03(lib):
    """Biggest moves first within each sheet's report (a sheet's lines are one report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy(ledger.change_rank(), F.abs(F.coalesce("change_pct", F.lit(0))).desc(), "line_no")
    return changes(lib).select("document_id", "line_no", "change", F.row_number().over(w).alias("rank"))


SINCE = "date '1998-01-01'"


@query(
    "a12_recent_changes",
    f"""with recursive {CHG}, r as (select chg.* from chg join b_document d on d.id = chg.document_id where d.approved_on >= {SINCE})
      select count(distinct document_id) as documents, count(*) filter (mv > 0) as up, count(*) filter (mv < 0) as down,
        round(sum(mv) filter (mv > 0) / count(*) filter (mv > 0), 1) as avg_up_pct, round(sum(mv) filter (mv < 0) / count(*) filter (mv < 0), 1) as avg_down_pct,
        count(*) filter (change = 'new') as new_rates, count(*) filter (change = 'same') as unchanged
      from (select *, case when change in ('up', 'down', 'new_season') then cast(change_pct as decimal(12,1)) end as mv from r)""",
    CHG_VIEWS,
)
def a12(lib):
    import datetime as dt

    docs = lib.b_document.filter(F.col("approved_on") >= F.lit(dt.date(1998, 1, 1))).select(F.col("id").alias("document_id"))
    return recent_changes(changes(lib).join(docs, "document_id", "left_semi"))


def recent_changes(c):
    moved = F.when(F.col("change").isin("up", "down", "new_season"), F.col("change_pct"))
    up, down = F.when(moved > 0, moved), F.when(moved < 0, moved)
    return c.agg(
        F.countDistinct("document_id").alias("documents"),
        F.count(up).alias("up"),
        F.count(down).alias("down"),
        F.round(F.sum(up) / F.nullif(F.count(up), F.lit(0)), 1).alias("avg_up_pct"),
        F.round(F.sum(down) / F.nullif(F.count(down), F.lit(0)), 1).alias("avg_down_pct"),
        F.count_if(F.col("change") == "new").alias("new_rates"),
        F.count_if(F.col("change") == "same").alias("unchanged"),
    )


# every case is a copy of the touched keys' lines: 0 is the library as it is, any other number the library without that document
_CASES = """newest as (select max_by(id, approval_seq) as undone from b_document where status = 'approved' group by supplier_id),
  cases as (select l.* replace (u.undone * 100000000 + l.document_id as document_id, u.undone || '#' || l.meal_plan as meal_plan), u.undone, l.document_id as doc from (
      select distinct u.undone, {k} from b_line join newest u on u.undone = b_line.document_id union select distinct 0, {k} from b_line join newest u on u.undone = b_line.document_id) u
    join b_line l on {same} where l.document_id <> u.undone)"""
_KEYS = ["room_type_id", "meal_plan", "occupancy", "weekdays", "is_net"]
_CASES = _CASES.format(k=", ".join(f"{c} as k_{c}" for c in _KEYS), same=" and ".join(f"l.{c} is not distinct from u.k_{c}" for c in _KEYS))
UNDO = f"""{_CASES}, {EXACT.replace('from b_line', 'from cases')},
  rows as (select t.undone, t.doc, t.doc || '-' || t.line_no as root_id, split_part(p.rate_key, '#', 1) as room, p.rate_key, p.taken, p.f, p.t,
      replace(p.rate_key, '|' || t.undone || '#', '|') as key from pieces p join told t on t.id = p.id),
  refused as (select distinct u.undone as document_id, 'trips use packages of this document' as reason from newest u join b_package p on p.document_id = u.undone
      where p.id in (select ref_id from b_item where kind = 'package') or p.id in (select source_package_id from b_trip_day)),
  replaced as (select distinct doc as document_id from rows where undone = 0 and taken is not null and doc in (select undone from newest)),
  guards as (select * from refused union all select document_id, 'a later document replaced some of these rates' from replaced where document_id not in (select document_id from refused))"""
_UNDO_VIEWS = ["b_line", "b_document", "b_package", "b_item", "b_trip_day"]


def _undo_requests(lib):
    """The newest approved sheet of every supplier."""
    d = lib.b_document.filter("status = 'approved'").groupBy("supplier_id").agg(F.max_by("id", "approval_seq").alias("document_id"))
    return d.select("document_id")


@query(
    "c12_undo_outcome",
    f"""with recursive {UNDO} select u.undone as document_id, case when g.reason is null then 'undone' else 'refused' end as outcome, g.reason from newest u left join guards g on g.document_id = u.undone""",
    _UNDO_VIEWS,
)
def c12o(lib):
    """Whether each of these sheets can be taken out of the library again."""
    asked = _undo_requests(lib)
    _, now = ownership.undo(asked, lib.b_line)
    no = ownership.undo_refused(asked, now, lib.b_package, lib.b_item, lib.b_trip_day)
    return asked.join(no, "document_id", "left").select("document_id", F.when(F.col("reason").isNull(), "undone").otherwise("refused").alias("outcome"), "reason")


@query(
    "c12_undo_document",
    f"""with recursive {UNDO},
      before as (select r.key, r.root_id, case when taken is null then 'active' else 'superseded' end as status, r.f, r.t, k.undone from rows r join (select distinct undone, replace(rate_key, '|' || undone || '#', '|') as key from kl where undone > 0
          union select distinct u.undone, {RK} from b_line join newest u on u.undone = b_line.document_id) k on k.key = r.key where r.undone = 0),
      after as (select key, root_id, case when taken is null then 'active' else 'superseded' end as status, f, t, undone from rows where undone > 0),
      moved as (select *, 'removed' as action from (select * from before except all select * from after) union all select *, 'restored' from (select * from after except all select * from before))
      select undone as document_id, action, key as rate_key, root_id, status, cast(f as varchar) as valid_from, cast(t as varchar) as valid_to from moved where undone not in (select document_id from guards)""",
    _UNDO_VIEWS,
)
def c12(lib):
    """The rows that taking out each of these sheets removes and restores; sheets that cannot be taken out have none."""
    asked = _undo_requests(lib)
    changes, now = ownership.undo(asked, lib.b_line)
    no = ownership.undo_refused(asked, now, lib.b_package, lib.b_item, lib.b_trip_day)
    return changes.join(no, "document_id", "left_anti").select("document_id", "action", "rate_key", "root_id", "status", "valid_from", "valid_to")


@query(
    "c13_approval_gate",
    f"""with recursive {SHEET},
      bad as (select distinct x.document_id from sheet_x x join (select * from sheet_fold qualify row_number() over (partition by document_id, rate_key, currency order by i desc) = 1) d
        on d.document_id = x.document_id and d.rate_key = x.rate_key and d.currency = x.currency where {_MET.format('<>')})
      select id as document_id, case when id in (select document_id from bad) then 'needs_review' else 'approved' end as outcome from b_document where status = 'needs_review'""",
    ["b_line", "b_document"],
)
def c13(lib):
    """Sheets waiting for review are approved when no check found an error."""
    errors = w04(lib).filter("conflict").select("document_id").distinct().withColumn("bad", F.lit(True))
    d = lib.b_document.filter("status = 'needs_review'").select(F.col("id").alias("document_id"))
    return d.join(errors, "document_id", "left").select("document_id", F.when(F.col("bad"), "needs_review").otherwise("approved").alias("outcome"))


@query(
    "c16_search_hotel_rates",
    f"""with recursive {LOADED},
      asked as (select r.*, h.id as hotel_id, h.name as hotel_name, h.city as hotel_city, m.id as room_id from b_rate_request r join b_hotel h
          on (r.destination is null or lower(h.city) like '%' || lower(r.destination) || '%' or lower(h.destination) like '%' || lower(r.destination) || '%')
            and (r.hotel is null or {KEY_SQL.format('h.name')} like '%' || {KEY_SQL.format('r.hotel')} || '%') join b_room m on m.hotel_id = h.id),
      onday as (select distinct l.rate_key, d.on_date, l.room_type_id, l.meal_plan, l.occupancy, l.weekdays, l.is_net, l.amount, l.currency, l.basis, l.taxes_included
          from (select distinct on_date from b_rate_request) d join loaded l on d.on_date between l.valid_from and l.valid_to
          qualify rank() over (partition by l.rate_key, d.on_date order by l.approval_seq desc) = 1),
      hits as (select a.request_id, a.hotel_id, a.hotel_name as hotel, a.hotel_city as city, o.*, row_number() over (partition by a.request_id order by o.amount, o.room_type_id, o.currency, o.basis, o.meal_plan, o.occupancy, o.is_net nulls first, o.weekdays nulls first, o.taxes_included nulls first) as rank
          from asked a join onday o on o.room_type_id = a.room_id and o.on_date = a.on_date
          where (a.meal_plan is null or o.meal_plan = a.meal_plan) and (a.occupancy is null or o.occupancy = a.occupancy) and (a.max_amount is null or o.amount <= a.max_amount) and (not a.net_only or o.is_net)
            and (o.weekdays is null or list_contains(string_split(o.weekdays, ','), {DOW_SQL.format('o.on_date')})))
      select request_id, rank, room_type_id, hotel_id, hotel, city, meal_plan, occupancy, cast(amount as double) as amount, currency, is_net, weekdays from hits where rank <= 200""",
    ["b_line", "b_room", "b_hotel", "b_rate_request"],
)
def c16(lib):
    """The 200 cheapest rates for each request, on its day and in its place."""
    found = search.search_hotel_rates(lib.b_rate_request, lib.b_line, lib.b_room, lib.b_hotel)
    return found.select("request_id", "rank", "room_type_id", "hotel_id", "hotel", "city", "meal_plan", "occupancy", "amount", "currency", "is_net", "weekdays")


@query(
    "c7b_rate_ledger",
    f"""with recursive {EXACT} select p.rate_key, case when piece = 0 then p.id else p.id || '/' || piece end as id, case when p.taken is null then 'active' else 'superseded' end as status, t.document_id,
      cast(t.amount as double) as amount, t.currency, cast(p.f as varchar) as valid_from, cast(p.t as varchar) as valid_to, w.document_id as replaced_by, t.previous_rate_id, t.change_pct
      from pieces p join told t on t.id = p.id left join kl w on w.rate_key = p.rate_key and w.n = p.taken""",
    ["b_line"],
)
def c7b_rows(lib):
    """Every ledger row: live and superseded, with the sheet that closed it and its link to the earlier rate."""
    led, _ = ownership.rebuild(lib.b_line)
    return led.select("rate_key", "id", "status", "document_id", "amount", "currency", "valid_from", "valid_to", "replaced_by", "previous_rate_id", "change_pct")


@query(
    "c7b_rate_changes",
    f"""with recursive {EXACT} select id, document_id, change, previous_rate_id, change_pct from told
      union all select kl.id, kl.document_id, 'same', null, null from kl join kfold using (rate_key, n) where same""",
    ["b_line"],
)
def c7b_changes(lib):
    """What every line did when its sheet was approved."""
    _, told = ownership.rebuild(lib.b_line)
    return told.select("id", "document_id", "change", "previous_rate_id", "change_pct")


EXACT_LIVE = f"""with recursive {EXACT},
  rows as (select p.rate_key, {', '.join(f't.{c}' for c in _TERMS.split(', '))}, p.f, p.t from pieces p join told t on t.id = p.id where p.taken is null),
  joined as (select *, sum(s) over (partition by rate_key, {_TERMS} order by f) as g from (select *, case when lag(t) over (partition by rate_key, {_TERMS} order by f) = f - 1 then 0 else 1 end as s from rows))
  select rate_key, cast(amount as double) as amount, currency, basis, taxes_included, cast(min(f) as varchar) as valid_from, cast(max(t) as varchar) as valid_to from joined group by rate_key, {_TERMS}, g"""


@query("c7b_ledger_live_picture", EXACT_LIVE, ["b_line"])
def c7b(lib):
    """The ledger's live rates, neighbours with equal terms joined."""
    return ownership.live_picture(lib.b_line)


# service lines: names of one service differ by an s at the end at most, which is close enough
_SK = "concat_ws('|', cast(supplier_id as varchar), kind, coalesce(vehicle_type, '-'), basis)"
_SERVICE_LINES = f"""
 kl as (select *, {_SK} || '|' || name_key as rate_key, row_number() over (partition by cls order by approval_seq, line_no) as n from (
   select document_id, approval_seq, line_no, supplier_id, amount, currency, coalesce(cast(amount_max as varchar), '-') as basis, cast(null as boolean) as taxes_included, valid_from, valid_to, {KEY_SQL.format("coalesce(season_name, '')")} as season,
     concat_ws('-', cast(document_id as varchar), cast(line_no as varchar)) as id, {KEY_SQL.format('name')} as name_key, {_SK} as blk, {_SK} || '|' || regexp_replace({KEY_SQL.format('name')}, 's$', '') as cls from b_service_line)),
""".replace(f"select *, {_SK} || '|'", "select *, blk || '|'")
_SERVICE_FOLD = f"""
 kfold as (select cls, n, false as same, rate_key as cmp, [struct_pack(k := k.rate_key, c := k.rate_key, line := {_WRITE})] as w from kl k where n = 1
   union all select cls, n, same, cmp, case when same then w else list_append(w, struct_pack(k := rate_key, c := cmp, line := line)) end from (
     select cls, n, w, line, rate_key, cmp, newest is distinct from seq and len(list_filter(met, lambda o: o.k = cmp and o.line.seq = newest and o.line.f <= line.f and o.line.t >= line.t and o.line.terms = line.terms)) > 0 as same
     from (select *, line.seq as seq, list_max(list_transform(met, lambda o: o.line.seq)) as newest
       from (select *, list_filter(w, lambda o: (o.k = cmp or o.c = cmp) and o.line.f <= line.t and line.f <= o.line.t) as met
         from (select k.cls, k.n, k.rate_key, f.w, {_WRITE} as line, case when len(list_filter(f.w, lambda o: o.k = k.rate_key and o.line.seq < k.approval_seq)) > 0 then k.rate_key
                 else coalesce(list_filter(f.w, lambda o: o.k <> k.rate_key and o.line.seq < k.approval_seq)[1].k, k.rate_key) end as cmp
               from kfold f join kl k on k.cls = f.cls and k.n = f.n + 1))))),
 wr as (select kl.*, cmp from kl join kfold using (cls, n) where not same),
"""
_AFTER = EXACT[EXACT.index(" own as (select id"):]
_AFTER = _AFTER.replace("w.rate_key = o.rate_key and w.approval_seq > o.approval_seq", "o.cls = w.cls and (o.rate_key = w.rate_key or o.rate_key = w.cmp) and w.approval_seq > o.approval_seq").replace("o.rate_key = x.rate_key and o.approval_seq < x.approval_seq", "o.rate_key = x.cmp and o.approval_seq < x.approval_seq")
# what a sheet's own lines take from each other's calendars is nothing, and a line takes no days under its own name if it is compared with another
SERVICE = _SERVICE_LINES + _SERVICE_FOLD + _AFTER


@query(
    "c05_service_rate_load",
    f"""with recursive {SERVICE} select id, document_id, change, previous_rate_id, change_pct from told
      union all select kl.id, kl.document_id, 'same', null, null from kl join kfold using (cls, n) where same""",
    ["b_service_line"],
)
def c05s(lib):
    """What every service line did when its sheet was approved, names being recognised as they come."""
    _, told = services.rebuild(lib.b_service_line)
    return told.select("id", "document_id", "change", "previous_rate_id", "change_pct")


@query(
    "c07_service_ledger",
    f"""with recursive {SERVICE} select p.rate_key, case when piece = 0 then p.id else p.id || '/' || piece end as id, case when p.taken is null then 'active' else 'superseded' end as status, t.document_id, cast(t.amount as double) as amount,
      cast(p.f as varchar) as valid_from, cast(p.t as varchar) as valid_to, w.document_id as replaced_by, t.previous_rate_id from pieces p join told t on t.id = p.id left join kl w on w.cls = t.cls and w.n = p.taken""",
    ["b_service_line"],
)
def c07s(lib):
    """Every row of the service ledger, live and superseded."""
    led, _ = services.rebuild(lib.b_service_line)
    return led.select("rate_key", "id", "status", "document_id", "amount", "valid_from", "valid_to", "replaced_by", "previous_rate_id")
