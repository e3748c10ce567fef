"""The dated library: golden splits, and the ledger against the day-by-day picture."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarifflake.operators import history, ledger, ownership
from tarifflake.streaming import jobs

D = dt.date
SCHEMA = (
    "document_id long, approval_seq long, line_no long, room_type_id long, meal_plan string, occupancy string, weekdays string, is_net boolean, "
    "amount decimal(12,2), currency string, basis string, taxes_included boolean, season_name string, valid_from date, valid_to date"
)


def line(doc, amount, f, t, room=1, season=None):
    return (doc, doc, 1, room, "CP", "double", None, True, Decimal(amount), "INR", "per_room_per_night", False, season, f, t)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def crowd(spark):
    """Random sheets in which one key holds a third of all lines."""
    rnd = random.Random(7)
    rows = []
    for doc in range(1, 241):
        start = D(2026, 1, 1) + dt.timedelta(days=rnd.randrange(200))
        room = 1 if doc % 3 == 0 else rnd.randrange(2, 12)
        rows.append(line(doc, rnd.choice([1000, 2000, 3000]), start, start + dt.timedelta(days=rnd.randrange(60)), room, rnd.choice([None, "Peak", "Low"])))
    return rows


def newest_per_day(rows):
    days = {}
    for r in sorted(rows, key=lambda r: r[1]):
        for i in range((r[14] - r[13]).days + 1):
            days[(r[3], r[13] + dt.timedelta(days=i))] = r[8]
    return days


def by_day(rows):
    out = {}
    for room, amount, f, t in rows:
        for i in range((t - f).days + 1):
            key = (room, f + dt.timedelta(days=i))
            assert key not in out, "live rates of a key overlap"
            out[key] = amount
    return out


def test_sweep_is_newest_per_day(spark, crowd):
    live = ledger.live_rates(frame(spark, crowd)).select("room_type_id", "amount", "valid_from", "valid_to").collect()
    assert by_day([tuple(r) for r in live]) == newest_per_day(crowd)


def year_on(d):
    return d.replace(year=d.year + 1, day=28 if (d.month, d.day) == (2, 29) else d.day)


def plain_ledger(lines):
    """The rules line by line: (rows, what each line did)."""
    rows, did = [], {}
    terms = lambda r: tuple(r["x"][c] for c in (8, 9, 10, 11))
    for x in sorted(lines, key=lambda x: (x[1], x[2])):
        f, t = x[13], x[14]
        new = {"x": x, "f": f, "t": t, "status": "active", "by": None}
        days = lambda a, b: max(0, (min(b, t) - max(a, f)).days + 1)  # noqa: B023, E731
        same_key = [r for r in rows if r["x"][3:8] == x[3:8] and r["x"][0] != x[0]]
        over = [r for r in same_key if r["status"] == "active" and days(r["f"], r["t"])]
        if any(terms(r) == terms(new) and r["f"] <= f and r["t"] >= t for r in over):
            did[(x[0], x[2])] = ("same", None)
            continue
        order = lambda r: (r["x"][1], r["x"][2])
        met = [r for r in same_key if days(r["f"], r["t"])]
        ended = [r for r in same_key if r["t"] < f]
        season = [r for r in ended if x[12] and (r["x"][12] or "").lower() == x[12].lower()]
        again = [r for r in ended if days(year_on(r["f"]), year_on(r["t"]))]
        if met:
            prev = max(met, key=lambda r: (r["status"] == "active", days(r["f"], r["t"]), order(r)))
        elif season:
            prev = max(season, key=lambda r: (r["t"], order(r)))
        else:
            prev = max(again, key=lambda r: (days(year_on(r["f"]), year_on(r["t"])), order(r)), default=None)
        kind = "new" if prev is None else "new_season" if not met else "extended" if terms(prev) == terms(new) else "up" if x[8] > prev["x"][8] else "down"
        did[(x[0], x[2])] = (kind, None if prev is None else (prev["x"][0], prev["x"][2]))
        for r in over:
            before, after = r["f"] < f, r["t"] > t
            if before and after:
                rows.append({**r, "f": t + dt.timedelta(days=1)})
            if before:
                r["t"] = f - dt.timedelta(days=1)
            elif after:
                r["f"] = t + dt.timedelta(days=1)
            else:
                r["status"], r["by"] = "superseded", x[0]
        rows.append(new)
    return rows, did


def compare(spark, rows):
    lines = frame(spark, rows)
    loaded = {(r.document_id, r.line_no) for r in ledger.loaded_lines(lines).collect()}
    want, did = plain_ledger([r for r in rows if (r[0], r[2]) in loaded])
    led, told = ownership.rebuild(lines)
    led, told = led.collect(), told.collect()
    name = lambda d, n: f"{d}-{n}"
    assert sorted((r.root_id, str(r.valid_from), str(r.valid_to), r.status, str(r.replaced_by)) for r in led) == sorted((name(r["x"][0], r["x"][2]), str(r["f"]), str(r["t"]), r["status"], str(r["by"])) for r in want)
    assert {r.id: (r.change, r.previous_rate_id) for r in told} == {name(*k): (kind, prev and name(*prev)) for k, (kind, prev) in did.items()}
    assert len({r.id for r in led}) == len(led)
    return did


def test_ledger_equals_the_rules_line_by_line(spark, crowd):
    did = compare(spark, crowd)
    assert {k for k, _ in did.values()} >= {"new", "up", "down", "extended", "new_season"}


@pytest.mark.parametrize("seed", range(3))
def test_ledger_with_chains_and_several_lines_per_sheet(spark, seed):
    """Few terms and nested dates, so that many lines are same, some only because others are; sheets in two currencies
    whose lines overlap each other; two years."""
    rnd = random.Random(seed)
    rows = []
    for doc in range(1, 121):
        for n in range(1, rnd.choice([1, 1, 2, 3]) + 1):
            f = D(2026, 1, 1) + dt.timedelta(days=rnd.choice([0, 30, 60, 300, 365, 420]) + rnd.choice([0, 0, 3]))
            x = list(line(doc, rnd.choice([1000, 1000, 2000]), f, f + dt.timedelta(days=rnd.choice([5, 20, 100])), rnd.choice([1, 1, 2, doc]), rnd.choice([None, "Peak"])))
            x[2], x[9] = n, rnd.choice(["INR", "INR", "USD"])
            rows.append(tuple(x))
    did = compare(spark, rows)
    assert sum(k == "same" for k, _ in did.values()) > 5


def test_same_follows_from_same(spark):
    """Each line is covered by the first only because the ones between changed nothing; the last is not."""
    one = line(1, 1000, D(2026, 1, 1), D(2026, 12, 31))
    rows = [one, *(line(d, 1000, D(2026, 1, d), D(2026, 12, 40 - d)) for d in range(10, 30)), line(40, 900, D(2026, 6, 1), D(2026, 6, 2)), line(41, 1000, D(2026, 2, 1), D(2026, 11, 1))]
    did = compare(spark, rows)
    assert [did[(d, 1)][0] for d in (10, 20, 29, 40, 41)] == ["same", "same", "same", "down", "extended"]


def odd_lines():
    """Keys with lines that have no dates, sheet, number or amount, or that end before they begin."""
    a, b = D(2026, 1, 1), D(2026, 3, 31)
    for room, put in enumerate([{13: None}, {14: None}, {2: None}, {0: None, 1: None}, {8: None}, {9: None}, {13: b, 14: a}, {14: D(2025, 6, 1)}], 50):
        for n in (1, 2, 3):
            x = list(line(10 * room + n, 1000 + n % 2, a + dt.timedelta(days=9 * (n % 3)), b, room, "Peak"))
            if n == 2:
                for i, v in put.items():
                    x[i] = v
            yield tuple(x)


def test_swept_keys_are_like_related_ones(spark, crowd, monkeypatch):
    """Keys that are looked at line by line have the same ledger as those settled as relations; lines that come twice and
    keys with odd lines included."""
    rnd = random.Random(5)
    rows = [*crowd, *crowd[:40], *odd_lines()]
    for doc in range(700, 730):
        for n in (1, 2, 3):
            f = D(2026, 1, 1) + dt.timedelta(days=rnd.choice([0, 30, 60, 365, 700]))
            x = list(line(doc, rnd.choice([1000, 1000, 2000]), f, f + dt.timedelta(days=rnd.choice([5, 20, 100])), rnd.choice([1, 2, 60]), rnd.choice([None, "Peak"])))
            x[2], x[9], x[11] = n, rnd.choice(["INR", "USD", None]), rnd.choice([True, None])
            rows.append(tuple(x))
    lines = frame(spark, rows).withColumn("hotel_id", F.col("room_type_id") % 5)

    def told():
        led, did = ownership.rebuild(lines, ["hotel_id"])
        return [sorted(repr(sorted(r.asDict().items())) for r in x.collect()) for x in (led, did, ownership.live_picture(lines))]

    swept = told()
    monkeypatch.setattr(ownership, "MANY", 0)
    assert swept == told()
    assert all(len(x) > 100 for x in swept)


def test_lines_of_a_key_are_moved_once(spark, crowd):
    led, did = ownership.rebuild(frame(spark, crowd))
    for df in (led, did, ownership.live_picture(frame(spark, crowd))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(rate_key") == 1


def test_new_sheet_splits_an_older_rate(spark):
    old = line(1, 5000, D(2026, 10, 1), D(2026, 12, 19))
    new = line(2, 4200, D(2026, 11, 1), D(2026, 11, 15))
    led, changes = ownership.rebuild(frame(spark, [old, new]))
    got = sorted((r.valid_from, r.valid_to, int(r.amount), r.id) for r in led.collect())
    assert got == [(D(2026, 10, 1), D(2026, 10, 31), 5000, "1-1"), (D(2026, 11, 1), D(2026, 11, 15), 4200, "2-1"), (D(2026, 11, 16), D(2026, 12, 19), 5000, "1-1/1")]
    down = [r for r in changes.collect() if r.change == "down"]
    assert [(r.previous_rate_id, str(r.change_pct)) for r in down] == [("1-1", "-16.0")]


def test_same_extended_season_and_year(spark):
    rows = [
        line(1, 5000, D(2026, 1, 1), D(2026, 3, 31), season="Peak"), line(2, 5000, D(2026, 2, 1), D(2026, 2, 28), season="Peak"), line(3, 5000, D(2026, 3, 1), D(2026, 4, 30)),
        line(4, 6000, D(2026, 7, 1), D(2026, 7, 31), season="PEAK"), line(5, 5500, D(2027, 1, 10), D(2027, 2, 1)),
    ]
    _, changes = ownership.rebuild(frame(spark, rows))
    assert {r.document_id: r.change for r in changes.collect()} == {1: "new", 2: "same", 3: "extended", 4: "new_season", 5: "new_season"}


def test_revised_rate_supersedes(spark):
    rows = [line(1, 7500, D(2026, 12, 20), D(2027, 1, 5)), line(2, 8000, D(2026, 12, 20), D(2027, 1, 5))]
    led, changes = ownership.rebuild(frame(spark, rows))
    assert sorted((r.status, int(r.amount), r.replaced_by) for r in led.collect()) == [("active", 8000, None), ("superseded", 7500, 2)]
    assert [str(r.change_pct) for r in changes.collect() if r.change == "up"] == ["6.7"]


def test_all_periods_of_a_sheet_stay(spark):
    regular = [(D(2026, 1, 1), D(2026, 3, 31)), (D(2026, 10, 1), D(2026, 12, 19))]
    rows = [line(1, 5000, *regular[0], season="Regular"), line(1, 9000, D(2026, 12, 20), D(2027, 1, 5), season="Peak"), line(1, 5000, *regular[1], season="Regular")]
    rows = [(*r[:2], n + 1, *r[3:]) for n, r in enumerate(rows)]
    repeat = (1, 1, 4, *line(1, 5000, *regular[0])[3:])
    conflict = (1, 1, 5, *line(1, 5500, D(2026, 3, 1), D(2026, 4, 30))[3:])
    sheet = frame(spark, [*rows, repeat, conflict])
    assert sorted(r.line_no for r in ledger.loaded_lines(sheet).collect()) == [1, 2, 3, 5]
    assert {(r.line_no, r.dup, r.conflict) for r in ledger.sheet_findings(sheet).collect()} == {(4, True, False), (5, False, True)}
    live = ledger.live_rates(sheet).orderBy("valid_from").collect()
    assert [(int(r.amount), r.valid_from, r.valid_to) for r in live] == [(5000, *regular[0]), (5500, D(2026, 3, 1), D(2026, 4, 30)), (5000, *regular[1]), (9000, D(2026, 12, 20), D(2027, 1, 5))]
    led, changes = ownership.rebuild(sheet)
    assert led.filter("status = 'active'").count() == 4 and {r.change for r in changes.collect()} == {"new"}
    # a revised sheet: one period moves up, one is left out, one is the same
    revised = [(2, 2, n + 1, *line(2, a, *p)[3:]) for n, (a, p) in enumerate([(5500, regular[0]), (9000, (D(2026, 12, 20), D(2027, 1, 5)))])]
    led, changes = ownership.rebuild(frame(spark, [*rows, *revised]))
    assert sorted((r.status, int(r.amount)) for r in led.collect()) == [("active", 5000), ("active", 5500), ("active", 9000), ("superseded", 5000)]
    assert sorted(r.change for r in changes.filter("document_id = 2").collect()) == ["same", "up"]


def test_repetitions_are_judged_against_kept_lines(spark):
    """1-10 and 15-25 January stay: the line between repeats the first and is gone before the third is looked at. Another
    currency or another amount is no repetition."""
    a, b, c = (D(2026, 1, 1), D(2026, 1, 10)), (D(2026, 1, 5), D(2026, 1, 20)), (D(2026, 1, 15), D(2026, 1, 25))
    rows = [(*line(1, 1000, *d)[:2], n + 1, *line(1, 1000, *d)[3:]) for n, d in enumerate([a, b, c])]
    usd = list(line(1, 1000, *a))
    usd[2], usd[9] = 4, "USD"
    clash = list(line(1, 1100, *b))
    clash[2] = 5
    sheet = frame(spark, [*rows, tuple(usd), tuple(clash)])
    assert sorted(r.line_no for r in ledger.loaded_lines(sheet).collect()) == [1, 3, 4, 5]
    assert {(r.line_no, r.dup, r.conflict) for r in ledger.sheet_findings(sheet).collect()} == {(2, True, False), (5, False, True)}
    assert ledger.loaded_lines(sheet.limit(0)).count() == 0
    led, told = ownership.rebuild(sheet.limit(0))
    assert led.count() == 0 and told.count() == 0


def test_staged_tables_are_compressed(spark):
    """A staged table keeps its rows and takes far less room than they do."""
    import os

    from pyspark.sql import functions as F

    from tarifflake.session import checkpoint_dir, stage

    def size():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(checkpoint_dir(spark).removeprefix("file:")) for f in files)

    df = spark.range(50_000).select("id", F.lit("Premium room with a view of the lake").alias("name"), F.array(F.struct(F.lit(1).alias("a"))).alias("rows"), F.lit(None).cast("date").alias("d"))
    before = size()
    got = stage(df)
    assert size() - before < 50_000 * 20
    assert got.schema.simpleString() == df.schema.simpleString() and got.count() == 50_000 and got.exceptAll(df).isEmpty()


def test_what_was_moved_for_a_staged_table_is_dropped(spark):
    """The shuffle files of a staged table are gone when it is written, and the setting is as before."""
    import glob
    import time

    from tarifflake.session import DROP_SHUFFLES, stage

    def files():
        top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in top for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before, was = files(), spark.conf.get(DROP_SHUFFLES, None)
    got = stage(spark.range(50_000).repartition(4, "id").groupBy("id").agg(F.sum("id").alias("n")))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(DROP_SHUFFLES, None) == was
    assert got.count() == got.count() == 50_000


def test_live_rates_move_a_key_once_and_big_keys_step_by_step(spark, crowd, monkeypatch):
    lines = frame(spark, [*crowd, *crowd[:30], *odd_lines()])
    live = ledger.live_rates(lines)
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(rate_key") == 1
    once = sorted(map(repr, live.collect()))
    for many in (0, 20):
        monkeypatch.setattr(ledger, "MANY", many)
        assert once == sorted(map(repr, ledger.live_rates(lines).collect()))


def test_trim_moves_only_rates_of_the_new_keys(spark, crowd):
    """Rates of other keys stay where they are, and are returned as they were."""
    lib = frame(spark, crowd).selectExpr("*", "concat(document_id, '-', line_no) as id", "if(document_id % 5 = 0, 'superseded', 'active') as status")
    new = frame(spark, [line(900, 100, D(2026, 3, 1), D(2026, 3, 9), 2), line(901, 100, D(2026, 4, 1), D(2026, 4, 2), 2)])
    out = ledger.trim(lib, new)
    got = out.collect()
    other = [r for r in crowd if r[3] != 2 and r[0] % 5]
    assert {(r.id, r.valid_from, r.valid_to) for r in got if not r.rate_key.startswith("2|")} == {(f"{r[0]}-1", r[13], r[14]) for r in other}
    assert any(r.touched for r in got) and not any(r.touched for r in got if not r.rate_key.startswith("2|"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan


def test_library_rows_of_other_documents_do_not_count(spark):
    """Picking documents inside the comparison equals picking them before it."""
    day = dt.date(2024, 1, 1)
    cols = "document_id long, line_no long, approval_seq long, room_type_id long, meal_plan string, occupancy string, weekdays string, is_net boolean, amount decimal(12,2), currency string, basis string, taxes_included boolean, season_name string, valid_from date, valid_to date"

    def line(doc, no, amount, room=1):
        return (doc, no, doc, room, "CP", "double", None, True, Decimal(amount), "INR", "per_room_per_night", False, None, day, dt.date(2024, 3, 31))

    library = spark.createDataFrame([line(1, 1, 100), line(2, 1, 300), line(3, 1, 500, 2)], cols).selectExpr("*", "concat(document_id, '-', line_no) as id", "'active' as status")
    new = spark.createDataFrame([line(9, 1, 200), line(9, 2, 500, 2)], cols).drop("approval_seq")
    ok = spark.createDataFrame([(1,), (1,)], "document_id long")
    got = {r["line_no"]: (r["change"], r["previous_rate_id"]) for r in ledger.classify(new, library, ok).collect()}
    assert got == {1: ("up", "1-1"), 2: ("new", None)}
    want = ledger.classify(new, library.filter("document_id = 1")).collect()
    assert got == {r["line_no"]: (r["change"], r["previous_rate_id"]) for r in want}


class _State:
    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value


def test_keys_of_one_state_group_stay_apart():
    """Keys that share a group give the same live rates as keys by themselves, over two triggers."""
    r = random.Random(4)
    lines = []
    for n in range(60):
        f = D(2026, 1, 1) + dt.timedelta(days=r.randrange(40))
        line = {"kind": "line", "rate_key": f"k{n % 5}", "id": f"{n}-1", "root_id": f"{n}-1", "document_id": n, "seq": n, "amount": Decimal(r.randrange(1, 4) * 100), "currency": "INR", "basis": "night", "taxes_included": r.choice([None, True]), "season_name": r.choice([None, "Peak"]), "pieces": 0}
        lines.append({**line, "valid_from": f, "valid_to": f + dt.timedelta(days=r.randrange(20))})
    lines[0] |= {"document_id": 2**53 + 1, "seq": -1}

    def live_after(groups):
        live = {}
        for group in groups:
            state = _State()
            for part in (group[: len(group) // 2], group[len(group) // 2 :]):
                out = next(jobs._advance((0,), iter([history._frame(part)]), state))
                rows = [x for x in history._records(out) if x["kind"] == "live"]
                for k in {x["rate_key"] for x in part}:
                    live[k] = sorted(str(x) for x in rows if x["rate_key"] == k)
        return live

    assert live_after([lines]) == live_after([[x for x in lines if x["rate_key"] == f"k{k}"] for k in range(5)])


def test_the_rate_stream_keeps_its_state_on_disk(spark, tmp_path):
    from tarifflake.session import settings

    history.as_lines(ledger.loaded_lines(frame(spark, [line(1, 1000, D(2026, 1, 1), D(2026, 1, 9))]))).write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(history.OUT).parquet(str(tmp_path / "lines"))
    with settings(spark, {**jobs.ON_DISK, "spark.sql.shuffle.partitions": "1"}):
        q = jobs.rate_state(stream).writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert "rocksdb" in q.lastProgress.json
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "false") == "false"


def test_rows_of_other_keys_are_dropped_before_they_move(spark):
    from tarifflake.functions.grouping import maybe_in

    rows = spark.range(20_000).selectExpr("id", "concat('key ', id) as name").unionByName(spark.createDataFrame([(None, None)], "id long, name string"))
    asked = spark.range(0, 20_000, 50).selectExpr("cast(id as int) as id", "concat('key ', id) as name")
    for on in (["id"], ["name"], ["id", "name"]):
        met, rest = maybe_in(rows, asked, on), maybe_in(rows, asked, on, rest=True)
        assert met.join(asked, on, "left_semi").count() == 400 and met.count() < 450 and met.count() + rest.count() == 20_001
        assert maybe_in(rows, asked.limit(0), on).count() == 0
    assert "Exchange hashpartitioning(id" not in maybe_in(rows, asked, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_small_and_large_keys_are_compared_alike(spark, crowd, monkeypatch):
    """Keys of few rows look through an array, the others through quarters; null dates and seasons included."""
    rnd = random.Random(3)
    old = [(*r, f"{r[0]}-1", rnd.choice(["active", "active", "superseded"])) for r in crowd if r[0] % 3]
    old += [(*line(500 + k, 1000 + 1000 * (k % 2), D(2025, 1, 1) + dt.timedelta(days=9 * k), D(2025, 1, 20) + dt.timedelta(days=9 * k), k % 3, rnd.choice([None, "Peak"])), f"{500 + k}-1", "active") for k in range(60)]
    old += [(*line(700, 1000, None, None, 4, "Low"), "700-1", "active"), (*line(701, 900, D(2026, 3, 1), None, 5, "Peak"), "701-1", "active")]
    new = [r for r in crowd if r[0] % 4 == 1] + [line(800 + k, 3000, D(2027, 1, k + 1), D(2027, 2, 1), k % 7, rnd.choice([None, "Peak", "Low"])) for k in range(20)]
    new += [line(900, 1000, None, None, 4, "Low"), line(901, 1000, D(2026, 3, 1), None, 5, "Peak")]
    inc, lib = frame(spark, new), spark.createDataFrame(old, f"{SCHEMA}, id string, status string")
    docs = lib.select("document_id").filter("document_id % 7 > 0").distinct()

    def told(few):
        monkeypatch.setattr(ledger, "FEW", few)
        return sorted(map(repr, ledger.classify(inc, lib, docs).collect()))

    alike = told(10_000)
    assert alike == told(0) == told(30) and len(alike) == len(new)
    assert len({r.change for r in ledger.classify(inc, lib, docs).collect()}) == 6


def test_undo_looks_only_at_the_keys_of_its_documents(spark, crowd):
    lines = frame(spark, crowd)
    asked = spark.createDataFrame([(6,), (7,)], "document_id long")
    keys = {r[3] for r in crowd if r[0] in (6, 7)}
    changes, now = ownership.undo(asked, lines)
    assert {int(r.rate_key.split("|")[0]) for r in now.collect()} == keys
    assert {r.document_id for r in changes.collect()} <= {6, 7} and changes.filter("action = 'removed'").count() > 0
