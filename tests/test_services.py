"""The dated load of services against its rules line by line."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tarifflake.functions.similarity import name_score
from tarifflake.operators import services

D = dt.date
LINE = "document_id long, approval_seq long, line_no long, supplier_id long, kind string, vehicle_type string, basis string, name string, amount decimal(12,2), amount_max decimal(12,2), currency string, season_name string, valid_from date, valid_to date"


def year_on(d):
    return d.replace(year=d.year + 1, day=28 if (d.month, d.day) == (2, 29) else d.day)


def plain(lines):
    rows, did = [], {}
    for x in sorted(lines, key=lambda x: (x[1], x[2])):
        f, t, name = x[12], x[13], x[7].lower()
        known = [r for r in rows if r["x"][3:7] == x[3:7] and r["x"][0] != x[0]]
        names = list(dict.fromkeys(r["x"][7].lower() for r in known))
        best = max(names, key=lambda n: (name_score(name, n), -names.index(n)), default=None) if name not in names else name
        mine = [r for r in known if best is not None and name_score(name, best) >= 92 and r["x"][7].lower() == best]
        days = lambda a, b: max(0, (min(b, t) - max(a, f)).days + 1)  # noqa: B023, E731
        over = [r for r in mine if r["live"] and days(r["f"], r["t"])]
        terms = lambda y: (y[8], y[9], y[10])
        if any(terms(r["x"]) == terms(x) and r["f"] <= f and r["t"] >= t for r in over):
            did[(x[0], x[2])] = ("same", None)
            continue
        order = lambda r: (r["x"][1], r["x"][2])
        met = [r for r in mine if days(r["f"], r["t"])]
        ended = [r for r in mine if r["t"] < f]
        season = [r for r in ended if x[11] and r["x"][11] == x[11]]
        again = [r for r in ended if days(year_on(r["f"]), year_on(r["t"]))]
        prev = max(met, key=lambda r: (r["live"], days(r["f"], r["t"]), order(r))) if met else max(season, key=lambda r: (r["t"], order(r))) if season else max(again, key=lambda r: (days(year_on(r["f"]), year_on(r["t"])), order(r)), default=None)
        kind = "new" if prev is None else "new_season" if not met else "extended" if terms(prev["x"]) == terms(x) else "up" if x[8] > prev["x"][8] else "down"
        did[(x[0], x[2])] = (kind, prev and (prev["x"][0], prev["x"][2]))
        for r in over:
            before, after = r["f"] < f, r["t"] > t
            if before and after:
                rows.append({**r, "f": t + dt.timedelta(days=1)})
            if before:
                r["t"] = f - dt.timedelta(days=1)
            elif after:
                r["f"] = t + dt.timedelta(days=1)
            else:
                r["live"] = False
        rows.append({"x": x, "f": f, "t": t, "live": True})
    return rows, did


@pytest.mark.parametrize("seed", range(2))
def test_names_are_recognised_as_they_come(spark, seed):
    r = random.Random(seed)
    names = ["airport transfer cochin to munnar", "airport transfer cochin to munnars", "Airport transfer cochin to munnar x", "houseboat cruise alleppey", "elephant ride"]
    lines = []
    for doc in range(1, 70):
        f = D(2026, 1, 1) + dt.timedelta(days=r.choice([0, 20, 40, 365, 380]))
        for n in range(1, r.choice([1, 2]) + 1):
            lines.append((doc, doc, n, r.choice([1, 1, None]), "transfer", None, "per_vehicle", r.choice(names), Decimal(r.choice([900, 900, 1200])), None, "INR", r.choice([None, "peak"]), f, f + dt.timedelta(days=r.choice([5, 30]))))
    want, did = plain(lines)
    led, told = services.rebuild(spark.createDataFrame(lines, LINE))
    name = lambda k: f"{k[0]}-{k[1]}"
    assert {x.id: (x.change, x.previous_rate_id) for x in told.collect()} == {name(k): (kind, p and name(p)) for k, (kind, p) in did.items()}
    assert sorted((x.root_id, str(x.valid_from), str(x.valid_to), x.status) for x in led.collect()) == sorted((name((y["x"][0], y["x"][2])), str(y["f"]), str(y["t"]), "active" if y["live"] else "superseded") for y in want)
    assert {"same", "up", "down"} <= {k for k, _ in did.values()}


def test_later_rounds_look_only_at_names_whose_kept_lines_changed(spark, monkeypatch):
    lines = []
    for doc in range(1, 7):
        for n, name in enumerate(["airport transfer cochin", "houseboat cruise alleppey", "elephant ride thekkady"]):
            f = D(2026, 1, 1) + dt.timedelta(days=0 if n == 0 else 40 * doc)
            lines.append((doc, doc, n, 1, "transfer", None, "per_vehicle", name, Decimal(900), None, "INR", None, f, f + dt.timedelta(days=9)))
    asked, look = [], services._looked_at

    def counted(part, close):
        asked.append(part.filter("asking").count())
        return look(part, close)

    monkeypatch.setattr(services, "_looked_at", counted)
    _, told = services.rebuild(spark.createDataFrame(lines, LINE))
    assert sum(x.change == "same" for x in told.collect()) == 5
    assert asked[0] == 18 and len(asked) > 1 and set(asked[1:]) == {6}
