"""Package versions upload after upload, against the rules one by one."""

import datetime as dt
import random

import pytest

from tarifflake.operators import packages

D = dt.date
FIELDS = "id long, family_id long, valid_from date, valid_to date, status string, version int, seq long"


def plain(library, uploads):
    """Each upload in turn: its number, its base, and what becomes of the live members."""
    members = [dict(r, live=r["status"] == "active", fate=None, by=None) for r in library]
    loaded = {}
    for u in sorted(uploads, key=lambda u: u["seq"]):
        mine = [m for m in members if m["family_id"] == u["family_id"]]
        known = lambda m: None not in (u["valid_from"], u["valid_to"], m["valid_from"], m["valid_to"])  # noqa: B023, E731
        days = lambda m: max(0, (min(u["valid_to"], m["valid_to"]) - max(u["valid_from"], m["valid_from"])).days + 1) if known(m) else 0  # noqa: B023, E731
        version = max((m["version"] for m in mine), default=0) + 1
        live = [m for m in mine if m["live"]]
        base = max(live or mine, key=lambda m: (days(m), m["version"], m["id"]), default=None)
        loaded[u["id"]] = (version, base and base["id"])
        for m in live:
            if not known(m) or (u["valid_from"] <= m["valid_from"] and u["valid_to"] >= m["valid_to"]):
                m["live"], m["fate"], m["by"] = False, "replaced", u["id"]
            elif m["fate"] is None or days(m):
                m["fate"] = "overlaps" if days(m) else m["fate"] or "kept"
        members.append({**u, "version": version, "live": True, "fate": None, "by": None})
    return loaded, {m["id"]: (m["fate"], m["by"]) for m in members if m["fate"]}


@pytest.mark.parametrize("seed", range(3))
def test_versions_upload_after_upload(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(90):
        f = D(2026, 1, 1) + dt.timedelta(days=r.choice([0, 30, 60, 90]))
        span = (f, f + dt.timedelta(days=r.choice([30, 60, 200]))) if r.random() < 0.9 else (None, None)
        rows.append({"id": i, "family_id": r.randrange(6), "valid_from": span[0], "valid_to": span[1], "status": r.choice(["active", "active", "superseded"]), "version": i, "seq": (i * 37) % 97})
    library, uploads = rows[:40], rows[40:]
    loaded, fates = plain(library, uploads)
    frame = lambda x: spark.createDataFrame([tuple(y.values()) for y in x], FIELDS)
    got = packages.load_versions(frame(uploads).drop("version", "status"), frame(library).drop("seq")).collect()
    assert {x.upload_id: (x.version, x.base_id) for x in got} == loaded
    effects = packages.version_effects(frame(uploads), frame(library).drop("seq")).collect()
    assert {x.id: (x.action.split(" ")[0], x.replaced_by) for x in effects} == fates
    assert len({b for _, b in loaded.values()} & {u["id"] for u in uploads}) > 3  # uploads are compared with uploads


def test_two_uploads_of_a_family_count_on(spark):
    old = spark.createDataFrame([(1, 7, D(2026, 1, 1), D(2026, 3, 31), "active", 4, None)], FIELDS).drop("seq")
    new = spark.createDataFrame([(2, 7, D(2026, 1, 1), D(2026, 6, 30), "", 0, 1), (3, 7, D(2026, 2, 1), D(2026, 2, 28), "", 0, 2)], FIELDS)
    assert {(x.upload_id, x.version, x.base_id) for x in packages.load_versions(new, old).collect()} == {(2, 5, 1), (3, 6, 2)}
    assert packages.load_versions(new.limit(0), old).count() == 0 and packages.version_effects(new, old.limit(0)).count() == 1
