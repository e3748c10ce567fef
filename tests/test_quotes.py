"""Quotations: what is frozen comes back as it was."""

import datetime as dt
import types
from decimal import Decimal

import pytest

from tarifflake.operators import quotes
from tarifflake.operators.trips import totals

D = dt.date
TRIP = "id long, title string, customer_name string, customer_phone string, customer_email string, assigned_to string, lead_source string, status string, start_date date, adults int, children_with_bed int, children_without_bed int, extra_beds int, markup_pct decimal(6,2), gst_pct decimal(5,2), currency string, is_template boolean, chosen_option string, destination string"
DAY = "trip_id long, position int, title string, overnight string, source_package_id long"
ITEM = "trip_id long, id long, kind string, ref_id long, day_position int, description string, quantity decimal(10,2), amount decimal(12,2), currency string, optional boolean, option_label string"


def trip(i, status="enquiry", template=False):
    return (i, f"Trip {i}", f"Customer {i}", None, "c@example.com", None, "web", status, D(2026, 9, 5), 2, 1, 0, 0, Decimal(10), Decimal(5), "INR", template, None, None)


@pytest.fixture(scope="module")
def lib(spark):
    item = lambda t, i, amount: (t, i, "custom", None, 1, f"Line {i}", Decimal(1), Decimal(amount), "INR", False, None)
    return types.SimpleNamespace(
        trips=spark.createDataFrame([trip(1), trip(2, "confirmed"), trip(3, template=True), trip(4)], TRIP),
        days=spark.createDataFrame([(1, 2, "Lake", None, 77), (1, 1, "Arrival", "Munnar", None), (3, 1, "Any", None, None)], DAY),
        items=spark.createDataFrame([item(1, 11, 5000), item(1, 10, 250), item(2, 20, 999), item(3, 30, 1)], ITEM),
        payments=spark.createDataFrame([], "trip_id long, amount decimal(12,2)"),
        quotes=spark.createDataFrame([(40, 1), (41, 1)], "id long, trip_id long"),
    )


def saved(lib):
    return quotes.save(lib.trips, lib.days, lib.items, totals(lib.trips, lib.items, lib.payments), lib.quotes, D(2026, 8, 1))


def test_saving_numbers_versions_and_notes(lib):
    q, moved, notes = saved(lib)
    assert {(r.trip_id, r.id, r.version, r.number, r.status, str(r.valid_until)) for r in q.collect()} == {(1, 42, 3, "Q-2026-0042", "draft", "2026-08-08"), (2, 43, 1, "Q-2026-0043", "draft", "2026-08-08")}
    assert [tuple(r) for r in moved.collect()] == [(1, "quoted")]  # a confirmed trip stays; templates and empty trips are not quoted
    assert {r.text for r in notes.filter("trip_id = 1").collect()} == {"Quotation Q-2026-0042 (v3) saved: INR 6,064"}


def test_a_snapshot_comes_back_without_loss(lib):
    q, _, _ = saved(lib)
    days, items = quotes.rows_of(q)
    assert sorted(map(tuple, days.collect())) == sorted(tuple(r) for r in lib.days.filter("trip_id = 1").collect())
    assert sorted(map(str, items.select(*lib.items.columns).collect())) == sorted(map(str, lib.items.filter("trip_id <= 2").collect()))
    assert [r.position for r in days.collect()] == [1, 2]  # in order


def test_restoring_replaces_the_plan_of_its_trip_only(lib, spark):
    q, _, _ = saved(lib)
    edited = lib.trips.filter("id <> 2").unionByName(spark.createDataFrame([(*trip(2, "confirmed")[:1], "Renamed", *trip(2, "confirmed")[2:])], TRIP))
    more = lib.days.unionByName(spark.createDataFrame([(2, 1, "New day", None, None), (4, 1, "Kept", None, None)], DAY))
    head, days, items = quotes.restore(q, edited, more, lib.items)
    assert {r.id: (r.title, r.status) for r in head.collect()} == {1: ("Trip 1", "enquiry"), 2: ("Trip 2", "confirmed"), 3: ("Trip 3", "enquiry"), 4: ("Trip 4", "enquiry")}
    assert {(r.trip_id, r.title) for r in days.collect()} == {(1, "Arrival"), (1, "Lake"), (3, "Any"), (4, "Kept")}
    assert items.count() == lib.items.count()


def test_new_trips_from_quotations(lib):
    q, _, _ = saved(lib)
    head, days, items, notes = quotes.new_trips(q, lib.trips)
    assert {(r.id, r.title, r.customer_name, r.status) for r in head.collect()} == {(46, "Trip 1", "Customer 1", "enquiry"), (47, "Trip 2", "Customer 2", "enquiry")}
    assert not {r.id for r in head.collect()} & {1, 2, 3, 4} and {r.trip_id for r in days.collect()} == {46} and items.count() == 3
    assert {r.text for r in notes.collect()} == {"Started from quotation Q-2026-0042", "Started from quotation Q-2026-0043"}
    copy = quotes.new_trips(q, lib.trips, title="For another")[0].collect()
    assert {(r.title, r.customer_name, r.customer_email) for r in copy} == {("For another", None, None)}
