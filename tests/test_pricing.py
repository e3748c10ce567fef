"""Stays, packages and trips: golden prices."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarifflake.operators import packages, stays, trips

from .fixtures import CATS, TIERS

D = dt.date
OCC = ["single", "double", "extra_adult", "child_with_bed", "child_without_bed"]
REGULAR, PEAK = [4500, 5000, 1500, 1200, 600], [7000, 7500, 2000, 1600, 800]


@pytest.fixture(scope="module")
def library(spark):
    rates = []
    for amounts, f, t, m in ((REGULAR, D(2026, 10, 1), D(2026, 12, 19), None), (PEAK, D(2026, 12, 20), D(2027, 1, 5), 2)):
        rates += [(f"{o}{f}", 1, 10, "CP", o, None, True, Decimal(a), "INR", "per_room_per_night", False, m, None, f, t, "active") for o, a in zip(OCC, amounts, strict=True)]
    for days, a in (("mon,tue,wed,thu,sun", 2200), ("fri,sat", 2600)):
        rates.append((f"w{a}", 2, 20, "EP", "double", days, True, Decimal(a), "THB", "per_room_per_night", True, None, None, D(2027, 5, 1), D(2027, 10, 31), "active"))
    cols = "id string, document_id long, room_type_id long, meal_plan string, occupancy string, weekdays string, is_net boolean, amount decimal(12,2), currency string, basis string, taxes_included boolean, min_nights int, season_name string, valid_from date, valid_to date, status string"
    sur = [(1, "supplement", "Gala", None, D(2026, 12, 31), D(2026, 12, 31), Decimal(3500), "INR", "per_adult", True, "active"), (1, "supplement", "Gala child", None, D(2026, 12, 31), D(2026, 12, 31), Decimal(1750), "INR", "per_child", True, "active"),
           (1, "blackout", "Stop", "Pool Villa", D(2026, 12, 24), D(2026, 12, 25), None, None, None, True, "active")]
    scols = "hotel_id long, kind string, name string, room_type string, date_from date, date_to date, amount decimal(12,2), currency string, basis string, mandatory boolean, status string"
    rooms = spark.createDataFrame([(10, 1, "Deluxe Room"), (11, 1, "Pool Villa"), (20, 2, "Superior")], "id long, hotel_id long, name string")
    hotels = spark.createDataFrame([(1, "Cedar"), (2, "Palm")], "id long, name string")
    return spark.createDataFrame(rates, cols), spark.createDataFrame(sur, scols), rooms, hotels


@pytest.fixture(scope="module")
def priced(spark, library):
    def ask(i, hotel, room, plan, a, b, rooms, markup=0):
        return (i, hotel, room, plan, a, b, rooms, True, Decimal(markup))

    two = [(2, 0, 0)]
    rows = [
        ask("season", 1, 10, "CP", D(2026, 12, 18), D(2026, 12, 22), two), ask("family", 1, 10, "CP", D(2026, 12, 30), D(2027, 1, 1), [(3, 1, 0)], 10), ask("weekend", 2, 20, "EP", D(2027, 5, 6), D(2027, 5, 10), two),
        ask("villa", 1, 11, "CP", D(2026, 12, 24), D(2026, 12, 26), two), ask("deluxe", 1, 10, "CP", D(2026, 12, 24), D(2026, 12, 26), two), ask("alone", 2, 20, "EP", D(2027, 5, 6), D(2027, 5, 7), [(1, 0, 0)]), ask("short", 1, 10, "CP", D(2026, 12, 20), D(2026, 12, 21), two),
    ]
    req = spark.createDataFrame(rows, "request_id string, hotel_id long, room_type_id long, meal_plan string, check_in date, check_out date, rooms array<struct<adults:int,children_with_bed:int,children_without_bed:int>>, prefer_net boolean, markup_pct decimal(6,2)")
    return {r.request_id: r for r in stays.price_stays(req, *library).collect()}


def test_stay_crosses_a_season(priced):
    assert (float(priced["season"].cost), priced["season"].ok, priced["season"].currency) == (25000.0, True, "INR")


def test_family_with_gala_dinner(priced):
    r = priced["family"]
    # 7500 + 2000 extra adult + 1600 child a night, twice, and the gala for three adults and a child
    assert float(r.cost) == 2 * (7500 + 2000 + 1600) + 3 * 3500 + 1750
    assert float(r.sell) == round(float(r.cost) * 1.1, 2)


def test_nights_are_written_before_answers_are_put_together(spark, monkeypatch):
    """What is moved for the price calendar and for the nights is not there when the answers are worked out."""
    written = []
    monkeypatch.setattr(stays, "stage", lambda df: written.append(df.columns) or df)
    req = spark.createDataFrame([], "request_id string, hotel_id long, room_type_id long, meal_plan string, check_in date, check_out date, rooms array<struct<adults:int,children_with_bed:int,children_without_bed:int>>, prefer_net boolean, markup_pct decimal(6,2)")
    rates = spark.createDataFrame([], "id long, document_id long, room_type_id long, meal_plan string, occupancy string, weekdays string, is_net boolean, amount decimal(12,2), currency string, basis string, taxes_included boolean, min_nights int, season_name string, valid_from date, valid_to date, status string")
    extra = spark.createDataFrame([], "hotel_id long, kind string, name string, room_type string, date_from date, date_to date, amount decimal(12,2), currency string, basis string, mandatory boolean, status string")
    names = spark.createDataFrame([], "id long, hotel_id long, name string")
    assert stays.price_stays(req, rates, extra, names, names).count() == 0
    assert [c[:2] for c in written] == [["room_type_id", "meal_plan"], ["request_id", "night"], ["request_id", "nights_total"]]


def test_weekend_rates(priced):
    assert (float(priced["weekend"].cost), priced["weekend"].currency) == (2200 + 2600 + 2600 + 2200, "THB")


def test_blackout_only_hits_its_room(priced):
    assert any("blackout / stop sale at Cedar (Pool Villa)" in e for e in priced["villa"].errors)
    assert priced["deluxe"].ok


def test_fallback_and_minimum_stay(priced):
    assert priced["alone"].warnings == ["2027-05-06: no single rate, used double rate for room 1"] and float(priced["alone"].cost) == 2200
    assert priced["short"].warnings == ["2026-12-20: minimum stay is 2 nights"]


def test_package_tiers(spark):
    rows, i = [], 0
    for n, row in TIERS.items():
        for c, a in zip(CATS, row, strict=True):
            i += 1
            rows.append((1, i, c, n, "double", Decimal(a), "INR", True, D(2026, 8, 1), D(2026, 10, 31)))
    for c, a in zip(CATS, [5000, 6500, 7500, 8500], strict=True):
        i += 1
        rows.append((1, i, c, None, "extra_adult", Decimal(a), "INR", True, D(2026, 8, 1), D(2026, 10, 31)))
    prices = spark.createDataFrame(rows, "package_id long, id long, category string, pax_min int, occupancy string, amount decimal(12,2), currency string, is_net boolean, valid_from date, valid_to date")
    asks = [("four", "Deluxe", 4, 0, D(2026, 9, 1), None), ("five", "Deluxe", 5, 1, D(2026, 9, 1), None), ("many", "Luxury", 20, 0, None, None), ("late", "Deluxe", 4, 0, D(2027, 1, 1), None), ("first", None, 2, 0, None, None), ("forced", "Luxury", 4, 0, None, 6), ("nope", "Gold", 2, 0, None, None)]
    req = spark.createDataFrame([(n, 1, c, a, x, 0, 0, 0, d, t) for n, c, a, x, d, t in asks], "request_id string, package_id long, category string, adults int, extra_beds int, children_with_bed int, children_without_bed int, single_rooms int, travel_date date, pax_tier int")
    got = {r.request_id: r for r in packages.price_packages(req, prices).collect()}
    assert float(got["four"].total) == 4 * 14000 and got["four"].pax_tier == 4
    assert float(got["five"].total) == 4 * 14000 + 6500
    assert (float(got["many"].total), got["many"].pax_tier) == (20 * 16500, 14)
    assert got["late"].errors == ["Package prices are not valid on 2027-01-01"]
    assert (got["first"].category, float(got["first"].total)) == ("Standard", 2 * 14800)
    assert float(got["forced"].total) == 4 * 17700
    assert got["nope"].errors == ["Category 'Gold' not in this package"]


def test_trip_totals_with_options(spark):
    t = spark.createDataFrame([(1, None, 2, 0, 0, Decimal(10), Decimal(5), "INR"), (2, "B", 2, 0, 0, Decimal(0), Decimal(0), "INR")], "id long, chosen_option string, adults int, children_with_bed int, children_without_bed int, markup_pct decimal(6,2), gst_pct decimal(5,2), currency string")
    item = [(1, 1, None, "39500"), (2, 3, None, "9000"), (2, 4, "A", "10000"), (2, 5, "B", "14000")]
    items = spark.createDataFrame([(a, b, c, Decimal(d), "INR", False) for a, b, c, d in item], "trip_id long, id long, option_label string, amount decimal(12,2), currency string, optional boolean")
    pay = spark.createDataFrame([(1, Decimal(1000))], "trip_id long, amount decimal(12,2)")
    got = {r.trip_id: r for r in trips.totals(t, items, pay).collect()}
    assert float(got[1].sell) == round(39500 * 1.1 * 1.05, 2) and float(got[1].balance) == round(39500 * 1.1 * 1.05 - 1000, 2)
    assert (float(got[2].sell), got[2].option, got[2].is_from_price) == (23000.0, "B", False)
    none = trips.totals(t.withColumn("chosen_option", F.lit(None).cast("string")), items, pay).filter("trip_id = 2").first()
    assert (float(none.sell), none.option, none.is_from_price) == (19000.0, "A", True)
