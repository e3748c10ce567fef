"""Name similarity: known scores, and candidate pairs that lose no match."""

import random

import pytest
from pyspark.sql import functions as F

from tarifflake.functions import similarity as sim
from tarifflake.functions.keys import core_title
from tarifflake.operators import match


def test_scores():
    assert sim.ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert sim.token_sort("resort hills", "hills resort") == 100
    assert sim.token_set("cedar ridge", "cedar ridge resort spa") == 100
    assert sim.name_score("cedar ridge", "cedar ridge resort spa") == 95
    assert sim.name_score("royal", "royal batoo") < 88


@pytest.mark.parametrize("how,threshold,fn", [("name", 88, sim.name_score), ("name", 92, sim.name_score), ("sort", 86, sim.token_sort), ("set", 85, sim.token_set)])
def test_candidates_lose_no_pair(spark, how, threshold, fn):
    rnd = random.Random(3)
    words = ["cedar", "ridge", "hotel", "resort", "spa", "palm", "bay", "green", "valley", "inn", "lake", "view", "grand", "royal"]
    names = set()
    while len(names) < 90:
        w = rnd.sample(words, rnd.randrange(1, 5))
        if rnd.random() < 0.5:
            i = rnd.randrange(len(w))
            at = rnd.randrange(len(w[i]))
            w[i] = w[i][:at] + rnd.choice("abcxyz") + w[i][at + rnd.randrange(2):]
        names.add(" ".join(w))
    df = spark.createDataFrame([("*", n) for n in names], "block string, name string")
    got = {(r.q, r.d) for r in sim.similar_pairs(df, df, threshold, how).collect()}
    want = {(a, b) for a in names for b in names if fn(a, b) >= threshold}
    assert got == want


def test_hotels_match_within_a_city(spark):
    known = spark.createDataFrame([(1, "Cedar Ridge Resort", "Ooty"), (2, "Cedar Ridge Resort", "Goa"), (3, "Palm Bay", None)], "id long, name string, city string")
    q = spark.createDataFrame([("a", "Cedar Ridge Resorts", "goa"), ("b", "PALM  BAY", "Goa"), ("c", "Cedar Ridge Resort", None), ("d", "Cedar Ridge Resort", "Pune")], "query_id string, name string, city string")
    got = {r.query_id: r.id for r in match.match_hotels(q, known).collect()}
    assert got == {"a": 2, "b": 3, "c": 1, "d": None}


def test_resolve_fills_blanks_and_adds_rows(spark):
    known = spark.createDataFrame([(1, "Cedar", None, "x")], "id long, name string, city string, phone string")
    inc = spark.createDataFrame([("a", "CEDAR", "Ooty", "y"), ("b", "Brand New", "Goa", None), ("c", "brand new", None, "z")], "query_id string, name string, city string, phone string")
    m = spark.createDataFrame([("a", 1), ("b", None), ("c", None)], "query_id string, id long")
    from tarifflake.functions.keys import name_key

    ids, after = match.resolve(inc, known, m, ["city", "phone"], [name_key("name")])
    rows = {r.name: (r.city, r.phone) for r in after.collect()}
    assert rows == {"Cedar": ("Ooty", "x"), "Brand New": ("Goa", "z")}
    assert len({r.id for r in ids.filter(F.col("query_id") != "a").collect()}) == 1


def test_the_eight_closest_families_of_any_score(spark):
    import types

    from tarifflake.plans.matching import t04

    doc = spark.createDataFrame([(1, "needs_review"), (2, "approved")], "id long, status string")
    titles = ["cedar hills tour", "palm bay", "zzz", "hills of cedar", "river walk", "old fort", "lake view", "tea garden", "desert camp", "city lights"]
    rows = [(100, 1, 1, 5, "Cedar Hills Tour", ["a", "b"], 0), (101, 1, 2, 5, "Cedar Hills Tour", None, 0)]
    rows += [(i, 2, 1, 5 if i else None, t, ["a", "c", "d"] if i == 3 else None, 200 + i) for i, t in enumerate(titles)]
    rows += [(50, 2, 1, 4, "Cedar Hills Tour", None, 300), (51, 2, 2, 5, "quartz", None, 301)]
    package = spark.createDataFrame(rows, "id long, document_id long, supplier_id long, nights int, title string, destinations array<string>, family_id long")
    got = {(r.upload_id, r["rank"]): r.family_id for r in t04(types.SimpleNamespace(b_package=package, b_document=doc)).collect()}
    core = {r.id: r.core for r in package.select("id", core_title("title").alias("core")).collect()}
    score = lambda i: max(0, sim.token_sort(core[100], core[i]) - (20 if i == 3 else 0))
    want = sorted(range(10), key=lambda i: (-score(i), i))[:8]
    assert got == {(100, k + 1): 200 + i for k, i in enumerate(want)} | {(101, 1): 301}


def test_equal_words_are_matched_without_comparing(spark, monkeypatch):
    """A query that a known name has the words of is not compared with others; the lowest id wins over all its blocks."""
    known = spark.createDataFrame([(7, "a", "supplier 01"), (5, "a", "01 supplier"), (3, "b", "supplier 01"), (9, "a", "supplier 02")], "id long, block string, name_key string")
    queries = spark.createDataFrame(
        [("x", "a", "supplier 01"), ("x", "b", "supplier 01"), ("y", "a", "suplier 02"), ("z", "a", ""), ("w", "c", "supplier 01"), ("v", "a", None)],
        "query_id string, block string, name_key string",
    )
    asked = []

    def noted(q, *rest):
        asked.extend(r["name"] for r in q.collect())
        return sim.similar_pairs(q, *rest)

    monkeypatch.setattr(match, "similar_pairs", noted)
    got = {r["query_id"]: (r["id"], r["score"]) for r in match.best_match(queries, known).collect()}
    assert got["x"] == (3, 100.0) and got["y"][0] == 9 and got["y"][1] < 100
    assert got["z"] == got["w"] == got["v"] == (None, None)
    # of "supplier 01" only the query w, whose block has no names, is left
    assert sorted(a for a in asked if a) == ["suplier 02", "supplier 01"]


def test_families_are_compared_once_per_kind_of_upload(spark):
    """The best families of each upload, from one comparison for all uploads and families alike."""
    from tarifflake.operators import packages

    cols = "id long, family_id long, supplier_id long, nights int, title string, destinations array<string>"
    known = [(100 + f, f, 1, 4 if f % 2 else None, "Hill Tour" if f < 20 else "Hill Tours", ["Munnar", "Kochi"] if f % 3 else ["Goa"]) for f in range(40)]
    up = [(u, None, 1, 4, "Hill Tour", ["kochi", "Munnar "]) for u in range(3)] + [(9, None, 2, 4, "Hill Tour", None)]
    uploads, old = spark.createDataFrame(up, cols), spark.createDataFrame(known, cols)
    every = packages.match_families(uploads, old, match.core_title_pairs, None).collect()
    best = packages.match_families(uploads, old, match.core_title_pairs, None, best=8).collect()
    assert len(every) == 3 * 40
    for u in range(3):
        rows = sorted((-r["score"], r["family_id"]) for r in every if r["upload_id"] == u)
        assert sorted((-r["score"], r["family_id"]) for r in best if r["upload_id"] == u) == rows[:8]
    close = packages.match_families(uploads, old, match.core_title_pairs, match.PACKAGES).collect()
    assert {(r["upload_id"], r["family_id"]) for r in close} == {(r["upload_id"], r["family_id"]) for r in every if r["score"] >= match.PACKAGES}
