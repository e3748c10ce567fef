"""Operators over pages and embeddings, the registered queries and the pipeline."""

import base64
import hashlib
import io
import os
import zipfile

import duckdb
import numpy as np
import pyarrow.fs as pafs
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from tarifflake.llm import archives, dom, extraction, topk
from tarifflake.llm.boosting import boost

from .small import documents
from .test_documents import plain_classes, plain_repeats

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, payload string, path string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "?", "?", "?") for i, u, h in rows], PAGES)


# archives


def test_packages(spark):
    rows = [(5, "http://a/ü?q=1", "<p>é</p>"), (9, None, "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, "x\r\ny", None), (8, "", ""), (4, "http://c", "x" * 100_000), (None, "http://d", "lone"), (None, "http://d", "<p>é</p>")]
    got = archives.read_packages(archives.write_packages(pages(spark, rows))).collect()
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = max(same, default=None)
        want = (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
        assert tuple(r := next(x for x in got if x["page_id"] == i and x["payload_bytes"] == len(raw))) == want, r
    kept = archives.read_packages(archives.write_packages(pages(spark, rows), min_bytes=5)).collect()
    assert {r["page_id"] for r in kept if r["record_type"] == "revisit"} == {5, 2, None}
    assert archives.read_packages(archives.write_packages(pages(spark, []))).count() == 0


def test_package_is_a_plain_zip(spark):
    files = archives.write_packages(pages(spark, [(1, "http://a", "one"), (2, "http://b", "two")]).coalesce(1)).collect()
    names = set()
    for f in files:
        with zipfile.ZipFile(f["path"].removeprefix("file:")) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            names |= set(z.namelist())
    assert names == {archives.RECORDS, archives.INDEX}


def test_directory_reads_zip64(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"PK\x05 not the end"
        for k in range(70_000 if os.environ.get("LONG") else 300):
            z.writestr(f"m{k}", b"x" * k)
    data = path.read_bytes()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        want = {i.filename: (i.file_size, i.header_offset) for i in z.infolist()}
    with pafs.LocalFileSystem().open_input_file(str(path)) as source:
        got = archives.directory(source, len(data))
        assert {n: (m.size, m.header) for n, m in got.items()} == want
        assert source.read_at(7, got["m7"].place(source)) == b"x" * 7


def test_damage_is_found():
    good = archives.record(1, "u", b"abc", archives.base32(hashlib.sha1(b"abc").digest()), None, "2000-01-01T00:00:00Z")
    assert archives.parse(good)[:2] == (1, 3)
    with pytest.raises(ValueError):
        archives.parse(archives.record(1, "u", b"abc", archives.base32(hashlib.sha1(b"abd").digest()), None, "2000-01-01T00:00:00Z"))


# top k


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(150)]
    rows += [(200, [0.5, -0.5]), (250, None), (300, [float("nan")] * 6), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("inf")] * 6), (None, [1.0] * 6), (450, []), (501, rows[0][1]), (502, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, "?", "?") for i, v in rows], "vec_id long, embedding array<float>, label int, score string, shard string")
    got = [tuple(r) for r in topk.search_embeddings(df).orderBy("query_id", "rank").collect()]
    floats = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    whole = {i: np.pad(np.floor(256 * v).astype(int), (0, 6 - len(v))) for i, v in floats.items()}
    want = []
    for q in sorted(i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    few = topk.search_embeddings(df.filter("vec_id in (0, 1, 50)"))
    assert few.count() == 4 and topk.search_embeddings(df.limit(0)).count() == 0


def test_max_score_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    for n, d, high in ((300, 8, 4), (40, 3, 2), (500, 16, 300)):
        shard = topk.Shard(rng.permutation(n), x := rng.integers(-high, high + 1, (n, d)))
        order = np.argsort(shard.ids)
        assert (shard.ids[order] == np.arange(n)).all() and x.shape == shard.x.shape
        for _ in range(40):
            q, own = rng.integers(-high, high + 1, d), int(rng.integers(0, n))
            scores = shard.x @ q
            want = [i for i in np.lexsort((shard.ids, -scores)) if shard.ids[i] != own][:5]
            ids, found = shard.search(own, q, 5)
            assert list(ids) == list(shard.ids[want]) and list(found) == list(scores[want])


# extraction


def test_extraction_on_composed_pages():
    """Held-out pages of the composer with plain names: most words right."""
    composer = extraction.Composer(77)
    model, scores = extraction.trained(), []
    for source in (composer.page() for _ in range(150)):
        page = dom.Page(source)
        want = page.kept([extraction.MARK in s for s in page.texts]).replace(extraction.MARK, "").split()
        got = extraction.main_texts([source.replace(extraction.MARK, "")], model)[0].split()
        common = len(set(want) & set(got))
        scores.append(2 * common / max(1, len(set(want)) + len(set(got))))
    assert np.mean(scores) > 0.9


def test_extraction(spark):
    article = "<article><h1>A &amp; B</h1><p>First   one,\n with <b>bold</b> words.<br>And more of it here.</p><p>Second &lt;p&gt; &#233;.</p></article>"
    around = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav>"
    foot = "<footer>&copy; all rights</footer>"
    comments = "<section class='comments'><h3>Comments</h3><p>I like this article very much, thanks.</p></section>"
    notice = "<div class='cookie-notice'><p>We use cookies on this site, as others do.</p><button>OK</button></div>"
    script = "<script>var a = '</p><p>no';</script><style>p{}</style><!-- <p>no</p> -->"
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{script}{around}{notice}{article}{comments}<form><label>Name</label><input></form>{foot}</body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (4, "u", page.replace("</article>", "").replace("</p>", "")), (5, "u", "<p>unclosed <b>text"), (6, "u", "<" * 500 + "a" * 5000)]
    got = {r["page_id"]: r for r in extraction.extracted(pages(spark, rows)).collect()}
    want = "A & B\nFirst one, with bold words. And more of it here.\nSecond <p> é."
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and got[None]["text"] == want
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["url"] is None
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    assert extraction.extracted(pages(spark, [])).count() == 0


def test_decoding_is_consistent():
    """No text is kept below an element whose whole subtree is dropped, whatever the probabilities."""
    rng = np.random.default_rng(3)
    page = dom.Page("<div><section><p>one</p><p>two</p></section><section>three<ul><li>four</li><li>five</li></ul></section></div>" * 3)
    _, chars, own = dom.features([page])
    for sure in (0.001, 0.999):
        p = np.full(len(page.tags), sure)
        assert set(extraction.decode(page, p, chars, own)) == {sure > 0.5}
    for _ in range(50):
        p = rng.random(len(page.tags))
        flags = extraction.decode(page, p, chars, own)
        assert len(flags) == len(page.texts)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost(x[:2000], y[:2000], np.ones(2000), trees=30)
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


# queries and the pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not here")
def test_registered(spark):
    names = entry_point.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("op5_top_vectors", "op11_collocations", "op13_host_rules"):
        cur = con.execute(entry_point.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        df = names[name](spark, SF)
        assert sorted(df.columns) == sorted(cols) and sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(cur.fetchall())


def test_pipeline(spark, tmp_path):
    """Each stage on its own input against a plain version of its decision."""
    good = "Plain words stand here and others follow them, line by line, as they do."
    texts = [f"{good} {'word ' * (i % 7)}{i}." for i in range(60)] + [f"BUY!! {'$$$ ' * 5}CLICK!! NOW!! {i}!!" for i in range(60)]
    shared = " ".join(f"shared{i}" for i in range(60))
    texts += [f"start {i} {'x' * i} {shared} and end {i}." for i in range(3)] + [" ".join(f"w{i}" for i in range(90)), " ".join(f"w{i}" for i in range(90)) + " more"]
    docs = documents(spark, texts, list(range(len(texts)))).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["good_documents"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} >= set(range(60)) and not {r["doc_id"] for r in kept.collect()} & set(range(60, 120))
    one = {r["doc_id"] for r in stages["near_dedup"](spark, docs, "").collect()}
    assert one == set(plain_classes(texts))
    rows = {r["doc_id"]: r["text"] for r in stages["suffix_dedup"](spark, docs.filter("doc_id >= 120"), "").collect()}
    for i, (n, gone, *_), t in zip(range(120, 125), plain_repeats(texts[120:], 200), texts[120:]):
        assert len(rows.get(i, "")) == n - gone, t
    mixed = stages["source_mix"](spark, docs, "").collect()
    assert {r["doc_id"] for r in mixed} <= set(range(len(texts))) and all(r["n_chars"] == len(r["text"]) for r in mixed)
    out = stages["encode_pieces"](spark, docs, "").collect()
    assert sorted(r["text"] for r in out) == sorted(texts) and all(len(r["ids"]) == r["n_tokens"] for r in out)
    assert all(f(spark, docs, str(tmp_path)).columns == docs.columns for _, f in corpus_pipeline.STAGES[:-1])
