"""Collocations, spelling variants and host rules against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifflake.llm import automata, collocations, fmindex, hostrules, spelling

from .small import documents, empty, odd_texts


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- collocations
def plain_collocations(rows, least, top, covered=50):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    often = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    out = []
    for g, a in often.items():
        lang, words = g[0], g[1:]
        if any(h[0] == lang and len(h) > len(g) and any(h[i : i + len(words)] == words for i in range(1, len(h))) and 100 * b >= covered * a for h, b in often.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    got, place = set(), Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            got.add((lang, place[lang], phrase.decode(), -a, l, r, sizes[lang], -score))
    return got


@pytest.mark.parametrize("shard", [40, 2_000_000])
def test_collocations(spark, shard):
    r = random.Random(3)
    texts = [" ".join(r.choice(["New York", "new  york\tcity", "the", "of the", "a", "É", "é", "bank. of", "x\n", "of", "new"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += odd_texts() + texts[:3]
    langs = [r.choice(["en", "fr", None, "und"]) for _ in texts]
    docs = documents(spark, texts).drop("lang")
    rows = spark.createDataFrame(list(zip(range(len(texts)), langs)), "k int, lang string").select("lang", (7 * F.col("k") + 50).cast("long").alias("doc_id"))
    got = collocations.collocations(docs.join(rows, "doc_id"), least=4, top=25, shard_words=shard)
    assert {tuple(x) for x in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == plain_collocations(list(zip(texts, langs)), 4, 25)
    assert got.count() > 40


def test_collocations_of_nothing(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(documents(spark, [None, "", "one two"])).count() == 0


def test_one_pair_in_every_text(spark):
    got = collocations.collocations(documents(spark, ["very common " * 30 + f"end{i}" for i in range(50)]), least=10)
    first = got.filter("rank = 1").first()
    assert (first["phrase"], first["a"], first["l"], first["r"]) == ("very common", 1500, 1500, 1500) or first["a"] >= 750


def test_transducers_keep_all_counts_and_share_states():
    r = random.Random(1)
    words = [f"w{i}".encode() for i in range(30)]
    grams = Counter(tuple([*(r.randrange(30) for _ in range(r.randint(1, 3))), -1, -1][:3]) for _ in range(3_000))
    columns = [np.array([0] * len(grams)), *[np.array([g[k] for g in grams]) for k in range(3)]]
    p = automata.summed(words, columns, np.array(list(grams.values())))
    data = automata.build(p, ["en"])
    names, _, (_, a, b, c), count = automata.read(data)
    back = {tuple(-1 if x < 0 else int(names[x][1:]) for x in g): n for g, n in zip(zip(a.tolist(), b.tolist(), c.tolist()), count.tolist())}
    assert back == dict(grams)
    union = automata.Union(most=500)
    for _ in range(5):
        union.add(data)
    u = union.phrases()
    assert int(u.count.sum()) == 5 * sum(grams.values()) and len(u) == len(grams)
    same = automata.summed(words, [np.zeros(20, np.int64), np.arange(20), np.full(20, 3), np.full(20, 7)], np.ones(20, np.int64))
    row = next(iter(__import__("pyarrow").ipc.open_stream(automata.build(same, ["en"]))))
    assert len(row.column("last").values) == 1  # twenty prefixes, one state behind them


# ---------------------------------------------------------------- spelling variants
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows, least_length=6, least_count=5, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def plain_variants(words, times=5):
    out, form = set(), {}
    around = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return out


def made_up(r, n, letters="abé÷"):
    return "".join(r.choice(letters) for _ in range(n))


def test_search_with_one_error():
    r = random.Random(5)
    words = sorted({made_up(r, r.randint(2, 9), "abcé") for _ in range(400)})
    for cells in (16_000_000, 900):
        fmindex.CELLS, before = cells, fmindex.CELLS
        index = fmindex.FMIndex(words)
        fmindex.CELLS = before
        found = set()
        for left in (True, False):
            q, v = index.one_error(words, left)
            pairs = set(zip(q.tolist(), v.tolist()))
            for a, b in pairs:
                h = len(words[a]) // 2
                assert a == b or near(words[a], words[b]) and (words[b].startswith(words[a][:h]) if left else words[b].endswith(words[a][h:]))
            found |= {p for p in pairs if p[0] != p[1]}
        assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


@pytest.mark.parametrize("most", [16_384, 8])
def test_variants(spark, most):
    r = random.Random(7)
    base = [made_up(r, r.randint(6, 9)) for _ in range(25)] + ["common" + made_up(r, 6, "ab") for _ in range(30)]
    words = {}
    for w in base:
        words[w] = r.choice([5, 25, 125, 625])
        for _ in range(6):
            i = r.randrange(len(w))
            words[r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abé") + w[i:], w[:i] + r.choice("abé") + w[i + 1 :]])] = r.randint(5, 130)
    words |= {"zzzzzz": 5, "zzzzzy": 30, "zzzzyy": 160}  # a chain of forms
    words["x" * 3_000], words["x" * 2_999] = 40, 8
    vocab = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(x) for x in spelling.grouped(vocab, most=most).collect()}
    assert got == plain_variants(words)
    assert max(n for *_, n, _ in got) > 5 and any(f and f != root for _, f, root, *_ in got)


def test_slips_and_vocabulary(spark):
    r = random.Random(2)
    texts = [" ".join(made_up(r, r.randint(5, 7), "abÉ") + r.choice(["", "1", "’", "-"]) for _ in range(300)) for _ in range(12)] + odd_texts()
    docs = documents(spark, texts)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 50, F.col("doc_id")))
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    for every in (199, 3):
        got = {x["word"]: x["n"] for x in spelling.vocabulary(spelling.with_slips(spelling.runs(docs), every)).collect()}
        assert got == plain_words(rows, every=every)
    assert {tuple(x) for x in spelling.variants(docs).collect()} == plain_variants(plain_words(rows))
    assert spelling.variants(empty(spark)).count() == 0


# ---------------------------------------------------------------- host rules
def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures():
    r = random.Random(4)
    texts = odd_texts() + [" ".join(r.choice(["a", "b", "#c", "d\n", "\x0b", "\x85é", "d\n"]) for _ in range(r.randint(0, 40))) for _ in range(200)] + ["a\n\n \na\na", "a b c a b c a b"]
    for t in texts:
        assert hostrules.measure(t or "") == plain_measures(t)


def test_hosts(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "spam"
    rows = [("good", good)] * 40 + [("good", bad)] * 4 + [("bad", bad)] * 30 + [("bad", good)] * 2 + [("tiny", bad), (None, good), (None, None)] + [(f"h{i}", good) for i in range(100)]
    docs = spark.createDataFrame([(None if i == 5 else i % 70, t, h, "?", 1) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, host string, refused int")
    got = hostrules.judged(docs).collect()
    assert len(got) == len(rows)
    refused = {x["host"] for x in got if x["host_refused"]}
    assert refused == {"bad"}  # one bad text of a tiny host proves little
    assert Counter((x["host"], x["base_failed"], x["kept"]) for x in got) == Counter((h, t != good, t == good and h != "bad") for h, t in rows)
    v = {x["host"]: x for x in hostrules.host_verdicts(hostrules.measured(docs, F.col("source"))).collect()}
    mean = sum(t != good for _, t in rows) / len(rows)
    rates = [sum(t != good for h, t in rows if h == k) / sum(h == k for h, _ in rows) for k in v]
    strength = max(1, mean * (1 - mean) / np.var(rates) - 1)
    assert v["tiny"]["short_rate"] == pytest.approx((1 + mean * strength) / (1 + strength))
    assert hostrules.judged(empty(spark)).count() == 0
