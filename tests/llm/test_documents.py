"""Operators over documents against plain versions on small tables."""

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarifflake.llm import fingerprints, minhash, mixing, neardup, pieces, quality, substrings, tokens

from .small import documents, empty, odd_texts, words


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def ids(n):
    return [7 * i + 50 for i in range(n)]


# fingerprints


def test_fingerprints(spark):
    texts = odd_texts()
    got = by_id(fingerprints.fingerprint_documents(documents(spark)))
    prints = collections.defaultdict(set)
    for k, i in enumerate(ids(len(texts))):
        t, after = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[t].add(got[i]["fingerprint"])
        if edited == t:
            assert got[i]["near_edited"] == 1
        if t == after:
            assert got[i]["near_next"] == 1
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert got[50 + 7 * 7]["class_id"] == got[50 + 7 * 8]["class_id"] == 50 + 7 * 7


def test_fingerprint_votes(spark):
    """The counters against a plain vote with the same hashes."""
    words = "some words vote here and some words vote twice".split()
    df = spark.createDataFrame([(1, " ".join(words))], "uid long, text string")
    hashes = {r["w"]: (r["a"], r["b"]) for r in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w").alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).collect()}
    got = fingerprints.simhash(df, "text", ["uid"]).first()
    for half in (0, 1):
        want = 0
        for bit in range(64):
            vote = sum(len(w) if (hashes[w][half] >> bit) & 1 else -len(w) for w in words)
            want |= (vote > 0) << bit
        assert got[f"f{half}"] & (2**64 - 1) == want


@pytest.mark.parametrize("radius,blocks", [(3, 4), (2, 4), (5, 8)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    near = [(a ^ sum(1 << int(b) for b in rng.integers(0, 62, 3)), b) for a, b in zip(base[::2], base[1::2])]
    all_ = sorted({*zip(base[::2], base[1::2]), *near})
    df = spark.createDataFrame(all_, "f0 long, f1 long")
    got = {(r.q0, r.q1, r.f0, r.f1): r.distance for r in fingerprints.within_radius(df, df, radius, blocks).collect()}
    want = {}
    for a in all_:
        for b in all_:
            d = bin((a[0] ^ b[0]) & (2**64 - 1)).count("1") + bin((a[1] ^ b[1]) & (2**64 - 1)).count("1")
            if d <= radius:
                want[(*a, *b)] = d
    assert got == want


def test_next_over_ties_and_one_row(spark):
    got = fingerprints.fingerprint_documents(documents(spark, ["b", "a", "c"], [5, 5, None])).collect()
    edited = sorted((r["doc_id"] or -1, r["n_chars"]) for r in got)
    assert edited == [(-1, 1), (5, 1), (5, 1)]
    one = fingerprints.fingerprint_documents(documents(spark, ["alone here"], [3])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"alonealone").hexdigest()
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0


# near duplicates


def plain_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            keys = set(x) | set(y)
            j = sum(1 / sum(max(x[k] / x[i], y[k] / y[i]) for k in keys) for i in set(x) & set(y))
            if (texts[a] or "") == (texts[b] or "") or j >= 0.8:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(len(texts))]


def test_texts_of_shared_blocks_meet_without_pairs(spark):
    """One common passage, four of fourteen shared blocks, every word several times: no text has anything of its own, and
    all repeat their shingles. Near copies of some are found; texts that share too little are not joined."""
    r = random.Random(8)
    passage, blocks = [words(r, 30)] * 2, [words(r, 25) for _ in range(14)]
    texts = [" ".join(passage + [b for b in r.sample(blocks, 4) for _ in range(2)]) for _ in range(40)]
    for t in texts[:6]:
        w = t.split()
        w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    got = by_id(neardup.near_duplicates(documents(spark, texts)))
    want = plain_classes(texts)
    assert [got[i]["class_id"] for i in ids(len(texts))] == [50 + 7 * c for c in want]
    assert 6 <= len(texts) - len(set(want)) < 20


def test_share_bound_holds_for_any_weights():
    r = np.random.default_rng(3)
    for _ in range(400):
        n = r.integers(1, 9)
        x, y = (np.where(r.random(n) < 0.7, r.integers(1, 30, n).astype(float) ** r.integers(1, 4), 0) for _ in range(2))
        if x.sum() and y.sum():
            a, b = np.flatnonzero(x), np.flatnonzero(y)
            both = np.intersect1d(a, b)
            p, q = x[both].sum() / x.sum(), y[both].sum() / y.sum()
            j = minhash.probability_jaccard(a, x[a], b, y[b])
            assert j <= (p * q / (p + q - p * q) if p and q else 0) + 1e-9


def test_near_duplicates(spark):
    texts = odd_texts()
    base = texts[7].split()
    for k in range(12):  # a chain of edits: neighbours are similar, the ends are not
        base[k * 9] = f"edit{k}"
        texts.append(" ".join(base))
    got = by_id(neardup.near_duplicates(documents(spark, texts)))
    want = plain_classes(texts)
    assert [got[i]["class_id"] for i in ids(len(texts))] == [50 + 7 * c for c in want]
    kept = neardup.one_of_each(documents(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({50 + 7 * c for c in want})
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["a b c d e f g"] * 3 + ["x y z"], [4, 4, None, 9])
    assert sorted((r["doc_id"] or -1, r["class_id"]) for r in neardup.near_duplicates(docs).collect()) == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    assert sorted(r["doc_id"] for r in neardup.one_of_each(docs).collect()) == [4, 9]


def test_near_duplicates_across_the_length_of_known_rare_shingles(spark):
    """A similar pair of 1,900 and 2,050 words whose band groups have other members as pivots."""
    part = [" ".join(f"p{i}w{k}" for k in range(370)) for i in range(5)]
    other = [" ".join(f"t{i}w{k}" for k in range(580)) for i in range(40)]
    texts = []
    for i, (a, b) in enumerate(4 * list(itertools.combinations(range(5), 2))):  # what one of these has, another has too
        texts.append(" ".join([part[a], part[b], other[i], other[(i + 1) % 40]]))
    texts += [" ".join([*part, *(f"u{k}" for k in range(50))]), " ".join([*part, *(f"v{k}" for k in range(200))])]
    got = neardup.classes(documents(spark, texts, list(range(len(texts)))), bands=8, rows=1).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: min(i, 40) for i in range(42)}


def test_near_duplicates_of_repeated_rows(spark):
    """Rows that stand several times, with and without an id, each with a near copy of similarity 0.81."""
    texts, at = [], []
    for i, a, b in ((0, 4, 9), (1, None, 2)):
        base = [f"r{i}w{k}" for k in range(200)]
        near = [f"changed{k}" if k % 50 == 20 else w for k, w in enumerate(base)]
        texts += [" ".join(base)] * 4 + [" ".join(near)]
        at += [a] * 4 + [b]
    got = neardup.near_duplicates(documents(spark, texts, at)).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"]) for r in got) == [(-1, 2)] * 4 + [(2, 2)] + [(4, 4)] * 4 + [(9, 4)]


def test_one_of_each_of_texts_under_null_and_equal_ids(spark):
    texts = ["one text without an id", "another text without an id", "first words under three", "other words under three", "first words under three", "x y"]
    docs = documents(spark, texts, [None, None, 3, 3, 3, 8])
    kept = neardup.one_of_each(docs).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted({(i or -1, t) for i, t in zip([None, None, 3, 3, 3, 8], texts)})
    got = neardup.near_duplicates(docs).collect()
    assert all(r["kept"] for r in got) and len({r["class_node"] for r in got}) == 5


def test_near_duplicates_weigh_shingles_by_count(spark):
    """Two texts of 200 times one block and words of their own: 0.98 by counts, 0.66 if counts are damped."""
    block = " ".join(f"b{k}" for k in range(100))
    texts = [" ".join([block] * 200 + [f"{c}{k}" for k in range(150)]) for c in "xy"]
    got = neardup.near_duplicates(documents(spark, texts, [1, 2])).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(1, 1), (2, 1)}


# quality


def test_quality(spark):
    rows = []
    for i in range(400):
        good = i % 2 == 0
        text = f"Some plain words stand here, number after number, in line {i}. And more." if good else f"BUY!! NOW!! {'$$$ ' * (i % 5 + 1)}CLICK!! {i}!!"
        rows.append((i, text))
    texts = [t for _, t in rows] + [None, ""]
    docs = documents(spark, texts, list(range(402)))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)] + [(0, None), (None, 1)], "doc_id long, label int")
    got = by_id(quality.scored(docs, labels))
    assert len(got) == 402
    for i in range(400):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    held = [i for i in range(400) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 2 == 0) for i in held]) > 0.97
    assert got[400]["score"] == got[401]["score"] and 0 <= got[400]["score"] <= 1
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i in got if got[i]["predicted"]}


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality.scored(documents(spark), labels).collect()} == {0.5}
    assert quality.scored(empty(spark), labels).count() == 0


def test_discriminant_is_the_gaussian_ratio():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = {k: rng.normal(k, 1 + k, (500, d)) for k in (0, 1)}
    moments = {k: np.hstack([np.ones((500, 1)), v]).T @ np.hstack([np.ones((500, 1)), v]) for k, v in x.items()}
    model = quality.fit(moments, pooled=0, diagonal=0, floor=0)
    point = rng.normal(0.5, 1, (3, d))
    for p, got in zip(point, model.score(point)):
        logs = []
        for k in (0, 1):
            m, c = x[k].mean(0), np.cov(x[k].T, bias=True)
            logs.append(-0.5 * ((p - m) @ np.linalg.solve(c, p - m) + np.linalg.slogdet(c)[1]))
        assert abs(got - 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))) < 1e-6


# mixing


def plain_targets(sizes, weights):
    total, left, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    rest = float(total)
    while left:
        share = rest / sum(weights[i] for i in left)
        over = [i for i in left if share * weights[i] > 3 * sizes[i]]
        if not over:
            for i in left:
                target[i] = share * weights[i]
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            rest -= target[i]
            left.remove(i)
    return target


@pytest.mark.parametrize("texts", [odd_texts(), ["w " * n for n in (1, 2, 900, 40, 0, 3, 700, 5, 6, 800)]])
def test_mix(spark, texts):
    docs = documents(spark, texts)
    got = by_id(mixing.mix_figures(docs, block=16))
    names = ["Z", "a", "b", "é", None]
    sources = dict(zip(ids(len(texts)), [["a", "b", None, "Z", "é"][k % 5] for k in range(len(texts))]))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(ids(len(texts)), texts)}
    sums = [sum(size[i] for i in size if sources[i] == s) for s in names]
    target = plain_targets(sums, [5, 2, 1, 5, 2])
    for k, s in enumerate(names):
        rows = [r for i, r in got.items() if sources[i] == s]
        assert all(r["source_size"] == sums[k] and abs(r["target"] - target[k]) < 1e-6 for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target[k]) <= 0.5
    assert all(r["size"] == size[i] and r["taken"] <= 3 * r["size"] for i, r in got.items())
    again = by_id(mixing.mix_figures(docs.repartition(3), block=16))
    assert again == got
    mixed = mixing.mixed_documents(docs, block=16).groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in mixed} == {i: r["taken"] for i, r in got.items() if r["taken"]}


def test_mix_of_nothing(spark):
    assert mixing.mix_figures(empty(spark)).count() == 0
    assert [r["taken"] for r in mixing.mix_figures(documents(spark, ["", None])).collect()] == [0, 0]


def test_permutation(spark):
    for n in (1, 2, 37, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("bigint"))
        got = [r["p"] for r in mixing.permuted(df, "id", "n", F.lit(3), "p").orderBy("id").collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000)) and abs(np.corrcoef(got, range(1000))[0, 1]) < 0.15


# pieces and token files


def test_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts() + ["  two  spaces \n\n\tx", "▁mark", "a\x00b", "<s> </s>", "----====    ", "hahaha aaaa"]
    got = by_id(pieces.encoded(documents(spark, texts), lambda: pieces.encoder(path)))
    for i, t in zip(ids(len(texts)), texts):
        want = model.encode(t or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(model.decode(want).encode()).hexdigest()
    rows = pieces.with_ids(documents(spark, texts), lambda: pieces.encoder(path)).collect()
    assert all(r["ids"] == model.encode(t or "", add_bos=True, add_eos=True) for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), texts))
    assert pieces.encoded(empty(spark), lambda: pieces.encoder(path)).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts() + ["It's we'll don't 12,5 <|endoftext|> x", "É é Σς İ ﬁ", "<|startoftext|>"]
    got = by_id(tokens.read_token_files(tokens.write_token_files(documents(spark, texts), lambda: tokens.encoder(path))))
    start = 0
    for i, t in zip(ids(len(texts)), texts):
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert tuple(got[i]) == (i, start, len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
        start += len(want)
    assert tokens.read_token_files(tokens.write_token_files(empty(spark), lambda: tokens.encoder(path))).count() == 0
    ties = tokens.read_token_files(tokens.write_token_files(documents(spark, ["b", "a", "c"], [5, 5, None]), lambda: tokens.encoder(path))).collect()
    assert sorted((r["start"], r["doc_id"]) for r in ties) == [(0, None), (2, 5), (4, 5)]


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32 - 1])
def test_blocks(high):
    rng = np.random.default_rng(high)
    for n in (1, 7, 512):
        ids_ = rng.integers(0, high, n).astype(np.uint32)
        ids_[: n // 20] = high
        for share in (0.5, 0.9, 1.0):
            assert (tokens.decode_block(tokens.encode_block(ids_, share)) == ids_).all()


# repeated strings


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [256, 1])
def test_repeated_strings(spark, most, monkeypatch):
    monkeypatch.setattr(substrings.repeated_starts, "__defaults__", (substrings.LENGTH, substrings.GRAM, most))
    texts = odd_texts() + ["aba" * 500, "x" * 199, "x" * 201, "y" * 200]
    got = by_id(substrings.without_repeats(documents(spark, texts)))
    assert [tuple(got[i])[1:] for i in ids(len(texts))] == plain_repeats(texts, 200)


def test_repeated_strings_of_repeated_rows(spark):
    text = odd_texts()[7]
    rows = substrings.without_repeats(documents(spark, [text, text, "short"], [1, 1, 2])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(text), len(text)]
    assert substrings.without_repeats(empty(spark)).count() == 0
    kept = substrings.trimmed(documents(spark)).collect()
    want = [(hashlib.sha256((t or "").encode()).hexdigest(), w) for t, w in zip(odd_texts(), plain_repeats(odd_texts(), 200))]
    assert len(kept) == sum(t not in (None, "") and w[0] > w[1] for t, (_, w) in zip(odd_texts(), want))


def test_suffix_sort():
    from tarifflake.llm.suffixes import Suffixes

    rng = np.random.default_rng(2)
    for n, letters in ((200, 2), (300, 1), (400, 20)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        starts = np.arange(n - 20)
        order = Suffixes(data).sort(starts, np.zeros(len(starts)), 20)
        found = [data[i : i + 20].tobytes() for i in order]
        assert found == sorted(found) and sorted(order) == list(starts)
