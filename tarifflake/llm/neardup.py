"""MinHash near-dedup over five-word shingles: ProbMinHash signatures, banding, exact verification, components.

A text (node) is known by a 64-bit hash, so exact copies are one node and cost a row of band keys each. Nodes that
share a band are candidates. No group is expanded into all its pairs: the weight of the shingles that no other
candidate has bounds a node's similarity to any, and nodes below the threshold are left out; each other member of a
band's group is verified against the most central one, and components are formed. Members of groups that are still apart
meet on their rarest shingles only, on so many that a similar pair must have one of them in common. So every candidate pair is verified, ruled out by an exact bound, or inside one
component already. Verification is exact: the probability Jaccard similarity of the whole weighted shingle sets; a shingle
weighs its count.

Words are what stands between white space. Defined cases: a null text counts as empty; texts without words are equal
only to the same text; a text of fewer than five words has one shingle; ``class_id`` is the smallest id of the class,
null ids aside; rows with equal ids are rows of their own; an empty table gives no rows; columns besides ``doc_id`` and
``text`` are not read. With 32 bands of 6 a pair of similarity 0.8 is missed with probability 6e-5, one of 0.85 with 5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .components import components
from .shared import saved

BANDS, ROWS, SIMILARITY = 32, 6, 0.8
#: Classes of shingles by hash, counted per text to bound what two texts have in common.
CLASSES = 64


def _word_hashes():
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _parts(b: pa.RecordBatch, most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of words, one text at least."""
    sizes = np.diff(b.column("words").offsets.to_numpy())
    lo, held = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and held + s > most:
            yield b.slice(lo, i - lo)
            lo, held = i, 0
        held += s
    if lo < b.num_rows:
        yield b.slice(lo)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``node``, ``bands`` (null for texts without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _parts(batch):
                words, sizes = _flat(b.column("words"))
                owner, h, count = minhash.shingles(words, sizes)
                keys = minhash.bands(minhash.signatures(owner, h, minhash.weights(count), len(sizes), bands * rows), rows).view(np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys[sizes > 0].ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), lists], ["doc_id", "node", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), _word_hashes().alias("words"))
    return rows_in.mapInArrow(sign, "doc_id bigint, node bigint, bands array<bigint>")


def _shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, its sorted shingles in 32 bits and their counts, as bytes; ``nodes`` has ``node`` and one of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _parts(batch):
                words, sizes = _flat(b.column("words"))
                owner, h, count = minhash.shingles(words, sizes)
                h = h >> np.uint64(32)
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, np.int64)
                count, h, owner = (np.add.reduceat(count, first) if len(h) else count), h[first], owner[first]  # equal in 32 bits: one
                ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
                cut = [(h[x:y], count[x:y]) for x, y in zip(ends[:-1], ends[1:])]
                items = pa.array([a.astype("<u4").tobytes() for a, _ in cut], pa.binary())
                counts = pa.array([c.astype("<u4").tobytes() if (c > 1).any() else b"" for _, c in cut], pa.binary())
                total = pa.array([float(minhash.weights(c).sum()) for _, c in cut], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column("node"), items, counts, total], ["node", "items", "counts", "total"])

    chosen = nodes.select(F.col("node").alias("__node"), F.col("rep").alias("__rep"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    rows = texts.join(chosen, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__rep")))
    rows = rows.select("node", "text").dropDuplicates(["node"])  # equal rows, and copies under null ids: one set
    return rows.select("node", _word_hashes().alias("words")).mapInArrow(run, "node bigint, items binary, counts binary, total double")


def _items(sets: DataFrame) -> DataFrame:
    """``item``, ``node`` and its weight ``w`` there: the shingles of the sets as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                cut = [(np.frombuffer(x, "<u4"), np.frombuffer(c, "<u4")) for x, c in zip(b.column("items").to_pylist(), b.column("counts").to_pylist())]
                items = np.concatenate([x for x, _ in cut]).astype(np.int64)
                weight = np.concatenate([minhash.weights(c) if len(c) else np.ones(len(x)) for x, c in cut])
                nodes_ = np.repeat(b.column("node").to_numpy(zero_copy_only=False), [len(x) for x, _ in cut])
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(nodes_), pa.array(weight)], ["item", "node", "w"])

    return sets.select("node", "items", "counts").mapInArrow(run, "item bigint, node bigint, w double")


def _shareable(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each of ``nodes``: the ``total`` weight and the weight that it can share with another (``common``: without the
    shingles that it alone has)."""
    nodes = saved(nodes)
    chosen = sets.join(nodes, "node", "left_semi")
    alone = _items(chosen).groupBy("item").agg(F.min("node").alias("node"), F.max("node").alias("__b"), F.min("w").alias("w")).filter("node = __b")
    own = alone.groupBy("node").agg(F.sum("w").alias("__own"))
    return chosen.select("node", "total").distinct().join(own, "node", "left").select("node", "total", (F.col("total") - F.coalesce("__own", F.lit(0.0))).alias("common"))


def bound(p: Column, q: Column) -> Column:
    """The most that the probability Jaccard similarity of two texts can be if at most the shares ``p`` and ``q`` of their
    weights lie on common shingles, whatever the weights are: each common shingle adds at most
    1 / ((1 - p) / x + (1 - q) / y + max(p / x, q / y)), and such terms add up to no more than the term of the sums."""
    return p * q / F.nullif(p + q - p * q, F.lit(0.0))


def _prefix(near: float):
    """Of each node (``items``: sorted by the number of nodes that have them, 0 for those that only its component has) the
    shareable shingles in the first ``1 - near`` of its weight, with the share of its weight that it can share and its
    counts of shareable shingles by class. Counts are cut at 127, which only weakens what they bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                out: list[tuple] = []
                lists = b.column("items")
                flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
                n, item, w = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("n", "item", "w"))
                for i, (node, component, total) in enumerate(zip(*(b.column(c).to_pylist() for c in ("node", "component", "total")))):
                    x = slice(ends[i], ends[i + 1])
                    free = n[x] > 0
                    share = float(w[x][free].sum()) / total
                    if share < near:
                        continue
                    before = np.concatenate([[0.0], np.cumsum(w[x])[:-1]])
                    classes = np.minimum(np.bincount(item[x][free] % CLASSES, minlength=CLASSES), 127).astype(np.int8)
                    out += [(k, node, component, total, share, int(free.sum()), classes) for k in item[x][free & (before <= (1 - near) * total)].tolist()]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int8()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["item", "node", "component", "total", "share", "shareable", "classes"])

    return run


def _prefix_pairs(sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``u``, ``v``) of ``nodes`` (``node``, ``component``) in different components that may reach the
    threshold. A similar pair has that share of the weight of either on common shingles, so the first common shingle in
    an order that both keep (rarest first) lies within the first rest of the weight of both: texts meet on the shingles
    of these prefixes only. By ``bound`` one of a similar pair can share 2s / (1 + s) of its weight, so that texts which
    cannot are never joined with each other. Counts of shareable shingles by class of hash bound a pair's common weight
    further (a shingle weighs one at least): a miss in one text where the other has it shows there."""
    near = similarity - 1e-6
    open_sets = sets.join(nodes, "node")
    totals = saved(open_sets.select("node", "component", "total"))
    with_component = _items(open_sets).join(totals.select("node", "component"), "node")
    seen = with_component.groupBy("item").agg((F.min("component") < F.max("component")).alias("shared"), F.count(F.lit(1)).cast("int").alias("n"))
    rows = _items(open_sets).join(seen, "item").select("node", "item", "w", F.when(F.col("shared"), F.col("n")).otherwise(0).alias("n"))
    lists = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "item", "w"))).alias("items"))
    prefix = lists.join(totals, "node").mapInArrow(_prefix(near), "item bigint, node bigint, component bigint, total double, share double, shareable int, classes array<tinyint>")
    prefix = saved(prefix)
    least = 2 * near / (1 + near)
    a, b = prefix.filter(F.col("share") >= least).alias("a"), prefix.alias("b")
    once = (F.col("b.share") < least) | (F.col("a.node") < F.col("b.node"))
    more = F.aggregate(F.zip_with("a.classes", "b.classes", lambda x, y: F.greatest(x.cast("int") - y, F.lit(0))), F.lit(0), lambda s, x: s + x)
    p = F.col("a.share") - more / F.col("a.total")
    q = F.col("b.share") - (more - F.col("a.shareable") + F.col("b.shareable")) / F.col("b.total")
    on = (F.col("a.item") == F.col("b.item")) & (F.col("a.component") != F.col("b.component")) & once
    on = on & (bound(F.col("a.share"), F.col("b.share")) >= near) & (bound(F.greatest(p, F.lit(0.0)), F.greatest(q, F.lit(0.0))) >= near)
    return a.join(b, on).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``u``, ``v``) whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for items, counts, other, other_counts in zip(*(b.column(c).to_pylist() for c in ("items", "counts", "items2", "counts2"))):
                x, y = np.frombuffer(items, "<u4"), np.frombuffer(other, "<u4")
                cx = minhash.weights(np.frombuffer(counts, "<u4")) if counts else np.ones(len(x))
                cy = minhash.weights(np.frombuffer(other_counts, "<u4")) if other_counts else np.ones(len(y))
                keep.append(minhash.probability_jaccard(x, cx, y, cy) >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(keep, pa.bool_())), b.column("v").filter(pa.array(keep, pa.bool_()))], ["u", "v"])

    left = sets.select(F.col("node").alias("u"), "items", "counts")
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("items2"), F.col("counts").alias("counts2"))
    return saved(pairs.join(left, "u").join(right, "v").select("u", "v", "items", "counts", "items2", "counts2").mapInArrow(run, "u bigint, v bigint"))


def _with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``node``, ``class_id``, ``component`` (the smallest node of the class) and ``kept`` of every row."""
    base = saved(signed(docs, bands, rows))
    reps = base.groupBy("node").agg(F.min("doc_id").alias("rep"))
    keyed = base.select("node", F.explode("bands").alias("k"))
    groups = keyed.groupBy("k").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("k")
    members = saved(keyed.join(groups, "k").distinct())
    sets = saved(_shingle_sets(docs, reps.join(members.select("node").distinct(), "node")))
    bounds = saved(_shareable(sets, members.select("node").distinct()).filter(F.col("common") >= (similarity - 1e-6) * F.col("total")))
    members = saved(members.join(bounds, "node"))

    # of a band's group, the member with the least of its own is likely to be near the others
    central = F.struct(F.col("common") / F.col("total"), "node")
    pivots = members.groupBy("k").agg(F.max_by("node", central).alias("pivot"))
    star = members.join(pivots, "k").filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    links = _verified(star, sets, similarity)

    first = saved(components(links))
    labelled = saved(_with_component(members.select("node", "k"), first))
    parts = labelled.groupBy("k").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one < other").select("k")
    open_nodes = saved(labelled.join(parts, "k", "left_semi").select("node", "component").distinct())
    more = _verified(_prefix_pairs(sets, open_nodes, similarity), sets, similarity)

    # links between components join whole components
    ends = [open_nodes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")) for c in "uv"]
    between = more.join(ends[0], "u").join(ends[1], "v").select(F.col("u_of").alias("u"), F.col("v_of").alias("v"))
    joined = components(between).select(F.col("node").alias("__c"), F.col("component").alias("__whole"))
    labelled = _with_component(reps, first).join(joined, F.col("component") == F.col("__c"), "left")
    labelled = saved(labelled.select("node", "rep", F.coalesce("__whole", "component").alias("component")))
    # class ids may be null or stand for several classes: a class is known by its smallest node
    first = F.struct(F.col("rep").isNull(), "rep", "node")
    named = labelled.groupBy("component").agg(F.min("rep").alias("class_id"), F.min_by("node", first).alias("first"))
    named = labelled.select("node", "component").join(named, "component")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first"))
    return base.select("doc_id", "node").join(named, "node").withColumn("kept", kept).select("doc_id", "node", "class_id", "component", "kept")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id``, ``kept`` (the row with the smallest id of its class; equal rows alike) and
    ``class_node``, which tells classes apart whose rows have no ids or the same."""
    return classes(docs).select("doc_id", "class_id", "kept", F.col("component").alias("class_node"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with the smallest id (of equal rows, one)."""
    stay = classes(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(stay, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__node")))
    return kept.dropDuplicates(["__id", "__node"]).select(*docs.columns)
