"""Jaccard join on word n-grams by vertical partitioning: partial overlaps are counted fragment by fragment and summed per pair.

The global n-gram order puts rare n-grams first: n-grams are counted over all documents in ``SLOTS`` hash slots, and slots are ordered by
their counts.  Any order gives right results, so slots bound the memory of the counts, not the result.  The order is cut into ``FRAGMENTS`` of
equally many occurrences, and a document's set into as many segments.

1. Rows with equal sets are one node.  A node is listed under the n-grams of its prefix: two sets that reach the similarity share one there.
2. In every list all nodes meet one of them, taken by a hash of list and node; in the next rounds the nodes outside a list's largest component meet
   another one of that component.  A pair is kept if the sizes, the places of the shared n-gram in both sets, and the overlap of both prefixes allow enough overlap.  For each fragment the two segments are counted against each other; the sums per pair
   decide.  Links form components.
3. In lists that still hold several components, all pairs across them are tested the same way, so no link between components is lost.
   Nodes outside a list's largest component meet the whole list in blocks, and only pairs that pass the tests of size and place become rows.

A component holds all rows that are reachable over links.  NULL and empty texts, or texts of white space, have an empty set and no link.  Fewer words
than an n-gram's are one n-gram.  Repeated rows are one node.  Long texts are read whole; their segments are dealt over the tasks.  NULL ids rank
last as names of components.  An empty table gives an empty result.  Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import is_empty, keyed, mix, rows_with, salted_join, table
from emberlog.llm.components import components
from emberlog.llm.hamming_minhash import shingle_sets
from emberlog.session import cut_lineage

#: Bits of an n-gram's slot; slots of a block of counts; fragments of the global order.
SLOT_BITS, SLOT_BLOCK, FRAGMENTS = 20, 1 << 14, 4
SLOTS = 1 << SLOT_BITS
#: Rounds in which lists meet single nodes, before all pairs across components are tested.
ROUNDS = 2
#: Nodes of a list that are compared in one block, as hosts and as guests.
HOSTS, GUESTS = 512, 512
#: Bits of the filter that keeps n-grams of a single prefix out of a shuffle.
FILTER_BITS = 24
#: Fingerprints of sets that a task remembers to leave out repeats.
SEEN = 1 << 18
SKETCH = "struct<n:bigint,s1:bigint,s2:bigint,counts:binary>"
SEED = 20_250_613


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _prints(grams: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set."""
    with np.errstate(over="ignore"):
        return int(grams.sum(dtype=np.uint64).astype(np.int64)), int(mix(grams + np.uint64(SEED)).sum(dtype=np.uint64).astype(np.int64))


def _sketch_udf(k: int):
    """Size and fingerprints of each row's set; the first row of a batch also holds the batch's counts by slot."""

    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        sizes, s1, s2, slots = [], [], [], [np.zeros(0, np.int64)]
        for grams in shingle_sets(texts, k):
            a, b = _prints(grams)
            sizes.append(len(grams))
            s1.append(a)
            s2.append(b)
            slots.append(_slot(grams))
        counts = np.bincount(np.concatenate(slots), minlength=SLOTS).astype("<u4")
        held = [counts.tobytes(), *[None] * (len(sizes) - 1)] if sizes else []
        arrays = [pa.array(x, pa.int64()) for x in (sizes, s1, s2)]
        return pa.StructArray.from_arrays([*arrays, pa.array(held, pa.binary())], ["n", "s1", "s2", "counts"])

    return sketch


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task, in blocks of slots."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for counts in batch.column(0):
            total += np.frombuffer(counts.as_buffer(), "<u4")
    parts = total.reshape(-1, SLOT_BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], ["block", "counts"])


def _summed(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), "<i8") for c in parts.column("counts"))
    return pa.table({"block": parts.column("block").slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


class Order:
    """The global order: the rank of each slot and the first rank of each fragment.  ``SLOTS`` small numbers, whatever the input."""

    def __init__(self, rows: DataFrame):
        held = rows.filter(F.col("sketch.counts").isNotNull()).select(F.col("sketch.counts").alias("counts"))
        by_block = held.mapInArrow(_added, "block int, counts binary").groupBy("block").applyInArrow(_summed, "block int, counts binary")
        counts = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.int64)
        for r in by_block.collect():
            counts[r["block"]] = np.frombuffer(r["counts"], "<i8")
        counts = counts.ravel()
        slots = np.argsort(counts, kind="stable")
        self.rank = np.empty(SLOTS, np.uint32)
        self.rank[slots] = np.arange(SLOTS, dtype=np.uint32)
        share = np.cumsum(counts[slots])
        self.cuts = np.searchsorted(share, share[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)

    def sort(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of an ascending set in the global order, and their ranks."""
        rank = self.rank[_slot(grams)]
        order = np.argsort(rank, kind="stable")
        return grams[order], rank[order]


def _prefixes(order, k: int, percent: int):
    """Of each set that the task has not met its prefix in the global order: ``(cid, n, last, grams)``, ``last`` the rank where it ends."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for i, own in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if own not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            sizes, ends, found = [], [], [np.zeros(0, np.uint64)]
            for grams in shingle_sets(batch.column(3), k):
                n = len(grams)
                ordered, rank = order.value.sort(grams)
                first = n - -(-percent * n // 100) + 1
                sizes.append(n)
                ends.append(int(rank[first - 1]))
                found.append(ordered[:first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ends, pa.int64()), _lists_of(found[1:])], ["cid", "n", "last", "grams"])

    return prefixes


def _lists_of(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _bit(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter bits of a task's n-grams, in blocks that are not empty."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_bit(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))] = True
    parts = np.packbits(bits).reshape(-1, SLOT_BLOCK)
    at = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([parts[i].tobytes() for i in at], pa.binary())], ["block", "bits"])


def _either(parts: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(c.as_buffer(), np.uint8) for c in parts.column("bits")])
    return pa.table({"block": parts.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def _filter(shared: DataFrame):
    """A bit for every n-gram of ``shared``, sent to all tasks: ``1 << FILTER_BITS`` bits whatever their number."""
    bits = np.zeros(((1 << FILTER_BITS) // 8 // SLOT_BLOCK, SLOT_BLOCK), np.uint8)
    for r in shared.mapInArrow(_marked, "block int, bits binary").groupBy("block").applyInArrow(_either, "block int, bits binary").collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return shared.sparkSession.sparkContext.broadcast(bits.ravel())


def _passed(bits):
    """The n-grams of prefixes that pass the filter: ``(gram, cid, n, last, pos)``."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            grams = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            offsets -= offsets[0]
            at = _bit(grams.view(np.uint64))
            keep = np.flatnonzero((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            row = np.searchsorted(offsets, keep, "right") - 1
            took = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(grams[keep]), *[batch.column(i).take(took) for i in range(3)], pa.array(keep - offsets[row])], ["gram", "cid", "n", "last", "pos"])

    return passed


def _segments(order, k: int):
    """The segments ``(cid, fragment, grams)`` of each set, ascending."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, grams in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                ordered, rank = order.value.sort(grams)
                ends = np.concatenate([[0], np.searchsorted(rank, order.value.cuts), [len(rank)]])
                parts = [(f, np.sort(ordered[a:b])) for f, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
                arrays = [pa.array([cid] * len(parts), pa.int64()), pa.array([f for f, _ in parts], pa.int32()), pa.array([p.view(np.int64) for _, p in parts], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["cid", "fragment", "grams"])

    return segments


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Partial overlaps of pairs of segments."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        out.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
    return pa.array(out, pa.int64())


def _may_link(percent: int) -> Column:
    """Whether two nodes of a list may link, by what is known of each alone.

    Sizes must be near each other, and the places of the shared n-gram, if it is the first one shared, must leave room for enough overlap.
    Up to the rank where the first of the two prefixes ends, all that the sets share stands in both prefixes and so in lists: that set
    can share no more than ``most``, its listed n-grams and all beyond its prefix.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    after = F.least(n_a - F.col("pos_a"), n_b - F.col("pos_b"))
    first = F.when(F.col("last_a") < F.col("last_b"), F.col("most_a")).when(F.col("last_a") > F.col("last_b"), F.col("most_b")).otherwise(F.greatest("most_a", "most_b"))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * F.least(after, first) >= percent * (n_a + n_b))


def _as(end: str) -> list[Column]:
    return [F.col("cid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "pos", "last", "most")]]


def _each_once(pairs: DataFrame) -> DataFrame:
    turned = F.col("a") > F.col("b")
    sizes = {"n_a": F.when(turned, F.col("n_b")).otherwise(F.col("n_a")), "n_b": F.when(turned, F.col("n_a")).otherwise(F.col("n_b"))}
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c.alias(name) for name, c in sizes.items()]).distinct()


def confirmed(pairs: DataFrame, texts, order, k: int, percent: int) -> DataFrame:
    """Links among written ``pairs (a, b, n_a, n_b)``: partial overlaps of their segments, summed per pair."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
    segments = cut_lineage(texts(ids).mapInArrow(_segments(order, k), "cid bigint, fragment int, grams array<bigint>"))
    met = pairs.join(segments.select(F.col("cid").alias("a"), "fragment", F.col("grams").alias("own")), "a")
    met = met.join(segments.select(F.col("cid").alias("b"), "fragment", "grams"), ["b", "fragment"])
    partial = met.select("a", "b", "n_a", "n_b", F.arrow_udf(_common, "bigint")("own", "grams").alias("common"))
    whole = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return whole.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _placed(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``lists`` with the ``component`` of each node, its own name if it has no link yet."""
    if labels is None:
        return lists.withColumn("component", F.col("cid"))
    return lists.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _stars(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """In lists of several components, the nodes outside the largest with one node of it.

    First with the node that has the fewest n-grams of its own, as others are the likeliest to link with it; then with any.
    """
    chance = F.xxhash64(F.lit(turn), "gram", "cid")
    order = [F.col("most") / F.col("n"), chance] if turn == 0 else [chance]
    pivot = F.max(F.struct(F.struct(*order).alias("order"), F.struct(*_as("b")).alias("end"))).alias("pivot")
    parts = placed.groupBy("gram", "component").agg(F.count("*").alias("size"), pivot)
    top = F.max(F.struct("size", "pivot", "component")).alias("top")
    tops = parts.groupBy("gram").agg(top, F.count("*").alias("parts")).filter(F.col("parts") > 1)
    tops = tops.select("gram", F.col("top.component").alias("of_b"), "top.pivot.end.*")
    met = placed.select("gram", *_as("a"), F.col("component").alias("of_a")).join(tops, "gram")
    return _each_once(met.filter((F.col("of_a") != F.col("of_b")) & _may_link(percent)))


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes of different components that share a list and may link."""
    sizes = placed.groupBy("gram", "component").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("gram").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("hosts"), F.count("*").alias("components")).filter(F.col("components") > 1)
    loads = sizes.select(
        "gram", F.col("top.component").alias("top"),
        F.floor(F.col("hosts") / HOSTS).cast("int").alias("blocks"), F.floor((F.col("hosts") - F.col("top.size")) / GUESTS).cast("int").alias("parts"),
    )
    here = placed.join(loads, "gram")

    def dealt(own: str, other: str) -> list[Column]:
        """A node's own share, and a copy for each share of the other side."""
        return [F.pmod(F.xxhash64("cid"), F.col(own) + 1).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other))).alias(other)]

    host = here.select("gram", *dealt("blocks", "parts"), *_as("a"), F.col("component").alias("of_a"), (F.col("component") == F.col("top")).alias("top_a"))
    guest = here.filter(F.col("component") != F.col("top"))
    guest = guest.select("gram", *dealt("parts", "blocks"), *_as("b"), F.col("component").alias("of_b"))
    same = [host[c] == guest[c] for c in ("gram", "blocks", "parts")]
    # Two guests meet once, as the one of the lesser component is the host; hosts of the largest component meet every guest.
    apart = (F.col("of_a") != F.col("of_b")) & (F.col("top_a") | (F.col("of_a") < F.col("of_b")))
    met = host.join(guest, same[0] & same[1] & same[2] & apart & _may_link(percent))
    return _each_once(met.select("a", "b", "n_a", "n_b"))


def _lists(held: DataFrame, copies: DataFrame) -> DataFrame:
    """Written ``(gram, cid, n, last, pos, listed)`` of the n-grams that several nodes hold in their prefixes; ``listed`` counts a node's lists."""
    several = F.count("*").alias("members")
    shared = held.select(F.explode("grams").alias("gram")).groupBy("gram").agg(several).filter(F.col("members") > 1).select("gram")
    shared = cut_lineage(shared)
    near = held.mapInArrow(_passed(_filter(shared)), "gram bigint, cid bigint, n bigint, last bigint, pos bigint")
    met = near.join(shared, "gram").join(copies.withColumnRenamed("rid", "cid"), "cid", "left")
    met = cut_lineage(met.select("gram", F.coalesce("node", "cid").alias("cid"), "n", "last", "pos").distinct())
    met = cut_lineage(met.join(met.groupBy("gram").agg(several).filter(F.col("members") > 1).select("gram"), "gram"))
    return cut_lineage(met.join(met.groupBy("cid").agg(F.count("*").alias("listed")), "cid"))


def _alike(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Written ``pairs (a, b, n_a, n_b)`` whose prefixes have enough in common.

    Up to the rank where the first of the two prefixes ends, all that the sets share stands in both prefixes; beyond it at most the
    rest of that set can be shared.
    """
    for end in ("a", "b"):
        pairs = pairs.join(profiles.select(F.col("cid").alias(end), F.col("last").alias(f"last_{end}"), F.col("grams").alias(f"grams_{end}")), end)
    rest = {end: F.ceil(F.lit(percent) * F.col(f"n_{end}") / 100) - 1 for end in ("a", "b")}
    beyond = F.when(F.col("last_a") < F.col("last_b"), rest["a"]).when(F.col("last_a") > F.col("last_b"), rest["b"]).otherwise(F.greatest(rest["a"], rest["b"]))
    most = F.size(F.array_intersect("grams_a", "grams_b")) + beyond
    enough = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    return cut_lineage(pairs.filter(enough).select("a", "b", "n_a", "n_b"))


def _node_components(lists: DataFrame, texts, order, k: int, percent: int) -> DataFrame:
    """``(node, component)`` for every node that has a link."""
    lists = lists.withColumn("most", F.col("listed") + F.ceil(F.lit(percent) * F.col("n") / 100) - 1)
    profiles = cut_lineage(lists.groupBy("cid").agg(F.first("last").alias("last"), F.collect_list("gram").alias("grams")))

    def links(pairs: DataFrame) -> DataFrame:
        return cut_lineage(confirmed(_alike(pairs, profiles, percent), texts, order, k, percent))

    labels = None
    for turn in range(ROUNDS + 1):
        placed = cut_lineage(_placed(lists, labels))
        more = links(_stars(placed, turn, percent) if turn < ROUNDS else _across(placed, percent))
        if labels is not None:
            if is_empty(more):
                continue
            more = more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = cut_lineage(components(more))
    return labels


def gram_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id`` (least id reachable over links)."""
    rows = keyed(docs.select("doc_id", "text"), sketch=_sketch_udf(k)(F.col("row.text")))
    flat = rows.select("rid", F.col("row.doc_id").alias("doc_id"), "sketch.n", "sketch.s1", "sketch.s2")
    order = docs.sparkSession.sparkContext.broadcast(Order(rows))
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    nodes = flat.filter(F.col("n") > 0).groupBy("n", "s1", "s2").agg(F.min(ordered).alias("first"), F.count("*").alias("n_rows"))
    nodes = cut_lineage(nodes.withColumn("node", F.col("first.rid")))
    several = nodes.filter(F.col("n_rows") > 1).select("n", "s1", "s2", "node")
    copies = salted_join(flat, several, ["n", "s1", "s2"], F.col("rid"), "inner").filter(F.col("rid") != F.col("node"))
    copies = cut_lineage(copies.select("rid", "node"))
    held = rows.filter(F.col("sketch.n") > 0).select("rid", "sketch.s1", "sketch.s2", F.col("row.text").alias("text"))
    held = cut_lineage(held.mapInArrow(_prefixes(order, k, percent), "cid bigint, n bigint, last bigint, grams array<bigint>"))

    def texts(ids: DataFrame) -> DataFrame:
        return rows_with(rows.select("rid", F.col("row.text").alias("text")), ids)

    labels = _node_components(_lists(held, copies), texts, order, k, percent)
    placed = nodes.select("node", "first").join(labels, "node")
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    placed = cut_lineage(salted_join(placed, least, ["component"], F.col("node"), "inner").select("node", F.col("least.doc_id").alias("component_id")))
    # A copy has the component of its node, any other row its own.
    alone = nodes.filter(F.col("n_rows") > 1).select("node", F.col("first.doc_id").alias("component_id")).join(placed.select("node"), "node", "left_anti")
    of_nodes = cut_lineage(placed.unionByName(alone))
    of_copies = salted_join(copies, of_nodes, ["node"], F.col("rid"), "inner").select("rid", "component_id")
    named = of_nodes.select(F.col("node").alias("rid"), "component_id").unionByName(of_copies).withColumn("named", F.lit(True))
    out = flat.join(named, "rid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_vertical_jaccard(spark, sf_dir: str) -> DataFrame:
    return gram_components(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams
    FROM words
), flat AS (SELECT r, len(grams) AS n, unnest(grams) AS gram FROM sets
), links AS (
    SELECT a.r AS x, b.r AS y FROM flat a JOIN flat b ON a.gram = b.gram AND a.r < b.r
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (SELECT r AS x, r AS y FROM sets UNION SELECT c.x, b.y FROM reached c JOIN both_ways b ON b.x = c.y
), least AS (SELECT c.x, min(s.doc_id) AS component_id FROM reached c JOIN sets s ON s.r = c.y GROUP BY c.x)
SELECT s.doc_id, len(grams) AS n_shingles, l.component_id FROM sets s JOIN least l ON l.x = s.r
"""
