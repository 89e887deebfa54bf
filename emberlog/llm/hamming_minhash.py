"""Near-duplicate detection: MinHash signatures matched by a multi-index Hamming join.

A document's set holds its distinct word shingles.  Its signature has ``LENGTH`` symbols of ``BITS`` bits, the scrambled
minima of as many hash functions.  Signatures are cut into ``CHUNKS`` chunks, and a chunk is indexed once for every choice of ``ERRORS``
symbols left out.  By the pigeonhole principle signatures that differ in at most ``(ERRORS + 1) * CHUNKS - 1`` symbols meet in some
bucket for certain.  At similarity 0.8 a symbol differs with probability 0.2 and a chunk of eight has at most one error with
probability 0.50, so a pair just at the limit misses all twelve chunks about once in 4,000 times; above it far less often.

Documents with equal sets are one node.  Each task merges the nodes it holds for a bucket into one row, so a bucket is never larger
than the number of tasks when it is shuffled.  First every node of a bucket is held against the bucket's least and greatest node; linked
nodes form components.  Then, in buckets that still hold several components, all nodes of different components are held
against each other, so no link between them is lost: small components pair by pair, a large component as a whole against each
node that shares a bucket with it.  A pair counts when the full sets confirm it.

NULL and empty texts, or texts of white space, have an empty set and no link.  Fewer words than a shingle's are one shingle.
Repeated rows are copies.  NULL ids rank last as names of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from emberlog.llm.common import Polynomial, blocks, is_empty, keyed, lower_ascii, mix, rows_with, rows_without, salted_join, table, texts_of
from emberlog.llm.components import components
from emberlog.session import cut_lineage

LENGTH, BITS = 96, 16
CHUNKS, ERRORS = 12, 1
#: Signatures of a pair to confirm differ in no more symbols (19 on average at similarity 0.8, 3.9 standard deviation).
CLOSE = 42
#: Nodes of a component that is compared in blocks, of so many members and so many other nodes.
LARGE, HOSTS, GUESTS = 16, 256, 1024
#: Nodes whose buckets a task merges together.
BLOCK = 4096
#: Rows of a batch given back.
ROWS = 1 << 14
#: Words above this many bytes are hashed as a whole by BLAKE2.
LONG_WORD = 1 << 12
#: Bytes of text, and hash values, handled at once.
AT_ONCE = 1 << 20
SKETCH = "struct<n:bigint,s1:bigint,s2:bigint,sig:binary>"
SEED = 20_240_229
_RANDOM = np.random.default_rng(SEED)
MULTIPLIERS = _RANDOM.integers(0, 1 << 63, LENGTH, np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RANDOM.integers(0, 1 << 63, LENGTH, np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, poly: Polynomial) -> np.ndarray:
    lens = ends - starts
    usual = lens <= LONG_WORD
    h1, h2 = poly.ranges(data, starts[usual], ends[usual])
    out = np.zeros(len(lens), np.uint64)
    out[usual] = (h1 << np.uint64(31)) | h2
    for i in np.flatnonzero(~usual):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


_POLY = Polynomial(LONG_WORD)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the ascending 64-bit hashes of its distinct ``k``-word shingles."""
    data, at = texts_of(texts)
    for lo, hi in blocks(at[1:] - at[:-1], AT_ONCE):
        low = lower_ascii(data[at[lo] : at[hi]])
        bounds = at[lo : hi + 1] - at[lo]
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        before = np.concatenate([[False], word[:-1]]) if len(word) else word
        after = np.concatenate([word[1:], [False]]) if len(word) else word
        inner = bounds[:-1][bounds[:-1] < len(word)]
        before[inner] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        words = _word_hashes(low, starts, ends, _POLY)
        first = np.searchsorted(starts, bounds)
        with np.errstate(over="ignore"):
            rows = words.copy()
            for j in range(1, k):
                rows[: len(words) - j] = mix(rows[: len(words) - j] + np.uint64(j)) ^ words[j:]
            rows = mix(rows)
            for a, b in zip(first[:-1], first[1:], strict=True):
                if b - a >= k:
                    yield np.unique(rows[a : b - k + 1])
                elif b > a:
                    acc = words[a : a + 1].copy()
                    for j in range(1, b - a):
                        acc = mix(acc + np.uint64(j)) ^ words[a + j]
                    yield mix(acc + np.uint64(b - a))
                else:
                    yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """The symbols of a set that is not empty, as little-endian 16-bit numbers."""
    least = np.full(LENGTH, np.iinfo(np.uint64).max, np.uint64)
    step = AT_ONCE // LENGTH
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), step):
            values = np.multiply.outer(MULTIPLIERS, shingles[lo : lo + step])
            values += ADDENDS[:, None]
            np.minimum(least, values.min(axis=1), out=least)
    return (mix(least) >> np.uint64(64 - BITS)).astype("<u2").tobytes()


def _sketch_udf(k: int):
    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        sizes, s1, s2, sigs = [], [], [], []
        with np.errstate(over="ignore"):
            for found in shingle_sets(texts, k):
                sizes.append(len(found))
                s1.append(int(found.sum(dtype=np.uint64).astype(np.int64)))
                s2.append(int(mix(found + np.uint64(SEED)).sum(dtype=np.uint64).astype(np.int64)))
                sigs.append(signature(found) if len(found) else None)
        arrays = [pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sigs, pa.binary())]
        return pa.StructArray.from_arrays(arrays, ["n", "s1", "s2", "sig"])

    return sketch


def _set_udf(k: int):
    @F.arrow_udf("array<bigint>")
    def shingles(texts: pa.Array) -> pa.Array:
        found = list(shingle_sets(texts, k))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))

    return shingles


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket and block of nodes one row: the least node and, if there are more, the others."""
    parts = np.array_split(np.arange(LENGTH), CHUNKS)
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(lo, BLOCK)
            cid = rows.column(0).to_numpy()
            sigs = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(len(cid), LENGTH)
            order = np.argsort(cid)
            cid, sigs = cid[order], sigs[order].astype(np.uint64)
            keys = []
            for c, places in enumerate(parts):
                for left_out in combinations(range(len(places)), ERRORS):
                    key = np.full(len(cid), 1 + c * 1000 + sum(1 << i for i in left_out), np.uint64)
                    for i, place in enumerate(places):
                        if i not in left_out:
                            key = mix(key + np.uint64(0x9E37)) ^ sigs[:, place]
                    keys.append(mix(key))
            keys, nodes = np.concatenate(keys), np.tile(cid, len(keys))
            order = np.argsort(keys, kind="stable")
            keys, nodes = keys[order], nodes[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(keys)]]))
            more = np.ones(len(keys), bool)
            more[first] = False
            offsets = np.concatenate([[0], np.cumsum(sizes - 1)]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes[more]), mask=pa.array(sizes == 1))
            out = pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(nodes[first]), rest], ["key", "least", "rest"])
            for at in range(0, out.num_rows, ROWS):
                yield out.slice(at, ROWS)


def _differing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of symbols that differ."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), "<u2").reshape(len(v), LENGTH) for v in (a, b))
    return pa.array((x != y).sum(axis=1).astype(np.int32))


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sizes of the intersections of pairs of ascending sets."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        out.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0)
    return pa.array(out, pa.int64())


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)``, each once, whose sizes and signatures allow a link."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        side = nodes.select(F.col("cid").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}"))
        pairs = pairs.join(side, end)  # a hub's pairs are split as the rows of any skewed join; salts would copy all signatures
    sized = pairs.filter(_sized("n_a", "n_b", percent))
    return sized.filter(F.arrow_udf(_differing, "int")("sig_a", "sig_b") <= CLOSE).select("a", "b")


def _confirmed(pairs: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links among written ``pairs (a, b)`` by their full sets."""
    sets = cut_lineage(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()))
    for end in ("a", "b"):
        side = sets.select(F.col("cid").alias(end), F.col("shingles").alias(f"set_{end}"))
        pairs = pairs.join(side, end)
    both = pairs.withColumn("common", F.arrow_udf(_common, "bigint")("set_a", "set_b"))
    return both.filter(100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def node_components(nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """``(node, component)`` for every node ``(cid, n, sig)`` that has a link; ``sets_of(ids)`` gives ``(cid, shingles)``."""
    held = nodes.select("cid", "sig").mapInArrow(_buckets, "key bigint, least bigint, rest array<bigint>")
    key = W.partitionBy("key")
    last = F.coalesce(F.array_max("rest"), F.col("least"))
    met = held.select("*", F.min("least").over(key).alias("low"), F.max(last).over(key).alias("high")).filter(F.col("low") != F.col("high"))
    members = F.concat(F.array("least"), F.coalesce("rest", F.array().cast("array<bigint>")))
    met = cut_lineage(met.select("key", F.explode(members).alias("cid"), "low", "high"))
    stars = met.select(F.col("cid").alias("a"), F.explode(F.array("low", "high")).alias("b")).filter(F.col("a") != F.col("b"))
    near = cut_lineage(_close(stars, nodes, percent))
    found = cut_lineage(_confirmed(near, sets_of, percent))
    labels = cut_lineage(components(found))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    placed = met.select("key", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = placed.join(nodes.select("cid", "n"), "cid").join(sizes, "component", "left").withColumn("large", F.coalesce(F.col("size") >= LARGE, F.lit(False)))
    placed = cut_lineage(placed.select("key", "cid", "n", "component", "large"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(F.col("low") != F.col("high"))
    open_rows = cut_lineage(placed.join(mixed.select("key"), "key", "left_semi"))
    more = _between_small(open_rows, nodes, sets_of, percent).unionByName(_with_large(open_rows, labels, sizes, sets_of, percent))
    more = cut_lineage(more)
    if is_empty(more):
        return labels
    return components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _sized(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _between_small(open_rows: DataFrame, nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links between nodes of different small components that share a bucket without a large one."""
    without = open_rows.join(open_rows.filter("large").select("key").distinct(), "key", "left_anti")
    left = without.select("key", F.col("cid").alias("a"), F.col("component").alias("of_a"), F.col("n").alias("size_a"))
    right = left.select("key", F.col("a").alias("b"), F.col("of_a").alias("of_b"), F.col("size_a").alias("size_b"))
    across = left.join(right, "key").filter((F.col("of_a") < F.col("of_b")) & _sized("size_a", "size_b", percent))
    across = cut_lineage(_close(across.select("a", "b"), nodes, percent))
    return _confirmed(across, sets_of, percent)


def _with_large(open_rows: DataFrame, labels: DataFrame, sizes: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links between large components and other nodes that share a bucket with them.

    Such a node, a guest, is held against the whole component and its other guests, in blocks, and no pair of them becomes a row: a
    task counts what a block's sets have in common with each guest's and gives back its links to guests and one to a member.
    """
    members = labels.join(sizes.filter(F.col("size") >= LARGE), "component")
    members = cut_lineage(members.select(F.col("component").alias("of"), F.col("node").alias("cid"), F.lit(True).alias("member")))
    here = open_rows.filter("large").select("key", F.col("component").alias("of")).distinct()
    guests = open_rows.join(here, "key").filter((F.col("component") != F.col("of")) & (~F.col("large") | (F.col("component") < F.col("of"))))
    guests = cut_lineage(guests.select("of", "cid").distinct())
    asked = members.join(guests.select("of").distinct(), "of", "left_semi").unionByName(guests.withColumn("member", F.lit(False)))
    loads = asked.groupBy("of").agg(F.count("*").alias("hosts"), F.count_if(~F.col("member")).alias("guests"))
    loads = loads.select("of", (F.floor(F.col("hosts") / HOSTS) + 1).cast("int").alias("blocks"), (F.floor(F.col("guests") / GUESTS) + 1).cast("int").alias("parts"))
    part = lambda of: F.pmod(F.xxhash64("cid"), F.col(of)).cast("int")
    many = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    sets = cut_lineage(sets_of(asked.select("cid").distinct()))
    hosts = asked.join(loads, "of").select("of", "cid", "member", part("blocks").alias("block"), "parts").join(sets, "cid")
    hosts = hosts.select("of", "block", many("parts").alias("part"), "cid", "member", "shingles")
    there = guests.select("of", "cid").join(loads, "of").select("of", "cid", part("parts").alias("part"), "blocks").join(sets, "cid")
    there = there.select(F.col("of").alias("to"), many("blocks").alias("its_block"), F.col("part").alias("its_part"), F.col("cid").alias("guest"), F.col("shingles").alias("own"))
    return hosts.groupBy("of", "block", "part").cogroup(there.groupBy("to", "its_block", "its_part")).applyInArrow(_block_links(percent), "a bigint, b bigint")


def _block_links(percent: int):
    def links(hosts: pa.Table, guests: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if hosts.num_rows and guests.num_rows:
            ids, member = hosts.column("cid").to_numpy(), np.array(hosts.column("member").to_pylist())
            lists = hosts.column("shingles").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            order = np.argsort(flat)
            flat, owner = flat[order], np.repeat(np.arange(len(ids)), sizes)[order]
            for cid, own in zip(guests.column("guest").to_pylist(), guests.column("own").combine_chunks(), strict=True):
                own = np.asarray(own.values)
                first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                runs = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
                common = np.bincount(owner[at], minlength=len(ids))
                linked = (100 * common >= percent * (sizes + len(own) - common)) & (ids != cid)
                found += [(cid, int(x)) for x in [*ids[linked & member][:1], *ids[linked & ~member]]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return links


def near_classes(docs: DataFrame, k: int, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Written rows ``(rid, row, sketch)`` and, for each, ``(rid, doc_id, n, component_id, keeper)``."""
    rows = keyed(docs, sketch=_sketch_udf(k)(F.col("row.text")))
    flat = rows.select("rid", F.col("row.doc_id").alias("doc_id"), "sketch.*")
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    nodes = flat.filter(F.col("n") > 0).groupBy("n", "s1", "s2").agg(F.min(ordered).alias("first"), F.first("sig").alias("sig"), F.count("*").alias("n_rows"))
    nodes = cut_lineage(nodes.withColumn("cid", F.col("first.rid")))

    def sets_of(ids: DataFrame) -> DataFrame:
        text = rows_with(rows.select("rid", F.col("row.text").alias("text")), cut_lineage(ids.select(F.col("cid").alias("rid"))))
        return text.select(F.col("rid").alias("cid"), _set_udf(k)(F.col("text")).alias("shingles"))

    labels = cut_lineage(node_components(nodes, sets_of, percent))
    placed = nodes.select("n", "s1", "s2", "cid", "first", "n_rows").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    least = placed.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("least"))
    placed = salted_join(placed, least, ["component"], F.col("cid")).withColumn("least", F.coalesce("least", "first"))
    named = placed.filter((F.col("n_rows") > 1) | F.col("component").isNotNull()).select("n", "s1", "s2", "least")
    out = salted_join(flat.drop("sig"), named, ["n", "s1", "s2"], F.col("rid")).select("rid", "doc_id", "n", "least")
    alone = F.col("least").isNull()
    return rows, out.select(
        "rid", "doc_id", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), F.when(alone, F.col("rid")).otherwise(F.col("least.rid")).alias("keeper")
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id`` (least id reachable over links) and ``kept``."""
    _, found = near_classes(docs.select("doc_id", "text"), k, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least id, with all its columns."""
    rows, found = near_classes(docs, k, percent)
    return rows_without(rows, cut_lineage(found.filter(F.col("rid") != F.col("keeper")).select("rid"))).select("row.*")


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
