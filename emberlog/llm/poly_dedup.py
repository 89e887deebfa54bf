"""Exact de-duplication by composable polynomial fingerprints.

Two texts are equal when they are identical after A-Z are lower-cased.  Each text gets a fingerprint for two
primes.  A text longer than one chunk is cut into chunks of bytes which are dealt over the cluster, hashed apart
and combined by length-shifted arithmetic, so a huge text is no single task's work.  Rows whose fingerprint and
length agree are then compared with the row that stays, chunk by chunk; a row that differs after all moves on to
the next round, where it is grouped among its like.

NULL text counts as empty; empty texts are equal to each other.  A NULL ``doc_id`` ranks below every other.
Among rows that share both the largest ``doc_id`` and the text, exactly one stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import Polynomial, is_empty, keyed, lower_ascii, rows_with, rows_without, salted_join, table, texts_of
from emberlog.session import cut_lineage

CHUNK = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SKETCH = "struct<n_bytes:bigint,sha:string,h1:bigint,h2:bigint>"
PART = "struct<len:bigint,h1:bigint,s1:bigint,h2:bigint,s2:bigint>"


def _sketch_udf(chunk: int, primes: tuple[int, int]):
    """Length, SHA-256 and, for texts of one chunk, the fingerprint."""

    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        data, at = texts_of(texts)
        low = lower_ascii(data)
        lens = at[1:] - at[:-1]
        short = lens <= chunk
        h1, h2 = _poly(chunk, primes).ranges(low, at[:-1][short], at[1:][short])
        view = memoryview(low)
        shas = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        prints = []
        for h in (h1, h2):
            full = np.zeros(len(lens), np.int64)
            full[short] = h.astype(np.int64)
            prints.append(pa.array(full, mask=~short))
        return pa.StructArray.from_arrays([pa.array(lens), pa.array(shas, pa.string()), *prints], ["n_bytes", "sha", "h1", "h2"])

    return sketch


def _part_udf(chunk: int, primes: tuple[int, int]):
    """Fingerprint and shift (base to the power of the length) of chunks of bytes."""

    @F.arrow_udf(PART)
    def part(chunks: pa.Array) -> pa.Array:
        data, at = texts_of(chunks)
        poly = _poly(chunk, primes)
        h1, h2 = poly.ranges(data, at[:-1], at[1:])
        lens = at[1:] - at[:-1]
        s1, s2 = (poly.powers[k][lens] for k in (0, 1))
        return pa.StructArray.from_arrays([pa.array(lens), *[pa.array(x.astype(np.int64)) for x in (h1, s1, h2, s2)]], ["len", "h1", "s1", "h2", "s2"])

    return part


_POLY: dict[tuple, Polynomial] = {}


def _poly(chunk: int, primes: tuple[int, int]) -> Polynomial:
    """The tables of powers, built once in each worker."""
    if (chunk, primes) not in _POLY:
        _POLY[chunk, primes] = Polynomial(chunk, primes)
    return _POLY[chunk, primes]


def _bytes(text: Column) -> Column:
    return F.encode(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "UTF-8")


def _chunks(df: DataFrame, raw: str, n_bytes: str, chunk: int) -> DataFrame:
    """A row ``(…, no, piece)`` for each chunk; an empty text has one empty chunk."""
    last = F.greatest(F.floor((F.col(n_bytes) - 1) / chunk), F.lit(0))
    out = df.withColumn("no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return out.withColumn("piece", F.substring(F.col(raw), (F.col("no") * chunk + 1).cast("int"), F.lit(chunk))).drop(raw)


def _combined(parts: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """Chunk fingerprints of each row folded from left to right."""

    def fold(h: str, s: str, p: int) -> Column:
        return F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, x: (acc * x["part"][s] + x["part"][h]) % F.lit(p))

    by_row = parts.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("no", "part"))).alias("parts"))
    return by_row.select("rid", fold("h1", "s1", primes[0]).alias("h1"), fold("h2", "s2", primes[1]).alias("h2"))


def fingerprints(rows: DataFrame, chunk: int = CHUNK, primes: tuple[int, int] = Polynomial.PRIMES) -> DataFrame:
    """``(rid, doc_id, n_bytes, sha, h1, h2)`` of written rows ``(rid, row, sketch)``."""
    flat = rows.select("rid", F.col("row.doc_id").alias("doc_id"), "sketch.*")
    huge = rows.filter(F.col("sketch.n_bytes") > chunk)
    raw = huge.select("rid", F.col("sketch.n_bytes").alias("n_bytes"), _bytes(F.col("row.text")).alias("raw"))
    dealt = _chunks(raw, "raw", "n_bytes", chunk).repartition(F.xxhash64("rid", "no"))
    long = _combined(dealt.select("rid", "no", _part_udf(chunk, primes)("piece").alias("part")), primes)
    joined = flat.filter(F.col("n_bytes") > chunk).drop("h1", "h2").join(long, "rid")
    return flat.filter(F.col("n_bytes") <= chunk).unionByName(joined)


def _compared(rows: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """Chunks ``(rid, keeper, no, piece)`` of the rows of ``members (rid, keeper)``."""
    text = rows_with(rows.select("rid", F.col("sketch.n_bytes").alias("n_bytes"), F.col("row.text").alias("text")), members.select("rid", "keeper"))
    return _chunks(text.select("rid", "keeper", "n_bytes", _bytes(F.col("text")).alias("raw")), "raw", "n_bytes", chunk)


def _differing(rows: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """``rid`` of ``members (rid, keeper)`` whose chunks are not all equal to those of their keeper.

    Chunks of one place meet as their least and greatest, in each task first, so a large group of copies ships
    one pair from each task.  Only in groups where the two differ is each row held against the keeper.
    """
    ends = _compared(rows, members, chunk).groupBy("keeper", "no").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    uneven = cut_lineage(ends.filter(F.col("low") != F.col("high")).select("keeper").distinct())
    if is_empty(uneven):
        return uneven.select(F.col("keeper").alias("rid"))
    pieces = cut_lineage(_compared(rows, cut_lineage(members.join(uneven, "keeper", "left_semi")), chunk))
    theirs = pieces.filter(F.col("rid") == F.col("keeper")).select("keeper", "no", F.col("piece").alias("other"))
    both = salted_join(pieces.filter(F.col("rid") != F.col("keeper")), theirs, ["keeper", "no"], F.col("rid"), "inner")
    return both.filter(F.col("piece") != F.col("other")).select("rid").distinct()


def classes(docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, int] = Polynomial.PRIMES) -> tuple[DataFrame, DataFrame]:
    """Written rows ``(rid, row, sketch)`` and, for each, ``(rid, doc_id, keeper, keep_id, group_size, sha)``."""
    rows = keyed(docs, sketch=_sketch_udf(chunk, primes)(F.col("row.text")))
    prints = cut_lineage(fingerprints(rows, chunk, primes))
    left, settled = prints.select("rid", "doc_id", "n_bytes", "h1", "h2"), []
    while True:
        groups = left.groupBy("n_bytes", "h1", "h2").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("n")).filter(F.col("n") > 1)
        groups = groups.select("n_bytes", "h1", "h2", F.col("top.rid").alias("keeper"), F.col("top.doc_id").alias("keep_id"))
        members = cut_lineage(salted_join(left, groups, ["n_bytes", "h1", "h2"], F.col("rid"), "inner"))
        differing = cut_lineage(_differing(rows, members, chunk))
        named = members.select("rid", "keeper", "keep_id")
        if is_empty(differing):
            settled.append(named)
            break
        settled.append(named.join(differing, "rid", "left_anti"))
        left = left.join(differing, "rid", "left_semi")
    same = settled[0]
    for more in settled[1:]:
        same = same.unionByName(more)
    sizes = same.groupBy("keeper").agg(F.count("*").alias("group_size"))
    same = salted_join(same, sizes, ["keeper"], F.col("rid"))
    out = prints.select("rid", "doc_id", "sha").join(same, "rid", "left")
    out = out.withColumn("keep_id", F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return rows, out.withColumns({"group_size": F.coalesce("group_size", F.lit(1).cast("bigint")), "keeper": F.coalesce("keeper", "rid")})


def exact_dedup(docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, int] = Polynomial.PRIMES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256`` (of the lower-cased UTF-8)."""
    _, found = classes(docs.select("doc_id", "text"), chunk, primes)
    return found.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keeper")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, found = classes(docs, chunk)
    return rows_without(rows, cut_lineage(found.filter(F.col("rid") != F.col("keeper")).select("rid"))).select("row.*")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
