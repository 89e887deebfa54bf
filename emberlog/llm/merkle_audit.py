"""Fixity audit of archived records by Merkle trees.

Records are hashed where they lie.  Their digests, in order of offset, are hashed together by ranges of ``RANGE`` bytes, and
ranges ``FAN_OUT`` at a time up to one root for each archive.  Two replicas are compared from the roots down: only children of nodes that
differ are looked at, until single records are left.

A record is named by archive and offset.  Several at one offset (repeated rows) are hashed together; a NULL payload
counts as empty; records with a NULL archive or offset cannot be placed and raise no finding.  Empty replicas have no
nodes, so all records of the other are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.llm.common import table
from emberlog.session import cut_lineage

RANGE = 1 << 16
FAN_OUT = 16


def digest(payload: Column) -> Column:
    return F.sha2(F.coalesce(payload.cast("binary"), F.lit("").cast("binary")), 256)


def _together(name: str, order: str) -> Column:
    """One digest of many in order, with their places."""
    parts = F.sort_array(F.collect_list(F.struct(order, name)))
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p[order], p[name])), ",").cast("binary"), 256)


def tree(records: DataFrame, span: int = RANGE, fan_out: int = FAN_OUT) -> DataFrame:
    """Written nodes ``(archive, level, node, digest)`` over ``records (archive, offset, digest)``.

    Level 0 are records (``node`` is the offset), level 1 ranges of offsets; each further level joins ``fan_out`` nodes
    until the archives with the largest offset have one.  An archive's root is its single node of the last level.
    """
    placed = records.filter(F.col("archive").isNotNull() & F.col("offset").isNotNull())
    level = placed.groupBy("archive", F.col("offset").alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ",").cast("binary"), 256).alias("digest"))
    level = cut_lineage(level.select("archive", F.lit(0).alias("level"), "node", "digest"))
    last = level.agg(F.max("node")).first()[0]
    out, depth, reach, width = level, 0, 0 if last is None else last, span
    while True:
        depth += 1
        up = level.withColumn("up", F.floor(F.col("node") / width).cast("bigint")).groupBy("archive", "up").agg(_together("digest", "node").alias("digest"))
        level = cut_lineage(up.select("archive", F.lit(depth).alias("level"), F.col("up").alias("node"), "digest"))
        out, reach, width = out.unionByName(level), reach // width, fan_out
        if reach == 0:
            return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of one level that are not the same on both sides: ``(archive, node, here, there)``."""
    left = a.select("archive", "node", F.col("digest").alias("here"))
    both = left.join(b.select("archive", "node", F.col("digest").alias("there")), ["archive", "node"], "full")
    return both.filter(~F.col("here").eqNullSafe(F.col("there")))


def audit(primary: DataFrame, replica: DataFrame, span: int = RANGE, fan_out: int = FAN_OUT) -> DataFrame:
    """``(archive, offset, kind, expected, found)`` of records ``(archive, offset, digest)`` that differ: ``missing``, ``extra`` or ``changed``."""
    trees = [tree(x, span, fan_out) for x in (primary, replica)]
    tops = [t.agg(F.max("level")).first()[0] or 1 for t in trees]
    while tops[0] != tops[1]:  # the lower tree grows by single parents
        low = int(tops[0] > tops[1])
        grown = trees[low].filter(F.col("level") == tops[low]).withColumn("up", F.floor(F.col("node") / fan_out).cast("bigint"))
        grown = grown.groupBy("archive", "up").agg(_together("digest", "node").alias("digest"))
        tops[low] += 1
        trees[low] = trees[low].unionByName(cut_lineage(grown.select("archive", F.lit(tops[low]).alias("level"), F.col("up").alias("node"), "digest")))
    wanted = None
    for depth in range(tops[0], -1, -1):
        sides = [t.filter(F.col("level") == depth) for t in trees]
        if wanted is not None:
            width = span if depth == 0 else fan_out
            sides = [s.withColumn("up", F.floor(F.col("node") / width).cast("bigint")).join(wanted, ["archive", "up"], "left_semi") for s in sides]
        found = cut_lineage(_differing(*sides))
        wanted = found.select("archive", F.col("node").alias("up"))
    kind = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("changed")
    return found.select("archive", F.col("node").alias("offset"), kind.alias("kind"), F.col("here").alias("expected"), F.col("there").alias("found"))


#: Pages in one archive file.
PER_ARCHIVE = 1000


def page_replicas(pages: DataFrame) -> DataFrame:
    """A WARC response record for each page, as stored and as a second copy with known damage has it.

    ``(archive, offset, page_id, digest, copy_digest)``; offsets are those of the records one after another.  In the copy some records have a
    flipped byte, some are cut short, and some are lost (NULL).
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    head = F.encode(F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n")), "UTF-8")
    record = F.concat(head, body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    spot = (F.octet_length(record) / 2).cast("int")
    flipped = F.concat(F.substring(record, F.lit(1), spot), F.encode(F.lit("\x7f"), "UTF-8"), F.substring(record, spot + 2, F.octet_length(record)))
    short = F.substring(record, F.lit(1), spot)
    damage = F.when(F.col("page_id") % 97 == 13, digest(flipped)).when(F.col("page_id") % 101 == 7, digest(short)).when(F.col("page_id") % 103 == 5, F.lit(None)).otherwise(digest(record))
    rows = pages.select("page_id", F.floor(F.col("page_id") / PER_ARCHIVE).cast("bigint").alias("archive"), F.octet_length(record).alias("n"), digest(record).alias("digest"), damage.alias("copy_digest"))
    before = W.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    return rows.select("archive", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "page_id", "digest", "copy_digest")


def op9_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    both = cut_lineage(page_replicas(table(spark, sf_dir, "pages")))
    copy = both.filter(F.col("copy_digest").isNotNull()).select("archive", "offset", F.col("copy_digest").alias("digest"))
    found = audit(both.select("archive", "offset", "digest"), copy)
    return found.join(both.select("archive", "offset", "page_id"), ["archive", "offset"]).select("page_id", "archive", "offset", "kind", "expected", "found")


OP9_SQL = f"""
WITH r AS (SELECT page_id, page_id // {PER_ARCHIVE} AS archive, encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS record FROM pages),
d AS (SELECT page_id, archive, octet_length(record) AS n, record, CAST(octet_length(record) // 2 AS BIGINT) AS spot FROM r),
h AS (SELECT page_id, archive, CAST(coalesce(sum(n) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    sha256(record) AS digest,
    CASE WHEN page_id % 97 = 13 THEN sha256(from_hex(hex(record)[:spot * 2] || '7F' || hex(record)[spot * 2 + 3:])) WHEN page_id % 101 = 7 THEN sha256(from_hex(hex(record)[:spot * 2]))
        WHEN page_id % 103 = 5 THEN NULL ELSE sha256(record) END AS copy_digest FROM d)
SELECT page_id, archive, "offset", CASE WHEN copy_digest IS NULL THEN 'missing' ELSE 'changed' END AS kind, sha256(digest) AS expected, sha256(copy_digest) AS found
FROM h WHERE copy_digest IS DISTINCT FROM digest
"""
