"""Merkle manifest of a dataset: leaves find their places by rank queries on bitmaps, never by sorting the rows.

A row's leaf is the SHA-256 of its fields.  The ids of each group (source) form a compressed bitmap: one 64-bit word for every 64
consecutive ids that has any.  Popcount directories hold how many rows come before a word, at the level of words and of 2^16, 2^32 and
2^48 ids, so no directory window is longer than 2^16 entries whatever the group's size.  A row's place in its group is the count
before its word plus the set bits below its own.  Nodes are then keyed by (group, place div ``FAN_OUT ** LEVELS``) and reduced in arrays
by slot, ``LEVELS`` levels in one shuffle; the roots of the groups, ranked by range partitions, reduce likewise to one root.  From the root
down every block receives the siblings on its path, so each row's proof is made where the row lies.

Rows that share group and id, and rows with a NULL id (before all others), follow each other by leaf; only they take a detour
over counts by leaf prefix and chunk of rows.  Equal rows take their places in any order.  NULL groups form a group of their own, before
all others.  NULL fields are written ``-``, an empty text ``0:``.  A text of any length is hashed where it is read and goes no
further.  Extra columns play no part.  An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.llm.common import is_empty, table
from emberlog.llm.poly_dedup import LOWER, UPPER
from emberlog.session import cut_lineage

FAN_OUT, LEVELS = 16, 3
BLOCK = FAN_OUT**LEVELS
#: Bits of an id below its word, and below the entries of the directories.
WORD, DIRECTORIES = 6, (16, 32, 48)
#: Rows of one chunk among rows of equal leaf (bits of the row number).
CHUNK = 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LINK = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    """``-`` for NULL, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256))


def leaves(docs: DataFrame, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Written ``(rid, grp, id, leaf, now)``; ``now`` is the leaf after ``altered`` has replaced fields of the rows that meet ``where``."""
    now = leaf([(altered or {}).get(f, F.col(f)) for f in fields])
    narrow = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("grp"),
        F.col(key).cast("bigint").alias("id"),
        leaf([F.col(f) for f in fields]).alias("leaf"),
        (F.when(where, now) if where is not None else F.lit(None).cast("binary")).alias("now"),
    )
    return cut_lineage(narrow)


def bitmap(rows: DataFrame) -> DataFrame:
    """Words ``(grp, word, bits, n, before, total)``: the ids of a word as bits, its rows, the group's rows before it and in all."""
    word = F.shiftright("id", WORD).alias("word")
    words = rows.filter(F.col("id").isNotNull()).groupBy("grp", word).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits"), F.count("*").alias("n"))
    words = cut_lineage(words)
    counts, keys = [words.withColumn("at", F.col("word"))], [WORD, *DIRECTORIES]
    for low, high in zip(keys, DIRECTORIES, strict=False):
        counts.append(counts[-1].groupBy("grp", F.shiftright("at", high - low).alias("at")).agg(F.sum("n").alias("n")))
    whole = W.partitionBy("grp")
    running = whole.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    top = counts[-1].withColumns({"before": F.coalesce(F.sum("n").over(running), F.lit(0)), "total": F.sum("n").over(whole)})
    none = F.coalesce(F.col("none"), F.lit(0))
    above = top.join(rows.filter(F.col("id").isNull()).groupBy("grp").agg(F.count("*").alias("none")), "grp", "left")
    above = above.select("grp", "at", (F.col("before") + none).alias("before"), (F.col("total") + none).alias("total"))
    for level, low, high in zip(reversed(counts[:-1]), reversed(keys[:-1]), reversed(DIRECTORIES), strict=True):
        up = F.shiftright("at", high - low)
        inside = W.partitionBy("grp", up).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        level = level.withColumns({"inside": F.coalesce(F.sum("n").over(inside), F.lit(0)), "up": up})
        above = level.join(above.select("grp", F.col("at").alias("up"), "before", "total"), ["grp", "up"]).withColumn("before", F.col("before") + F.col("inside")).drop("inside", "up")
    return above.drop("at")


def _among_equals(tied: DataFrame) -> DataFrame:
    """``tied`` with ``turn``, the row's place among the rows of its group and id, by leaf: sums over leaf prefixes, leaves and chunks."""
    tied = tied.withColumns({"prefix": F.substring("leaf", 1, 2), "chunk": F.shiftright("rid", CHUNK)})
    same = ["grp", "id"]
    cells = tied.groupBy(*same, "prefix", "leaf", "chunk").agg(F.count("*").alias("n"))
    inside = W.partitionBy(*same, "prefix").orderBy("leaf", "chunk").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sums = cells.groupBy(*same, "prefix").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy(*same).orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    keyed = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")
    cells = cells.select("*", keyed).join(sums.select("grp", keyed, "prefix", "earlier"), ["grp", "key", "prefix"])
    cells = cells.select("grp", "key", "leaf", "chunk", (F.col("earlier") + F.col("inside")).alias("start"))
    row = F.row_number().over(W.partitionBy("grp", "key", "leaf", "chunk").orderBy("rid")) - 1
    placed = tied.select("*", keyed).withColumn("row", row).join(cells, ["grp", "key", "leaf", "chunk"])
    return placed.withColumn("turn", F.col("start") + F.col("row")).drop("key", "prefix", "chunk", "start", "row")


def coordinates(rows: DataFrame) -> DataFrame:
    """Written ``(grp, pos, total, id, leaf, now)``: ``pos`` is the leaf's place in its group, from 0."""
    words = cut_lineage(bitmap(rows))
    placed = rows.withColumn("word", F.shiftright("id", WORD)).join(words, ["grp", "word"])
    plain = F.bit_count("bits") == F.col("n")
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(id & 63 as int))"))
    out = ["grp", "pos", "total", "id", "leaf", "now"]
    alone = placed.filter(plain).withColumn("pos", F.col("before") + below).select(out)
    none = rows.filter(F.col("id").isNull())
    if is_empty(none) and is_empty(words.filter(~plain)):
        return cut_lineage(alone)
    tied = placed.filter(~plain).select("rid", "grp", "id", "leaf", "now", "word", "before", "total")
    ids = tied.groupBy("grp", "word", "id").agg(F.count("*").alias("n"))
    smaller = F.sum("n").over(W.partitionBy("grp", "word").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    ids = ids.select("grp", "id", F.coalesce(smaller, F.lit(0)).alias("smaller"))
    tied = tied.join(ids, ["grp", "id"]).withColumn("before", F.col("before") + F.col("smaller")).drop("word", "smaller")
    totals = rows.groupBy("grp").agg(F.count("*").alias("total"))
    none = none.join(totals, "grp").withColumn("before", F.lit(0).cast("bigint"))
    equals = _among_equals(cut_lineage(tied.unionByName(none.select(tied.columns))))
    return cut_lineage(alone.unionByName(equals.withColumn("pos", F.col("before") + F.col("turn")).select(out)))


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _runs(digests: list[str], total: int) -> list[list[str]]:
    """The texts of the runs at each level of a block, and at last its digest; ``total`` nodes of the block's level stand in the group."""
    out = []
    while total > 1 and len(out) < LEVELS:
        runs = ["".join(digests[i : i + FAN_OUT]) for i in range(0, len(digests), FAN_OUT)]
        out.append(runs)
        digests, total = [_hash(r) for r in runs], -(-total // FAN_OUT)
    return [*out, digests]


def _links(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after a node in its run, level by level inside its block."""
    links = []
    for runs in levels:
        run, cut = runs[at // FAN_OUT], 64 * (at % FAN_OUT)
        links.append((run[:cut], run[cut + 64 :]))
        at //= FAN_OUT
    return links


def _in_order(nodes: pa.Table) -> tuple[pa.Table, list[str], int]:
    nodes = nodes.sort_by("pos")
    return nodes, [d.hex() for d in nodes.column("leaf").to_pylist()], nodes.column("total")[0].as_py()


def _reduced(nodes: pa.Table) -> pa.Table:
    nodes, digests, total = _in_order(nodes)
    top = _runs(digests, total)[-1][0]
    return pa.table({"grp": nodes.column("grp").slice(0, 1), "pos": [nodes.column("pos")[0].as_py() // BLOCK], "total": [-(-total // BLOCK)], "leaf": [bytes.fromhex(top)]})


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).alias("block")


def _ladder(nodes: DataFrame) -> list[DataFrame]:
    """``nodes (grp, pos, total, leaf)`` and their blocks, block of blocks and so on, written, until every group has one."""
    ladder = [nodes]
    while True:
        narrow = ladder[-1].select("grp", "pos", "total", "leaf")
        ladder.append(cut_lineage(narrow.groupBy("grp", _block()).applyInArrow(_reduced, "grp string, pos bigint, total bigint, leaf binary")))
        if is_empty(ladder[-1].filter(F.col("total") > 1)):
            return ladder


def _passed_down(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The path of each node from its block's: its links inside the block, then the block's own."""
    nodes, digests, total = _in_order(nodes)
    *levels, _ = _runs(digests, total)
    rest = above.column("path")[0].as_py()
    paths = [[{"before": b, "after": a} for b, a in _links(levels, i)] + rest for i in range(len(digests))]
    same = {name: [above.column(name)[0].as_py()] * len(digests) for name in ("subroot", "root")}
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"grp": nodes.column("grp"), "pos": nodes.column("pos"), "path": pa.array(paths, kind), **{k: pa.array(v, pa.string()) for k, v in same.items()}})


def _paths(ladder: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths ``(grp, pos, path, subroot, root)`` of the blocks of the lowest rung, from those of the highest."""
    paths = top
    for rung in reversed(ladder[1:-1]):
        parts = rung.select("grp", "pos", "total", "leaf").groupBy("grp", _block()).cogroup(paths.groupBy("grp", "pos"))
        paths = cut_lineage(parts.applyInArrow(_passed_down, f"grp string, pos bigint, path array<{LINK}>, subroot string, root string"))
    return paths


def _proofs(with_paths: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def proofs(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, digests, total = _in_order(nodes)
        *levels, _ = _runs(digests, total)
        rest = [(x["before"], x["after"]) for x in above.column("path")[0].as_py()]
        upper = "".join(b + a for b, a in rest).encode()
        proof, folded, paths = [], [], []
        for i, (old, new) in enumerate(zip(digests, nodes.column("now").to_pylist(), strict=True)):
            links = _links(levels, i)
            state = sha256("".join(b + a for b, a in links).encode())
            state.update(upper)
            proof.append(state.hexdigest())
            digest = new.hex() if new is not None else old
            for before, after in links + rest:
                digest = _hash(before + digest + after)
            folded.append(digest)
            if with_paths:
                paths.append([{"before": b, "after": a} for b, a in links + rest])
        n = len(digests)
        out = {
            "grp": nodes.column("grp"), "pos": nodes.column("pos"), "id": nodes.column("id"), "leaf": pa.array(digests, pa.string()),
            "subroot": pa.array([above.column("subroot")[0].as_py()] * n, pa.string()), "root": pa.array([above.column("root")[0].as_py()] * n, pa.string()),
            "proof": pa.array(proof, pa.string()), "folded": pa.array(folded, pa.string()),
        }
        if with_paths:
            out["path"] = pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
        return pa.table(out)

    return proofs


def _by_rank(groups: DataFrame) -> DataFrame:
    """``groups (grp, leaf)`` as nodes of one tree, in the order of ``grp``: sorted range partitions, numbered by the sizes of those before."""
    dealt = cut_lineage(groups.sort("grp").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # a row for each partition
    starts, total = {}, 0
    for part, n in sizes:
        starts[part], total = total, total + n
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("part"))
    place = F.row_number().over(W.partitionBy("part").orderBy("grp")) - 1
    return cut_lineage(dealt.select(F.lit("").alias("grp"), (start + place).cast("bigint").alias("pos"), F.lit(total).cast("bigint").alias("total"), "leaf", F.col("grp").alias("of")))


def manifest(docs: DataFrame, with_paths: bool = False, **how) -> DataFrame:
    """One row per row of ``docs``: ``grp, pos, id, leaf, subroot, root, proof, folded`` and, if asked for, ``path``.

    ``grp`` is the group with a ``g`` before it (empty for NULL).  ``path`` holds what stands before and after the row's node in its run,
    level by level up to ``root``; ``proof`` is the digest of all of it; ``folded`` is the root that the leaf, or the altered one, folds to.
    ``how`` is passed to :func:`leaves`.
    """
    schema = f"grp string, pos bigint, id bigint, leaf string, subroot string, root string, proof string, folded string{f', path array<{LINK}>' if with_paths else ''}"
    rows = leaves(docs, **how)
    if is_empty(rows):
        return docs.sparkSession.createDataFrame([], schema)
    placed = coordinates(rows)
    ladder = _ladder(placed)
    groups = _by_rank(ladder[-1].select("grp", "leaf"))
    upper = _ladder(groups)
    root = F.hex("leaf")
    top = upper[-1].select("grp", "pos", F.array().cast(f"array<{LINK}>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(root).alias("root"))
    above = _paths(upper, top)
    parts = groups.select("grp", "pos", "total", "leaf").groupBy("grp", _block()).cogroup(above.groupBy("grp", "pos"))
    above = cut_lineage(parts.applyInArrow(_passed_down, f"grp string, pos bigint, path array<{LINK}>, subroot string, root string"))
    named = groups.select("pos", F.col("of").alias("grp"), F.lower(root).alias("subroot")).join(above.select("pos", "path", "root"), "pos")
    tops = cut_lineage(named.select("grp", F.lit(0).cast("bigint").alias("pos"), "path", "subroot", "root"))
    blocks = _paths(ladder, tops)
    return placed.groupBy("grp", _block()).cogroup(blocks.groupBy("grp", "pos")).applyInArrow(_proofs(with_paths), schema)


def op12_bitmap_rank_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    every_fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest(docs, altered={"text": F.translate("text", UPPER, LOWER)}, where=every_fifth)
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


OP12_SQL = """
WITH RECURSIVE steps AS (
    SELECT i AS byte, i AS c, 0 AS k FROM range(256) r(i)
    UNION ALL
    SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8
), docs AS (
    SELECT doc_id, coalesce('g' || source, '') AS grp, source, lang, n_chars, text,
        doc_id IS NOT NULL AND xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
            lambda a, x: xor(a // 256, t[(xor(a, x) % 256) + 1]))) % 5 = 0 AS tampered
    FROM documents, crc_table
), cells AS (
    SELECT *, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
        CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
        CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later
    FROM docs
), leaves AS (
    SELECT doc_id, grp, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(head || CASE WHEN later IS NULL THEN '-' ELSE strlen(later) || ':' || later END) AS now
    FROM cells
), placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS total FROM leaves
), lower_tree AS (
    SELECT grp, 0 AS level, pos, total, leaf AS digest FROM placed
    UNION ALL
    SELECT grp, any_value(level) + 1, pos // 16, (any_value(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM lower_tree WHERE total > 1 GROUP BY grp, pos // 16
), subroots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS rank, count(*) OVER () AS total FROM lower_tree WHERE total = 1
), upper_tree AS (
    SELECT 0 AS level, rank AS pos, total, subroot AS digest FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, pos // 16, (any_value(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper_tree WHERE total > 1 GROUP BY pos // 16
), nodes AS (
    SELECT grp, level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
        coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM (SELECT grp, level, pos, digest FROM lower_tree WHERE total > 1 UNION ALL SELECT NULL, level, pos, digest FROM upper_tree WHERE total > 1)
    WINDOW w AS (PARTITION BY grp, level, pos // 16 ORDER BY pos)
), numbered AS (SELECT p.*, s.subroot, s.rank, row_number() OVER () AS row FROM placed p JOIN subroots s USING (grp)
), links AS (
    SELECT r.row, n.level AS step, n.before, n.after FROM numbered r JOIN nodes n ON n.grp = r.grp AND n.pos = r.pos // (16 ** n.level)::BIGINT
    UNION ALL
    SELECT r.row, 1000 + n.level, n.before, n.after FROM numbered r JOIN nodes n ON n.grp IS NULL AND n.pos = r.rank // (16 ** n.level)::BIGINT
), listed AS (SELECT row, list({'b': before, 'a': after} ORDER BY step) AS path, string_agg(before || after, '' ORDER BY step) AS siblings FROM links GROUP BY row
), folds AS (
    SELECT row, now AS digest, coalesce(path, []) AS path, 0 AS k FROM numbered LEFT JOIN listed USING (row)
    UNION ALL
    SELECT row, sha256(path[k + 1].b || digest || path[k + 1].a), path, k + 1 FROM folds WHERE k < len(path)
)
SELECT doc_id, leaf, subroot, u.digest AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = u.digest AS verified
FROM numbered r LEFT JOIN listed l USING (row) JOIN folds f ON f.row = r.row AND f.k = len(f.path) CROSS JOIN (SELECT digest FROM upper_tree WHERE total = 1) u
"""
