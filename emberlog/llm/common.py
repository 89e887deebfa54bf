"""Helpers shared by the text operators: row ids, salted joins, hashing of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.session import work_folder

#: Copies of the small side of a salted join.
SALTS = 16
#: Slots of the filter that keeps rows out of a shuffle.
SLOTS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, **extra: Column) -> DataFrame:
    """Writes ``docs`` as ``(rid, row, extra…)``: ``rid`` numbers the rows, ``row`` holds all their columns.

    Written, because row numbers given twice may differ; nested, because no column of the input can then
    clash with one that an operator adds.
    """
    row = docs.select(F.struct("*").alias("row"))
    row = row.select(F.monotonically_increasing_id().alias("rid"), "row").withColumns(extra)
    path = work_folder(docs.sparkSession, "rows")
    row.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(row.schema).parquet(path)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt: Column, how: str = "left") -> DataFrame:
    """Equality join whose hot keys are dealt to ``SALTS`` tasks; ``small`` has one row for each key."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _slot(rid: str) -> Column:
    return F.pmod(F.xxhash64(rid), F.lit(SLOTS)).cast("int").alias("_slot")


def _slots(ids: DataFrame) -> DataFrame:
    """The slots of some row ids: at most ``SLOTS`` integers, whatever the number of ids, and so safe to broadcast."""
    return F.broadcast(ids.select(_slot("rid")).distinct())


def rows_with(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Written ``rows (rid, …)`` joined with written ``ids (rid, …)``, one of each.

    Rows whose slot no id has are left out before the shuffle.  With far more ids than slots all rows are shuffled;
    the join decides in any case.
    """
    near = rows.withColumn("_slot", _slot("rid")).join(_slots(ids), "_slot", "left_semi").drop("_slot")
    return near.join(ids.hint("merge"), "rid")


def rows_without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Written ``rows (rid, …)`` other than those of written ``ids (rid)``; only rows that share a slot with one are shuffled."""
    placed = rows.withColumn("_slot", _slot("rid"))
    far = placed.join(_slots(ids), "_slot", "left_anti").drop("_slot")
    near = placed.join(_slots(ids), "_slot", "left_semi").drop("_slot")
    return far.unionByName(near.join(ids.select("rid").hint("merge"), "rid", "left_anti"))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (as UTF-8) or binary column in one array and the offsets of its rows; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in UTF-8 bytes; bytes of other characters are never in that range."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 32
    return out


class Polynomial:
    """Fingerprints that compose: ``h(a + b) = h(a) * B ** len(b) + h(b)`` for two primes below 2 ** 31."""

    PRIMES = (2_147_483_647, 2_147_483_629)
    BASES = (1_103_515_245, 1_664_525_013)

    def __init__(self, longest: int, primes: tuple[int, int] = PRIMES):
        self.primes, self.longest = primes, longest
        self.powers = []
        for p, b in zip(primes, self.BASES, strict=True):
            table = np.ones(1, np.uint64)  # doubled: b ** (n + i) = b ** n * b ** i
            while len(table) <= longest:
                step = np.uint64(pow(b, len(table), p))
                table = np.concatenate([table, table * step % np.uint64(p)])
            self.powers.append(table[: longest + 1])

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 20) -> list[np.ndarray]:
        """One fingerprint for each prime and range ``starts[i]:ends[i]`` of ``data`` (an empty range has 0)."""
        out = [np.zeros(len(starts), np.uint64) for _ in self.primes]
        lens = ends - starts
        for lo, hi in blocks(lens, at_once):
            part = lens[lo:hi]
            total = int(part.sum())
            if not total:
                continue
            first = np.concatenate([[0], np.cumsum(part)[:-1]])
            inside = np.arange(total) - np.repeat(first, part)
            values = data[np.repeat(starts[lo:hi], part) + inside].astype(np.uint64) + np.uint64(1)
            left = np.repeat(part, part) - 1 - inside
            full = np.flatnonzero(part)
            for k, p in enumerate(self.primes):
                sums = np.add.reduceat(values * self.powers[k][left], first[full])
                out[k][lo + full] = sums % np.uint64(p)
        return out


def blocks(sizes: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``at_once`` (or a single larger one)."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + at_once, "right")))
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))
