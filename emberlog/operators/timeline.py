"""Windows along a time axis that never put a whole session into one task.

A session may hold a large share of all rows, so no window here is partitioned by the
session alone over raw rows.  Every operator cuts the axis into bins of fixed width, works
inside ``(keys, bin)``, and passes what crosses a bin edge through a summary holding one
row per *non-empty bin*.  Windows over ``keys`` only ever see that summary, whose size is
bounded by ``axis span / width`` whatever the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BIN = "_bin"
DEFAULT_WIDTH = 1024


def bin_of(axis: str | Column, width: int) -> Column:
    col = F.col(axis) if isinstance(axis, str) else axis
    return F.floor(col / F.lit(width)).cast("bigint")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  The ``rank <= k`` filter becomes a map-side group limit,
    so a hot key ships at most ``k`` rows per input partition into the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows of every bin preceded by its carry row (``_from_before``).  A union, not a join: both
    inputs meet in the shuffle of the bin window that follows, and since no join condition adds
    filters to one side only, Spark can share the shuffle both are built from."""
    return rows.withColumn("_from_before", F.lit(False)).unionByName(carry.withColumn("_from_before", F.lit(True)), allowMissingColumns=True)


def _carry_first() -> Column:
    return F.desc("_from_before")


def previous_row(
    df: DataFrame, keys: Sequence[str], axis: str, cols: Sequence[str], order: Sequence[str] = (), width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Adds ``prev_<col>`` from the preceding row of the same key (NULL for the first)."""
    sort = [axis, *order]
    rows = df.withColumn(BIN, bin_of(axis, width)).withColumn("_payload", F.struct(*[F.col(c) for c in cols]))
    last = rows.groupBy(*keys, BIN).agg(F.max_by("_payload", F.struct(*[F.col(c) for c in sort])).alias("_payload"))
    carry = last.select(*keys, BIN, F.lag("_payload").over(W.partitionBy(*keys).orderBy(BIN)).alias("_payload"))
    local = W.partitionBy(*keys, BIN).orderBy(_carry_first(), *sort)
    out = _with_carry(rows, carry).withColumn("_prev", F.lag("_payload").over(local)).filter(~F.col("_from_before"))
    return out.select(*df.columns, *[F.col("_prev")[c].alias(f"prev_{c}") for c in cols])


def running(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    order: Sequence[str] = (),
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Running sum / max / last-non-null per key; each dict maps output name to input column.

    The window of a bin starts from its carry row: the same aggregate over all earlier bins,
    taken from the per-bin summary.
    """
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    sort = [F.col(axis), *[F.col(c) for c in order]]
    inputs = {f"_{n}": c for d in (sums, maxes, lasts) for n, c in d.items()}
    rows = df.select("*", bin_of(axis, width).alias(BIN), *[F.col(c).alias(n) for n, c in inputs.items()])
    position = F.struct(*sort)
    per_bin = rows.groupBy(*keys, BIN).agg(
        *[F.sum(f"_{n}").alias(f"_{n}") for n in sums],
        *[F.max(f"_{n}").alias(f"_{n}") for n in maxes],
        *[F.max_by(F.col(f"_{n}"), F.when(F.col(f"_{n}").isNotNull(), position)).alias(f"_{n}") for n in lasts],
    )

    def over(w) -> list[tuple[str, Column]]:
        return (
            [(n, F.sum(f"_{n}").over(w)) for n in sums]
            + [(n, F.max(f"_{n}").over(w)) for n in maxes]
            + [(n, F.last(f"_{n}", ignorenulls=True).over(w)) for n in lasts]
        )

    before = W.partitionBy(*keys).orderBy(BIN).rowsBetween(W.unboundedPreceding, -1)
    carry = per_bin.select(*keys, BIN, *[e.alias(f"_{n}") for n, e in over(before)])
    local = W.partitionBy(*keys, BIN).orderBy(_carry_first(), *sort).rowsBetween(W.unboundedPreceding, 0)
    out = _with_carry(rows, carry).select("*", *[e.alias(n) for n, e in over(local)]).filter(~F.col("_from_before"))
    return out.select(*df.columns, *sums, *maxes, *lasts)


def positions(df: DataFrame, keys: Sequence[str], axis: str, order: Sequence[str] = (), name: str = "pos", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Zero-based dense position of each row inside its key, in axis order."""
    out = running(df.withColumn("_one", F.lit(1)), keys, axis, sums={name: "_one"}, order=order, width=width)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def trailing(
    df: DataFrame, keys: Sequence[str], axis: str, window: int, aggs: dict[str, Column], width: int | None = None
) -> DataFrame:
    """Aggregates over the closed trailing range ``[axis - window, axis]``.

    ``aggs`` maps output name to an aggregate expression.  A row whose range reaches into
    the next bin is copied there once as a halo row, so each bin is self-contained.
    """
    width = max(width or DEFAULT_WIDTH, window + 1)
    own = bin_of(axis, width)
    reach = bin_of(F.col(axis) + F.lit(window), width)
    halo = df.withColumn("_own", own).withColumn(BIN, F.explode(F.sequence(F.col("_own"), reach)))
    w = W.partitionBy(*keys, BIN).orderBy(axis).rangeBetween(-window, 0)
    out = halo.select("*", *[expr.over(w).alias(name) for name, expr in aggs.items()])
    return out.filter(F.col(BIN) == F.col("_own")).drop("_own", BIN)


def dense_buckets(bounds: DataFrame, keys: Sequence[str], last: str, name: str, chunk: int = 4096) -> DataFrame:
    """Rows ``0..last`` per key.  Two nested sequences keep every generated array short, and
    the chunk rows are spread before the inner explode."""
    chunks = bounds.select(
        *keys, F.col(last).alias("_last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col(last) / chunk))).alias("_c")
    )
    inner = F.sequence(F.col("_c") * chunk, F.least(F.col("_last"), (F.col("_c") + 1) * chunk - 1))
    return chunks.select(*keys, F.explode(inner).alias(name))


def islands(df: DataFrame, keys: Sequence[str], axis: str, window: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """One row per distinct ``(keys, axis)`` with ``island_start``: the axis value at which the
    current run of rows, each at most ``window`` after the one before, began."""
    keys = list(keys)
    points = df.select(*keys, axis).distinct().withColumn(BIN, bin_of(axis, width))
    local = W.partitionBy(*keys, BIN).orderBy(axis)
    inner = points.withColumn("_start", F.when(F.col(axis) - F.lag(axis).over(local) > window, F.col(axis)))
    per_bin = inner.groupBy(*keys, BIN).agg(F.min(axis).alias("_first"), F.max(axis).alias("_final"), F.max("_start").alias("_inner"))
    by_key = W.partitionBy(*keys).orderBy(BIN)
    gap = F.col("_first") - F.lag("_final").over(by_key)
    per_bin = per_bin.withColumn("_head", F.when(gap.isNull() | (gap > window), F.col("_first")))
    latest = F.last(F.coalesce("_inner", "_head"), ignorenulls=True).over(by_key.rowsBetween(W.unboundedPreceding, -1))
    # The carry row of a bin stands for the last row before it and names the run then open.
    carry = per_bin.select(*keys, BIN, F.lag("_final").over(by_key).alias(axis), latest.alias("_open"))
    in_bin = W.partitionBy(*keys, BIN).orderBy(_carry_first(), axis)
    gap = F.col(axis) - F.lag(axis).over(in_bin)
    both = _with_carry(points, carry).withColumn("_start", F.when(F.col("_from_before"), F.col("_open")).when(gap.isNull() | (gap > window), F.col(axis)))
    start = F.max("_start").over(in_bin.rowsBetween(W.unboundedPreceding, 0))
    return both.select(*keys, axis, start.alias("island_start"), "_from_before").filter(~F.col("_from_before")).drop("_from_before")


def near_frames(df: DataFrame, axis: str, tol: int, name: str) -> DataFrame:
    """Copies each row to every frame within ``tol`` so that a band join becomes an equi join.
    The copy factor is the fixed ``2 * tol + 1``; apply it to the smaller side."""
    return df.withColumn(name, F.explode(F.sequence(F.col(axis) - tol, F.col(axis) + tol)))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], resolution: int = 16384) -> DataFrame:
    """Exact linear-interpolation quantiles (rank ``(n - 1) * p``), whatever the group sizes.

    Values are first reduced to ``(keys, value) -> count``.  A histogram over a fixed logarithmic
    scale (``resolution`` cells per factor e, so no range has to be known beforehand) shows which
    cell holds each wanted rank; only those cells are ranked by value.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    scale = F.floor(F.log1p(F.abs("_v")) * resolution)
    # Never NULL, so the join below adds no filter to one side and the counts are shuffled once.
    counts = counts.withColumn("_cell", F.coalesce(F.when(F.col("_v") < 0, -scale).otherwise(scale), F.lit(0)))
    hist = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn"))
    by_key = W.partitionBy(*keys)
    up_to = by_key.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.select("*", (F.sum("_cn").over(up_to) - F.col("_cn")).alias("_before"), F.sum("_cn").over(by_key).alias("_total"))
    last = F.col("_total") - 1
    ranks = F.array(*[r.cast("bigint") for p in probs.values() for r in (F.floor(last * F.lit(p)), F.ceil(last * F.lit(p)))])
    inside = F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_cn")))
    cells = hist.withColumn("_ranks", inside).filter(F.size("_ranks") > 0).drop("_cn")
    in_cell = W.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.join(cells, [*keys, "_cell"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(in_cell))
    hit = F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))
    picked = ranked.select(*keys, "_total", "_v", F.explode(hit).alias("_r"))
    out = []
    for name, p in probs.items():
        k = (F.col("_total") - 1) * F.lit(p)
        low = F.max(F.when(F.col("_r") == F.floor(k), F.col("_v")))
        high = F.max(F.when(F.col("_r") == F.ceil(k), F.col("_v")))
        out.append((low + (k - F.floor(k)) * (high - low)).alias(name))
    return picked.groupBy(*keys, "_total").agg(*out).drop("_total")
