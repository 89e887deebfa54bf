"""Whitening of embeddings by the components that contour integration finds.

Vectors are put on a grid (``floor(scale * entry)``) and each distinct grid vector is fitted once.  Tasks count and sum the distinct vectors, then
multiply them centred at the nearest integers to their means; all sums are integers of any length, so the covariance is exact up to its last rounding.
What meets on the driver are the entries of a matrix of the vectors' dimension, whatever the number of rows.

The spectrum is cut where inertia counts (signs of the pivots of a symmetric factorisation, which equal the numbers of eigenvalues on each
side of a shift) allow: a cut lies in a gap, and a cell between two cuts holds few eigenvalues.  Each cell is a task: the resolvent is integrated around
the cell by Gauss-Legendre quadrature of complex shifted solves, which projects a random block onto the cell's eigenvectors; Rayleigh-Ritz extracts
them, and rounds are repeated until the residuals are rounding errors and the cell holds as many as the inertia counts say.
A last Rayleigh-Ritz step over the cells makes their vectors orthogonal to each other.

Rows whose vector is NULL, or holds NULL or a number that is not finite, are left out; so are vectors of another length than most distinct
ones have (of equally many the longest), and vectors without entries.  Entries beyond ``LARGEST`` grid steps count as ``LARGEST``.  Equal vectors get equal
results, and rows are never merged.  Components whose eigenvalue is below ``ZERO`` of the largest row sum of the covariance are no components, as nothing
can be divided by them: a table with a single distinct vector gives no rows, as does an empty one.  Among equal eigenvalues any basis may be returned.  A
``deviation`` that no long can hold is NULL.  Columns beside id and vector play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm.common import table
from emberlog.session import cut_lineage

COMPONENTS = 16
SCALE, ORIGIN = 64, 1_000_000
LARGEST = 1 << 40
#: Eigenvalues and distances relative to the largest row sum: least of a component, half width of a gap to cut in, width of a cell not cut again.
ZERO, GAP, NARROW = 1e-9, 1e-8, 1e-7
#: Eigenvalues that a cell should not exceed, cuts tried in a cell at once, quadrature nodes on a half circle, rounds of a cell.
PER_CELL, CUTS, NODES, ROUNDS = 8, 15, 8, 30
SEED = 11


def _grid(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a list column on the grid, the offsets of the rows, and which rows count."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    finite = np.isfinite(values)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
    good &= ~np.asarray(vectors.is_null())
    steps = np.clip(np.floor(np.where(finite, values, 0.0) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return steps, offsets, good


def _packed(row: np.ndarray) -> bytes:
    """A grid vector in the narrowest integers that hold it, so that equal vectors have equal bytes."""
    most = int(np.abs(row).max())
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return row.astype(f"<i{width}").tobytes()


def _cells(vectors: pa.Array) -> pa.Array:
    steps, offsets, good = _grid(vectors)
    rows = [_packed(steps[a:b]) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], good, strict=True)]
    sizes = pa.array((offsets[1:] - offsets[:-1]).astype(np.int32), mask=~good)
    return pa.StructArray.from_arrays([sizes, pa.array(rows, pa.binary())], ["d", "x"])


def _unpacked(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The vectors of batches ``(x)`` as matrices, one for each width."""
    for batch in batches:
        rows = batch.column(0).to_pylist()
        sizes = np.array([len(r) for r in rows])
        for size in np.unique(sizes):
            data = b"".join(r for r in rows if len(r) == size)
            yield np.frombuffer(data, f"<i{size // d}").reshape(-1, d).astype(np.int64)


def fit_list(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Written distinct grid vectors ``(x)`` and their dimension, 0 if there are none."""
    found = cut_lineage(vectors.select(F.arrow_udf(_cells, "struct<d:int,x:binary>")(F.col(column)).alias("cell")).filter(F.col("cell.x").isNotNull()).select("cell.*").distinct())
    usual = found.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    return found.filter(F.col("d") == d).select("x"), d


def _rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema)


def _sums(d: int) -> Callable:
    """Of each task the number of vectors (at ``i = -1``) and the sums of their entries."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for part in _unpacked(batches, d):
            n += len(part)
            for lo in range(0, len(part), 1 << 20):
                total += part[lo : lo + (1 << 20)].sum(axis=0).astype(object)
        if n:
            schema = pa.schema([("i", pa.int32()), ("s", pa.decimal128(38, 0))])
            yield _rows({"i": [-1, *range(d)], "s": [Decimal(int(v)) for v in (n, *total)]}, schema)

    return sums


def exact_gram(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` in integers of any length; matrices of doubles that hold every sum exactly do the work."""
    out = np.zeros((z.shape[1], z.shape[1]), object)
    most = int(np.abs(z).max(initial=0))
    step = max(1, (1 << 53) // max(most * most, 1))
    if step >= 256:
        for lo in range(0, len(z), step):
            part = z[lo : lo + step].astype(np.float64)
            out += (part.T @ part).astype(np.int64).astype(object)
        return out
    low = z & ((1 << 20) - 1)
    high = (z - low) >> 20
    for lo in range(0, len(z), 512):
        a, b = high[lo : lo + 512].astype(np.float64), low[lo : lo + 512].astype(np.float64)
        across = (a.T @ b).astype(np.int64).astype(object)
        out += (1 << 40) * (a.T @ a).astype(np.int64).astype(object) + (1 << 20) * (across + across.T) + (b.T @ b).astype(np.int64).astype(object)
    return out


def _products(d: int, centre: np.ndarray) -> Callable:
    """Of each task the sums of products of the centred vectors, one triangle."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for part in _unpacked(batches, d):
            total += exact_gram(part - centre)
        schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.decimal128(38, 0))])
        for i in range(d):
            if any(total[i, i:]):
                yield _rows({"i": [i] * (d - i), "j": list(range(i, d)), "s": [Decimal(int(v)) for v in total[i, i:]]}, schema)

    return products


class Moments:
    """``n`` vectors, integer centres, sums ``rest`` of what is left of each entry, and the covariance with divisor ``n``."""

    def __init__(self, fit: DataFrame, d: int):
        sums = {r["i"]: int(r["s"]) for r in fit.mapInArrow(_sums(d), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
        self.n = n = sums[-1]
        self.centre = np.array([(2 * sums[i] + n) // (2 * n) for i in range(d)], np.int64)
        self.rest = [sums[i] - n * int(self.centre[i]) for i in range(d)]
        products = fit.mapInArrow(_products(d, self.centre), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
        self.covariance = np.zeros((d, d))
        for i in range(d):
            for j in range(d):
                self.covariance[i, j] = -self.rest[i] * self.rest[j] / (n * n)
        for r in products.collect():
            i, j, s = r["i"], r["j"], int(r["s"])
            self.covariance[i, j] = self.covariance[j, i] = (n * s - self.rest[i] * self.rest[j]) / (n * n)
        self.trace = float(np.trace(self.covariance))

    def centred(self, z: np.ndarray) -> np.ndarray:
        return (z - self.centre) - np.array([r / self.n for r in self.rest])


def number_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of a factorisation with complete pivoting (1 x 1 and 2 x 2)."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size = np.abs(a)
        own = size.diagonal()
        i = int(own.argmax())
        p, q = divmod(int(size.argmax()), len(a))
        if size[p, q] == 0.0:
            break
        if p == q or own[i] >= 0.64 * size[p, q]:
            first = [i]
            above += a[i, i] > 0
        else:
            first = [p, q]
            above += 1  # such a block has one positive and one negative eigenvalue
        keep = np.setdiff1d(np.arange(len(a)), first)
        side = a[np.ix_(keep, first)]
        a = a[np.ix_(keep, keep)] - side @ np.linalg.solve(a[np.ix_(first, first)], side.T)
        a = (a + a.T) / 2
    return int(above)


def contour(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` and their vectors (columns)."""
    d = len(matrix)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - nodes))
    middle, radius = (low + high) / 2, (high - low) / 2
    width = min(d, count + max(4, count // 2))
    block = np.random.default_rng(SEED).standard_normal((d, width))
    best = (np.inf, np.zeros(0), np.zeros((d, 0)))
    for turns in range(ROUNDS):
        projected = np.zeros(block.shape)
        for at, weight in zip(turn, weights, strict=True):
            solved = np.linalg.solve((middle + radius * at) * np.eye(d) - matrix, block.astype(complex))
            projected += weight * radius / 2 * (at * solved).real
        basis, _ = np.linalg.qr(projected)
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ small
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max(initial=0.0)
        if inside.sum() == count:
            if residual >= best[0] / 4 and best[0] <= 1e-10:
                break
            if residual < best[0]:
                best = (residual, values[inside], vectors[:, inside])
        block = vectors
        if turns % 6 == 5 and best[0] > 1e-10 and width < d:  # too narrow a block: widen it, up to the whole space
            more = np.random.default_rng(SEED + turns).standard_normal((d, min(d, 2 * width) - width))
            block, width = np.hstack([block, more]), min(d, 2 * width)
    if len(best[1]) != count:
        raise ArithmeticError(f"{len(best[1])} of {count} eigenvalues found between {low} and {high}")
    return best[1], best[2]


def _counted(spark: SparkSession, matrix: np.ndarray, shifts: list[float]) -> dict[float, int]:
    """How many eigenvalues lie above each shift; shifts with an eigenvalue within ``GAP`` are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            yield _rows({"shift": at, "over": [number_above(matrix, s + GAP) for s in at], "under": [number_above(matrix, s - GAP) for s in at]}, pa.schema([("shift", pa.float64()), ("over", pa.int64()), ("under", pa.int64())]))

    frame = spark.createDataFrame([(s,) for s in shifts], "shift double")
    return {r["shift"]: r["over"] for r in frame.mapInArrow(count, "shift double, over bigint, under bigint").collect() if r["over"] == r["under"]}


def slices(spark: SparkSession, matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Cells ``(low, high, count)`` from the top that together hold ``wanted`` eigenvalues, or all above ``ZERO``; the largest row sum is 1."""
    floor, tried = ZERO, _counted(spark, matrix, [ZERO])
    while floor not in tried:  # an eigenvalue lies there: a little higher
        floor *= 1.5
        tried = _counted(spark, matrix, [floor])
    cells, done = [(floor, 1.0 + 2 * GAP, tried[floor])], set()
    while True:
        top, held = [], 0
        for cell in sorted(cells, reverse=True):
            if held >= wanted:
                break
            if cell[2]:
                top.append(cell)
                held += cell[2]
        wide = [c for c in top if c[2] > PER_CELL and c[1] - c[0] > NARROW and c not in done]
        if not wide:
            return top
        shifts = {c: [c[0] + (c[1] - c[0]) * i / (CUTS + 1) for i in range(1, CUTS + 1)] for c in wide}
        over = _counted(spark, matrix, sorted({s for at in shifts.values() for s in at}))
        for cell in wide:
            cuts = [s for s in shifts[cell] if s in over]
            if not cuts:
                done.add(cell)
                continue
            beyond = sum(c[2] for c in cells if c[0] >= cell[1])
            ends = [(cell[0], cell[2]), *[(s, over[s] - beyond) for s in cuts], (cell[1], 0)]
            cells.remove(cell)
            cells += [(a, b, n - m) for (a, n), (b, m) in zip(ends, ends[1:], strict=False)]


def principal(spark: SparkSession, covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest eigenvalues that count as positive, falling, and their unit vectors as columns."""
    size = float(np.abs(covariance).sum(axis=1).max(initial=0.0))
    if size == 0.0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    matrix = covariance / size
    cells = slices(spark, matrix, wanted)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                _, vectors = contour(matrix, cell["low"], cell["high"], cell["n"])
                yield _rows({"low": [cell["low"]] * cell["n"], "vector": vectors.T.tolist()}, pa.schema([("low", pa.float64()), ("vector", pa.list_(pa.float64()))]))

    if not cells:
        return np.zeros(0), np.zeros((len(covariance), 0))
    frame = spark.createDataFrame(cells, "low double, high double, n int").repartition(len(cells))
    found = frame.mapInArrow(solve, "low double, vector array<double>").collect()  # at most wanted + a cell's
    basis, _ = np.linalg.qr(np.array([r["vector"] for r in found]).T)
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:wanted]
    vectors = basis @ small[:, order]
    return values[order] * size, vectors / np.linalg.norm(vectors, axis=0)


def _identity_error(fit: DataFrame, d: int, moments: Moments, weights: np.ndarray) -> float:
    """Largest absolute entry of the fit list's whitened covariance minus the identity."""
    k = weights.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for part in _unpacked(batches, d):
            w = moments.centred(part) @ weights
            first += w.sum(axis=0)
            second += w.T @ w
        at = [(-1, j) for j in range(k)] + [(i, j) for i in range(k) for j in range(k)]
        schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])
        yield _rows({"i": [i for i, _ in at], "j": [j for _, j in at], "s": [*first, *second.ravel()]}, schema)

    mean, second = np.zeros(k), np.zeros((k, k))
    for r in fit.mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        if r["i"] < 0:
            mean[r["j"]] = r["s"] / moments.n
        else:
            second[r["i"], r["j"]] = r["s"] / moments.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(z: np.ndarray, moments: Moments) -> list[int | None]:
    """The sums over the entries of ``(n * x - S) ** 2``, in integers."""
    n, rest, offsets = moments.n, moments.rest, z - moments.centre
    most = n * int(np.abs(offsets).max(initial=0)) + max(abs(r) for r in rest)
    if most * most * z.shape[1] < 1 << 63:
        return ((n * offsets - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * offsets.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row that counts and each component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit, d = fit_list(vectors, column)
    if not d:
        return spark.createDataFrame([], schema)
    moments = Moments(fit, d)
    values, found = principal(spark, moments.covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    weights = found / np.sqrt(values)
    error = _identity_error(fit, d, moments, weights)
    explained = values / moments.trace
    k = len(values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, offsets, good = _grid(batch.column(1))
            at = np.flatnonzero(good & (offsets[1:] - offsets[:-1] == d))
            if not len(at):
                continue
            z = steps[offsets[at][:, None] + np.arange(d)]
            rows = len(at)
            out = {
                "vec_id": batch.column(0).take(pa.array(np.repeat(at, k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, moments.n, np.int64)),
                "deviation": pa.array(_deviations(z, moments), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                "whitened": pa.array((moments.centred(z) @ weights).ravel()),
                "explained": pa.array(np.tile(explained, rows)),
                "identity_error": pa.array(np.full(rows * k, error)),
            }
            yield pa.RecordBatch.from_pydict(out)

    return vectors.select(key, column).mapInArrow(apply, schema)


def op11_feast_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
