"""Whitening of vectors by the leading eigenvectors of their covariance.

Vectors are put on an integer grid, so that sums and squared deviations are exact.  The eigenvectors come
from Chebyshev-filtered subspace iteration: a block of trial vectors goes through a polynomial of the
covariance that is small on the unwanted end of the spectrum, is made orthonormal, and is turned to
Ritz vectors; this repeats until the residuals of the wanted ones are down to rounding.  The covariance
is never formed: each factor of the polynomial is one pass over the table, in which a task multiplies
its centred rows by the block and back, and the tasks' products are summed by row.  A few Lanczos
steps, passes with one column, bound the spectrum from below.  The driver holds blocks of a few dozen
vectors, whatever the number of rows.

The fit list has each distinct grid vector once; copies are combined before they are shuffled.

Defined results: rows whose vector is null, or holds null, non-finite or off-grid entries (2**53 / 64
and beyond), are left out, and so are vectors of another length than the most frequent one (of equally
frequent ones the longest); null and repeated keys are kept; an empty table gives no rows; further
columns of the input are left out, whatever their names.  Vectors of fewer dimensions than components
wanted give as many components as dimensions.  A component without variance is returned with null
as ``whitened`` and takes no part in ``identity_error``.  Tied eigenvalues leave the choice of their
components open.  ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import acosh, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from lexmill.session import new_folder, stored

GRID, SHIFT = 64, 1_000_000
EDGE = 2.0**53

# Trial vectors for each component wanted, Lanczos steps, most factors of one polynomial.
SPARE = 2
LANCZOS = 12
DEGREE = 24
# Residuals, as shares of the largest eigenvalue: certified, and good enough once they stop falling.
CERTIFIED, SETTLED = 1e-14, 1e-10
ROUNDS = 200
# Eigenvalues below this share of the largest are rounding.
NOTHING = 1e-13

# Rows of a task that are multiplied or returned at once.
TOGETHER = 8192
# Sums of grid values are kept in two parts.
PART = 26


# ---- the grid -------------------------------------------------------------------------------


def _packed(vectors: pa.Array) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Rows that stay, their dimensions, and their grid vectors in the least width that holds them.

    Bytes depend on the values alone, so equal vectors have equal bytes.
    """
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    entries = vectors.flatten().to_numpy(zero_copy_only=False)  # null entries become nan
    grid = np.floor(GRID * entries)
    wrong = ~(np.abs(grid) < EDGE)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    stays = np.bincount(owner[wrong], minlength=len(sizes)) == 0
    stays &= vectors.is_valid().to_numpy(zero_copy_only=False)
    grid = np.where(wrong, 0, grid).astype(np.int64)
    ends = np.r_[0, np.cumsum(sizes)]
    kept, out = np.flatnonzero(stays), []
    for i in kept:
        values = grid[ends[i] : ends[i + 1]]
        most = int(np.abs(values).max(initial=0))
        out.append(values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes())
    return kept, sizes[kept].tolist(), out


def gridded(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, size, grid)``: the rows that stay, with their grid vectors as bytes."""
    rows = vectors.select(F.col(key).alias("key"), F.col(column).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                kept, sizes, found = _packed(part["vector"])
                columns = [
                    part["key"].take(pa.array(kept)),
                    pa.array(sizes, pa.int32()),
                    pa.array(found, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "size", "grid"])

    shape = StructType([rows.schema["key"]]).add("size", IntegerType()).add("grid", BinaryType())
    return rows.mapInArrow(run, shape)


def _values(grid: pa.Array, size: int) -> np.ndarray:
    """Grid vectors of ``size`` dimensions as rows of a matrix, without the shift."""
    out = np.empty((len(grid), size), np.int64)
    widths = pc.binary_length(grid).to_numpy(zero_copy_only=False) // max(size, 1)
    for width in np.unique(widths):
        here = np.flatnonzero(widths == width)
        data = b"".join(grid.take(pa.array(here)).to_pylist())
        out[here] = np.frombuffer(data, f"<i{width}").reshape(len(here), size) if size else 0
    return out


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            yield _values(batch["grid"].slice(start, TOGETHER), size)


# ---- sums over the fit list -----------------------------------------------------------------


@dataclass(frozen=True)
class Centre:
    """Number of fitted vectors and the exact sums of their grid values (without the shift).

    ``near`` is the integer next to the mean and ``rest`` the exact remainder of the sum, so that
    neither a difference nor a deviation loses digits.
    """

    count: int
    sums: tuple[int, ...]

    @property
    def near(self) -> np.ndarray:
        return np.array([(2 * s + self.count) // (2 * self.count) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s - self.count * int(m) for s, m in zip(self.sums, self.near)]

    def centred(self, values: np.ndarray) -> np.ndarray:
        return (values - self.near).astype(np.float64) - np.array([r / self.count for r in self.rest])

    def deviations(self, values: np.ndarray) -> pa.Array:
        """Sums over dimensions of ``(count * value - sum) ** 2``, null where they exceed a long.

        Integer arithmetic modulo 2**64 is exact for every sum that a long holds; the sum in floating
        point tells which those are.
        """
        wide = np.array([r % 2**64 for r in self.rest], np.uint64)
        apart = np.uint64(self.count % 2**64) * (values - self.near).astype(np.uint64) - wide
        exact = (apart * apart).sum(axis=1, dtype=np.uint64).view(np.int64)
        about = ((self.centred(values) * self.count) ** 2).sum(axis=1)
        return pa.array(exact, mask=(about > 2.0**62) & ((about > 2.0**63 * (1 + 1e-9)) | (exact < 0)))


def _centre(fit: DataFrame, size: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for values in _matrices(batches, size):
            count += len(values)
            high += (values >> PART).sum(axis=0)
            low += (values & ((1 << PART) - 1)).sum(axis=0)
        if count:
            columns = [np.arange(-1, size), np.r_[count, high], np.r_[0, low]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "high", "low"])

    parts = fit.mapInArrow(run, "place long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = {r["place"]: (int(r["high"]) << PART) + int(r["low"]) for r in parts.groupBy("place").agg(*wide).collect()}
    count = found.pop(-1, 0) >> PART
    return Centre(count, tuple(found[i] for i in range(size)) if count else ())


def _summed(fit: DataFrame, size: int, rows: int, columns: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(values)``, a matrix of ``rows`` by ``columns``, over all vectors.

    A task adds up its own; the matrices of the tasks are summed row by row.
    """
    names = [f"c{j}" for j in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for values in _matrices(batches, size):
            found = part(values)
            total = found if total is None else total + found
        if total is not None:
            arrays = [pa.array(np.arange(rows)), *(pa.array(total[:, j]) for j in range(columns))]
            yield pa.RecordBatch.from_arrays(arrays, ["place", *names])

    shape = ", ".join(["place long", *(f"{name} double" for name in names)])
    sums = fit.mapInArrow(run, shape).groupBy("place").agg(*(F.sum(name).alias(name) for name in names))
    out = np.zeros((rows, columns))
    for row in sums.collect():
        out[row["place"]] = [row[name] for name in names]
    return out


# ---- the eigenvectors -----------------------------------------------------------------------

Product = Callable[[np.ndarray], np.ndarray]


def _low_end(product: Product, size: int, rng: np.random.Generator) -> float:
    """A lower bound of the spectrum, from Lanczos steps with all vectors kept orthogonal."""
    basis = [v / np.linalg.norm(v) for v in [rng.standard_normal(size)]]
    diagonal, beside = [], []
    for _ in range(min(LANCZOS, size)):
        image = product(basis[-1][:, None])[:, 0]
        diagonal.append(basis[-1] @ image)
        for _ in range(2):
            image = image - np.array(basis).T @ (np.array(basis) @ image)
        beside.append(np.linalg.norm(image))
        if beside[-1] <= NOTHING * max(map(abs, diagonal)):
            break
        basis.append(image / beside[-1])
    small = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
    ritz, turned = np.linalg.eigh(small)
    return max(0.0, ritz[0] - beside[-1] * abs(turned[-1, 0]))


def _ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values by falling size, Ritz vectors, and the vectors' images."""
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, image @ turn


def _filtered(product: Product, block: np.ndarray, image: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The block after a Chebyshev polynomial that is small on ``[low, high]`` and one at ``top``.

    ``image`` is the block's product, which stands for the first factor.
    """
    half, middle = (high - low) / 2, (high + low) / 2
    scale = first = half / (top - middle)
    before, now = block, (image - middle * block) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        then = (product(now) - middle * now) * (2 * following / half) - scale * following * before
        before, now, scale = now, then, following
    return now


def leading(product: Product, size: int, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``count`` largest eigenvalues, their vectors as columns, and the largest residual.

    ``product`` multiplies a block by the symmetric, non-negative matrix.  The residual, a share of the
    largest eigenvalue, is certified: it is at most ``CERTIFIED``, or has come to rest near rounding.
    """
    rng = np.random.default_rng(seed)
    width = min(size, SPARE * count)
    low = _low_end(product, size, rng) if width < size else 0.0
    block = np.linalg.qr(rng.standard_normal((size, width)))[0]
    last = np.inf
    for _ in range(ROUNDS):
        values, block, image = _ritz(block, product(block))
        top = max(values[0], 0.0)
        errors = np.linalg.norm(image - block * values, axis=0)[:count] / (top or 1.0)
        worst = float(errors.max())
        if worst <= CERTIFIED or worst <= SETTLED and worst > last / 2 or width == size:
            return np.maximum(values[:count], 0.0), block[:, :count], worst
        last = worst
        high = values[-1]
        if high - low <= NOTHING * top:  # nothing is left but what the block holds
            block = np.linalg.qr(image)[0]
            continue
        gain = [acosh(max(1.0, (2 * v - low - high) / (high - low))) for v in (values[0], values[count - 1])]
        wanted = log(worst / CERTIFIED) / max(gain[1], 0.05) + 1
        # The largest vector must not drown the others by more than rounding tells apart.
        bearable = (log(1e6) - log(max(errors[0], 1e-15))) / max(gain[0] - gain[1], 1e-9)
        degree = int(max(2, min(wanted, bearable, DEGREE)))
        block = np.linalg.qr(_filtered(product, block, image, degree, low, high, top))[0]
    raise RuntimeError(f"eigenvectors not certified after {ROUNDS} rounds: residual {last}")


# ---- the operator ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening; ``vectors`` has a component in each column, largest variance first."""

    centre: Centre
    variances: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float = 0.0

    @property
    def scaled(self) -> np.ndarray:
        """Components over their deviations; nan where there is no variance."""
        good = self.variances > NOTHING * max(self.variances.max(initial=0.0), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(good, self.vectors / np.sqrt(self.variances), np.nan)


def _identity_error(fit: DataFrame, size: int, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, by one more pass."""
    scaled = model.scaled[:, ~np.isnan(model.scaled).any(axis=0)]
    wide = scaled.shape[1]
    if not wide:
        return 0.0

    def products(values: np.ndarray) -> np.ndarray:
        out = model.centre.centred(values) @ scaled
        return np.vstack([out.T @ out, out.sum(axis=0)])

    found = _summed(fit, size, wide + 1, wide, products) / model.centre.count
    return float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(wide)).max())


def fitted(rows: DataFrame, count: int = 16) -> tuple[Whitening, int] | None:
    """The whitening of the distinct vectors of ``rows(size, grid)`` and their dimensions.

    None if there is no vector.
    """
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return None
    size = sizes["size"]
    spark = rows.sparkSession
    distinct = rows.where(F.col("size") == size).select("grid").distinct()
    fit = stored(distinct, new_folder(spark, "whitening-fit"))
    centre = _centre(fit, size)

    def product(block: np.ndarray) -> np.ndarray:
        def part(values: np.ndarray) -> np.ndarray:
            rows = centre.centred(values)
            return rows.T @ (rows @ block)

        return _summed(fit, size, size, block.shape[1], part) / centre.count

    def square(values: np.ndarray) -> np.ndarray:
        return np.square(centre.centred(values)).sum(keepdims=True)

    total = _summed(fit, size, 1, 1, square)[0, 0] / centre.count
    if total:
        variances, vectors, _ = leading(product, size, min(count, size))
    else:
        variances, vectors = np.zeros(min(count, size)), np.eye(size)[:, :count]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(centre, variances, vectors, float(total))
    error = _identity_error(fit, size, model)
    return Whitening(centre, variances, vectors, float(total), error), size


def whitened(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", count: int = 16
) -> DataFrame:
    """A row for each vector that stays and each component: deviation, projection, and the fit's figures."""
    spark = vectors.sparkSession
    rows = stored(gridded(vectors, key, column), new_folder(spark, "grid"))
    shape = StructType([rows.schema["key"]])
    for name, kind in (("component", IntegerType()), ("n", LongType()), ("deviation", LongType()),
                       ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType())):
        shape = shape.add(StructField(name, kind))
    found = fitted(rows, count)
    if found is None:
        return spark.createDataFrame([], shape).withColumnRenamed("key", key)
    model, size = found
    share = model.variances / model.total if model.total else model.variances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, wide = model.scaled, len(model.variances)
        empty = np.isnan(scaled).any(axis=0)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                values = _values(part["grid"], size)
                many = len(values)
                each = pa.array(np.repeat(np.arange(many), wide))
                found = model.centre.centred(values) @ np.where(empty, 0.0, scaled)
                columns = [
                    part["key"].take(each),
                    pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * wide, model.centre.count)),
                    model.centre.deviations(values).take(each),
                    pa.array(found.ravel(), mask=np.tile(empty, many)),
                    pa.array(np.tile(share, many)),
                    pa.array(np.full(many * wide, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, shape.names)

    out = rows.where(F.col("size") == size).select("key", "grid").mapInArrow(run, shape)
    return out.withColumnRenamed("key", key)
