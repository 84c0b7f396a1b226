"""Whitening of embeddings by the leading components, found by Chebyshev-filtered subspace iteration.

Entries are fixed-point numbers: x = floor(scale * c), as a long. The covariance is that of the distinct x vectors. It is
never built: a pass over the stored vectors gives V Q = X'(XQ) / n for a block Q of a few vectors, with X centred before
multiplying. A short Lanczos run bounds the spectrum from below; a block gives its first Ritz values. Then, until the
wanted pairs are certified, a polynomial of V damps what lies between the lower bound and the block's smallest Ritz
value (a pass per degree, by the three-term recurrence), QR makes the block orthonormal again, and Rayleigh-Ritz takes
the best vectors in it. A pair is certified by its residual |V q - e q|, which bounds the error of e, and over the gap to
the next value that of q. A block that hardly improves is doubled; one of all dimensions is exact.

Results for odd input: rows whose vector is null or empty or holds null, NaN or infinite entries are dropped, as are
those of another length than most rows have (the shorter one on a tie). Entries beyond a long saturate. Components
without variance are not returned, so equal vectors, a single row or an empty table give no rows; nor are more than
there are dimensions. Components of equal variance are any orthonormal ones of their space. A deviation beyond a long is
null. Repeated rows teach once and are all returned. Extra columns are ignored.

Each task of a pass holds one block of vectors and sends d x b sums; beyond SLOTS tasks these are added up by other tasks
before the driver gets them. Vectors are stored as blocks of bytes in the shared folder, once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import bounded_batches, stored

SCALE = 256
COMPONENTS = 4
#: Bytes of a block of vectors as 64-bit numbers.
BLOCK_BYTES = 1 << 21
#: Sums that the driver gets at most of one pass.
SLOTS = 64
DEGREE = 8
LANCZOS = 8
#: Residuals are certified below this share of the largest value; beyond that they are taken once they stop falling.
TOLERANCE = 4e-15
ACCEPTED = 1e-11
SEED = 13
LONG = 1 << 63


def entries(column: pa.Array, scale: int, dimensions: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their x vectors; every kept row has the same length."""
    if not len(column):
        return np.empty(0, dtype=np.int64), np.empty((0, dimensions or 0), dtype=np.int64)
    kind = pa.list_(pa.float64())
    column = column.cast(kind)
    lengths = np.diff(column.offsets.to_numpy())
    lengths[np.array(column.is_null())] = -1
    values = column.flatten().to_numpy(zero_copy_only=False)  # null entries become NaN
    held = np.maximum(lengths, 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(held)
    keep = np.flatnonzero((lengths == dimensions) & (bad[ends] == bad[ends - held]))
    rows = values[(ends - held)[keep][:, None] + np.arange(dimensions)]
    with np.errstate(over="ignore"):
        floored = np.floor(rows * scale)
    most = float(LONG - 1024)
    return keep, np.where(floored >= LONG, LONG - 1, np.clip(floored, -LONG, most).astype(np.int64))


def main_length(vectors: DataFrame) -> int | None:
    """The length that most clean vectors have."""
    clean = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = vectors.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & clean)
    first = found.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first["d"] if first else None


@dataclass
class FitList:
    """Distinct x vectors as stored blocks of bytes, with their number and exact sums."""

    blocks: DataFrame
    dimensions: int
    n: int
    sums: list[int]
    tasks: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _block(size: int, payload: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(payload, dtype=f"<i{size}").reshape(-1, dimensions)


def fit_list(vectors: DataFrame, dimensions: int, scale: int) -> FitList:
    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = entries(batch.column(0), scale, dimensions)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], names=["x"])

    most = max(1, BLOCK_BYTES // (8 * dimensions))

    def packed(rows: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(rows), dtype=np.int64).reshape(-1, dimensions)
        low, high = int(x.min()), int(x.max())
        size = next(s for s in (1, 2, 4, 8) if -(1 << 8 * s - 1) <= low and high < 1 << 8 * s - 1)
        columns = [pa.array([size], pa.int32()), pa.array([x.astype(f"<i{size}").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["size", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[bytes] = []
        for batch in batches:
            rows += batch.column(0).to_pylist()
            while len(rows) >= most:
                yield packed(rows[:most])
                rows = rows[most:]
        if rows:
            yield packed(rows)

    distinct = vectors.select("vector").mapInArrow(fixed, "x binary").distinct()
    written = stored(distinct.mapInArrow(blocks, "size int, payload binary"), "whitening")
    fit = FitList(written, dimensions, 0, [0] * dimensions, written.rdd.getNumPartitions())
    # Halves of 32 bits are added apart, so that no sum leaves 64 bits.
    parts = _added(fit, lambda x: np.concatenate([[[len(x)] * dimensions], [(x >> 32).sum(axis=0)], [(x & 0xFFFFFFFF).sum(axis=0)]]), np.int64)
    fit.n = int(parts[0][0]) if dimensions else 0
    fit.sums = [(int(high) << 32) + int(low) for high, low in zip(parts[1], parts[2])]
    return fit


def _added(fit: FitList, of_block: Callable[[np.ndarray], np.ndarray], kind) -> np.ndarray:
    """The sum of a function's matrices over all blocks. Sums are added in the order of the stored files."""
    dimensions, dtype = fit.dimensions, np.dtype(kind).str

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for size, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = of_block(_block(size, payload.as_buffer(), dimensions).astype(np.int64)).astype(dtype)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for packed in batch.column(1):
                part = np.frombuffer(packed.as_buffer(), dtype=dtype)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = fit.blocks.mapInArrow(partial, "sums binary")
    if fit.tasks > SLOTS:
        numbered = sums.select(F.spark_partition_id().alias("task"), "sums")
        sums = numbered.repartition(SLOTS, F.col("task") % SLOTS).sortWithinPartitions("task").mapInArrow(again, "sums binary")
    rows = [np.frombuffer(r["sums"], dtype=dtype) for r in sums.collect()]
    shape = of_block(np.zeros((0, dimensions), dtype=np.int64)).shape
    return sum(rows, np.zeros(int(np.prod(shape)), dtype=dtype)).reshape(shape)


def times(fit: FitList, q: np.ndarray) -> np.ndarray:
    """V q by one pass over the vectors."""
    mean = fit.mean

    def of_block(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ q)

    return _added(fit, of_block, np.float64) / fit.n


def trace(fit: FitList) -> float:
    mean = fit.mean
    return float(_added(fit, lambda x: np.array([((x - mean) ** 2).sum()]), np.float64)[0]) / fit.n


def least_value(fit: FitList, rng: np.random.Generator) -> float:
    """A value that is hardly above any eigenvalue, by a few Lanczos steps less the last residual."""
    d = fit.dimensions
    basis = np.zeros((d, 0))
    vector = rng.standard_normal(d)
    diagonal, beside = [], []
    for _ in range(min(LANCZOS, d)):
        vector /= np.linalg.norm(vector)
        basis = np.column_stack([basis, vector])
        image = times(fit, vector[:, None])[:, 0]
        diagonal.append(vector @ image)
        for _ in range(2):
            image -= basis @ (basis.T @ image)
        beside.append(np.linalg.norm(image))
        if beside[-1] <= 1e-12 * abs(diagonal[0]):
            break
        vector = image
    small = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
    values, vectors = np.linalg.eigh(small)
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def damped(fit: FitList, q: np.ndarray, low: float, high: float, top: float, image: np.ndarray) -> np.ndarray:
    """A Chebyshev polynomial of V on q, small on [low, high] and 1 at top, by the scaled recurrence. image is V q."""
    half, middle = (high - low) / 2, (high + low) / 2
    first = ratio = half / (top - middle)
    last, now = q, (image - middle * q) * (ratio / half)
    for _ in range(1, DEGREE):
        following = 1 / (2 / first - ratio)
        last, now = now, (times(fit, now) - middle * now) * (2 * following / half) - last * (ratio * following)
        ratio = following
    return now


@dataclass
class Components:
    """Eigenvalues by falling size, eigenvectors as columns, and what certifies them."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(fit: FitList, wanted: int) -> Components:
    """The leading eigenpairs of the fit list's covariance."""
    d = fit.dimensions
    rng = np.random.default_rng(SEED)
    width = min(d, 4 * wanted)
    passes = 0
    if width < d:
        low = least_value(fit, rng)
        passes += min(LANCZOS, d)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    before = np.inf
    while True:
        if q.shape[1] == d:
            q = np.eye(d)
        image = times(fit, q)
        passes += 1
        values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(values[0], 0.0)
        residuals = np.linalg.norm(image - q * values, axis=0)[:wanted]
        worst = residuals.max()
        stuck = worst > before / 4
        if q.shape[1] == d or worst <= TOLERANCE * top or (stuck and worst <= ACCEPTED * top):
            return Components(values[:wanted], q[:, :wanted], residuals, passes)
        high = values[-1]
        if stuck or high - low <= 1e-9 * top or top - high <= 1e-9 * top:
            more = rng.standard_normal((d, min(q.shape[1], d - q.shape[1])))
            q, before = np.linalg.qr(np.column_stack([q, more]))[0], np.inf
            continue
        before = worst
        q = np.linalg.qr(damped(fit, q, low, high, top, image))[0]
        passes += DEGREE - 1


def whiten(
    rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE,
    dimensions: int | None = None,
) -> DataFrame:
    """A row per clean vector and component: key, component, n, deviation, whitened, explained, identity_error.

    `dimensions` spares the pass that finds the length of most vectors.
    """
    source = bounded_batches(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")))
    name, kind = key, source.schema["key"].dataType.simpleString()
    kinds = (
        f"`{name}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    empty = rows.sparkSession.createDataFrame([], kinds)
    dimensions = dimensions or main_length(source)
    if not dimensions:
        return empty
    fit = fit_list(source, dimensions, scale)
    if fit.n < 2:
        return empty
    spread = trace(fit)
    if spread <= 0:
        return empty
    found = leading(fit, min(components, dimensions))
    real = found.values > 1e-12 * spread
    values, vectors = found.values[real], found.vectors[:, real]
    # The sign of a component is that of its largest entry.
    vectors = vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    k, n, sums, mean, lengths = len(values), fit.n, fit.sums, fit.mean, np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ vectors / lengths
        return np.vstack([w.T @ w, w.sum(axis=0)])

    totals = _added(fit, moments, np.float64) / n
    error = float(np.abs(totals[:k] - np.outer(totals[k], totals[k]) - np.eye(k)).max())
    explained = values / spread
    largest = max(map(abs, sums))

    def deviations(x: np.ndarray) -> pa.Array:
        most = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
        if (n * most + largest) ** 2 * dimensions < LONG:
            return pa.array(((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1), pa.int64())
        exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
        return pa.array([v if v < LONG else None for v in exact], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = entries(batch.column(1), scale, dimensions)
            rows = len(keep)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(keep, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, dtype=np.int64)),
                    deviations(x).take(each),
                    pa.array(((x - mean) @ vectors / lengths).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=[name, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.mapInArrow(project, kinds)
