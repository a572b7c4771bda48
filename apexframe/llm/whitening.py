"""Embedding whitening by QDWH spectral divide-and-conquer.

Entries are taken on a grid of 1/256. Each distinct vector counts once in the
fit. Spark dedupes the vectors, sums them and multiplies the centred ones, task by
task; what reaches the driver has dims x dims numbers, however many rows there
are. There the covariance is split: the polar factor of the covariance minus a
shift, found by dynamically weighted Halley steps, is 1 on the subspace above the
shift and -1 below it, so it gives both projectors. Each half is split again until
its components stand alone. A matrix of dims x components then goes to every task.

Rows whose vector is null, empty, or holds null or non-finite entries take no part.
Vectors of several lengths are an error. A component without variance (fewer
distinct vectors than dimensions, say) has a null whitened value. An empty table
gives no rows. Null ids and repeated rows stay; a vector counts once in the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import keep_only
from apexframe.session import stage

GRID = 256
COMPONENTS = 4
# Vectors that a task centres and multiplies at a time.
CHUNK_ENTRIES = 1 << 21
ROWS_A_CHUNK = 4096


# ---- spectral divide-and-conquer ---------------------------------------------


def polar_factor(a: np.ndarray, most_steps: int = 30) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix: its eigenvalues' signs, by QDWH steps.

    A step maps every singular value x to x (p + q x^2) / (1 + r x^2); the weights
    are the best for the interval that the singular values are known to lie in.
    """
    size = len(a)
    scale = float(np.linalg.norm(a)) or 1.0
    x = a / scale
    # A lower bound of the singular values; one that is too small costs a step or two.
    lower = 1e-17
    eye = np.eye(size)
    for _ in range(most_steps):
        square = lower * lower
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        # The inverse of (I + r x'x) by an orthogonal factorisation, which stays stable for large r.
        basis, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (basis[:size] @ basis[size:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        lower = min(lower * (p + q * square) / (1 + r * square), 1.0)
        if 1 - lower < 1e-15 and moved < 1e-13 * np.sqrt(size):
            break
        lower = min(lower, 1 - 1e-16)
    return x


def _range_of(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis of a projector's range: its columns of largest norm in turn, orthogonalised."""
    rest, chosen = projector.copy(), []
    for _ in range(rank):
        k = int(np.einsum("ij,ij->j", rest, rest).argmax())
        v = rest[:, k]
        for _ in range(2):
            for u in chosen:
                v = v - u * (u @ v)
        v = v / np.linalg.norm(v)
        chosen.append(v)
        rest = rest - np.outer(v, v @ rest)
    basis, _ = np.linalg.qr(projector @ np.stack(chosen, 1))
    return basis


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if all eigenvalues are one."""
    size = len(a)
    spread = np.linalg.norm(a - np.eye(size) * (np.trace(a) / size))
    if spread <= 4e-16 * size * max(np.linalg.norm(a), 1e-300):
        return None
    diagonal = np.diag(a)
    for shift in (float(np.median(diagonal)), float(diagonal.mean()), float(diagonal.mean()) + spread / size * 1e-3, float(diagonal.mean()) - spread / size * 1e-3):
        sign = polar_factor(a - shift * np.eye(size))
        upper = (np.eye(size) + sign) / 2
        rank = int(round(float(np.trace(upper))))
        # At an eigenvalue the sign is neither 1 nor -1, and the projector none.
        if 0 < rank < size and np.linalg.norm(upper @ upper - upper) < 1e-8:
            basis, full = _range_of(upper, rank), np.eye(size)
            return basis, _range_of(full - basis @ basis.T, size - rank)
    return None


def components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    The upper subspace is split first; the lower one only if components lack.
    """
    a = (a + a.T) / 2
    found: list[np.ndarray] = []

    def descend(basis: np.ndarray) -> None:
        if len(found) >= most:
            return
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        halves = None if basis.shape[1] == 1 else split(inner)
        if halves is None:
            found.extend(basis[:, k] for k in range(basis.shape[1]))
            return
        for half in halves:
            descend(basis @ half)

    descend(np.eye(len(a)))
    vectors = np.stack(found[:most], 1)
    vectors, values = _polished(a, vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    # Either sign is right; a fixed one makes runs alike.
    turn = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[order], vectors * np.where(turn == 0, 1, turn)


def _polished(a: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors made orthogonal once more, and their Rayleigh quotients."""
    basis, upper = np.linalg.qr(vectors)
    basis = basis * np.sign(np.diag(upper))
    return basis, np.einsum("ij,ij->j", basis, a @ basis)


# ---- Spark passes ------------------------------------------------------------


def _gridded(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and 64-bit grid vectors of the rows that take part."""
    lists = batch.column(column)
    lists = lists.cast(pa.list_(lists.type.value_type))
    valid = np.asarray(lists.is_valid())
    offsets = np.asarray(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
    rows, found = [], []
    with np.errstate(over="ignore", invalid="ignore"):
        grid = np.floor(values * GRID) + 0.0
    good = np.isfinite(values)
    if (np.abs(grid[good]) >= 2.0**62).any():
        raise ValueError("an entry times 256 doesn't fit 62 bits")
    whole = np.where(good, grid, 0).astype(np.int64)
    for k in np.flatnonzero(valid & (np.diff(offsets) > 0)).tolist():
        a, b = offsets[k], offsets[k + 1]
        if good[a:b].all():
            rows.append(k)
            found.append(whole[a:b])
    return np.array(rows, np.int64), found


def _packed(x: np.ndarray) -> bytes:
    """A vector's bytes: equal vectors have equal ones. A first byte tells their width."""
    small = not len(x) or (-(2**31) <= int(x.min()) and int(x.max()) < 2**31)
    return (b"4" if small else b"8") + x.astype("<i4" if small else "<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4" if data[:1] == b"4" else "<i8", offset=1).astype(np.int64)


def distinct_vectors(embeddings: DataFrame, vec_col: str) -> DataFrame:
    """Each distinct grid vector once, packed (x), with its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            _, found = _gridded(batch, "v")
            # Equal vectors of a batch go on once.
            data = dict.fromkeys(map(_packed, found))
            yield pa.RecordBatch.from_arrays([pa.array(list(data), pa.binary())], names=["x"])

    return embeddings.select(F.col(vec_col).alias("v")).mapInArrow(run, "x binary").distinct()


def _summed(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        lengths: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for data in batch.column("x").to_pylist():
                x = _unpacked(data)
                by.setdefault(len(x), []).append(x)
            for dims, found in by.items():
                n, own = lengths.get(dims, (0, [0] * dims))
                exact = np.stack(found)
                if np.abs(exact).max() >= 2**40:
                    exact = exact.astype(object)
                lengths[dims] = (n + len(found), [a + int(b) for a, b in zip(own, exact.sum(0), strict=True)])
        rows = [(dims, k, n, Decimal(s)) for dims, (n, own) in lengths.items() for k, s in enumerate(own)]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)), strict=True)], names=["dims", "k", "n", "s"])

    by_dimension = fit.mapInArrow(run, "dims int, k int, n long, s decimal(38,0)").groupBy("dims", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = sorted(by_dimension.limit(1 << 20).collect())
    lengths = sorted({r.dims for r in rows})
    if len(lengths) > 1:
        raise ValueError(f"vectors have several lengths: {lengths}")
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def _matrices(batch: pa.RecordBatch, dims: int) -> Iterator[np.ndarray]:
    """The batch's packed vectors as integer matrices of bounded size."""
    data = batch.column("x").to_pylist()
    step = max(1, CHUNK_ENTRIES // dims)
    for k in range(0, len(data), step):
        yield np.stack([_unpacked(d) for d in data[k : k + step]])


def _products(fit: DataFrame, mean: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the outer products of (x - mean) times ``weights``, over the fit list.

    The tasks' matrices are summed entry by entry in Spark.
    """
    dims, width = weights.shape
    plain = width == dims and np.array_equal(weights, np.eye(dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        total = np.zeros((width, width))
        for batch in batches:
            for x in _matrices(batch, dims):
                centred = x - mean
                if not plain:
                    centred = centred @ weights
                total += centred.T @ centred
        place = np.arange(width)
        for k in range(width):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, k, np.int32)), pa.array(place.astype(np.int32)), pa.array(total[k])], names=["i", "j", "v"])

    found = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    table = found.toArrow()
    out[table["i"].to_numpy(), table["j"].to_numpy()] = table["v"].to_numpy()
    return (out + out.T) / 2


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal]:
    """Sum over dimensions of (n x - S)^2 of each row, exact."""
    most = max(int(np.abs(x).max()) * n + max(map(abs, sums)), 1)
    if most * most * len(sums) < 2**63:
        centred = x * n - np.array(sums, np.int64)
        return (centred * centred).sum(1).tolist()
    centred = x.astype(object) * n - np.array(sums, object)
    return (centred * centred).sum(1).tolist()


def whiten(embeddings: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each of the first ``most`` components.

    Columns: the id, component from 1, n, deviation (decimal, exact), whitened,
    explained and identity_error, the largest absolute entry of the whitened fit
    list's covariance minus the identity.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = stage(distinct_vectors(embeddings, vec_col))
    n, sums = _summed(fit)
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = len(sums)
    mean = np.array([s / n for s in sums])
    covariance = _products(fit, mean, np.eye(dims)) / n
    trace = float(np.trace(covariance))
    values, vectors = components(covariance, min(most, dims))
    there = values > 1e-14 * dims * max(float(values.max()), 0.0)
    weights = np.where(there, vectors / np.sqrt(np.where(there, values, 1)), 0)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    error = 0.0
    if there.any():
        error = float(np.abs(_products(fit, mean, weights[:, there]) / n - np.eye(int(there.sum()))).max())
    # dims x components numbers go to the tasks.
    shared = embeddings.sparkSession.sparkContext.broadcast((mean, weights, there, explained, sums, n, error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        mean, weights, there, explained, sums, n, error = shared.value
        width = len(there)
        for whole in batches:
            for start in range(0, len(whole), ROWS_A_CHUNK):
                batch = whole.slice(start, ROWS_A_CHUNK)
                rows, found = _gridded(batch, "v")
                if not len(rows):
                    continue
                x = np.stack(found)
                projected = (x - mean) @ weights
                deviation = pa.array([Decimal(d) for d in _deviations(x, n, sums)], pa.decimal128(38, 0))
                again = np.repeat(np.arange(len(rows)), width)
                count = len(again)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(rows[again])),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(count, n, np.int64)),
                        deviation.take(pa.array(again)),
                        pa.array(projected.ravel(), mask=np.tile(~there, len(rows))),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(count, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    narrow = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
