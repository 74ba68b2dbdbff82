"""Whitened principal components of embeddings by block Lanczos, without a covariance matrix.

Vectors are quantised to whole numbers, each distinct one is kept once (the fit list) and packed into blocks. A pass over the
blocks multiplies the centred vectors with a few directions and back, and sums the products over all tasks; that is all
that is ever asked of the covariance. The driver keeps the directions met so far (dimensions by ``MOST_BASIS`` at most),
makes each new block orthogonal to all of them twice, and solves the small projected problem. Directions that vanish are
replaced by random ones; the basis shrinks to its best vectors when it is full. Rounds end when what the covariance makes of each
wanted vector differs from its multiple by less than ``TOLERANCE`` of the greatest eigenvalue (or by less than ``NOISE``, and stops
falling, as the sums' own rounding allows no less), or when the basis spans all dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.base import checkpoint, lean, shared

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Directions of one pass, and of the basis before it shrinks; a basis never has more than there are dimensions.
BLOCK, MOST_BASIS = 16, 256
TOLERANCE, NOISE, STALLED, MOST_PASSES = 1e-14, 1e-11, 6, 400
#: Components whose eigenvalue is below this share of the greatest are rounding, not variance.
LEAST_EIGENVALUE = 1e-11
#: Vectors packed into one row.
PACKED = 4096
#: Quantised entries are at most this in size, so that differences of two fit a long.
MOST_ENTRY = 1 << 62
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """key as long and x, the vector in whole numbers; rows whose vector is null, empty or holds null or non-finite entries are dropped."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(MOST_ENTRY >> 1)
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))).cast("long") + F.lit(offset)
    rows = vectors.select(F.col(key).cast("long").alias(key), v.alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    return rows.filter(~bad).select(key, F.transform("v", whole).alias("x"))


def commonest_length(rows: DataFrame) -> int:
    """The length that most vectors have, the greater of two that tie; 0 without rows."""
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return 0 if found is None else found.d


def matrix_of(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def packed(distinct: DataFrame, dim: int) -> DataFrame:
    """The vectors of each partition in rows of up to PACKED, as the bytes of a matrix."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + PACKED].tobytes() for i in range(0, len(x), PACKED)], pa.binary())], names=["block"])

    return distinct.mapInArrow(run, "block binary")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: as 64-bit integers where all fit, else as Python's."""
    least, most = min(sums), max(sums)
    size = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if n * size < LONG >> 1 and max(abs(least), abs(most)) < LONG >> 1:
        return x * np.int64(n) - np.array(sums, np.int64)
    out = np.empty(x.shape, object)
    out[:] = [[n * v - s for v, s in zip(row, sums, strict=True)] for row in x.tolist()]
    return out


def squares(off: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if off.dtype != object and (not off.size or int(np.abs(off).max()) ** 2 * off.shape[1] <= LONG):
        return (off * off).sum(1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in off.tolist()]


def centred(off: np.ndarray, n: int) -> np.ndarray:
    """x - S/n as doubles, each rounded once."""
    return off / n if off.dtype != object else np.array([[v / n for v in row] for row in off.tolist()], np.float64).reshape(off.shape)


def summed(blocks: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """The sum over all blocks of ``work`` (an array of ``cells`` numbers): in each task, then between tasks by cell."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            for block in batch.column(0):
                total += work(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dim)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    out = np.zeros(cells)
    for r in blocks.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # ``cells`` rows: dimensions x BLOCK at most
        out[r.cell] = r.value
    return out


def exact_sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, in decimals."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dim)
                n += len(x)
                fits = max(abs(int(x.min())), abs(int(x.max()))) <= LONG // max(len(x), 1)
                total = [a + b for a, b in zip(total, x.sum(0).tolist() if fits else [sum(c) for c in x.T.tolist()], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array([Decimal(v) for v in [*total, n]], pa.decimal128(38, 0))], names=["cell", "value"])

    rows = {r.cell: int(r.value) for r in blocks.mapInArrow(run, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()}
    return rows.get(dim, 0), [rows.get(i, 0) for i in range(dim)]


def orthogonal(block: np.ndarray, basis: np.ndarray, draw: np.random.Generator, size: float) -> np.ndarray:
    """The block made orthonormal and orthogonal to the basis; directions of a length under rounding of ``size`` are drawn anew."""
    found = np.zeros((len(block), 0))
    room = len(block) - basis.shape[1]
    for column in block.T:
        if found.shape[1] == room:
            break
        before = size
        while True:
            for _ in range(2):  # twice is enough
                for q in (basis, found):
                    column = column - q @ (q.T @ column)
            length = float(np.linalg.norm(column))
            if length > 1e-10 * before and length > 0:
                break
            column, before = draw.standard_normal(len(block)), 1.0  # a breakdown: go on from a new direction
        column = column / length
        for q in (basis, found):
            column = column - q @ (q.T @ column)
        found = np.column_stack([found, column / np.linalg.norm(column)])
    return found


def leading(multiply: Callable[[np.ndarray], np.ndarray], dim: int, k: int, *, block: int = BLOCK, most_basis: int = MOST_BASIS, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` greatest eigenvalues (or all) of the symmetric operator, their vectors as columns, and the passes made."""
    k, block = min(k, dim), min(block, dim)
    most_basis = min(max(most_basis, 2 * (k + block)), dim)
    draw = np.random.default_rng(seed)
    basis = image = np.zeros((dim, 0))
    fresh = orthogonal(draw.standard_normal((dim, block)), basis, draw, 1.0)
    least, since = math.inf, 0
    for passes in range(1, MOST_PASSES + 1):
        made = multiply(fresh)
        basis, image = np.hstack([basis, fresh]), np.hstack([image, made])
        projected = basis.T @ image
        values, inner = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(-values)
        values, inner = values[order], inner[:, order]
        wanted = basis @ inner[:, :k]
        rest = np.linalg.norm(image @ inner[:, :k] - wanted * values[:k], axis=0)
        off = float(rest.max() / values[0]) if values[0] > 0 else 0.0
        least, since = (off, 0) if off < least else (least, since + 1)
        if basis.shape[1] == dim or (basis.shape[1] >= k and (off <= tolerance or (off <= NOISE and since >= STALLED))):
            q, r = np.linalg.qr(wanted)
            return values[:k], q * np.sign(np.diag(r)), passes
        following = orthogonal(made, basis, draw, max(float(np.abs(values).max()), 1e-300))
        if basis.shape[1] + following.shape[1] > most_basis and most_basis < dim:  # keep the best vectors; the new block holds what they lack
            keep = min(k + block, basis.shape[1])
            basis, image = basis @ inner[:, :keep], image @ inner[:, :keep]
        fresh = following
    raise RuntimeError(f"no convergence in {MOST_PASSES} passes")


@dataclass
class Whitening:
    """What ``apply`` needs: rows and sums of the fit list, unit vectors (columns), eigenvalues, their shares, and the measured error."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int = 0


def fit(rows: DataFrame, dim: int, *, components: int = COMPONENTS, block: int = BLOCK, most_basis: int = MOST_BASIS) -> Whitening:
    """Components of the distinct ``x`` vectors of length ``dim``.

    The fit list is written to the shared folder once, so passes read it packed and a lost executor costs a pass's part only.
    Components whose eigenvalue is 0 but for rounding are left out, so there are fewer than vectors.
    """
    blocks = checkpoint(packed(rows.select("x").distinct(), dim))
    n, sums = exact_sums(blocks, dim)
    # exact offsets from the mean, then one rounding each
    offsets = lambda x: centred(deviations(x, n, sums), n)
    trace = float(summed(blocks, dim, lambda x: np.array([math.fsum(s / (n * n) for s in squares(deviations(x, n, sums)))]), 1)[0]) / n

    def multiply(directions: np.ndarray) -> np.ndarray:
        sent = shared(rows.sparkSession, directions)

        def work(x: np.ndarray) -> np.ndarray:
            c = offsets(x)
            return c.T @ (c @ sent.value)

        made = summed(blocks, dim, work, directions.size).reshape(directions.shape) / n
        sent.destroy()
        return made

    if trace <= 0:  # one distinct vector
        return Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), np.zeros(0), 0.0)
    values, vectors, passes = leading(multiply, dim, components, block=block, most_basis=most_basis)
    real = values > LEAST_EIGENVALUE * values[0]
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    white = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = offsets(x) @ white
        return np.vstack([w.T @ w, w.sum(0)])

    total = summed(blocks, dim, moments, (k + 1) * k).reshape(k + 1, k) / n
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    return Whitening(n, sums, vectors, values, values / trace, error, passes)


def apply(rows: DataFrame, model: Whitening, dim: int, *, key: str = "vec_id") -> DataFrame:
    """A row for each vector and component."""
    sent = shared(rows.sparkSession, model)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = sent.value
        k = len(m.values)
        white = m.vectors / np.sqrt(m.values)
        for whole in batches:
            for at in range(0, whole.num_rows, PACKED):
                batch = whole.slice(at, PACKED)
                off = deviations(matrix_of(batch.column(1), dim), m.n, m.sums)
                whitened = centred(off, m.n) @ white
                size = np.array([min(s, LONG) for s in squares(off)], np.int64)
                r = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(r), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                        pa.array(np.full(r * k, m.n, np.int64)),
                        pa.array(np.repeat(size, k)),
                        pa.array(whitened.ravel()),
                        pa.array(np.tile(m.explained, r)),
                        pa.array(np.full(r * k, m.identity_error)),
                    ],
                    names=names,
                )

    return rows.mapInArrow(run, f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, block: int = BLOCK, most_basis: int = MOST_BASIS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error for each vector and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors of another length than
    the commonest one (of two that tie, the greater), as they have no covariance with the rest. Entries become ``floor(scale * c) +
    offset``, at most 2**61 in size before the offset. Repeated vectors count once in the fit and each has its rows; repeated keys
    stay, a null key stays null; other columns are left out. Components whose eigenvalue is 0 are left out, so a table of one
    distinct vector, or an empty one, gives no rows. Of equal eigenvalues, any orthonormal vectors are given. A deviation over a
    long's range is given as the greatest long. A vector of any length is in one row, so ``PACKED`` of them are in memory.
    """
    rows = quantised(vectors, key=key, vector=vector, scale=scale, offset=offset)
    dim = commonest_length(rows)
    rows = rows.filter(F.size("x") == dim)
    if not dim:
        return apply(rows, Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0), 1, key=key)
    return apply(rows, fit(rows, dim, components=components, block=block, most_basis=most_basis), dim, key=key)
