"""Whitening embeddings by the leading components of their covariance, found by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

#: Sizes from which a long can't hold 256 times an entry.
LARGEST = float(1 << 55)


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``shift``: positive pivots of matrix - shift I, by Sylvester.

    Pivots are single entries or blocks of two, chosen as the largest (Bunch and Parlett), so small ones do no harm.
    """
    a = matrix - shift * np.eye(len(matrix))
    ratio, above = (1 + np.sqrt(17)) / 8, 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = divmod(int(off.argmax()), len(a))
        if not max(diagonal[i], off[r, s]):
            break  # only zeros are left, none above
        if diagonal[i] >= ratio * off[r, s]:
            rest = np.delete(np.arange(len(a)), i)
            above += int(a[i, i] > 0)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, i], a[i, rest]) / a[i, i]
        else:  # a block whose determinant is negative has one eigenvalue of each sign
            rest = np.delete(np.arange(len(a)), [r, s])
            block, side = a[np.ix_([r, s], [r, s])], a[np.ix_(rest, [r, s])]
            above += 1
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return above


def intervals(matrix: np.ndarray, count: int, most: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top of the spectrum down to ``count`` eigenvalues or more.

    Intervals are halved by inertia counts until they have ``most`` eigenvalues at most, or are as narrow as rounding lets
    eigenvalues be told apart. A cut next to an eigenvalue is moved off it, so each one is well inside its interval.
    """
    norm = float(np.abs(matrix).sum(axis=1).max())  # no eigenvalue is larger
    if not norm:
        return []
    wide = norm * 1e-12

    def clear(cut: float, low: float, high: float) -> float:
        """A cut near ``cut`` that no eigenvalue is next to."""
        step = (high - low) / 64
        for k in range(32):
            for at in (cut - k * step, cut + k * step):
                if low < at < high and inertia(matrix, at - step / 4) == inertia(matrix, at + step / 4):
                    return at
        return cut

    open_, found, have = [(-wide, norm * (1 + 1e-9), 0, inertia(matrix, -wide))], [], 0
    while open_ and have < count:
        low, high, above, upto = open_.pop()
        inside = upto - above
        if not inside:
            continue
        if inside > most and high - low > 64 * wide:
            cut = clear((low + high) / 2, low, high)
            middle = inertia(matrix, cut)
            open_ += [(low, cut, middle, upto), (cut, high, above, middle)]
        else:
            found.append((low, high, inside))
            have += inside
    return found


def feast(matrix: np.ndarray, low: float, high: float, inside: int, nodes: int = 16, rounds: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs with eigenvalue in (low, high), of which inertia counts ``inside``.

    A block of vectors is projected by quadrature over the circle through low and high: the sum of weighted solutions of
    (z I - matrix) Q = Y at Gauss-Legendre points z of its upper half, real parts doubled for the lower one.
    Rayleigh-Ritz on the projected block gives the pairs; rounds go on until residuals are at rounding and as many pairs are
    inside as inertia counts. A block that misses some is made wider.
    """
    size, scale = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(1j * np.pi / 2 * (1 + points))
    wide = min(size, max(inside + 4, inside * 3 // 2))
    rng = np.random.default_rng(seed)
    while True:
        block = np.linalg.qr(rng.standard_normal((size, wide)))[0]
        for _ in range(rounds):
            projected = np.zeros_like(block)
            for turn, weight in zip(turns, weights, strict=True):
                solved = np.linalg.solve((centre + radius * turn) * np.eye(size) - matrix, block.astype(complex))
                projected += weight / 2 * np.real(radius * turn * solved)
            basis = np.linalg.qr(projected)[0]
            basis = np.linalg.qr(basis)[0]
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turned
            here = (values > low) & (values < high)
            residual = np.abs(matrix @ block[:, here] - block[:, here] * values[here]).max(initial=0)
            if here.sum() == inside and residual <= 4e-15 * scale * np.sqrt(size):
                return values[here], block[:, here]
        if here.sum() == inside and residual <= 1e-12 * scale:
            return values[here], block[:, here]
        if wide == size:
            raise ArithmeticError(f"{int(here.sum())} eigenvalues of {inside} between {low} and {high}, residual {residual}")
        wide = min(size, 2 * wide)


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors; those that are zero by rounding are left out."""
    parts = [feast(matrix, *part) for part in intervals(matrix, count)]
    if not parts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    values, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
    order = np.argsort(-values, kind="stable")[:count]
    order = order[values[order] > np.trace(matrix) * len(matrix) * 1e-13]
    return values[order], vectors[:, order]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sums(rows: DataFrame, width: int, mean: np.ndarray | None = None, turn: np.ndarray | None = None) -> np.ndarray:
    """Per dimension the sum of x, or, given a mean, the matrix of sums of products of (x - mean), projected by ``turn`` if given.

    Each task sums its rows and sends one row per line of the matrix, which Spark adds up.
    """
    kind = "double" if mean is not None else "long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if mean is None:
                part = x.sum(axis=0)[None]
            else:
                centred = x - mean if turn is None else (x - mean) @ turn
                part = centred.T @ centred
            total = part if total is None else total + part
        if total is not None:
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["i", "j", "v"])

    found = rows.select("x").mapInArrow(add, f"i long, j long, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max((r.i for r in found), default=-1), 1 + max((r.j for r in found), default=-1)), np.float64 if kind == "double" else object)
    for r in found:
        out[r.i, r.j] = r.v
    return out


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """The sum of (n x - total)^2 of each row, exact; null where a long can't hold it."""
    largest = n * float(np.abs(x).max(initial=0)) + float(np.abs(total).max(initial=0))
    if largest < 2**62:
        apart = n * x - total.astype(np.int64)
        near = (apart.astype(float) ** 2).sum(axis=1)
        if near.max(initial=0) < 2**62:
            return (apart**2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - total) ** 2).sum(axis=1)
    return [d if d < 1 << 63 else None for d in exact.tolist()]


def whitening(docs: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4, scale: int = 256, row_bytes: int = 16 << 20) -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(``scale`` * c). The mean and the covariance V (divisor n) are of the distinct x-vectors; components are
    unit eigenvectors of V by falling eigenvalue e, found by FEAST over intervals that inertia counts cover from the top. ``whitened``
    is x less the mean, on the component, over sqrt(e); ``explained`` is e / trace(V); ``deviation`` the exact sum over
    dimensions of (n x - S)^2, null where a long can't hold it. ``identity_error`` is the largest entry, by size, of the covariance of
    whitened less the identity, taken in a pass of its own over the distinct vectors.

    Vectors that are null, hold null or non-finite entries, or entries of 2^55 / scale and more (no long holds x), are left
    out, and so are those without entries or of another length than the most frequent one (the longer one in a tie). Components
    whose eigenvalue is zero by rounding are left out; if none is left there are no rows, as with no vectors. Repeated rows,
    null and repeated keys give rows each. Other columns of ``docs`` aren't read. The driver holds matrices of the dimension
    squared, nothing that grows with rows: 32 KB for 64 dimensions.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST / scale)
    rows = docs.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter((F.size("v") > 0) & F.forall("v", entry))
    rows = materialize(rows.select("key", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")), "vectors")
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width = int(widths["width"])
    rows = rows.filter(F.size("x") == width)
    fit = materialize(rows.select("x").distinct(), "fit")
    n = fit.count()
    sums = [int(s) for s in _sums(fit, width)[0]]
    mean = np.array([s / n for s in sums])
    covariance = _sums(fit, width, mean) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading(covariance, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    turn = vectors / np.sqrt(values)
    error = float(np.abs(_sums(fit, width, mean, turn) / n - np.eye(k)).max())
    explained = values / np.trace(covariance)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, object)
        for whole in batches:
            step = max(1, row_bytes // (8 * width))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _matrix(batch.column("x"), width)
                white = (x - mean) @ turn
                deviation = _deviations(x, n, total)
                m = len(x)
                index = pa.array(np.repeat(np.arange(m), k))
                columns = [batch.column("key").take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(index), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
