"""Whitening of embeddings: distributed exact covariance, eigenvectors by mixed precision.

Entries are scaled to integers, so sums and products of the different vectors are added up without
rounding, however many tasks share the work. The eigenvectors are first computed in float32 and
then corrected by the iteration of Ogita and Aishima, which needs matrix products alone, in extended
precision: the residuals of orthogonality and of diagonality give the next correction, and the error is
squared by every step. Where eigenvalues lie too close for that, the vectors of such a cluster are
turned by the eigenvectors of the small problem they span, shifted to the cluster's centre, which
tells apart what the whole matrix in float32 could not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.llm.shared import picked, staged

#: Fixed: how entries become integers.
SCALE, SHIFT = 64, 1_000_000
#: Larger entries are not told apart by doubles, so they count as not finite.
LARGEST = 2.0**52 / SCALE
EXTENDED = np.longdouble
_LIMB = 20  # bits of the parts that are multiplied; sums of 2**12 such products are exact
_ROWS = 1 << 12


# --- eigenvectors -------------------------------------------------------------------------------


def refined(a: np.ndarray, x: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the symmetric ``a``, falling, from approximate vectors ``x``."""
    a, x = a.astype(EXTENDED), x.astype(EXTENDED)
    eps = np.finfo(EXTENDED).eps
    norm = np.sqrt((a * a).sum()) or EXTENDED(1)
    one = np.eye(len(a), dtype=EXTENDED)
    last = np.inf
    # division by gaps below this would give rounding errors only
    least = np.sqrt(eps) * norm
    for _ in range(most):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = max(2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), least)
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= bound
        step = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ step
        turned = 0.0
        for members in _clusters(values, bound):
            turned = max(turned, _turn(a, x, members, 8 * len(a) * norm * eps))
        size = max(float(np.abs(step).max()), turned)
        if size <= 8 * float(eps) or (size >= last and size < 1e-12):
            break
        last = size
    x = x @ (1.5 * one - 0.5 * (x.T @ x))
    values = np.array([v @ (a @ v) / (v @ v) for v in x.T])
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order], x / np.sqrt((x * x).sum(axis=0))


def _clusters(values: np.ndarray, bound) -> Iterator[np.ndarray]:
    """Groups of two or more places whose values follow one another within ``bound``."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order]) > bound) + 1
    yield from (g for g in np.split(order, ends) if len(g) > 1)


def _turn(a: np.ndarray, x: np.ndarray, members: np.ndarray, least) -> float:
    """Turn the vectors ``members`` to the eigenvectors within their span; how far they turned."""
    part = x[:, members]
    # an orthonormal basis of the span, by two steps of the Newton iteration
    for _ in range(2):
        part = part @ (1.5 * np.eye(len(members), dtype=EXTENDED) - 0.5 * (part.T @ part))
    small = part.T @ (a @ part)
    small -= np.eye(len(members), dtype=EXTENDED) * (np.trace(small) / len(members))
    size = np.abs(small).max()
    x[:, members] = part
    off = np.abs(small - np.diag(np.diag(small))).max()
    if off <= least:
        return 0.0  # diagonal within the precision
    turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(EXTENDED)
    # the vectors of the float64 solution are orthonormal to its precision only
    turn = turn @ (1.5 * np.eye(len(members), dtype=EXTENDED) - 0.5 * (turn.T @ turn))
    x[:, members] = part @ turn
    return float(off / size)


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of ``a``, to double precision or better."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    size = np.abs(a).max() or 1
    start = np.linalg.eigh((a / size).astype(np.float32))[1]
    values, vectors = refined(a / size, start)
    return values * size, vectors


# --- exact sums ---------------------------------------------------------------------------------


def _limbs(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shift, part) with ``x`` the sum of parts * 2**shift; parts are small whole doubles."""
    out, shift = [], 0
    while True:
        if (np.abs(x) < 1 << _LIMB).all():
            return [*out, (shift, x.astype(np.float64))]
        rest = x >> _LIMB
        out.append((shift, (x - (rest << _LIMB)).astype(np.float64)))
        x, shift = rest, shift + _LIMB


def products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` of whole numbers, without rounding (Python integers)."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), _ROWS):
        parts = _limbs(x[at:at + _ROWS])
        for i, left in parts:
            for j, right in parts:
                block = (left.T @ right).astype(np.int64)
                total += block.astype(object) << (i + j) if i + j else block
    return total


def _rows(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """A matrix of a column of lists of ``dims`` whole numbers each."""
    return np.asarray(batch[column].flatten().cast(pa.int64())).reshape(-1, dims)


def _sums(dims: int, centre: np.ndarray | None):
    """Per task: (i, j, value) sums of products of centred entries for j <= i, entries for j = -1, count for i = -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, plain = 0, np.zeros(dims, object)
        square = np.zeros((dims, dims), object)
        for batch in batches:
            x = _rows(batch, "x", dims)
            count += len(x)
            if centre is None:
                plain += _total(x)
            else:
                x = x - centre
                plain += _total(x)
                square += products(x)
        rows = [(-1, -1, count)] + [(i, -1, int(v)) for i, v in enumerate(plain)]
        if centre is not None:
            rows += [(i, j, int(square[i, j])) for i in range(dims) for j in range(i + 1)]
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([str(r[2]) for r in rows], pa.string())], names=["i", "j", "value"])

    return run


def _total(x: np.ndarray) -> np.ndarray:
    """Column sums without overflow."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return (high.sum(axis=0).astype(object) << 32) + low.sum(axis=0).astype(object)


def _added(fit: DataFrame, dims: int, centre: np.ndarray | None) -> dict[tuple[int, int], int]:
    """The tasks' sums added up: at most dims * (dims + 3) / 2 + 1 values reach the driver."""
    parts = fit.mapInArrow(_sums(dims, centre), "i int, j int, value string")
    # values of up to 38 digits; more would need vectors far beyond LARGEST
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()
    return {(r.i, r.j): int(r.value) for r in rows}


# --- the operator -------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit has found: count, exact sums, falling eigenvalues and their vectors (columns)."""

    count: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``count * x - sums``, exact: int64 where it fits, else Python integers."""
        most = int(np.abs(x).max(initial=0)) * self.count + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 2**63 else object
        return x.astype(kind) * self.count - np.array(self.sums, kind)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Coordinates of variance one of each row."""
        scale = (self.vectors / (EXTENDED(self.count) * np.sqrt(self.values))).astype(EXTENDED)
        return (deviations.astype(EXTENDED) @ scale).astype(np.float64)


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x`` (whole numbers) of the rows of ``vectors`` (vec_id, embedding) that take part.

    Left out: null vectors, empty ones, and those with a null, not finite or too large entry.
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)
    rows = picked(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", entry))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Learn from the different vectors of ``scaled(vectors)``; None where there is none.

    Vectors of a length other than the commonest (of several, the longest) take no part. Directions
    without variance are no components.
    """
    rows = scaled(vectors)
    sizes = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return None
    dims = sizes.dims
    # copies are folded before they move
    fitted = staged(rows.where(F.size("x") == dims).select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors")
    first = _added(fitted, dims, None)
    count, sums = first[-1, -1], [first[i, -1] for i in range(dims)]
    # a whole centre near the mean: entries are centred before they are multiplied, and stay whole
    centre = np.array([round(Fraction(s, count)) for s in sums], np.int64)
    found = _added(fitted, dims, centre)
    rest = [found[i, -1] for i in range(dims)]
    cells = [[Fraction(found[max(i, j), min(i, j)] * count - rest[i] * rest[j], count * count) for j in range(dims)] for i in range(dims)]
    covariance = np.array([[_extended(c) for c in row] for row in cells], EXTENDED).reshape(dims, dims)
    trace = sum(cells[i][i] for i in range(dims))
    values, vectors_ = eigenvectors(covariance)
    # beyond the precision of the sums, a value is no variance
    keep = (values > EXTENDED(dims) * 64 * np.finfo(EXTENDED).eps * _extended(trace))[:components].sum() if trace else 0
    values, vectors_ = values[:keep], vectors_[:, :keep]
    model = Whitening(count, sums, values, vectors_, (values / _extended(trace)).astype(float) if keep else np.zeros(0))
    if keep:
        model.identity_error = _identity_error(fitted, model)
    return model


def _extended(x: Fraction) -> np.longdouble:
    """``x`` with the full precision of ``EXTENDED``."""
    high = EXTENDED(float(x))
    return high + EXTENDED(float(x - Fraction(float(x))))


def _identity_error(fitted: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened vectors less the identity, measured."""
    shared = fitted.sparkSession.sparkContext.broadcast(model)
    kept = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        count, plain, square = 0, np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            w = model.project(model.deviations(_rows(batch, "x", model.dims)))
            count += len(w)
            plain += w.sum(axis=0)
            square += w.T @ w
        if count:
            cells = [(i, j, square[i, j]) for i in range(kept) for j in range(kept)] + [(i, -1, plain[i]) for i in range(kept)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))],
                names=["i", "j", "value"])

    rows = fitted.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    cells = {(r.i, r.j): r.value / model.count for r in rows}
    shared.destroy()
    return max(abs(cells[i, j] - cells[i, -1] * cells[j, -1] - (i == j)) for i in range(kept) for j in range(kept))


_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding) that takes part and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``.

    ``n`` counts the different vectors; ``deviation`` is the exact squared length of n * x - S, null where no long
    holds it; ``whitened`` the coordinate of x - S / n on the component over its standard deviation; ``explained``
    the component's share of the variance; ``identity_error`` is measured over the different vectors.

    Rows that ``scaled`` or ``fit`` leave out give nothing, nor do components without variance: so a table of
    one different vector, or an empty one, gives an empty result. Repeated rows are all returned and count
    once in the fit; a null vec_id stays null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], _RESULT)
    shared = spark.sparkContext.broadcast(model)  # components * dims numbers
    rows = scaled(vectors).where(F.size("x") == model.dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kept = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = model.deviations(_rows(part, "x", model.dims))
                whole = [sum(v * v for v in row) for row in found.tolist()]
                whole = [v if v < 2**63 else None for v in whole]
                size = len(whole)
                each = pa.array(np.repeat(np.arange(size), kept))
                yield pa.RecordBatch.from_arrays([
                    part["vec_id"].cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * kept, model.count)), pa.array(whole, pa.int64()).take(each),
                    pa.array(model.project(found).reshape(-1)), pa.array(np.tile(model.explained, size)),
                    pa.array(np.full(size * kept, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, _RESULT)
