"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from commentlake.llm.staging import staged

MAX_DIM = 4096  # the scatter of so many dimensions is 128 MB
SWEEPS = 60
BATCH_ROWS = 2048


def pivoted_cholesky(scatter):
    """(factor, order): scatter[order][:, order] = factor @ factor.T with `factor` lower trapezoidal.

    The largest remaining diagonal entry is the next pivot; it ends where what remains is rounding (rank).
    """
    a = scatter.copy()
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    left = np.diag(a).copy()
    floor = d * np.finfo(float).eps * max(left.max(initial=0), 0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= floor:
            return factor[:, :k], order
        for v in (order, left):
            v[[k, p]] = v[[p, k]]
        factor[[k, p]] = factor[[p, k]]
        factor[k, k] = math.sqrt(left[k])
        row = a[order[k], order[k + 1:]] - factor[k + 1:, :k] @ factor[k, :k]
        factor[k + 1:, k] = row / factor[k, k]
        left[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def _rounds(n):
    """Every pair of n columns once, as rounds of disjoint pairs."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1:-1]) if max(a, b) < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        seats.insert(1, seats.pop())


def jacobi_columns(factor):
    """Rotates the columns of `factor` until all are orthogonal to 4 units of rounding; the product factor @ factor.T stays.

    Raises if they are not so after 60 sweeps.
    """
    g = factor.copy()
    rounds = list(_rounds(g.shape[1])) if g.shape[1] > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(a * b)
            cosine = np.abs(np.divide(c, scale, out=np.zeros_like(c), where=scale > 0))
            turn = cosine > 4 * np.finfo(float).eps
            worst = max(worst, cosine.max(initial=0))
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = x * cos - y * (t * cos), x * (t * cos) + y * cos
        if worst <= 16 * np.finfo(float).eps:
            return g
    raise RuntimeError(f"columns are not orthogonal after {SWEEPS} sweeps: cosine {worst:.1e}")


def principal(scatter):
    """(eigenvalues, components as columns) of a scatter matrix, falling; only those above the rank's rounding.

    The largest entry of each component is positive.
    """
    factor, order = pivoted_cholesky(scatter)
    g = np.zeros(factor.shape)
    g[order] = jacobi_columns(factor)
    values = (g * g).sum(0)
    rank = np.argsort(-values, kind="stable")
    values, g = values[rank], g[:, rank]
    g = g / np.sqrt(values)
    lead = np.abs(g).argmax(0)
    return values, g * np.sign(g[lead, np.arange(g.shape[1])])


def _matrix(column, d):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches, d):
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(lo, BATCH_ROWS)
            if part.num_rows:
                yield part, _matrix(part.column("x"), d)


def _sums(rows, d, of=None, k=None):
    """Exact column sums of integer vectors, or sums of what `of` makes of them (k columns)."""
    def run(batches):
        total = [0] * d if of is None else np.zeros(k)
        for _, x in _blocks(batches, d):
            if of is not None:
                total = total + of(x).sum(0)
            elif np.abs(x.astype(float)).max(initial=0) * len(x) < 2 ** 62:
                total = [t + int(v) for t, v in zip(total, x.sum(0))]
            else:
                total = [t + int(v) for t, v in zip(total, x.astype(object).sum(0))]
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total] if of is None else total)],
                              names=["i", "v"])
    kind = "string" if of is None else "double"
    value = F.sum(F.col("v").cast("decimal(38,0)")) if of is None else F.sum("v")
    found = {r.i: r.s for r in rows.mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(value.alias("s")).collect()}
    return [int(found[i]) if of is None else found[i] for i in range(d if of is None else k)]


def _scatter(rows, d, of, k):
    """Sum of the outer products of what `of` makes of the vectors (k columns, centred)."""
    def run(batches):
        total = np.zeros((k, k))
        for _, x in _blocks(batches, d):
            y = of(x)
            total += y.T @ y
        yield pa.record_batch([pa.array(np.repeat(np.arange(k, dtype=np.int32), k)),
                               pa.array(np.tile(np.arange(k, dtype=np.int32), k)), pa.array(total.ravel())], names=["i", "j", "v"])
    out = np.zeros((k, k))
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def integers(rows, vector="embedding", scale=256):
    """The rows whose vector has only finite entries and is not empty, with x: floor(scale * entry) as longs.

    Entries beyond the range of longs end at its limits.
    """
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(F.coalesce(ok, F.lit(False)))
    return kept.withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


class Whitening:
    """Fitted means, eigenvalues and components, all bounded by the dimension."""

    def __init__(self, n, sums, trace, values, components, identity_error):
        self.n, self.sums, self.trace, self.values = n, sums, trace, values
        self.components, self.identity_error = components, identity_error

    def transform(self, x):
        return (x - np.array([s / self.n for s in self.sums])) @ (self.components / np.sqrt(self.values))


def fit(vectors, components=4):
    """A Whitening of the distinct vectors in column x, or None if there is none.

    Vectors of another length than the commonest (ties: the longer) are left out. Components whose eigenvalue is rounding are too,
    so there may be fewer than asked for. `identity_error` is measured on the whitened vectors themselves.

    Scale: the distinct vectors are written once and read once for the sums, once for the centred scatter and twice for the error;
    a task sends d sums or d x d products (d at most 4,096, checked), which are added on the executors.
    """
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0].d
    if d > MAX_DIM:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIM}")
    rows = staged(vectors.where(F.size("x") == d).select("x").distinct())
    n, sums = rows.count(), _sums(rows, d)
    mean = np.array([s / n for s in sums])
    scatter = _scatter(rows, d, lambda x: x - mean, d) / n
    values, vectors_ = principal(scatter)
    values, vectors_ = values[:components], vectors_[:, :components]
    model = Whitening(n, sums, float(np.trace(scatter)), values, vectors_, 0.0)
    k = len(values)
    if k:
        middle = np.array(_sums(rows, d, model.transform, k)) / n
        cov = _scatter(rows, d, lambda x: model.transform(x) - middle, k) / n
        model.identity_error = float(np.abs(cov - np.eye(k)).max())
    return model


def _deviation(x, n, sums):
    """Sum over dimensions of (n * x - S)^2, exactly; None where it is no long."""
    most = n * np.abs(x.astype(float)).max(initial=0) + max(map(abs, sums))
    if most * most * len(sums) < 2 ** 62:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def whiten(vectors, model, id_col="vec_id"):
    """One row per vector and component: the projection of the centred vector over the root of the eigenvalue, and what the model says.

    `vectors` has the columns id_col (a long) and x. Ids may be null or repeat; other columns are not read. Without a model (no
    vectors), without spread (one distinct vector) or for a vector of another length there are no rows.
    """
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    k = 0 if model is None else len(model.values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    d, share = len(model.sums), model.values / model.trace

    def run(batches):
        for part, x in _blocks(batches, d):
            m = len(x)
            ids = part.column(id_col).cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.record_batch([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(model.transform(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error))],
                names=names)
    return vectors.where(F.size("x") == d).select(id_col, "x").mapInArrow(run, schema)
