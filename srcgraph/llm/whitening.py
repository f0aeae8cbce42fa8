"""Whitening of embeddings: leading principal components, scaled to variance one.

Vectors are put on a grid, ``x = floor(256 * c)``.  The fit list holds each distinct x once; every
covariance is over it, with divisor n, centred before multiplying.

1.  Sums per dimension are exact whole numbers, added up by Spark.
2.  Every task centres its vectors on the exact mean and sums their outer products; Spark adds the tasks'
    matrices entry by entry.  The driver receives one ``d x d`` matrix, whatever the number of vectors.
3.  Householder reflections turn the matrix into a tridiagonal one; Sturm counts (how many eigenvalues
    lie below a value) and bisection give the leading eigenvalues; inverse iteration gives their vectors,
    reorthogonalised inside clusters of close values; the reflections carry them back.
4.  Mean and scaled components are broadcast, and every vector is projected where it lies.
5.  One more pass over the fit list measures the covariance of the result against the identity; tasks'
    means and centred products are merged without uncentred squares.

Defined results: vectors that are null or hold null or non-finite entries are dropped; vectors of each
length are a table of their own (their own n, mean, components and error); an empty vector has no
components and so no rows; a vector of fewer dimensions than components has as many rows as dimensions;
a component without variance (all vectors equal, or fewer distinct vectors than components) has null
``whitened``, and null ``explained`` if there is no variance at all; it does not enter the error, which is
null if no component has variance.  Grid values beyond the range of a long are cut to it, and a deviation
beyond it is null.  Repeated rows and null ids give rows of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.stage import Stage

#: Steps of the grid in a unit, and components.
GRID, COMPONENTS = 256, 4
#: Vectors whose outer products are taken at once.
_ROWS = 4096


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections of the tridiagonal form of a symmetric matrix."""
    a = a.copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        largest = np.abs(v).max()
        if largest == 0 or not np.abs(v[1:]).any():
            mirrors.append(np.zeros_like(v))
            continue
        v /= largest
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        below = a[k + 1:, k + 1:]
        p = below @ v
        w = p - (v @ p) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = a[k + 1:, k]
        column -= 2 * v * (v @ column)
        a[k, k + 1:] = column
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, value: float) -> int:
    """Eigenvalues of the tridiagonal matrix below ``value``."""
    count, q = 0, 1.0
    tiny = np.finfo(float).tiny
    squares = np.concatenate(([0.0], off * off))
    for d, s in zip(diagonal.tolist(), squares.tolist(), strict=True):
        q = d - value - s / q
        if q == 0:
            q = tiny ** 0.5
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bit that bisection can tell."""
    n = len(diagonal)
    reach = np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    margin = np.finfo(float).eps * max(abs(low), abs(high)) * n
    low, high = low - margin, high + margin
    out = []
    for i in range(1, k + 1):
        a, b = low, high
        while True:
            middle = a + (b - a) / 2
            if not a < middle < b:
                break
            if sturm_count(diagonal, off, middle) <= n - i:
                a = middle
            else:
                b = middle
        out.append(a + (b - a) / 2)
        high = b  # the next one is not larger
    return np.array(out)


def _solve(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of (T - value) x = right by elimination with row exchanges."""
    n = len(diagonal)
    u, v, w = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n
    x = right.tolist()
    for i in range(n - 1):
        below, here, after = float(off[i]), u[i + 1], v[i + 1]
        if abs(below) > abs(u[i]):
            u[i], v[i], w[i], below, here, after = below, here, after, u[i], v[i], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        factor = below / (u[i] if u[i] else tiny)
        u[i + 1], v[i + 1] = here - factor * v[i], after - factor * w[i]
        x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        total = x[i]
        if i + 1 < n:
            total -= v[i] * x[i + 1]
        if i + 2 < n:
            total -= w[i] * x[i + 2]
        x[i] = total / (u[i] if abs(u[i]) > tiny else tiny)
        if abs(x[i]) > 1e150:  # scale while there is room
            scale = 1.0 / abs(x[i])
            x = [c * scale for c in x]
    return np.array(x)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values`` by inverse iteration."""
    n = len(diagonal)
    scale = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    tiny, close = np.finfo(float).eps * scale, 1e-3 * scale
    rng = np.random.default_rng(7)
    out = np.zeros((n, len(values)))
    first = 0  # of the cluster at hand
    for i, value in enumerate(values):
        if i and values[i - 1] - value > close:
            first = i
        x = rng.normal(size=n)
        # values of a cluster are moved apart, so that no two solves are the same
        shift = value - (i - first) * 2 * tiny
        for _ in range(steps):
            for _ in range(2):  # twice is enough to be orthogonal to the last bit
                x = x - out[:, first:i] @ (out[:, first:i].T @ x)
            x = _solve(diagonal, off, shift, x / np.sqrt(x @ x), tiny)
            x = x / np.abs(x).max()
        for _ in range(2):
            x = x - out[:, :i] @ (out[:, :i].T @ x)
            x = x / np.sqrt(x @ x)
        out[:, i] = x
    return out


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    n = len(covariance)
    k = min(k, n)
    scale = float(np.abs(covariance).max(initial=0))
    if scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, mirrors = householder(covariance / scale)
    values = leading_values(diagonal, off, k)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1:] -= 2 * np.outer(v, v @ vectors[at + 1:])
    # the first sizable entry is positive
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return values * scale, vectors * sign


def on_grid(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the vectors that are whole."""
    c = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    edge = float(1 << 62)

    def place(v):
        y = F.floor(F.greatest(F.least(v * F.lit(float(GRID)), F.lit(2 * edge - 1024)), F.lit(-2 * edge)))
        return y.cast("long")

    return c.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("embedding", place).alias("x"))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of every length among the lists of a column, as (places, matrix)."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x) to (d, i, n, high, low): exact sums; x is ``high * 2 ** 32 + low``."""
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            new = (len(x), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))
            old = found.get(x.shape[1])
            found[x.shape[1]] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]
    for d, (n, high, low) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)],
            names=["d", "i", "n", "high", "low"])


def _products(means: dict[int, np.ndarray]):
    """mapInArrow function: (x) to (d, i, j, v), sums of centred products for i <= j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {d: np.zeros((d, d)) for d in means}
        seen = set()
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                d = x.shape[1]
                seen.add(d)
                for lo in range(0, len(x), _ROWS):
                    y = x[lo:lo + _ROWS] - means[d]
                    found[d] += y.T @ y
        for d in sorted(seen):
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(found[d][i, j])],
                names=["d", "i", "j", "v"])
    return run


def _spread(model: dict):
    """mapInArrow function: (x) to (d, n, mean, products) of a task's whitened vectors, centred."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                m = model[x.shape[1]]
                y = (x - m["mean"]) @ m["scaled"][:, m["whole"]]
                mean = y.mean(0)
                new = (len(y), mean, (y - mean).T @ (y - mean))
                old = found.get(x.shape[1])
                found[x.shape[1]] = merged(old, new) if old else new
        for d, (n, mean, products) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d]), pa.array([n]), pa.array([mean], pa.list_(pa.float64())),
                 pa.array([products.ravel()], pa.list_(pa.float64()))], names=["d", "n", "mean", "products"])
    return run


def merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two parts together."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def fit_whitening(grid: DataFrame, k: int = COMPONENTS) -> dict[int, dict]:
    """Per length of vectors: n, sums (whole numbers), mean, values, scaled (components over the roots of
    their values), whole (components with variance), trace, error."""
    stage = Stage(grid.sparkSession, "whitening")
    fit, _ = stage.save(grid.select("x").distinct())
    sums = fit.mapInArrow(_sums, "d long, i long, n long, high long, low long").groupBy("d", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
        F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("d", "i").collect()  # d rows a length
    model: dict[int, dict] = {}
    for r in sums:
        m = model.setdefault(r["d"], {"n": r["n"], "sums": []})
        m["sums"].append((int(r["high"]) << 32) + int(r["low"]))
    for m in model.values():
        m["mean"] = np.array([s / m["n"] for s in m["sums"]])
    entries = fit.mapInArrow(_products({d: m["mean"] for d, m in model.items()}),
                             "d long, i long, j long, v double").groupBy("d", "i", "j").agg(
        F.sum("v").alias("v")).toArrow()  # a half matrix a length
    columns = [entries.column(c).to_numpy() for c in ("d", "i", "j", "v")]
    for d, m in model.items():
        i, j, v = (c[columns[0] == d] for c in columns[1:])
        covariance = np.zeros((d, d))
        covariance[i, j] = v / m["n"]
        covariance[j, i] = v / m["n"]
        m["trace"] = float(np.trace(covariance))
        values, vectors = leading_components(covariance, k)
        m["whole"] = np.flatnonzero(values > m["trace"] * d * 1e-14)
        m["values"] = values
        m["scaled"] = vectors / np.sqrt(np.where(values > m["trace"] * d * 1e-14, values, np.inf))
        m["error"] = None
    parts: dict[int, tuple] = {}
    for r in fit.mapInArrow(_spread(model), "d long, n long, mean array<double>, products array<double>"
                            ).toArrow().to_pylist():  # one small row a task and length
        size = len(r["mean"])
        new = (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(size, size))
        parts[r["d"]] = merged(parts[r["d"]], new) if r["d"] in parts else new
    for d, (n, _, products) in parts.items():
        if len(products):
            model[d]["error"] = float(np.abs(products / n - np.eye(len(products))).max())
    stage.drop(fit)
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n x - S) squared of every row."""
    most = max(max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)), 1)
    if most * most * x.shape[1] < 1 << 63:
        y = x * n - np.array(sums, dtype=np.int64)
        return (y * y).sum(1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every whole vector."""
    spark = vectors.sparkSession
    grid = on_grid(vectors)
    shared = spark.sparkContext.broadcast(fit_whitening(grid, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, x in _matrices(batch.column(1)):
                m = shared.value[x.shape[1]]
                size = len(m["values"])
                y = (x - m["mean"]) @ m["scaled"]
                whole = np.zeros(size, dtype=bool)
                whole[m["whole"]] = True
                off = np.tile(~whole, len(x))
                repeat = np.repeat(np.arange(len(x)), size)
                share = [v / m["trace"] if m["trace"] > 0 else None for v in m["values"].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at[repeat])), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(repeat), m["n"])),
                     pa.array(deviations(x, m["n"], m["sums"]), pa.int64()).take(pa.array(repeat)),
                     pa.array(y.ravel(), pa.float64(), mask=off),
                     pa.array(share * len(x), pa.float64()),
                     pa.array([m["error"]] * len(repeat), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, "
                                "explained double, identity_error double")
