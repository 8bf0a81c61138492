"""Embedding whitening by spectrum slicing.

The covariance is brought to tridiagonal form T by reflections, which keep eigenvalues.  For a shift
s the pivots of LDL^T = T - s I have as many positive entries as T has eigenvalues above s, so counts
over many shifts at once isolate each leading eigenvalue in an interval of its own.  Rayleigh quotient
iteration on the full matrix then converges cubically from the interval's midpoint, and two more
counts, just below and just above the value found, certify its number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import written

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
#: Values outside this range are not representable after scaling; their rows count as not finite.
LARGEST = 2.0**55
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
EPS = np.finfo(float).eps


# ---- eigenvalues of a symmetric matrix --------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the matrix after reflections from both sides."""
    a = np.array(matrix, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        x[0] -= alpha
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x / size
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = alpha
        a[k + 2:, k] = a[k, k + 2:] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues above each shift: positive pivots of LDL^T of the shifted matrix."""
    shifts = np.asarray(shifts, float)
    squares = off * off
    tiny = EPS * EPS * (np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0)) + np.finfo(float).tiny
    pivot = diagonal[0] - shifts
    found = (pivot > 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - squares[i - 1] / pivot
        found += pivot > 0
    return found


def slices(diagonal: np.ndarray, off: np.ndarray, wanted: int, width: float) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, above, inside) that hold the ``wanted`` largest eigenvalues, the highest first.

    ``above`` eigenvalues lie over the interval and ``inside`` in it; only intervals narrower than
    ``width`` hold more than one.
    """
    n = len(diagonal)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    pad = EPS * n * max(abs(low), abs(high)) + np.finfo(float).tiny
    todo, done = [(low - pad, high + pad, 0, n)], []
    while todo:
        middles = np.array([(a + b) / 2 for a, b, _, _ in todo])
        counts = count_above(diagonal, off, middles)
        parts = []
        for (a, b, above, inside), m, c in zip(todo, middles.tolist(), counts.tolist()):
            parts.append((m, b, above, c - above))
            parts.append((a, m, c, above + inside - c))
        todo = []
        for part in parts:
            a, b, above, inside = part
            if inside <= 0 or above >= wanted:
                continue
            lonely = inside == 1 and b - a < 0.05 * max(abs(a), abs(b), width)
            (done if lonely or b - a <= width else todo).append(part)
    return sorted(done, key=lambda x: x[2])


def _rayleigh(matrix: np.ndarray, shift: float, x: np.ndarray, known: np.ndarray) -> tuple[float, np.ndarray]:
    """Value and unit vector nearest the shift, orthogonal to the columns of ``known``."""
    def clean(v):
        for _ in range(2):
            v = v - known @ (known.T @ v)
        return v / np.linalg.norm(v)

    eye = np.eye(len(matrix))
    scale = np.abs(matrix).sum(axis=1).max()
    x = clean(x)
    value, last = shift, np.inf
    for step in range(60):
        try:
            y = np.linalg.solve(matrix - value * eye, x)
        except np.linalg.LinAlgError:  # the shift is the value to the last bit
            y = np.linalg.solve(matrix - (value + EPS * scale) * eye, x)
        if not np.isfinite(y).all():
            break
        x = clean(y)
        value = float(x @ matrix @ x) if step else value  # the first solve at the interval's midpoint turns x towards its vector
        rest = np.linalg.norm(matrix @ x - float(x @ matrix @ x) * x)
        if rest <= 4 * EPS * scale or (step > 2 and rest >= last):
            break
        last = rest
    return float(x @ matrix @ x), x


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors as columns.

    Each value is certified: the counts at its two sides, at a distance of the rounding error, differ
    by what lies there.  A quotient iteration that ends at another value starts again from a narrower
    interval.
    """
    n = len(matrix)
    wanted = min(wanted, n)
    diagonal, off = tridiagonal(matrix)
    scale = max(float(np.abs(matrix).sum(axis=1).max()), np.finfo(float).tiny)
    close = 64 * EPS * n * scale
    values: list[float] = []
    vectors = np.zeros((n, 0))
    draws = np.random.default_rng(11)
    for low, high, above, inside in slices(diagonal, off, wanted, close):
        for k in range(inside):
            if len(values) == wanted:
                break
            a, b = low, high
            for _ in range(80):
                value, x = _rayleigh(matrix, (a + b) / 2, draws.standard_normal(n), vectors)
                up, down = count_above(diagonal, off, np.array([value + close, value - close])).tolist()
                number = above + k + 1
                if up < number <= down or b - a <= close:
                    break
                m = (a + b) / 2  # not the eigenvalue of this interval: halve it by one more count
                a, b = (m, b) if count_above(diagonal, off, np.array([m]))[0] >= number else (a, m)
            values.append(value)
            vectors = np.column_stack([vectors, x])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


# ---- the operator ---------------------------------------------------------------------------

def _vectors(frame: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector is whole: no null or non-finite entry, not empty."""
    entry = lambda f: (lambda c: f(c.cast("double")))
    whole = F.forall("embedding", entry(lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False)) & ~F.isnan(c)))
    return (
        frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
        .filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
        .select("vec_id", F.transform("embedding", entry(lambda c: F.floor(c * SCALE).cast("long") + SHIFT)).alias("x"))
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(vectors: DataFrame, make, width: int) -> np.ndarray:
    """Sum over all rows of the square matrices that ``make`` gives for each batch.

    A task sends one line for each row of its matrix and Spark adds them by line, so the driver gets
    one matrix whatever the number of tasks.
    """
    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                m = make(batch)
                total = m if total is None else total + m
        if total is not None:
            lines = pa.array(list(range(len(total))), pa.int32())
            yield pa.RecordBatch.from_arrays([lines, pa.array(list(total), pa.list_(pa.float64()))], names=["line", "entries"])

    lines = vectors.mapInArrow(part, "line int, entries array<double>")
    cells = lines.select("line", F.posexplode("entries").alias("at", "entry")).groupBy("line", "at").agg(F.sum("entry").alias("entry"))
    out = np.zeros((width, width))
    for r in cells.collect():  # width * width numbers
        out[r["line"], r["at"]] = r["entry"]
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows of ``embeddings`` projected on the leading components, scaled to unit variance.

    Rows with a null vector, or a null, non-finite or unrepresentable entry (2 ** 55 or more), are
    dropped, and so are vectors whose length differs from the most frequent one (the longer, if two
    are equally frequent).  Null and repeated ids stay, each row on its own; other columns are
    ignored; an empty table gives no rows.  There are at most ``components`` components and no more
    than directions with a variance above rounding.  Sums and deviations are exact integers; a
    deviation that no long can hold is null.  The driver holds matrices of the vector's length only.
    """
    spark = embeddings.sparkSession
    vectors = _vectors(embeddings)
    lengths = vectors.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    dims, n = lengths[0]["dims"], lengths[0]["count"]
    vectors = written(spark, vectors.filter(F.size("x") == dims), "vectors")
    sums = vectors.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    total = [0] * dims
    for r in sums.collect():  # one number for each dimension
        total[r["at"]] = int(r["s"])
    centre = [round(s / n) for s in total]  # an integer near the mean: x - centre is exact
    rest = [s - n * c for s, c in zip(total, centre)]  # S - n * centre
    middle, part = np.array(centre, np.int64), np.array(rest, np.int64) / n

    def centred(batch) -> np.ndarray:
        return (_matrix(batch.column("x"), dims) - middle) - part

    covariance = _sums(vectors, lambda b: (lambda d: d.T @ d)(centred(b)), dims) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, axes = leading(covariance, components)
    keep = values > 64 * EPS * dims * max(trace, 0.0)
    values, axes = values[keep], axes[:, keep]
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    project = axes / np.sqrt(values)

    def moments(batch) -> np.ndarray:  # products and, in the last line, sums
        w = np.column_stack([centred(batch) @ project, np.ones(batch.num_rows)])
        return w.T @ w

    found = _sums(vectors, moments, k + 1) / n
    spread = found[:k, :k] - np.outer(found[k, :k], found[k, :k])
    error = float(np.abs(spread - np.eye(k)).max())
    explained = values / trace
    small = int(max(abs(r) for r in rest))

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                m = piece.num_rows
                if not m:
                    continue
                y = _matrix(piece.column("x"), dims) - middle
                scaled = (y - part) @ project
                bound = float(n) * np.abs(y).max(axis=1).astype(float) + small
                sure = bound * bound * dims < 2.0**62
                off = np.where(sure[:, None], y, 0) * n - np.array(rest, np.int64)
                deviation = (off * off).sum(axis=1).tolist()
                for i in np.flatnonzero(~sure).tolist():
                    exact = sum((n * int(v) - r) ** 2 for v, r in zip(y[i].tolist(), rest))
                    deviation[i] = exact if exact < 2**63 else None
                spread_out = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    piece.column("vec_id").take(pa.array(spread_out)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(spread_out)),
                    pa.array(scaled.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ], names=NAMES)

    return vectors.mapInArrow(rows, SCHEMA)
