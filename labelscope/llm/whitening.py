"""Embedding whitening by an incremental eigendecomposition.

The entries c of a vector become whole numbers x = floor(SCALE * c) + SHIFT.
The components are the unit eigenvectors of the covariance of x over all
vectors that are left (divisor n), by falling eigenvalue.

Partitions.  A task deals its vectors to ``LANES`` lanes and keeps, for each,
n, the mean, and the eigenvalues and eigenvectors of the scatter matrix.  A
vector's difference d to the mean adds n / (n + 1) * d d', a rank-one change:
in the eigenvectors' own axes the new eigenvalues are the roots of the secular
equation 1 + rho * sum z_i^2 / (d_i - x) = 0, one between two successive old
ones, found for all roots of all lanes at once by fitting a simple pole to the
terms on either side of each.  Axes that the change does not touch, and all but
one of equal eigenvalues (after a rotation), are deflated: they stay as they
are.  The new vectors come from weights computed back from the roots, which
keeps them orthogonal.

Combining.  Spectra are merged a few at a time, in rounds, by successive
rank-one changes: each eigenvector of the one, scaled, and the difference of
the means change the other.

Refinement.  One more pass forms the covariance in the axes found (centred with
the exact mean before multiplying) and solves it there (Rayleigh-Ritz); the
axes span the whole space, so the result is exact to double precision whatever
rounding the updates took.  A last aggregate measures the covariance of the
whitened values.  What the driver and a task hold follows the dimension only.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are left out, and so are vectors whose length is not the most frequent
one (of equally frequent ones the largest); repeated rows and null ids count
and are returned one by one; a component without variance has a null whitened
value and takes no part in the identity error; with no vector left the result
is empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.scratch import parked

SCALE, SHIFT = 1024, 100_000
LANES, CELLS = 16, 1 << 16  # lanes of a task, and entries of all their eigenvectors, at most (one lane at least)
FAN = 16  # spectra or matrices that one task merges
EPS = np.finfo(float).eps


def rotate_equal(d: np.ndarray, z: np.ndarray, vectors: np.ndarray, tol: np.ndarray) -> None:
    """Rotate pairs of nearly equal eigenvalues so that only one of them has a weight, in place; all lanes at once."""
    lane = np.arange(len(d))
    before = np.full(len(d), -1)
    for i in range(d.shape[1]):
        here = z[:, i] != 0
        pair = np.flatnonzero(here & (before >= 0))
        if len(pair):
            j = before[pair]
            length = np.hypot(z[pair, j], z[pair, i])
            c, s, gap = z[pair, i] / length, -z[pair, j] / length, d[pair, i] - d[pair, j]
            near = np.abs(gap * c * s) <= tol[pair]
            pair, j, length, c, s = pair[near], j[near], length[near], c[near], s[near]
            if len(pair):
                z[pair, i], z[pair, j] = length, 0
                a, b = vectors[pair, :, j].copy(), vectors[pair, :, i].copy()
                vectors[pair, :, j], vectors[pair, :, i] = c[:, None] * a + s[:, None] * b, c[:, None] * b - s[:, None] * a
                x, y = d[pair, j].copy(), d[pair, i].copy()
                d[pair, j], d[pair, i] = x * c * c + y * s * s, x * s * s + y * c * c
        before[lane[here]] = i


def secular_roots(d: np.ndarray, w: np.ndarray, rho: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum w_i / (d_i - x), as (index of the pole each is measured from, offset to it).

    ``d`` ascends over the live poles; the root of live pole j lies between it
    and the next live one, or below d_j + rho * sum w for the last.  Dead poles
    (w = 0) have the offset 0 to themselves."""
    lanes, k = d.shape
    index = np.arange(k)
    high = np.where(live, index, k)
    after = np.minimum.accumulate(np.append(high, np.full((lanes, 1), k), 1)[:, ::-1], axis=1)[:, ::-1][:, 1:]  # the next live pole, or k
    last = after == k
    after = np.minimum(after, k - 1)
    right = np.take_along_axis(d, after, 1)
    gap = np.where(last, (rho * w.sum(1))[:, None], right - d)
    left_of = (index[None, :] <= index[:, None])[None]  # [root, pole]: poles up to the root's own
    weight = (rho[:, None] * w)[:, None, :]
    from_left = d[:, None, :] - d[:, :, None]

    def terms(shift: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums and derivatives of the terms of poles left and right of each root."""
        far = shift - x[:, :, None]
        far[far == 0] = np.inf
        t = weight / far
        slope = t / far
        t_left, s_left = np.where(left_of, t, 0).sum(2), np.where(left_of, slope, 0).sum(2)
        return t_left, s_left, t.sum(2) - t_left, slope.sum(2) - s_left

    middle = terms(from_left, gap / 2)
    near_right = (1 + middle[0] + middle[2] < 0) & ~last  # the function rises: its root is in the right half
    origin = np.where(near_right, after, index[None])
    shift = d[:, None, :] - np.take_along_axis(d, origin, 1)[:, :, None]
    low, up = np.where(near_right, -gap / 2, 0.0), np.where(near_right, 0.0, np.where(last, gap, gap / 2))
    x = np.where(near_right, -gap / 4, np.where(last, gap / 2, gap / 4))
    a, b = np.where(near_right, -gap, 0.0), np.where(near_right, 0.0, gap)  # the two poles
    done = ~live
    for _ in range(60):
        t0, s0, t1, s1 = terms(shift, x)
        value = 1 + t0 + t1
        low, up = np.where(value <= 0, x, low), np.where(value > 0, x, up)
        done |= (np.abs(value) <= 8 * EPS * (1 + np.abs(t0) + np.abs(t1))) | (up - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(up)))
        if done.all():
            break
        # t0 as r0 + q0 / (a - x) and t1 as r1 + q1 / (b - x), with their derivatives
        da, db = a - x, b - x
        q0, q1 = s0 * da * da, np.where(last, 0.0, s1 * db * db)
        c = 1 + t0 - s0 * da + np.where(last, 0.0, t1 - s1 * db)
        # c (a - y)(b - y) + q0 (b - y) + q1 (a - y) = 0 with y = x + step
        with np.errstate(all="ignore"):
            p, q, r = c, -(c * (da + db) + q0 + q1), c * da * db + q0 * db + q1 * da
            root = np.sqrt(np.maximum(q * q - 4 * p * r, 0))
            big = -(q + np.where(q >= 0, root, -root)) / 2
            first, second = big / p, r / big
            single = da + q0 / c
            new = [x + s for s in (first, second, single)]
        inside = [np.isfinite(y) & (y > low) & (y < up) for y in new]
        y = np.where(last, np.where(inside[2], new[2], (low + up) / 2),
                     np.where(inside[1], new[1], np.where(inside[0], new[0], (low + up) / 2)))
        x = np.where(done, x, y)
    return np.where(live, origin, index[None]), np.where(live, x, 0.0)


def rank_one(d: np.ndarray, vectors: np.ndarray, rho: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of U diag(d) U' + rho v v' for every lane; ``rho`` is not negative."""
    d, vectors = d.copy(), vectors.copy()
    z = np.matmul(v[:, None, :], vectors)[:, 0]
    norm = np.sqrt((z * z).sum(1))
    z /= np.where(norm > 0, norm, 1)[:, None]
    rho = rho * norm * norm
    tol = 8 * EPS * np.maximum(np.abs(d).max(1), rho)
    z[np.abs(z) * rho[:, None] <= tol[:, None]] = 0
    live = z != 0
    place = np.where(live, np.arange(d.shape[1]), -1)
    before = np.maximum.accumulate(place, axis=1)[:, :-1]
    at = np.maximum(before, 0)
    z_before, d_before = np.take_along_axis(z, at, 1), np.take_along_axis(d, at, 1)
    length = z[:, 1:] ** 2 + z_before ** 2
    with np.errstate(all="ignore"):
        near = live[:, 1:] & (before >= 0) & (np.abs((d[:, 1:] - d_before) * z[:, 1:] * z_before) <= tol[:, None] * length)
    some = np.flatnonzero(near.any(1))
    if len(some):
        part = d[some], z[some], vectors[some]
        rotate_equal(*part, tol[some])
        d[some], z[some], vectors[some] = part
        live = z != 0
    touched = live.any(1)
    if not touched.any():
        return _sorted(d, vectors)
    w = z * z
    origin, x = secular_roots(d, w, rho, live)
    roots = np.take_along_axis(d, origin, 1) + x
    # root - pole, without cancellation: [lane, root, pole]
    apart = (np.take_along_axis(d, origin, 1)[:, :, None] - d[:, None, :]) + x[:, :, None]
    both = live[:, :, None] & live[:, None, :]
    own = np.eye(d.shape[1], dtype=bool)[None]
    poles = d[:, :, None] - d[:, None, :]
    with np.errstate(all="ignore"):
        ratio = np.where(both & ~own, apart / poles, np.where(both & own, apart, 1.0))
        weight = np.sqrt(np.abs(ratio.prod(1))) * np.sign(z)
        q = np.where(both, weight[:, None, :] / -apart, np.where(own & ~both, 1.0, 0.0))  # [lane, root, axis]
        q[~np.isfinite(q)] = 0
    q /= np.sqrt((q * q).sum(2))[:, :, None]
    return _sorted(np.where(live, roots, d), np.matmul(vectors, q.transpose(0, 2, 1)))


def _sorted(d: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if (d[:, 1:] < d[:, :-1]).any():
        order = np.argsort(d, axis=1)
        d, vectors = np.take_along_axis(d, order, 1), np.take_along_axis(vectors, order[:, None, :], 2)
    return d, vectors


class Spectra:
    """n, mean, eigenvalues and eigenvectors of the scatter matrices of some lanes."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def empty(cls, lanes: int, size: int) -> Spectra:
        return cls(np.zeros(lanes), np.zeros((lanes, size)), np.zeros((lanes, size)), np.tile(np.eye(size), (lanes, 1, 1)))

    def add(self, x: np.ndarray) -> None:
        """One more vector for each of the first lanes."""
        m = len(x)
        n, apart = self.n[:m], x - self.mean[:m]
        self.values[:m], self.vectors[:m] = rank_one(self.values[:m], self.vectors[:m], n / (n + 1), apart)
        self.mean[:m] += apart / (n + 1)[:, None]
        self.n[:m] += 1

    def merge(self, other: Spectra) -> None:
        """Add the other's vectors lane by lane: its eigenvectors as rank-one changes, then the difference of the means."""
        for i in range(other.values.shape[1]):
            self.values, self.vectors = rank_one(self.values, self.vectors, np.maximum(other.values[:, i], 0), other.vectors[:, :, i])
        n = np.maximum(self.n + other.n, 1)
        apart = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / n, apart)
        self.mean += apart * (other.n / n)[:, None]
        self.n += other.n

    def lanes(self, which: slice) -> Spectra:
        return Spectra(self.n[which].copy(), self.mean[which].copy(), self.values[which].copy(), self.vectors[which].copy())

    def joined(self) -> Spectra:
        """All lanes merged into one, half of them into the other half at a time."""
        out = self
        while len(out.n) > 1:
            half = len(out.n) // 2
            rest = out.lanes(slice(2 * half, None))
            left = out.lanes(slice(0, half))
            left.merge(out.lanes(slice(half, 2 * half)))
            out = Spectra(*(np.concatenate([getattr(left, a), getattr(rest, a)]) for a in ("n", "mean", "values", "vectors")))
        return out

    def packed(self) -> bytes:
        return np.concatenate([self.n, self.mean[0], self.values[0], self.vectors[0].ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data: list[bytes], size: int) -> Spectra:
        a = np.stack([np.frombuffer(x) for x in data])
        return cls(a[:, 0].copy(), a[:, 1:size + 1].copy(), a[:, size + 1:2 * size + 1].copy(), a[:, 2 * size + 1:].reshape(-1, size, size).copy())


def whole(column: pa.Array, size: int) -> np.ndarray:
    """x of a batch's vectors of ``size`` entries, as longs."""
    y = np.floor(SCALE * np.asarray(column.flatten(), float).reshape(-1, size)) + SHIFT
    if len(y) and np.abs(y).max() >= 2.0 ** 53:
        raise ValueError("an entry is too large to become a whole number")
    return y.astype(np.int64)


def folded(parts: DataFrame, name: str, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """All rows (node, data) merged ``FAN`` at a time, in rounds; None if there are none."""
    parts = parked(parts, name)
    last = parts.agg(F.max("node")).first()[0]
    if last is None:
        return None

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        return pa.table([pa.array([table["node"][0].as_py() // FAN], pa.int64()), pa.array([merge(table["data"].to_pylist())], pa.binary())],
                        names=["node", "data"])
    while True:
        parts = parts.groupBy(F.floor(F.col("node") / FAN).alias("parent")).applyInArrow(group, "node long, data binary")
        if last < FAN:
            return bytes(parts.first()["data"])
        last //= FAN


def task_rows(vectors: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> DataFrame:
    """(node, data) with what ``each`` makes of every partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = each(batches)
        if data is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([data], pa.binary())], ["node", "data"])
    return vectors.select("vector").mapInArrow(run, "node long, data binary")


def spectrum(vectors: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(n, exact sums, eigenvectors) of all vectors, by rank-one changes."""
    lanes = min(LANES, max(1, CELLS // size ** 2))

    def each(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        held, total = Spectra.empty(lanes, size), np.zeros(size, object)
        for batch in batches:
            x = whole(batch["vector"], size)
            total += x.sum(0).astype(object)
            for a in range(0, len(x), lanes):
                held.add(x[a:a + lanes].astype(float))
        return _with_sums(total, held.joined()) if held.n.any() else None

    def merge(data: list[bytes]) -> bytes:
        cut = [x.index(b";") + 1 for x in data]
        total = sum((np.array([int(i) for i in x[:c - 1].split(b",")], object) for x, c in zip(data, cut)), np.zeros(size, object))
        return _with_sums(total, Spectra.unpacked([x[c:] for x, c in zip(data, cut)], size).joined())
    data = folded(task_rows(vectors, each), "spectra", merge)
    if data is None:
        return None
    head, _, rest = data.partition(b";")
    out = Spectra.unpacked([rest], size)
    return int(out.n[0]), np.array([int(i) for i in head.split(b",")], object), out.vectors[0]


def _with_sums(total: np.ndarray, spectra: Spectra) -> bytes:
    """The exact sums as decimals before the packed spectrum."""
    return b",".join(b"%d" % int(i) for i in total) + b";" + spectra.packed()


def added(data: list[bytes]) -> bytes:
    return sum(np.frombuffer(x) for x in data).tobytes()


def refined(vectors: DataFrame, size: int, mean: np.ndarray, axes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, eigenvectors as columns) of the covariance, by Rayleigh-Ritz in ``axes``."""
    axes = np.linalg.qr(axes)[0]

    def each(batches: Iterator[pa.RecordBatch]) -> bytes:
        out = np.zeros((size, size))
        for batch in batches:
            y = (whole(batch["vector"], size) - mean) @ axes
            out += y.T @ y
        return out.tobytes()
    inner = np.frombuffer(folded(task_rows(vectors, each), "inner", added)).reshape(size, size) / n
    values, q = np.linalg.eigh((inner + inner.T) / 2)
    return np.maximum(values[::-1], 0), axes @ q[:, ::-1]


def moments(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    mean = w.mean(0)
    return float(len(w)), mean, (w - mean).T @ (w - mean)


def identity_error(vectors: DataFrame, size: int, mean: np.ndarray, project: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the projected vectors minus the identity."""
    k = project.shape[1]

    def joined(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> bytes:
        n, m, c = parts[0]
        for n2, m2, c2 in parts[1:]:
            apart = m2 - m
            c = c + c2 + np.outer(apart, apart) * (n * n2 / (n + n2))
            m, n = m + apart * (n2 / (n + n2)), n + n2
        return np.concatenate([[n], m, c.ravel()]).tobytes()

    def split(data: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        a = np.frombuffer(data)
        return a[0], a[1:k + 1], a[k + 1:].reshape(k, k)

    def each(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        parts = [moments((whole(b["vector"], size) - mean) @ project) for b in batches if b.num_rows]
        return joined(parts) if parts else None
    n, _, c = split(folded(task_rows(vectors, each), "identity", lambda data: joined([split(x) for x in data])))
    return float(np.abs(c / n - np.eye(k)).max()) if k else 0.0


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int] | np.ndarray:
    """Exact sum over dimensions of (n * x - total)^2 of every row."""
    bound = n * float(np.abs(x).max(initial=0)) + float(max(map(abs, total)))
    if bound < 2.0 ** 62:
        apart = x * n - total.astype(np.int64)
        if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
            return (apart * apart).sum(1)
        apart = apart.astype(object)
    else:
        apart = x.astype(object) * n - total
    return [int(s) for s in (apart * apart).sum(1)]


def whiten(table: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error) of every remaining vector."""
    spark = table.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = table.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).where(
        (F.size("vector") > 0) & F.forall("vector", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    common = vectors.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["size"]
    vectors = vectors.where(F.size("vector") == size)
    n, total, axes = spectrum(vectors, size)
    mean = np.array([int(s) / n for s in total])
    values, axes = refined(vectors, size, mean, axes, n)
    k = min(components, size)
    alive = values[:k] > size * EPS * values[0]
    project = axes[:, :k][:, alive] / np.sqrt(values[:k][alive])
    error = identity_error(vectors, size, mean, project)
    explained = values[:k] / values.sum() if values.sum() > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch["vector"], size)
            m = len(x)
            w = np.full((m, k), np.nan)
            w[:, alive] = (x - mean) @ project
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                 pa.array(deviations(x, n, total)).cast(pa.decimal128(38, 0)).take(row), pa.array(w.ravel(), from_pandas=True),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return vectors.mapInArrow(run, schema)
