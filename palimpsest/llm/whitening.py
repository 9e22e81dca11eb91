"""Whitening by an incremental eigendecomposition of the covariance.

A task holds for its rows the count, the mean and the eigendecomposition Q diag(e) Q' of the centred
scatter.  A vector u adds rho u u': in the eigenbasis the new eigenvalues are the roots of the secular
equation 1 + rho sum z_i^2 / (e_i - t) = 0, one between any two old ones, found in all intervals at once
after deflation (entries of z that vanish, eigenvalues that coincide).  The new eigenvectors come from
the z for which the computed roots are exact, so they stay orthogonal.

Rows come in blocks.  A block's scatter round its own mean is R'R, with R from an orthogonal
triangularisation, so the d rows of R are applied as rank-one updates in place of all rows of the block, and
one more for the distance between the two means.  Spectra of tasks are combined the same way, by one
update for each eigenpair and one for the means, in rounds of about ``FAN`` to a task.

The merged basis then only serves as the start of one Rayleigh-Ritz step over all rows: the covariance is
summed anew in that basis, in which it is nearly diagonal, and its eigenvectors turn the basis into the
components.  What reaches the driver is d x d numbers a step, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.vectors import clean, matrix, pieces, width
from palimpsest.llm.words import Shared
from palimpsest.scratch import stage

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
LIMIT = 1 << 40
BLOCK = 1024
FAN = 32
EPS = np.finfo(float).eps
RANK = 1e-13  # components with a smaller share of the variance are noise of rounding


def secular_roots(e: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum z2 / (e - t)`` for rising, distinct ``e`` and positive ``z2``.

    Each root is given by the pole nearest to it and its distance from there, which keeps it exact to
    the last digits however near they lie.  Iterates by the quadratic through both poles of the interval,
    inside a bracket that each step narrows.
    """
    k = len(e)
    ends = np.append(e[1:], e[-1] + z2.sum())
    gap = ends - e
    middle = e + gap / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 1 + (z2[None] / (e[None] - middle[:, None])).sum(axis=1)
    right = (value < 0) & (np.arange(k) < k - 1)  # the root lies in the right half
    base = np.where(right, np.arange(k) + 1, np.arange(k))
    poles = e[None] - e[base][:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(value < 0, gap, gap / 2))
    low = np.where(~right & (value < 0), gap / 2, low)
    t = (low + high) / 2
    left = np.tri(k, dtype=bool)  # poles up to the own one
    near, far = e - e[base], ends - e[base]
    open_ = np.arange(k)
    for _ in range(60):
        apart = poles[open_] - t[open_, None]
        term = z2[None] / apart
        slope = term / apart
        below = left[open_]
        f = 1 + term.sum(axis=1)
        psi, phi = np.where(below, slope, 0).sum(axis=1), np.where(below, 0, slope).sum(axis=1)
        up = f < 0
        low[open_] = np.where(up, t[open_], low[open_])
        high[open_] = np.where(up, high[open_], t[open_])
        one, two = near[open_] - t[open_], far[open_] - t[open_]
        a = (one + two) * f - one * two * (psi + phi)
        b = one * two * f
        c = f - one * psi - two * phi
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = t[open_] + step
        bad = ~np.isfinite(new) | (new <= low[open_]) | (new >= high[open_])
        new = np.where(bad, (low[open_] + high[open_]) / 2, new)
        exact = np.abs(f) <= 4 * EPS * (1 + np.abs(term).sum(axis=1))
        done = exact | (high[open_] - low[open_] <= 2 * EPS * np.abs(t[open_]))
        t[open_] = np.where(exact, t[open_], new)
        open_ = open_[~done]
        if not len(open_):
            break
    return base, t


class Spectrum:
    """Count, mean and eigendecomposition of the centred scatter, eigenvalues rising."""

    def __init__(self, d: int):
        self.n, self.mean = 0, np.zeros(d)
        self.values, self.basis = np.zeros(d), np.eye(d)

    def update(self, u: np.ndarray, rho: float = 1.0) -> None:
        """Adds ``rho u u'`` to the scatter."""
        z = self.basis.T @ u
        size = rho * (z @ z)
        if not size > 0:
            return
        e, q = self.values, self.basis
        top = max(abs(e[-1]), size)
        z = z * np.sqrt(rho)
        weak = np.abs(z) * np.sqrt(size) <= 8 * EPS * top  # these eigenpairs stay
        same = np.flatnonzero(~weak)
        # eigenvalues that coincide: a turn in their plane moves all of z into one of them
        tight = np.flatnonzero(np.diff(e[same]) <= 8 * EPS * top) if len(same) > 1 else []
        if len(tight):
            q = q.copy()
            for i in tight:
                a, b = same[i], same[i + 1]
                r = np.hypot(z[a], z[b])
                cos, sin = z[b] / r, z[a] / r
                one, two = q[:, a].copy(), q[:, b].copy()
                q[:, a], q[:, b] = cos * one - sin * two, sin * one + cos * two
                z[a], z[b] = 0.0, r
                weak[a] = True
            same = np.flatnonzero(~weak)
        e = e.copy()
        if len(same) == 1:
            e[same] += z[same] ** 2
        elif len(same):
            d, w = e[same], z[same]
            base, t = secular_roots(d, w * w)
            apart = d[None] - d[base][:, None] - t[:, None]  # d_i - root_j at [j, i]
            # the z of which these roots are exact
            ratio = -apart.T  # [i, j]
            gaps = d[None] - d[:, None]  # d_j - d_i at [i, j]
            np.fill_diagonal(gaps, 1.0)
            exact = np.sqrt(np.abs(np.prod(ratio / gaps, axis=1)))
            vectors = np.copysign(exact, w)[:, None] / apart.T
            vectors /= np.linalg.norm(vectors, axis=0)
            e[same] = d[base] + t
            if q is self.basis:
                q = q.copy()
            q[:, same] = q[:, same] @ vectors
        order = np.argsort(e, kind="stable")
        self.values, self.basis = e[order], q[:, order]

    def shift(self, n: int, mean: np.ndarray) -> None:
        """Takes in ``n`` rows with this mean, whose scatter has been added."""
        if n:
            self.update(mean - self.mean, self.n * n / (self.n + n))
            self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
            self.n += n

    def take(self, rows: np.ndarray) -> None:
        if len(rows):
            mean = rows.mean(axis=0)
            apart = rows - mean
            for u in np.linalg.qr(apart, mode="r") if len(rows) > rows.shape[1] else apart:
                self.update(u)
            self.shift(len(rows), mean)

    def merge(self, other: Spectrum) -> None:
        for value, u in zip(other.values, other.basis.T):
            if value > 0:
                self.update(u, value)
        self.shift(other.n, other.mean)

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.basis.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, body: bytes) -> Spectrum:
        flat = np.frombuffer(body, "<f8")
        d = round(len(flat) ** 0.5) - 1  # 1 + d + d + d d numbers
        out = cls(d)
        out.n, out.mean, out.values = int(flat[0]), flat[1 : d + 1].copy(), flat[d + 1 : 2 * d + 1].copy()
        out.basis = flat[2 * d + 1 :].reshape(d, d).copy()
        return out


def integers(found: Iterator[pa.RecordBatch], kind: str, scale: int, shift: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(found):
        whole = np.floor(np.clip(matrix(batch.column("body"), kind), -1e30, 1e30) * scale)
        whole = np.clip(whole, -LIMIT, LIMIT).astype("<i8") + shift
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array([x.tobytes() for x in whole], pa.binary())], names=["vec_id", "body"])


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """The integers as they are: not through floats."""
    if not batch.num_rows:
        return np.zeros((0, 0), np.int64)
    return np.frombuffer(b"".join(batch.column("body").to_pylist()), "<i8").reshape(batch.num_rows, -1)


def spectra(found: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """One spectrum a task, and the exact sums of its rows."""
    own, total = Spectrum(d), [0] * d
    for batch in pieces(found, BLOCK):
        x = whole(batch)
        if len(x):
            own.take(x.astype(float))
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
    if own.n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.packed()], pa.binary()), pa.array([own.n]), pa.array([[str(x) for x in total]])],
            names=["spectrum", "n", "total"])


def combined(table: pa.Table) -> pa.Table:
    found = [Spectrum.unpacked(x) for x in table.sort_by("rank").column("spectrum").to_pylist()]
    for other in found[1:]:
        found[0].merge(other)
    return pa.table({"group": table.column("group")[:1], "spectrum": pa.array([found[0].packed()], pa.binary())})


def combine(parts: DataFrame, fan: int = FAN) -> Spectrum | None:
    """The spectrum of all parts; each round merges ``fan`` of them in one task."""
    held = parts.count()
    while held > 1:
        dealt = parts.selectExpr("spectrum", "xxhash64(spectrum) AS rank").withColumn(
            "group", F.pmod("rank", F.lit(-(-held // fan))).cast("int"))
        merged = dealt.groupBy("group").applyInArrow(combined, "group int, spectrum binary")
        parts = stage(merged.select("spectrum"), "whitening-merged")
        held = parts.count()
    last = parts.first()
    return Spectrum.unpacked(bytes(last["spectrum"])) if last else None


class Frame:
    """Exact mean of the rows as ``sums / n``, and directions to project on."""

    def __init__(self, n: int, sums: list[int], directions: np.ndarray):
        self.n, self.directions = n, directions
        self.sums = np.array(sums, object)
        self.base = np.array([s // n for s in sums], np.int64)  # whole part of the mean
        self.rest = np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over components of (n x - sum)^2, exact; None beyond a long."""
        rest = np.array([s % self.n for s in self.sums.tolist()], object)
        apart = x - self.base
        largest = int(np.abs(apart).max(initial=0)) + 1
        if (largest * self.n) ** 2 * x.shape[1] < 1 << 63:
            y = apart * self.n - rest.astype(np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        found = ((apart.astype(object) * self.n - rest) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found]


MOMENTS = "i int, j int, value double"


def moments(found: Iterator[pa.RecordBatch], frame: Shared) -> Iterator[pa.RecordBatch]:
    """Sums of products of the projections (lower half), and at j = -1 of the projections."""
    d = frame.value.directions.shape[1]
    total, plain = np.zeros((d, d)), np.zeros(d)
    for batch in pieces(found):
        if batch.num_rows:
            y = frame.value.projected(whole(batch))
            total += y.T @ y
            plain += y.sum(axis=0)
    i, j = np.tril_indices(d)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(i, np.arange(d)).astype(np.int32)), pa.array(np.append(j, np.full(d, -1)).astype(np.int32)),
         pa.array(np.append(total[i, j], plain))], names=["i", "j", "value"])


def covariance(rows: DataFrame, frame: Frame) -> np.ndarray:
    """Covariance of the projections, divisor n."""
    shared = Shared(rows.sparkSession, frame)
    parts = rows.select("body").mapInArrow(lambda found: moments(found, shared), MOMENTS)
    sums = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    d = frame.directions.shape[1]
    total, plain = np.zeros((d, d)), np.zeros(d)
    for r in sums:
        if r["j"] < 0:
            plain[r["i"]] = r["value"]
        else:
            total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["value"]
    return total / frame.n - np.outer(plain / frame.n, plain / frame.n)


WHITE = "vec_id bigint, deviation bigint, component int, whitened double"


def white(found: Iterator[pa.RecordBatch], frame: Shared) -> Iterator[pa.RecordBatch]:
    k = frame.value.directions.shape[1]
    for batch in pieces(found, BLOCK):
        if batch.num_rows:
            x = whole(batch)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(frame.value.deviations(x), pa.int64()).take(pa.array(each)),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(frame.value.projected(x).ravel())], names=["vec_id", "deviation", "component", "whitened"])


def components(rows: DataFrame, d: int) -> tuple[Frame, np.ndarray, float] | None:
    """Frame whose directions are unit eigenvectors of the covariance, their eigenvalues (falling), the trace."""
    parts = stage(rows.select("body").mapInArrow(
        lambda found: spectra(found, d), "spectrum binary, n bigint, total array<string>"), "whitening-spectra")
    start = combine(parts.select("spectrum"))
    if start is None:
        return None
    n = parts.agg(F.sum("n")).first()[0]
    sums = parts.select(F.posexplode("total").alias("p", "s")).groupBy("p").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(sums, key=lambda r: r["p"])]
    basis = np.linalg.qr(start.basis)[0]
    inside = covariance(rows, Frame(n, sums, basis))
    values, turn = np.linalg.eigh(inside)
    directions = (basis @ turn)[:, ::-1]
    largest = np.argmax(np.abs(directions), axis=0)
    directions = directions * np.where(directions[largest, np.arange(d)] < 0, -1.0, 1.0)
    return Frame(n, sums, directions), values[::-1], float(np.trace(inside))


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every vector taken and each
    of the first ``most`` components.

    Taken are vectors that are not null, hold no null or non-finite component, and have the most frequent
    length (ties: the longer).  A component c becomes ``floor(scale * c) + shift``, held within 2^40
    either way.  Repeated rows count and are returned as often as they occur; rows without a vec_id too.
    Components with no variance (a share below 1e-13) cannot be scaled and are left out, so equal vectors,
    a single one or an empty table give no row.  ``deviation`` is null where it doesn't fit in a long.  Of equal
    eigenvalues any basis may come out; signs make the largest entry of a component positive.  Other
    columns are ignored.
    """
    spark, kind = vectors.sparkSession, "<f4" if width(vectors, vector) == 4 else "<f8"
    sound = clean(vectors, vec_id, vector)
    lengths = sound.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    d = lengths["dim"] if lengths else 1
    rows = sound.filter(F.col("dim") == d).select("vec_id", "body").mapInArrow(
        lambda found: integers(found, kind, scale, shift), "vec_id bigint, body binary")
    rows = stage(rows, "whitening-rows")
    found = components(rows, d) if lengths else None
    if found is None:
        frame, values, trace = Frame(1, [0] * d, np.zeros((d, 0))), np.zeros(0), 1.0
    else:
        frame, values, trace = found
    k = int((values[:most] > RANK * max(trace, 0)).sum()) if trace > 0 else 0
    final = Frame(frame.n, frame.sums.tolist(), frame.directions[:, :k] / np.sqrt(values[:k]))
    error = float(np.abs(covariance(rows, final) - np.eye(k)).max()) if k else 0.0
    shared = Shared(spark, final)
    out = rows.mapInArrow(lambda found: white(found, shared), WHITE)
    explained = F.array(*[F.lit(float(v / trace)) for v in values[:k]]) if k else F.array().cast("array<double>")
    return out.select(
        "vec_id", "component", F.lit(int(final.n)).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))


def op13(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
