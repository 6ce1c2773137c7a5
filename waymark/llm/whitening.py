"""Whitening of beat vectors by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of all vectors are found without forming V: the only thing asked of the vectors is V Q for a narrow
block Q, one distributed pass of centred X'(X Q) whose result has as many numbers as Q. A Chebyshev polynomial of V, evaluated by its three-term
recurrence over such passes, damps the part of the spectrum below the block and lets the wanted part grow; QR and a Rayleigh-Ritz step turn the
block into approximate eigenvectors, until the residuals of the wanted ones are at the rounding error and a fresh random block, taken through
the same filter beside them, shows no larger eigenvalue that was missed.

A single Lanczos vector rides along in every pass. It tells where the spectrum ends below, so that the damped interval is no wider than it has
to be; that matters for flat spectra.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40
STEP = 2048
TARGET, ACCEPT = 3e-15, 1e-12
GROWTH = 1e7
TRUSTED = 6
MOST_PASSES = 2000


def _blocks(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ``STEP`` vectors and their whole-number matrix."""
    for b in batches:
        for lo in range(0, b.num_rows, STEP):
            part = b.slice(lo, STEP)
            v = part.column(at)
            yield part, v.flatten().to_numpy().reshape(len(v), -1)


def _total(table: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], rows: int, cols: int, kind: str = "double") -> np.ndarray:
    """The sum of ``kernel`` over all slices of vectors, a matrix of ``rows`` x ``cols``.

    Each task adds up its own slices; the tasks' matrices are added row by row in the shuffle. Only the sum reaches the driver, and its size does
    not depend on the number of vectors.
    """
    names = [f"c{j}" for j in range(cols)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for _, x in _blocks(batches):
            part = kernel(x)
            own = part if own is None else own + part
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *[pa.array(np.ascontiguousarray(own[:, j])) for j in range(cols)]], names=["i", *names])

    parts = table.select("x").mapInArrow(run, f"i long, {', '.join(f'{c} {kind}' for c in names)}")
    out = np.zeros((rows, cols), np.int64 if kind == "long" else np.float64)
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = r[1:]
    return out


@dataclass
class Components:
    """Count, sums, trace and the leading eigenpairs (vectors in columns, values falling); how many passes it took."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - mean, exact up to one rounding: (n x - S) is a whole number."""
    return (n * x - sums) / n


class _Lanczos:
    """One vector's Lanczos run; ``low`` estimates where the spectrum ends below: 0, which is safe, until the run has ``TRUSTED`` steps."""

    def __init__(self, d: int, rng: np.random.Generator):
        v = rng.standard_normal(d)
        self.basis, self.diag, self.off, self.low, self.done = [v / np.linalg.norm(v)], [], [], 0.0, False

    @property
    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def step(self, image: np.ndarray) -> None:
        if self.done:
            return
        self.diag.append(float(self.vector @ image))
        b = np.array(self.basis)
        w = image - b.T @ (b @ image)
        w -= b.T @ (b @ w)
        beta = float(np.linalg.norm(w))
        t = np.diag(self.diag) + np.diag(self.off, 1) + np.diag(self.off, -1)
        val = np.linalg.eigvalsh(t)
        # the smallest Ritz value less the whole residual; too high an end only slows the iteration down
        if len(self.diag) >= TRUSTED:
            self.low = max(0.0, float(val[0]) - beta)
        if beta <= 1e-12 * abs(val[-1]) or len(self.diag) == len(image):
            self.done = True
            return
        self.off.append(beta)
        self.basis.append(w / beta)


def leading_components(table: DataFrame, k: int, guard: int = 16, seed: int = 7) -> Components:
    """The ``k`` leading eigenpairs of the covariance (divisor n) of the whole-number vectors in column ``x`` of ``table``.

    The block is ``k`` + ``guard`` columns wide, or the whole space if that is narrower. Eigenvalues that are zero up to rounding are left out.
    """
    d, n = table.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    if not n:
        return Components(0, np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 0)), 0.0, 0)
    sums = _total(table, lambda x: x.sum(0)[:, None], d, 1, "long")[:, 0]
    k, width = min(k, d), min(d, k + guard)
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        if passes > MOST_PASSES:
            raise RuntimeError("the subspace iteration does not settle")

        def kernel(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        return _total(table, kernel, d, q.shape[1]) / n

    def spread(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, sums) ** 2).sum(0)[:, None]

    trace = float(_total(table, spread, d, 1).sum()) / n
    rng = np.random.default_rng(seed)
    end = _Lanczos(d, rng)

    def image(block: np.ndarray) -> np.ndarray:
        """V block, with the Lanczos vector carried in the same pass."""
        if end.done:
            return apply(block)
        both = apply(np.column_stack([block, end.vector]))
        end.step(both[:, -1])
        return both[:, :-1]

    def settle(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """QR and Rayleigh-Ritz: Ritz values, vectors and their images."""
        q, _ = np.linalg.qr(block)
        y = image(q)
        h = q.T @ y
        val, u = np.linalg.eigh((h + h.T) / 2)
        val, u = val[::-1], u[:, ::-1]
        return val, q @ u, y @ u

    def filtered(q: np.ndarray, y: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
        """The scaled Chebyshev polynomial of V on q that is small on [low, cut]; y = V q is known, so degree - 1 passes are made."""
        half, mid = (cut - low) / 2, (cut + low) / 2
        sigma = half / (top - mid)
        tau, s = 2 / sigma, sigma
        older, newer = q, (y - mid * q) * (s / half)
        for _ in range(degree - 1):
            s_next = 1 / (tau - s)
            older, newer = newer, 2 * s_next / half * (image(newer) - mid * newer) - s * s_next * older
            s = s_next
        return newer

    val, q, y = settle(rng.standard_normal((d, width)))
    last = np.inf
    probed = width == d
    while True:
        size = max(float(val[0]), 0.0)
        rank = int((val[:k] > max(size, trace) * 1e-13 * d).sum())
        worst = float(np.linalg.norm(y[:, :rank] - q[:, :rank] * val[:rank], axis=0).max()) if rank else 0.0
        settled = worst <= TARGET * size or (worst <= ACCEPT * size and worst > last / 2)
        if width == d or size <= 0 or (settled and probed):
            return Components(n, sums, trace, val[:rank], q[:, :rank], worst, passes)
        last = worst
        cut, low = float(val[-1]), min(end.low, float(val[-1]) * (1 - 1e-3))
        cut = max(cut, size * 1e-12)
        reach = np.arccosh(max(1 + 2 * (size - cut) / max(cut - low, size * 1e-12), 1.0))
        degree = int(np.clip(np.log(2 * GROWTH) / max(reach, 1e-3), 2, 10))
        if settled:
            # a fresh block beside the settled one: anything large that the first block lacks would show here
            fresh = rng.standard_normal((d, min(width, d - rank)))
            fresh -= q[:, :rank] @ (q[:, :rank].T @ fresh)
            fresh, _ = np.linalg.qr(fresh)
            grown = filtered(fresh, image(fresh), low, cut, size, max(degree, 4))
            grown -= q[:, :rank] @ (q[:, :rank].T @ grown)
            seen, _, _ = settle(grown)
            probed = bool(rank == 0 or rank < k or seen[0] <= val[rank - 1] * (1 + 1e-9))
            if not probed:
                val, q, y = settle(np.column_stack([q[:, :rank], grown])[:, : min(d, width + rank)])
                val, q, y = val[:width], q[:, :width], y[:, :width]
                last = np.inf
            continue
        val, q, y = settle(filtered(q, y, low, cut, size, degree))


def whitened_beats(units: DataFrame, k: int = 32, unit_id: str = "unit_id", beat: str = "beat") -> DataFrame:
    """Beat vectors projected on the leading components of their covariance and scaled to unit variance.

    One row per vector and component: unit_id, component (int from 1), n, deviation (long, the vector's exact squared distance from the mean times
    n squared), whitened, explained, identity_error (one value for all rows, from a pass over the whitened vectors). Entries are whole numbers
    floor(64 c) + 1000000, so sums are exact.

    Vectors that are null, empty, or hold a null, a non-finite entry or one of more than 2^40 / 64 in size take no part; nor do vectors whose length
    is not the one most vectors have (the smaller on a tie). Components with a zero eigenvalue are left out, so fewer than ``k`` may come back, and
    none if all vectors are equal. Repeated rows and equal vectors each count; null ids are passed on; an empty table gives an empty result. A
    deviation beyond a long is null. Other columns are not read.
    """
    kind = dict(units.dtypes)[unit_id]
    rows = units.select(F.col(unit_id).alias("unit_id"), F.col(beat).cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / SCALE)))
    table = materialise(rows.select("unit_id", F.transform("v", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")).alias("x")))
    usual = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    table = table.filter(F.size("x") == (usual["d"] if usual else 0))
    found = leading_components(table, k)
    n, sums, rank = found.n, found.sums, len(found.values)
    project = found.vectors / np.sqrt(found.values)

    def square(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ project
        return np.vstack([w.T @ w, w.sum(0)])

    error = 0.0
    if rank:
        both = _total(table, square, rank + 1, rank) / n
        error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(rank)).max())
    explained = found.values / found.trace if rank else found.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, 1):
            off = n * x - sums
            w = (off / n) @ project
            exact = pa.array((off * off).sum(1), mask=(off.astype(np.float64) ** 2).sum(1) > 9.2e18)
            row = np.repeat(np.arange(len(x)), rank)
            many = len(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), len(x))), pa.array(np.full(many, n, np.int64)), exact.take(pa.array(row)),
                 pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))],
                names=["unit_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    fields = f"unit_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = table.select("unit_id", "x").mapInArrow(run, fields)
    return out if rank else out.filter("false")
