"""Embedding whitening by QDWH spectral divide and conquer (operator 12).

Three passes over the vectors, none of which shuffles rows: the sums of every
dimension (exact integers), the covariance of the centred entries, and the
covariance of the whitened rows as a check. Each task reduces its batches to
one small matrix. The eigenvectors of the d x d covariance come from its polar
decompositions: the polar factor of a shifted covariance is the sign of its
spectrum, so (U + I) / 2 projects onto the eigenvectors above the shift; the
matrix is split into the two invariant subspaces and each is treated the same
way until subspaces are lines (or multiples of the identity). The d x k
whitening matrix is broadcast, and every row is projected where it stands.

Entries are the integers x = floor(64 c) + 1000000; centring uses n x - S,
which is exact, so the offset costs no digits.

Defined results: a vector that is NULL or empty, or holds NULL, NaN or infinite
entries, or has not the most frequent length (ties: the longer) gives no row;
NULL ids and repeated rows give rows of their own; components without variance
(rank-deficient vectors, constant dimensions) have no whitened value and are
left out, so identical vectors give no rows; equal eigenvalues share an
invariant subspace, of which any orthonormal basis serves, the same for all
rows; a ``deviation`` beyond 64 bits raises; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
EPS = np.finfo(float).eps
#: Rows of a batch that are widened to doubles at a time.
STEP = 4096


# ------------------------------------------------------ spectral decomposition
def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the QR-based
    dynamically weighted Halley iteration (QDWH)."""
    n = len(a)
    u = a / np.linalg.norm(a)                # Frobenius: all singular values are at most 1
    low, eye = EPS, np.eye(n)                # a lower bound of them that no iteration overshoots
    for _ in range(60):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * u, eye]))
        new = wb / wc * u + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        moved = np.linalg.norm(new - u)
        u = (new + new.T) / 2                # the factor of a symmetric matrix is symmetric
        low = min(1.0, low * (wa + wb * low ** 2) / (1 + wc * low ** 2))
        if moved < 10 * EPS * np.sqrt(n) or (low > 1 - 10 * EPS and moved < np.cbrt(EPS)):
            break
    return u


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first ``rank`` columns span the eigenvectors
    above a shift, the others those below; None if ``a`` is a multiple of the
    identity to working precision."""
    n, norm = len(a), np.linalg.norm(a)
    centre = np.trace(a) / n
    if np.linalg.norm(a - centre * np.eye(n)) <= n * EPS * max(norm, abs(centre)):
        return None
    best = None
    diagonal = np.sort(np.diag(a))
    # the median entry splits evenly; the mean lies strictly inside the spectrum
    for shift in (float(np.median(diagonal)), centre, *rng.uniform(diagonal[0], diagonal[-1], 4)):
        shifted = a - shift * np.eye(n)
        if np.linalg.norm(shifted) == 0:
            continue
        projector = (polar(shifted) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        start = rng.standard_normal((n, rank))
        for _ in range(3):                   # subspace iterations with the projector
            q, _ = np.linalg.qr(projector @ start, mode="complete")
            left = np.linalg.norm(q[:, :rank].T @ a @ q[:, rank:])
            if best is None or left < best[0]:
                best = left, q, rank
            if left <= 20 * n * EPS * norm:
                return q, rank
            start = q[:, :rank]
    # a shift next to an eigenvalue may leave a little more; the least is taken
    return best and best[1:]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric
    matrix, by recursive splitting into invariant subspaces."""
    rng = np.random.default_rng(12)
    values, vectors = np.empty(len(a)), np.empty(a.shape)
    done, open_ = 0, [(a, np.eye(len(a)))]
    while open_:
        block, basis = open_.pop()
        split = _split(block, rng) if len(block) > 1 else None
        if split is None:
            k = len(block)
            vectors[:, done:done + k], values[done:done + k] = basis, np.diag(block)
            done += k
            continue
        q, rank = split
        for part in (q[:, rank:], q[:, :rank]):
            small = part.T @ block @ part
            open_.append(((small + small.T) / 2, basis @ part))
    vectors, _ = np.linalg.qr(vectors)       # the product of many bases, orthogonal again
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# -------------------------------------------------------------------- passes
def usable(rows: DataFrame, vector: str) -> Column:
    """Whether a vector has entries and all of them are finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def _codes(vectors: pa.Array, dims: int) -> Iterator[np.ndarray]:
    """Blocks of integer entries x of the vectors of one batch."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for at in range(0, len(flat), STEP):
        yield np.floor(SCALE * flat[at:at + STEP].astype(float)).astype(np.int64) + OFFSET


def _sums(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors and the exact sum of every dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=np.int64)
        for batch in batches:
            for x in _codes(batch.column(0), dims):
                n += len(x)
                total += x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "s": total, "n": np.full(dims, n)})

    found = rows.select("v").mapInArrow(partial, "dim int, s long, n long").groupBy("dim").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    return found[0]["n"], np.array([r["s"] for r in found], dtype=np.int64)


def _gram(rows: DataFrame, dims: int, size: int, of) -> np.ndarray:
    """Mean of the outer products of ``of(x)``, rows of ``size`` centred
    values: one matrix per task, added up entry by entry (``size`` squared
    rows, whatever the number of vectors)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, plain = 0, np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for x in _codes(batch.column(0), dims):
                y = of(x)
                n += len(y)
                total += y.T @ y
                plain += y.sum(axis=0)
        at = np.arange(size)
        yield pa.RecordBatch.from_pydict({
            "i": np.append(np.repeat(at, size), at), "j": np.append(np.tile(at, size), np.full(size, -1)),
            "s": np.append(total.ravel(), plain), "n": np.full(size * (size + 1), n)})

    cells = rows.select("v").mapInArrow(partial, "i long, j long, s double, n long").groupBy("i", "j").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out, mean = np.empty((size, size)), np.empty(size)
    for r in cells:
        if r["j"] < 0:
            mean[r["i"]] = r["s"] / r["n"]
        else:
            out[r["i"], r["j"]] = r["s"] / r["n"]
    out -= np.outer(mean, mean)              # what rounding left of the mean
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation; its size depends on the dimensions alone."""
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of squares of n x - S."""
        off = self.n * x - self.sums
        if len(off) and float(np.abs(off).max()) ** 2 * off.shape[1] >= 2 ** 63:
            return np.array([int(r @ r) for r in off.astype(object)], dtype=np.int64)   # raises beyond 64 bits
        return (off * off).sum(axis=1)


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of the column ``v`` of usable vectors of ``dims`` entries."""
    n, sums = _sums(rows, dims)
    covariance = _gram(rows, dims, dims, lambda x: (n * x - sums) / n)
    values, vectors = eigen(covariance)
    kept = min(components, int((values > dims * EPS * max(values[0], 0.0)).sum()))
    return Whitening(n, sums, values[:kept], vectors[:, :kept], float(np.trace(covariance)))


def whitening_table(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = rows.filter(usable(rows, "embedding")).select("vec_id", F.col("embedding").alias("v"))
    lengths = vectors.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    kind = "vec_id long, n long, deviation long, explained array<double>, whitened array<double>, identity_error double"
    if common is None:
        out = rows.sparkSession.createDataFrame([], kind)
    else:
        dims = common["dims"]
        vectors = vectors.filter(F.size("v") == dims)
        model = fit(vectors, dims, components)
        k = len(model.values)
        error = float(np.abs(_gram(vectors, dims, k, model.whitened) - np.eye(k)).max()) if k else 0.0
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            part = own.values / own.trace if own.trace else own.values
            for batch in batches:
                at = 0
                for x in _codes(batch.column(1), dims):
                    m = len(x)
                    lists = lambda a: pa.ListArray.from_arrays(np.arange(0, m * k + 1, k, dtype=np.int32)
                                                               if k else np.zeros(m + 1, dtype=np.int32), a.ravel())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, m), np.full(m, own.n), own.deviation(x), lists(np.tile(part, m)),
                         lists(own.whitened(x)), np.full(m, error)],
                        ["vec_id", "n", "deviation", "explained", "whitened", "identity_error"])
                    at += m

        out = vectors.select(F.col("vec_id").cast("long"), "v").mapInArrow(apply, kind)
    pair = F.arrays_zip("whitened", "explained")
    return out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(pair).alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_table(table(spark, sf_dir, "embeddings"))
