"""Whitening of embeddings by their leading components, found by Jacobi-Davidson.

Vectors become integers, and the covariance of the distinct ones is never formed: what the
solver asks for are products of the centred data with a few vectors, each a pass of all
tasks over a stored table of packed blocks, summed before they reach the driver,
which holds vectors of one length only (so many numbers as a vector has dimensions).

The solver keeps a search space, solves the small Rayleigh-Ritz problem in it,
locks pairs whose residual is down to double precision, and extends it by a
correction for every pair that is still wanted: the equation (I - QQ')(V - eI)(I - QQ')t = -r,
solved roughly by MINRES from the right-hand side. The corrections of all wanted pairs
go through MINRES side by side, so that one pass serves them all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.shared import discard, stored, table
from shelfspark.shipping import map_arrow

#: Passes of one correction, and vectors of the search space before it is cut back to the leading ones.
INNER, SPACE = 12, 40
#: A pair is locked when its residual is below this share of the largest component's variance.
TOLERANCE = 2e-14
#: Vectors of a packed block.
BLOCK_ROWS = 4096

Product = Callable[[np.ndarray], np.ndarray]


# --- the solver -------------------------------------------------------------------


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of new without what they share with against and with each other, as unit vectors; those with nothing left are dropped."""
    known = np.concatenate([new[:, :0], *against], axis=1)
    given = known.shape[1]
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - known @ (known.T @ v)
        if size > 0 and np.linalg.norm(v) > 1e-10 * size:
            v = v / np.linalg.norm(v)
            v = v - known @ (known.T @ v)
            known = np.concatenate([known, (v / np.linalg.norm(v))[:, None]], axis=1)
    return known[:, given:]


def _minres(product: Product, shifts: np.ndarray, project: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int) -> np.ndarray:
    """For each column b of rhs the t that MINRES reaches for P(V - shift)P t = b after so many steps, all columns in the same passes."""
    rhs = project(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    live = beta > 0
    v, v_old = np.where(live, rhs / np.where(live, beta, 1), 0), np.zeros_like(rhs)
    t, d1, d2 = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    c, s, c_old, s_old = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    eta, b_now = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        w = project(product(v) - shifts * v)
        alpha = (v * w).sum(axis=0)
        w = project(w - alpha * v - b_now * v_old)
        b_next = np.linalg.norm(w, axis=0)
        r2, r1 = s * alpha + c_old * c * b_now, s_old * b_now
        r0 = c * alpha - c_old * s * b_now
        size = np.hypot(r0, b_next)
        live = live & (size > 1e-300)
        safe = np.where(live, size, 1)
        c_old, s_old = c, s
        c, s = np.where(live, r0 / safe, 1), np.where(live, b_next / safe, 0)
        d = (v - r2 * d1 - r1 * d2) / safe
        t = np.where(live, t + c * eta * d, t)
        eta = -s * eta
        d2, d1, v_old = d1, d, v
        b_now = b_next
        live = live & (b_next > 1e-14 * beta)
        if not live.any():
            break
        v = np.where(live, w / np.where(live, b_next, 1), 0)
    return t


def _search(product: Product, space: np.ndarray, wanted: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs found from a space. One is locked when its residual is at double precision, when rounding lets it fall no further, or when
    the space is all that there is."""
    dims, image = space.shape[0], product(space)
    locked, values, best, stale = np.zeros((dims, 0)), [], np.inf, 0
    while len(values) < wanted:
        small = space.T @ image
        theta, rotate = np.linalg.eigh((small + small.T) / 2)
        theta, space, image = theta[::-1], space @ rotate[:, ::-1], image @ rotate[:, ::-1]
        residual = image - space * theta
        residual -= locked @ (locked.T @ residual)
        size, scale = np.linalg.norm(residual, axis=0), max(abs(theta[0]), *map(abs, values), 1e-300)
        best, stale = min(best, size[0]), stale + 1 if size[0] > best / 2 else 0
        whole = space.shape[1] + locked.shape[1] == dims
        done = 0
        while done < space.shape[1] and len(values) < wanted and (whole or size[done] <= TOLERANCE * scale or (done == 0 and stale > 2 and size[0] <= 1e-12 * scale)):
            values.append(theta[done])
            locked = np.concatenate([locked, space[:, done : done + 1]], axis=1)
            done, best, stale = done + 1, np.inf, 0
        space, image, theta, residual = space[:, done:], image[:, done:], theta[done:], residual[:, done:]
        if len(values) == wanted:
            break
        if space.shape[1] > SPACE:
            space, image = space[:, : SPACE // 2], image[:, : SPACE // 2]
        k = min(wanted - len(values) + 1, space.shape[1])  # one more than wanted, which keeps a close follower apart
        at, kept = space[:, :k], locked
        t = _minres(product, theta[:k], lambda x, at=at, kept=kept: (lambda y: y - at @ (at.T @ y))(x - kept @ (kept.T @ x)), -residual[:, :k], INNER)
        new = _orthonormal(t, locked, space)
        if not new.shape[1]:
            new = _orthonormal(random.standard_normal((dims, k)), locked, space)
        space, image = np.concatenate([space, new], axis=1), np.concatenate([image, product(new)], axis=1)
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


def leading_pairs(product: Product, dims: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the symmetric map with the largest values; product takes and gives columns.

    Corrections are drawn to the values next to them, so a larger one (or one more of several equal ones) may be passed by. A
    Krylov space from new random vectors, orthogonal to what was found, is therefore held against it; if that has more, both are searched.
    """
    wanted, random = min(wanted, dims), np.random.default_rng(seed)
    space = _orthonormal(random.standard_normal((dims, min(dims, 2 * wanted))))
    while True:
        values, vectors = _search(product, space, wanted, random)
        other = _orthonormal(random.standard_normal((dims, min(wanted, dims - wanted))), vectors)
        last, image = other, np.zeros((dims, 0))
        while last.shape[1] and other.shape[1] <= INNER * wanted:
            now = product(last)
            image = np.concatenate([image, now], axis=1)
            last = _orthonormal(now, vectors, other)
            other = np.concatenate([other, last], axis=1)
        known = other[:, : image.shape[1]]
        small = known.T @ image
        more, rotate = np.linalg.eigh((small + small.T) / 2)
        if not len(more) or more[-1] <= values[-1] + 1e-10 * abs(values[0]):
            return values, vectors
        space = _orthonormal(np.concatenate([vectors, known @ rotate[:, ::-1][:, :wanted]], axis=1))


# --- the data ---------------------------------------------------------------------------


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, floor(256 * entry) as array<long>, of the rows with a usable vector.

    Left out are rows whose vector is null, is empty, or holds a null, a NaN, an infinite entry or one of 2^32 or more (whose sums
    would not be exact), and rows whose vector has another length than most have (of lengths as frequent, the largest counts).
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**32)
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", fine) & (F.size("v") > 0))
    usual = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return kept.where(F.size("v") == (usual[0]["dims"] if usual else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class FitList:
    """The distinct x-vectors, stored as packed blocks, with their number and exact sums."""

    def __init__(self, x: DataFrame):
        spark = x.sparkSession
        distinct = stored(x.select("x").distinct(), "whitening-distinct")
        self.n = distinct.count()
        self.dims = len(distinct.first()["x"]) if self.n else 0
        self.parts = max(spark.sparkContext.defaultParallelism, self.n * self.dims // 16_000_000)

        def pack(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    block = _matrix(batch.slice(lo, BLOCK_ROWS).column(0))
                    most = int(np.abs(block).max())
                    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([len(block)], pa.int64()), pa.array([block.astype(f"<{kind}").tobytes()], pa.binary()), pa.array([block.sum(axis=0)], pa.list_(pa.int64()))], names=["kind", "n", "data", "sums"])

        self.blocks = stored(map_arrow(distinct.repartition(self.parts), pack, "kind string, n long, data binary, sums array<long>"), "whitening-blocks")
        discard(distinct)
        total = self.blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
        self.sums = [int(s) for _, s in sorted(total)]
        self.mean = np.array([s / self.n for s in self.sums])

    def summed(self, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over the blocks of what function makes of a block's centred vectors. Each task adds up its blocks, a few
        tasks add these up, and one array for each of those (about the root of the number of tasks) comes to the driver."""
        mean = self.mean

        def partial(batches):
            total = None
            for batch in batches:
                for kind, n, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    made = function(np.frombuffer(data, f"<{kind}").reshape(n, -1) - mean)
                    total = made if total is None else total + made
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part"])

        def add(batches):
            total = None
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    made = np.frombuffer(part, "<f8")
                    total = made if total is None else total + made
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = map_arrow(self.blocks.select("kind", "n", "data"), partial, "part binary")
        few = map_arrow(parts.repartition(max(1, int(self.parts**0.5))), add, "part binary")
        return np.sum([np.frombuffer(r["part"], "<f8") for r in few.collect()], axis=0)

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times the columns of vectors, without forming it."""
        return self.summed(lambda x: (x.T @ (x @ vectors)).ravel()).reshape(vectors.shape) / self.n


def whiten(rows: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row with a usable vector (see integers) and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    The fit list is each distinct x once. deviation is exact, and null beyond the range of a long. A component without variance (fewer
    distinct vectors than dimensions, or all equal) has a null whitened; explained is null if there is no variance at all, and
    identity_error is over the components that have some (null if none). Rows may repeat; other columns are ignored; no rows give none.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = integers(rows, id_col, vector_col)
    fit = FitList(x)
    if not fit.n:
        return rows.sparkSession.createDataFrame([], schema)
    values, vectors = leading_pairs(fit.product, fit.dims, components)
    n, trace = fit.n, float(fit.summed(lambda b: np.array([(b * b).sum()]))[0]) / fit.n
    has = values > 1e-13 * trace
    scale = vectors / np.sqrt(np.where(has, values, 1))
    error = None
    if has.any():
        own = scale[:, has]
        sums = fit.summed(lambda b: (lambda w: np.r_[w.sum(axis=0), (w.T @ w).ravel()])(b @ own)) / n
        k = own.shape[1]
        error = float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())
    explained = [float(v) / trace if trace > 0 else None for v in np.maximum(values, 0)]
    sums, mean, k = fit.sums, fit.mean, len(values)

    def deviations(block: np.ndarray) -> list[int | None]:
        if (n * int(np.abs(block).max(initial=0)) + max(map(abs, sums))) ** 2 * block.shape[1] < 1 << 63:
            return ((n * block - np.array(sums)) ** 2).sum(axis=1).tolist()
        exact = ((n * block.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
        return [d if d < 1 << 63 else None for d in exact]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                block = _matrix(part.column(1))
                whitened = (block - mean) @ scale
                at = np.repeat(np.arange(len(block)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block))),
                        pa.array([n] * len(at), pa.int64()),
                        pa.array(deviations(block), pa.int64()).take(pa.array(at)),
                        pa.array(whitened.ravel(), mask=~np.tile(has, len(block))),
                        pa.array(explained * len(block), pa.float64()),
                        pa.array([error] * len(at), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_arrow(x, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
