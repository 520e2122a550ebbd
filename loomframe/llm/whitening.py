"""Operator 12: whitening of embeddings by Jacobi-Davidson.

The covariance is never formed. Its product with a few columns is a pass over stored blocks of centred vectors: each task adds up
C'(C p) of its blocks, sums meet in a tree. A search space grows by the solutions of Jacobi-Davidson's correction equations,
projected away from what is locked and from the target's Ritz vector and solved by MINRES, all targets in step, so one pass serves
every target. Rayleigh-Ritz in the space gives the next targets; a pair is locked when its residual is at the rounding of the
products. The driver holds vectors of the space (dimensions x at most about a hundred), never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.llm.common import drop, durable, read, small_batches

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Vectors of a block of centred rows; blocks of a task; sums that meet in the driver before a level of tasks goes between.
BLOCK, PER_TASK, MEET = 4_096, 16, 64
#: Residuals of locked pairs, of the greatest eigenvalue; where products can't do better, what is let pass after STALLED rounds without gain.
SHARP, BLUNT, STALLED = 2e-14, 1e-11, 4
#: Steps of MINRES in a round, the gain at which it stops, rounds at most, and columns of the search space beyond those wanted.
INNER, GAIN, ROUNDS, GUARD = 8, 1e-3, 200, 8
#: An eigenvalue below this share of the greatest is none: the vectors do not vary that way.
NONE = 1e-13
LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): floor(64 c) + 1000000 of vectors whose entries are all there and finite (the greatest or least long where that is
    beyond one); rows without an id or entries are left out."""
    whole = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    own = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    return own.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda c: F.least(F.floor(c.cast("double") * SCALE).cast("long"), F.lit(LONG - SHIFT)) + SHIFT).alias("x"))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _less(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """x - base in whole numbers: longs, or objects where entries are so large that longs might not do."""
    return x - base.astype(np.int64) if np.abs(x.astype(np.float64)).max(initial=0) < 2.0**61 else x.astype(object) - base


def _sums(d: int) -> Callable:
    """(at, s): exact sums of a task's rows in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x = _rows(batch.column(0), d)
            small = np.abs(x.astype(np.float64)).max(initial=0) * len(x) < 2.0**62
            total = [t + int(s) for t, s in zip(total, (x if small else x.astype(object)).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["at", "s"])

    return run


def _added(d: int, m: int) -> Callable:
    """Sums of a task's packed (d, m) matrices: one for each task that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((d, m)), False
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part).reshape(d, m)
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return run


class Covariance:
    """Products with the covariance of stored blocks of centred vectors: rows (block binary), n vectors of d entries in all."""

    def __init__(self, blocks: DataFrame, n: int, d: int, tasks: int):
        self.blocks, self.n, self.d, self.tasks, self.passes = blocks, n, d, tasks, 0

    def __matmul__(self, p: np.ndarray) -> np.ndarray:
        d, m = p.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, any_ = np.zeros((d, m)), False
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    c = np.frombuffer(packed).reshape(-1, d)
                    total += c.T @ (c @ p)
                    any_ = True
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        sums = self.blocks.mapInArrow(run, "part binary")
        if self.tasks > MEET:  # a level between: the root of the number of tasks meets in each task of it, and that many in the driver
            sums = sums.repartition(math.isqrt(self.tasks)).mapInArrow(_added(d, m), "part binary")
        self.passes += 1
        return np.sum([np.frombuffer(r.part).reshape(d, m) for r in sums.collect()], axis=0, initial=0.0) / self.n


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns that span what new adds to the orthonormal bases; what is lost in rounding is left out."""
    old, kept = np.hstack(bases), []
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(2):
            column = column - old @ (old.T @ column)
        now = np.linalg.norm(column)
        if now > 1e-8 * size and now > 0:
            column = column / now
            column = column - old @ (old.T @ column)
            column /= np.linalg.norm(column)
            kept.append(column)
            old = np.hstack([old, column[:, None]])
    return np.stack(kept, axis=1) if kept else np.zeros((new.shape[0], 0))


def minres(product: Callable, b: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Columns t of which product(t) is near b, by MINRES for all columns in step: until each residual has fallen to gain of b."""
    x, w_old, w = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    first, v_old, v = beta.copy(), np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    c_old, c, s_old, s, eta, beta = 1.0, np.ones(b.shape[1]), np.zeros(b.shape[1]), np.zeros(b.shape[1]), beta, np.zeros(b.shape[1])
    for _ in range(steps):
        y = product(v)
        alpha = (v * y).sum(0)
        y = y - alpha * v - beta * v_old
        after = np.linalg.norm(y, axis=0)
        # rotations of the last two steps, then this one's
        delta, gamma, epsilon = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        rho = np.hypot(delta, after)
        live = rho > 0
        safe = np.where(live, rho, 1)
        c_old, s_old, c, s = c, s, np.where(live, delta / safe, 1), np.where(live, after / safe, 0)
        w_old, w = w, (v - epsilon * w_old - gamma * w) / safe
        x = x + np.where(live, c * eta, 0) * w
        eta = -s * eta
        v_old, v, beta = v, y / np.where(after > 0, after, 1), after
        if (np.abs(eta) <= gain * first).all():
            break
    return x


def jacobi_davidson(a, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the symmetric a, of which only products a @ columns are used: the
    greatest wanted ones, all residuals at the rounding of the products."""
    wanted, rng = min(wanted, d), np.random.default_rng(12)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    v = _orthonormal(rng.standard_normal((d, min(d, wanted + GUARD))), np.zeros((d, 0)))
    av, best, stalled = a @ v, math.inf, 0
    for _ in range(ROUNDS):
        h = v.T @ av
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        v, av = v @ y, av @ y
        norm = max([abs(theta[0]) if len(theta) else 0.0, *np.abs(values[:1])])
        want = min(wanted - locked.shape[1], v.shape[1])
        residual = av[:, :want] - v[:, :want] * theta[:want]
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        stalled = stalled + 1 if sizes.max(initial=0) > 0.5 * best else 0
        best = min(best, sizes.max(initial=0))
        enough = SHARP * math.sqrt(d) if stalled < STALLED else BLUNT
        done = sizes <= enough * norm
        if done.any():
            take = np.flatnonzero(done)
            locked, values = np.hstack([locked, v[:, take]]), np.concatenate([values, theta[take]])
            rest = np.setdiff1d(np.arange(v.shape[1]), take)
            v, av, theta, residual, best = v[:, rest], av[:, rest], theta[rest], residual[:, ~done], math.inf
        want = wanted - locked.shape[1]
        # a pair beside the locked ones that is greater than one of them takes its place among the wanted
        late = v.shape[1] and want == 0 and theta[0] > values.min() + BLUNT * norm
        if want == 0 and not late:
            break
        if locked.shape[1] + v.shape[1] >= d and not want:
            break
        if late:
            out = int(values.argmin())
            v, av = np.hstack([v, locked[:, [out]]]), np.hstack([av, locked[:, [out]] * values[out]])
            locked, values = np.delete(locked, out, 1), np.delete(values, out)
            continue
        most = 3 * wanted + GUARD
        if v.shape[1] + want > most:  # begin again from the leading Ritz vectors
            v, av, theta = v[:, : want + GUARD], av[:, : want + GUARD], theta[: want + GUARD]
        if residual.shape[1] < want:
            new = rng.standard_normal((d, want - residual.shape[1]))
        else:
            u, shift = v[:, :want], theta[:want]

            def away(t: np.ndarray) -> np.ndarray:
                t = t - locked @ (locked.T @ t)
                return t - u * (u * t).sum(0)

            new = minres(lambda t: away((a @ (t := away(t))) - shift * t), -away(residual[:, :want]), INNER, GAIN)
        new = _orthonormal(new, locked, v)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((d, want)), locked, v)
        if new.shape[1]:
            v, av = np.hstack([v, new]), np.hstack([av, a @ new])
    else:
        raise ArithmeticError("Jacobi-Davidson has not converged")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


def _whitened(n: int, base: np.ndarray, rest: np.ndarray, weights: np.ndarray, names: list[str]) -> Callable:
    """(id, component, deviation, whitened) of (id, x). deviation is worked out in whole numbers, in longs where they hold it."""
    d, m = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _rows(batch.column(1), d)
            z = _less(x, base)
            far = [int(z.min(initial=0)), int(z.max(initial=0))]
            over = n * max(abs(far[0]), abs(far[1])) + int(np.abs(rest).max())
            if d * over * over <= LONG:
                spread = n * z.astype(np.int64) - rest.astype(np.int64)
                deviation = (spread * spread).sum(1)
            else:
                deviation = np.array([min(LONG, sum(int(e) ** 2 for e in row)) for row in n * z.astype(object) - rest], np.int64)
            c = z.astype(np.float64) - (rest / n).astype(np.float64)
            for at in range(0, len(ids), 500):
                some = (c[at : at + 500] @ weights).ravel()
                k = len(some) // m
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + k], m)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.repeat(deviation[at : at + k], m)), pa.array(some)], names)

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each component.

    Vectors that are null or empty or hold a null or non-finite entry, and rows without an id, take no part; nor do vectors of another
    length than the commonest (of equally common ones the shorter), as covariance needs one. Repeated rows count as often as they
    come. Components in whose direction the vectors do not vary (below NONE of the greatest eigenvalue) can't be whitened and are left
    out; without any variance, as with one row, there is no row. deviation is the greatest long where it is beyond one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = durable(whole_numbers(vectors, id_col, vector_col).withColumn("d", F.size("x")), "vectors")
    names = ["vec_id", "component", "deviation", "whitened"]
    types = "vec_id long, component int, deviation long, whitened double"
    common = own.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    nothing = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not common:
        return nothing
    d, n = common.d, common.n
    own = own.filter(F.col("d") == d).select("id", "x")
    each = own.select("x").mapInArrow(_sums(d), "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s"))
    sums = [int(r.s) for r in sorted(each.collect(), key=lambda r: r.at)]  # d rows
    base = np.array([s // n for s in sums], object)
    rest = np.array([s - n * (s // n) for s in sums], object)
    mean = (rest / n).astype(np.float64)  # of x - base, which is small: nothing is lost to the shift

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def block() -> pa.RecordBatch:
            c = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()), pa.array([float((c * c).sum())])], ["block", "squares"])

        for batch in batches:
            held.append(_less(_rows(batch.column(0), d), base).astype(np.float64) - mean)
            count += len(held[-1])
            if count >= BLOCK:
                yield block()
                held, count = [], 0
        if count:
            yield block()

    tasks = max(1, math.ceil(n / (BLOCK * PER_TASK)), min(spark.sparkContext.defaultParallelism, math.ceil(n / BLOCK)))
    blocks = durable(own.select("x").repartition(tasks).mapInArrow(packed, "block binary, squares double"), "blocks")
    trace = (blocks.agg(F.sum("squares").alias("t")).first().t or 0.0) / n
    if trace == 0.0:
        return nothing
    v = Covariance(blocks.select("block"), n, d, tasks)
    values, vectors_ = jacobi_davidson(v, d, components)
    some = values > NONE * values[0]
    values, vectors_ = values[some], vectors_[:, some]
    weights = vectors_ / np.sqrt(values)
    error = float(np.abs(weights.T @ (v @ weights) - np.eye(len(values))).max())  # from the vectors themselves, in one more pass
    drop(blocks)
    out = own.mapInArrow(_whitened(n, base, rest, weights, names), types)
    explained = F.element_at(F.array(*[F.lit(float(e / trace)) for e in values]), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
