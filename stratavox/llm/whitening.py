"""Whitening of embeddings on eigenvectors found by the Jacobi-Davidson method.

The covariance is never formed. A product with a block of vectors is one pass over the rows: every task centres its rows,
multiplies them with the block and back, and its partial sums are added in two steps. On the driver lie a search space of a few
dozen vectors, its products, and nothing that grows with the rows:

* Rayleigh-Ritz: eigenvalues and vectors of the covariance within the search space, largest first;
* locking: leading pairs whose residual reaches double precision are fixed, and everything later is kept orthogonal to them;
* correction: for each open pair the projected equation (I - QQ')(V - theta I)(I - QQ') t = -r is solved by some steps of
  MINRES, all pairs at once, so a step is one pass; the solutions widen the search space;
* restart: a full search space is cut back to its leading Ritz vectors.

Entries are whole numbers, so sums, centring and each row's deviation are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.common import give_back, stored, table
from stratavox.llm.registry import query

COMPONENTS = 32
INNER_STEPS = 5
GUARD = 8
MOST_ROUNDS = 200
#: A residual counts as double precision below this share of the largest eigenvalue.
PRECISION = 64 * np.finfo(float).eps
SEED = 20_231
OFFSET = 1_000_000
#: Entries beyond are held at this bound; only values above 10**16 get there.
LARGEST = 1 << 60
FOLDS = 64
SLICE_BYTES = 16 << 20

Product = Callable[[np.ndarray], np.ndarray]


def minres(product: Product, right: np.ndarray, steps: int, enough: float = 0.01) -> np.ndarray:
    """About x with product(x) = right, for every column by itself, from zero and in at most ``steps`` products."""
    x = np.zeros_like(right)
    size = np.linalg.norm(right, axis=0)
    start = np.where(size > 0, size, 1.0)
    left, v, v_old = size.copy(), right / start, np.zeros_like(right)
    w, w_old = np.zeros_like(right), np.zeros_like(right)
    beta = np.zeros_like(size)
    c, c_old, s, s_old = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        y = product(v)
        alpha = np.einsum("ij,ij->j", y, v)
        y = y - alpha * v - beta * v_old
        following = np.linalg.norm(y, axis=0)
        diagonal = c * alpha - c_old * s * beta
        pivot = np.hypot(diagonal, following)
        alive = pivot > 0
        safe = np.where(alive, pivot, 1.0)
        w, w_old = (v - (s_old * beta) * w_old - (s * alpha + c_old * c * beta) * w) / safe * alive, w
        c, c_old, s, s_old = diagonal / safe, c, following / safe, s
        x += c * left * w
        left = -s * left
        beta, v_old = following, v
        v = y / np.where(following > 0, following, 1.0)
        if np.all(np.abs(left) <= enough * start):
            break
    return x


def _orthonormal(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to each other and to ``old``; those that lie in the others' span are left out."""
    kept = old
    for column in new.T:
        length = np.linalg.norm(column)
        for _ in range(3):
            column = column - kept @ (kept.T @ column)
        now = np.linalg.norm(column)
        if length > 0 and now > 1e-10 * length:
            column = column / now
            column = column - kept @ (kept.T @ column)
            kept = np.column_stack([kept, column / np.linalg.norm(column)])
    return kept[:, old.shape[1] :]


def leading_pairs(product: Product, size: int, wanted: int, seed: int = SEED, inner: int = INNER_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator given by its products."""
    wanted = min(wanted, size)
    widest = min(size, 3 * wanted + GUARD)
    locked, values = np.zeros((size, 0)), []
    space = _orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, wanted + GUARD))), locked)
    image = product(space)
    exhausted = 0
    for _ in range(MOST_ROUNDS):
        inside = space.T @ image
        theta, turn = np.linalg.eigh((inside + inside.T) / 2)
        turn = turn[:, ::-1]
        theta, space, image = theta[::-1], space @ turn, image @ turn
        open_pairs = min(wanted - len(values), space.shape[1])
        rest = image[:, :open_pairs] - theta[:open_pairs] * space[:, :open_pairs]
        rest -= locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        scale = max([abs(theta[0]), *map(abs, values[:1])])
        good = norms <= PRECISION * scale
        done = open_pairs if good.all() else int(np.argmin(good))
        locked = np.column_stack([locked, space[:, :done]])
        values += theta[:done].tolist()
        if len(values) == wanted:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        theta, space, image = theta[done:], space[:, done:], image[:, done:]
        rest, good = rest[:, done:], good[done:]
        active = np.flatnonzero(~good)
        keep = wanted - len(values) + GUARD
        if space.shape[1] + len(active) + locked.shape[1] > widest and space.shape[1] > keep and widest < size:
            space, image = space[:, :keep], image[:, :keep]
        shift, near = theta[active], np.column_stack([locked, space[:, active]])

        def projected(z: np.ndarray) -> np.ndarray:
            z = product(z) - shift * z
            return z - near @ (near.T @ z)

        known = np.column_stack([locked, space])
        wider = np.zeros((size, 0))
        if known.shape[1] < size:
            right = -rest[:, active]
            wider = _orthonormal(minres(projected, right - near @ (near.T @ right), inner), known)
        if wider.shape[1]:
            space, image = np.column_stack([space, wider]), np.column_stack([image, product(wider)])
        else:  # the whole space is searched: only rounding is left, which fresh products remove
            exhausted += 1
            if exhausted > 3:
                break
            space = _orthonormal(space, locked)
            image = product(space)
    raise RuntimeError(f"{len(values)} of {wanted} eigenpairs reached double precision")


def whole_entries(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors without null or non-finite entries as whole numbers; those of another length than most are left out."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    kept = vectors.where(v.isNotNull() & ~bad)
    common = kept.where(F.size(v) > 0).groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).head()
    bounded = lambda c: F.least(F.greatest(c.cast("double") * 64, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    x = F.transform(v, lambda c: F.floor(bounded(c)) + OFFSET)
    return kept.where(F.size(v) == (common["size"] if common else -1)).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))


def _matrices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of a batch as int64 matrices of bounded size, each with the place of its first row."""
    flat = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    step = max(1, SLICE_BYTES // (8 * size))
    for begin in range(0, len(flat), step):
        yield begin, flat[begin : begin + step]


class Rows:
    """Centred rows of a stored table (id, x) and what can be summed over them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        first = rows.select(F.size("x").alias("d")).head()
        self.size = first["d"] if first else 0
        self.n, self.sums = self._sums() if self.size else (0, [])
        self.middle = [(2 * s + self.n) // (2 * self.n) for s in self.sums]  # whole numbers next to the means
        self.over = [s - self.n * m for s, m in zip(self.sums, self.middle)]
        self.spread = 0.0

    def _sums(self) -> tuple[int, list[int]]:
        size = self.size

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, low, high = 0, [0] * size, [0] * size
            for batch in batches:
                for _, x in _matrices(batch, size):
                    n += len(x)
                    low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(0).tolist())]
                    high = [a + b for a, b in zip(high, (x >> 32).sum(0).tolist())]
            place = list(range(size))
            yield pa.RecordBatch.from_pydict(
                {"place": pa.array(place, pa.int32()), "n": pa.array([n] * size, pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())}
            )

        wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("string").alias(c)
        parts = self.rows.mapInArrow(add, "place int, n long, low long, high long")
        got = sorted(parts.groupBy("place").agg(F.sum("n").alias("n"), wide("low"), wide("high")).collect())  # one row per dimension
        return got[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in got]

    def _centring(self) -> Callable[[np.ndarray], np.ndarray]:
        middle = np.array(self.middle, np.int64)
        share = np.array([o / self.n for o in self.over])
        return lambda x: (x - middle).astype(float) - share

    def summed(self, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """``work`` of centred rows, summed over all of them: per task, then over ``FOLDS`` groups of tasks, then here."""
        size, centred = self.size, self._centring()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for _, x in _matrices(batch, size):
                    total += work(centred(x))
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"fold": pa.array([part % FOLDS], pa.int32()), "part": pa.array([part], pa.int32()), "body": pa.array([total.tobytes()], pa.binary())}
            )

        def fold(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, k = np.zeros(shape), 0
            for batch in groups:
                for key, body in zip(batch["fold"].to_pylist(), batch["body"]):
                    total, k = total + np.frombuffer(body.as_py()).reshape(shape), key
            yield pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})

        parts = self.rows.mapInArrow(partial, "fold int, part int, body binary")
        tasks = self.rows.rdd.getNumPartitions()
        if tasks > FOLDS:
            parts = parts.repartition(FOLDS, "fold").sortWithinPartitions("part").mapInArrow(fold, "fold int, body binary")
        got = sorted(parts.select("fold", "body").collect())  # at most FOLDS small matrices
        return sum((np.frombuffer(r["body"]).reshape(shape) for r in got), np.zeros(shape))

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times block; the trace falls off beside it."""

        def work(c: np.ndarray) -> np.ndarray:
            own = np.zeros((1, block.shape[1]))
            own[0, 0] = np.einsum("ij,ij->", c, c)
            return np.vstack([c.T @ (c @ block), own])

        out = self.summed(work, (self.size + 1, block.shape[1])) / self.n
        self.spread = float(out[-1, 0])
        return out[:-1]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry are left out, as are empty ones and those of another length than
    the commonest (the smaller length if two are equally common). Repeated rows count and come back as often as they occur, ids
    may be null. Components whose eigenvalue is zero to rounding cannot be scaled to one and do not appear, so equal vectors, a
    single vector or an empty table give no rows. A deviation beyond 64 bits is null.
    """
    id_name, id_type = id_col, vectors.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = Rows(stored(whole_entries(vectors, id_col, vector_col)))
    size, n = rows.size, rows.n
    if not size:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_name)
    values, basis = leading_pairs(rows.times, size, components)
    trace = rows.spread
    real = values > max(size, 64) * 16 * np.finfo(float).eps * max(values[0], 0.0)
    values, basis = values[real], basis[:, real]
    scaled = basis / np.sqrt(values) if len(values) else basis
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_name)

    def square(c: np.ndarray) -> np.ndarray:
        w = c @ scaled
        return np.vstack([w.T @ w, w.sum(0)])

    seen = rows.summed(square, (k + 1, k)) / n
    error = float(np.abs(seen[:-1] - np.outer(seen[-1], seen[-1]) - np.eye(k)).max())
    explained = values / trace
    centred, middle, over = rows._centring(), np.array(rows.middle, np.int64), rows.over
    limit, most = 1 << 63, max(map(abs, over))

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 in whole numbers of any size where 64 bits might not do."""
        off = x - middle
        if (n * (int(np.abs(off).max(initial=0)) + 1) + most) ** 2 * size < limit:
            z = n * off - np.array(over, np.int64)
            return np.einsum("ij,ij->i", z, z).tolist()
        z = off.astype(object) * n - np.array(over, object)
        return [s if s < limit else None for s in (z * z).sum(1).tolist()]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, x in _matrices(batch, size):
                m = len(x)
                ids = batch["id"].slice(begin, m).take(pa.array(np.repeat(np.arange(m), k)))
                dev = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    dev,
                    pa.array((centred(x) @ scaled).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])
        give_back()

    return rows.rows.mapInArrow(project, schema).withColumnRenamed("id", id_name)


@query("op11_whiten_embeddings")
def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
