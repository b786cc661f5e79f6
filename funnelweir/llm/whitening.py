"""Whitening of vectors by blockwise QR and the qd solver of :mod:`funnelweir.llm.qd`.

1. Components become integers, floor(scale * c) + offset, so the number of rows n and the
   sums S are exact, and n * x - S is exact before anything is rounded.
2. A task reduces its centred rows block by block to a triangular R with R'R equal to their
   cross products; the R of the tasks are stacked and reduced again by a tree of groups.
3. The last R goes to the driver (its size is the squared dimension). Its right singular
   vectors are the covariance's eigenvectors, its squared singular values over n the
   eigenvalues; the covariance itself, which loses half of the digits, is never formed.
4. A second pass projects the rows; their covariance is gathered by the same tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.llm.common import cut
from funnelweir.llm.qd import right_singular

#: States that one task of the tree reduces.
FAN = 32
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What a fit found: components as rows, their eigenvalues, and all eigenvalues' sum."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


def integers(vectors: DataFrame, scale: int, offset: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole: not null, not empty, all components finite."""
    rows = vectors.select(F.col(id_column).alias("id"), F.transform(F.col(vector_column), lambda c: c.cast("double")).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset)).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[np.ndarray]:
    """The arrays of a column as int64 matrices of a bounded size."""
    rows = max(dim, (1 << 20) // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield np.asarray(part.column(column).flatten()).reshape(part.num_rows, dim)


def reduced(states: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One state from the rows (part, state), by groups of ``FAN`` at a time."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        merged = combine(group.column("state").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([merged], pa.binary())})

    at = cut(states)
    while (last := at.agg(F.max("part")).first()[0]) is not None and last > 0:
        grouped = at.select(F.floor(F.col("part") / FAN).cast("long").alias("part"), "state").groupBy("part")
        at = cut(grouped.applyInArrow(run, "part long, state binary"))
    rows = at.select("state").collect()
    return rows[0][0] if rows else None


def task_states(rows: DataFrame, run: Callable) -> DataFrame:
    return rows.mapInArrow(run, "state binary").select(F.spark_partition_id().cast("long").alias("part"), "state")


def one_state(state: bytes | None) -> Iterator[pa.RecordBatch]:
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["state"])


def triangle(rows: DataFrame, dim: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows, ``dim`` by ``dim``."""

    def stacked(states: list[bytes]) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(s).reshape(-1, dim) for s in states]), mode="r").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for x in matrices(batches, 0, dim):
            block = (n * x - sums) / n
            r = np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")
        yield from one_state(None if r is None else r.tobytes())

    r = np.frombuffer(reduced(task_states(rows.select("x"), run), stacked)).reshape(-1, dim)
    return np.vstack((r, np.zeros((max(0, dim - len(r)), dim))))


def identity_error(rows: DataFrame, dim: int, model: Whitening) -> float:
    """The largest entry by which the whitened rows' covariance differs from the identity."""
    k = len(model.components)

    def merged(states: list[bytes]) -> bytes:
        total = np.frombuffer(states[0]).copy()
        for s in states[1:]:
            other = np.frombuffer(s)
            n, m = total[0], other[0]
            apart = other[1 : k + 1] - total[1 : k + 1]
            total[k + 1 :] += other[k + 1 :] + (n * m / (n + m) * np.outer(apart, apart)).ravel()
            total[1 : k + 1] += apart * (m / (n + m))
            total[0] = n + m
        return total.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for x in matrices(batches, 0, dim):
            w = model.whitened(x)
            mean = w.mean(axis=0)
            here = np.concatenate(([len(w)], mean, ((w - mean).T @ (w - mean)).ravel())).tobytes()
            state = here if state is None else merged([state, here])
        yield from one_state(state)

    state = np.frombuffer(reduced(task_states(rows.select("x"), run), merged))
    return float(np.abs(state[k + 1 :].reshape(k, k) / state[0] - np.eye(k)).max(initial=0.0))


def fit(rows: DataFrame, dim: int, most: int) -> Whitening | None:
    """Fit over all rows (id, x) of one dimension; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, np.int64)
        for x in matrices(batches, 0, dim):
            n, sums = n + len(x), sums + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([[n, *sums.tolist()]], pa.list_(pa.int64()))], names=["sums"])

    parts = rows.select("x").mapInArrow(run, "sums array<long>").select(F.posexplode("sums").alias("at", "s"))
    totals = [r["s"] for r in parts.groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()]
    if not totals or not totals[0]:
        return None
    n, sums = int(totals[0]), np.array(totals[1:], np.int64)
    values, components = right_singular(triangle(rows, dim, n, sums), most)
    return Whitening(n, sums, components, values[: len(components)] ** 2 / n, float((values**2).sum() / n))


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    All usable vectors are the fit list. Vectors that are null, empty or hold null or
    non-finite components are left out, and so are those of another length than the most
    common one (the longer of two equally common). Rows with a null id and repeated rows
    count and are returned. Components whose eigenvalue is zero but for rounding cannot be
    whitened and give no rows: none at all for one row, or for equal rows. An empty table
    gives an empty one. Raises if a deviation leaves 64 bits.
    """
    usable = integers(vectors, scale, offset, id_column, vector_column)
    kind = usable.schema["id"].dataType.simpleString()
    lengths = usable.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    rows = usable.filter(F.size("x") == dim)
    model = fit(rows, dim, components) if dim else None
    empty = model is None or not len(model.components)
    if empty:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, {OUT}").withColumnRenamed("id", id_column)
    error = identity_error(rows, dim, model)
    names = ["id", "deviation", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // dim)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, dim)
                apart = model.centred(x)
                if dim * float(np.abs(apart).max()) ** 2 >= 2.0**63:
                    raise OverflowError("a deviation leaves 64 bits")
                w = model.whitened(x)
                flat = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((apart * apart).sum(axis=1)), flat], names=names)

    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    projected = rows.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")
    out = projected.select("id", "deviation", F.posexplode("whitened").alias("at", "w"))
    return out.select(
        F.col("id").alias(id_column),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("w").alias("whitened"),
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
