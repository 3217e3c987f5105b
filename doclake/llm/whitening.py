"""Whitening of embedding vectors, each distinct vector once.

Vectors are brought to a grid of whole numbers, x = floor(scale * c). Equal x are grouped, with the
number of their rows as multiplicity; the fit list is each x once (``weights="one"``) or as often as it
occurs (``weights="count"``). Means come from exact sums. The covariance is a weighted product of
centred matrices, summed over the tasks; its largest eigenvectors are the components. Every distinct x
is whitened once, and the rows get the result by a join on the sha256 of their x. An x with more than
1 / ``HOT`` of all rows is joined by broadcast, so there are fewer than ``HOT`` of these however large
the table is, and no task gets all rows of one x.

Only matrices of dimension x dimension reach the driver.

Defined cases: rows whose vector is null, or holds null or non-finite entries, or has another length
than most rows (of two as frequent lengths the larger counts), are dropped; repeated rows are each
returned; directions without variance (one distinct x, equal entries) give no component; an empty table
gives an empty result. Entries beyond 64 bits are cut to the largest long. Of components with equal
variance any orthogonal choice is right; the sign makes a component's largest entry positive. All
columns of the input, whatever their names, are passed on inside the struct ``_llm_row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm.common import ROW, packed, written

HOT = 1000
_SAFE = 1 << 62
_WIDE = "decimal(38,0)"


@dataclass
class Model:
    """What the fit list gives: number of vectors, exact sums, components as columns, their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float  # trace of the covariance

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def on_grid(vector: Column, scale: float) -> Column:
    """x of a usable vector."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def key_of(x: Column) -> Column:
    """The sha256 of x. Not null to the planner, which would work it out a second time to filter on it."""
    return F.coalesce(F.unhex(F.sha2(F.concat_ws(",", x.cast("array<string>")), 256)), F.lit(b""))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _partials(table: DataFrame, fn: Callable[[np.ndarray, np.ndarray], object], merge: Callable, emit: Callable, column: str, dim: int, schema: str) -> DataFrame:
    """``fn`` on each batch of vectors and weights, merged within a task; ``emit`` makes the task's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                part = fn(matrix(b.column(0), dim), np.asarray(b.column(1)))
                held = part if held is None else merge(held, part)
        if held is not None:
            yield emit(held)

    return table.select(column, "weight").mapInArrow(run, schema)


def exact_sums(table: DataFrame, column: str, dim: int) -> tuple[int, list[int]]:
    """Total weight and exact weighted sum of each dimension of whole-number vectors."""

    def sums(x: np.ndarray, w: np.ndarray) -> list[int]:
        if max(int(x.max()), -int(x.min())) * int(w.sum()) >= _SAFE:
            x, w = x.astype(object), w.astype(object)
        return [int(w.sum()), *map(int, w @ x)]

    def add(a: list[int], b: list[int]) -> list[int]:
        return [p + q for p, q in zip(a, b, strict=True)]

    def emit(total: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(map(Decimal, total))], pa.list_(pa.decimal128(38, 0)))], ["s"])

    parts = _partials(table, sums, add, emit, column, dim, f"s array<{_WIDE}>")
    by_place = parts.select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in by_place}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(dim)]


def covariance(table: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Weighted covariance with divisor ``n``, centred before multiplying; tasks' products are summed row by row."""
    dim = len(mean)

    def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        centred = x.astype(float) - mean
        return (centred * w[:, None]).T @ centred

    def emit(total: np.ndarray) -> pa.RecordBatch:
        from pyspark import TaskContext

        task = np.full(dim, TaskContext.get().partitionId())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(task), pa.array(list(total))], ["i", "task", "row"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:  # one row of the matrix, from every task, always in the same order
        total = np.sum(np.stack(rows.sort_values("task")["row"].to_list()), 0)
        return pd.DataFrame({"i": rows["i"].iloc[:1], "row": [total]})

    parts = _partials(table, product, np.add, emit, column, dim, "i long, task long, row array<double>")
    out = np.zeros((dim, dim))
    for r in parts.groupBy("i").applyInPandas(summed, "i long, row array<double>").collect():
        out[r["i"]] = r["row"]
    return (out + out.T) / (2 * n) if n else out


def principal(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvectors (columns) and eigenvalues of largest variance, falling; those without variance are left out."""
    if not len(cov):
        return np.zeros((0, 0)), np.zeros(0)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > len(cov) * np.finfo(float).eps * max(values[-1], 0.0)]
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), 0), np.arange(len(order))])
    return vectors * sign, values[order]


def fit(distinct: DataFrame, dim: int, components: int) -> Model:
    """The model of a table of vectors ``x`` and their ``weight``."""
    n, sums = exact_sums(distinct, "x", dim)
    if not n:
        return Model(0, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    cov = covariance(distinct, "x", np.array([s / n for s in sums]), n)
    return Model(n, sums, *principal(cov, components), float(np.trace(cov)))


def deviations(x: np.ndarray, model: Model) -> list[Decimal | None]:
    """Sum over dimensions of (n * x - S)**2 of each vector, exact; null beyond 38 digits."""
    size = model.n * max(int(x.max()), -int(x.min())) + max(map(abs, model.sums), default=0)
    small = size * size * x.shape[1] < _SAFE
    kind = np.int64 if small else object
    d = model.n * x.astype(kind) - np.array(model.sums, kind)
    return [Decimal(int(v)) if v < 10**38 else None for v in (d * d).sum(1)]


def whiten_distinct(distinct: DataFrame, model: Model) -> DataFrame:
    """key, n_rows, weight, deviation and ``whitened`` of every distinct x."""
    mean, to = model.mean, model.components / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(3), len(mean))
            whitened = pa.array(list((x - mean) @ to), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(deviations(x, model), pa.decimal128(38, 0)), whitened],
                                             ["key", "n_rows", "weight", "deviation", "whitened"])

    return distinct.select("key", "n_rows", "weight", "x").mapInArrow(
        run, f"key binary, n_rows long, weight long, deviation {_WIDE}, whitened array<double>")


def whiten(df: DataFrame, vector: str = "embedding", scale: float = 256.0, components: int = 4, weights: str = "one",
           columns: list[str] | None = None) -> DataFrame:
    """``_llm_row`` (the named columns, all by default) of every usable row, beside

    n (total weight of the fit list), deviation, whitened (one value per component), explained (share of
    the total variance of each) and identity_error (how far the covariance of the whitened fit list is
    from the identity).
    """
    if weights not in ("one", "count"):
        raise ValueError(weights)
    given = F.col(f"`{vector}`")
    rows, x = df.where(usable(given)), on_grid(given, scale)
    grouped = rows.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n_rows"))
    weight = F.lit(1).cast("long") if weights == "one" else F.col("n_rows")
    grouped = written(grouped.select("x", "n_rows", weight.alias("weight"), F.size("x").alias("dim")), "distinct")

    lengths = grouped.groupBy("dim").agg(F.sum("n_rows").alias("n_rows")).orderBy(F.desc("n_rows"), F.desc("dim")).limit(1).collect()
    dim, total = lengths[0] if lengths else (0, 0)
    distinct = grouped.where(F.col("dim") == dim).withColumn("key", key_of(F.col("x")))
    model = fit(distinct, dim, components)
    done = written(whiten_distinct(distinct, model), "whitened")

    k, error = len(model.variances), 0.0
    if k:
        means = done.agg(*[(F.sum(F.col("whitened")[i] * F.col("weight")) / model.n).alias(f"m{i}") for i in range(k)]).first()
        error = float(np.abs(covariance(done, "whitened", np.array(list(means)), model.n) - np.eye(k)).max())

    # A row finds its x by broadcast if that is frequent, else by a shuffle of narrow rows.
    results = done.select("key", "n_rows", "deviation", "whitened")
    hot = results.where(F.col("n_rows") * HOT > total)
    keyed = packed(rows, columns, key_of(x).alias("key"))
    frequent = keyed.join(F.broadcast(hot), "key")
    others = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").join(results.where(F.col("n_rows") * HOT <= total), "key")
    explained = [float(v / model.total) for v in model.variances]
    return frequent.unionByName(others).select(
        ROW, F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame, row_id: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1."""
    pairs = F.arrays_zip("whitened", "explained")
    return whitened.select(F.col(f"{ROW}.`{row_id}`").alias(row_id), "n", F.col("deviation").try_cast("long").alias("deviation"),
                           "identity_error", F.posexplode(pairs).alias("place", "pair")).select(
        row_id, (F.col("place") + 1).alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"), "identity_error")
