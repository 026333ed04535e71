"""Whitening of embeddings: covariance by MLlib's RowMatrix over exactly centred rows, eigenvectors on the driver, projection in tasks.

Entries are counted on a grid of whole numbers, so that sums, means and deviations are exact: a centred
entry is (n*x - S) / n with n*x - S a whole number, and no digits are lost to a far-off mean.

Special cases. Vectors that are null, empty, hold null or non-finite entries, or entries beyond LARGEST
steps of the grid take no part. Where vectors differ in length, the shorter ones end in zeros. Repeated
vectors count once in the fit and are all answered; so are rows without an id and rows of equal ids. A
component along which the fit list doesn't vary (an eigenvalue of at most RANK of the largest) can't be
brought to unit variance and is left out, so one distinct vector gives no rows, and an empty table
neither. A deviation that no long can hold is null. More than MAX_DIMS dimensions raise ValueError: the
driver holds a square matrix of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import lean, scratch, written

#: Steps of the grid in one unit, and the whole number at zero.
SCALE, SHIFT = 64, 1_000_000
#: Components that are answered at most.
COMPONENTS = 16
#: Dimensions at most: the driver's matrices have their square, 134 MB each.
MAX_DIMS = 4096
#: Entries of more steps aren't whole numbers of 64 bits once shifted.
LARGEST = 2.0**62
#: A share of the largest eigenvalue below which an eigenvalue is rounding: 1e-16 of the largest is an error of 1e-4 in an eigenvalue of 1e-12.
RANK = 1e-11

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def on_grid(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift of each entry as double; null for vectors that take no part."""
    entries = vector.cast("array<double>")
    # NaN is greater than everything, so the bound also turns it away
    usable = (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) * scale < LARGEST))
    return F.when(usable, F.transform(entries, lambda c: F.floor(c * scale).cast("long") + shift))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _wide(x: np.ndarray, factor: int) -> np.ndarray:
    """x, as Python's integers where `factor` times it might not fit in 64 bits."""
    return x.astype(object) if x.size and max(abs(int(x.max())), abs(int(x.min()))) * max(factor, 1) >= 1 << 61 else x


def deltas(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact."""
    x = _wide(x, n)
    return n * x - np.array(sums, object if x.dtype == object or max(map(abs, sums)) >= 1 << 61 else np.int64)


def centred(delta: np.ndarray, n: int) -> np.ndarray:
    return (delta / n).astype(np.float64)


def deviations(delta: np.ndarray) -> list[int | None]:
    """The sum of each row's squares, exact; None if a long can't hold it."""
    if not delta.size:
        return []
    if max(abs(int(delta.max())), abs(int(delta.min()))) ** 2 * delta.shape[1] < 1 << 63:
        return np.einsum("ij,ij->i", delta, delta).tolist()
    sums = (delta.astype(object) ** 2).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in sums]


def gramian(rows: DataFrame, column: str, n: int, dims: int) -> np.ndarray:
    """The sum over rows of each row's products with itself (RowMatrix, summed in a tree)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, dims).computeGramianMatrix().toArray()


def sums_of(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of fit (x) and the exact sum of each dimension."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0
        for frame in frames:
            if len(frame):
                x = _matrix(frame["x"])
                n, total = n + len(x), total + _wide(x, len(x)).sum(axis=0).astype(object)
        if n:
            yield pd.DataFrame({"dim": np.arange(len(total), dtype=np.int32), "n": n, "s": [str(v) for v in total]})

    rows = fit.select("x").mapInPandas(add, "dim int, n long, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


@dataclass
class Whitening:
    """What a fit list gives: its size, exact sums, unit eigenvectors as columns by falling eigenvalue, eigenvalues, their shares, and the check's figure."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def fit(cls, fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
        """From a table of distinct vectors x that can be read several times."""
        n, sums = sums_of(fit)
        if not n:
            return None
        dims = len(sums)

        def centre(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"c": list(centred(deltas(_matrix(frame["x"]), n, sums), n))})

        covariance = gramian(fit.select("x").mapInPandas(centre, "c array<double>"), "c", n, dims) / n
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > RANK * max(values.max(), 0)]
        vectors = vectors[:, order]
        if len(order):
            vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
        model = cls(n, sums, vectors, values[order], values[order] / np.trace(covariance) if len(order) else values[order])
        if len(order):
            again = gramian(model.project(fit.select("x")), "whitened", n, len(order)) / n
            model.identity_error = float(np.abs(again - np.eye(len(order))).max())
        return model

    def project(self, rows: DataFrame) -> DataFrame:
        """rows, whose column x is replaced by deviation and whitened (an array, one entry a component). Other columns go along; they may have no nulls."""
        shared = rows.sparkSession.sparkContext.broadcast((self.n, self.sums, self.vectors, self.values))
        others = [c for c in rows.columns if c != "x"]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, sums, vectors, values = shared.value
            for frame in frames:
                if len(frame):
                    delta = deltas(_matrix(frame["x"]), n, sums)
                    out = frame[others].copy()
                    out["deviation"] = pd.array(deviations(delta), dtype="Int64")
                    out["whitened"] = list(centred(delta, n) @ vectors / np.sqrt(values))
                    yield out

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x")
        return rows.mapInPandas(run, f"{kinds}{', ' if kinds else ''}deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    vectors: vec_id and embedding are read. Fitted on each distinct vector once; see the module's special cases.
    """
    spark = lean(vectors.sparkSession)
    x = vectors.select("vec_id", on_grid(F.col("embedding")).alias("x")).filter("x IS NOT NULL")
    dims, least = x.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.min(F.size("x")), F.lit(0))).first()
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions; the driver's matrices take {MAX_DIMS} at most")
    if least < dims:
        x = x.withColumn("x", F.expr(f"concat(x, array_repeat(CAST({SHIFT} AS BIGINT), {dims} - size(x)))"))
    with scratch(spark):
        model = Whitening.fit(written(x.select("x").distinct(), "whitening-fit"), components) if dims else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], RESULT)
    # pandas has no nullable long of its own, so an absent id goes along as a mark
    rows = x.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("absent"), "x")
    explained = F.array(*map(F.lit, model.explained.tolist()))
    return (
        model.project(rows)
        .select(F.when(~F.col("absent"), F.col("vec_id")).alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
    )
