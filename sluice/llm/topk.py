"""Exact top-k search by inner product, with a pivot-distance index.

Vectors of integers get one more component that gives all of them the same length, so a larger
inner product with a query is a smaller distance to it. The index keys a vector by its nearest pivot
and its distance to it; ranges of that order, dealt evenly, are cut into cells whose vectors are
sorted by distance, and a cell into annuli. A query visits a cell's annuli from its own distance to
the pivot outwards and stops where the triangle inequality leaves no vector that could reach its
k-th best score so far (from a bounded sample at first). What is reported is the exact integer score.

Queries come in blocks of bounded size, each of which is broadcast and goes over the index once.

Results in special cases: vectors that are null, empty or hold a null or non-finite component, and
rows without an id, take no part; shorter vectors count as filled up with zeros; a repeated query
row is one query, a repeated candidate row is a candidate each time; ties go to the smaller id.
Products are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import keep_written, new_path, remove, scratch, written

SCALE = 1024
PIVOTS = 32
#: Vectors whose scores set a query's first bound; the pivots are its first ones.
SAMPLE = 2048
#: Vectors of an annulus, and of a cell.
ANNULUS, CELL = 256, 4096
#: Bytes of queries in a block.
BLOCK_BYTES = 32 << 20


def valid(column: str = "embedding") -> Column:
    inf = F.lit(float("inf"))
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and vec (array of longs) of the rows that take part."""
    return vectors.filter(valid() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exactly."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0**53:
        return a @ b.T
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor.copy()
        self.q, self.score, self.id, self.more = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.parts: list[tuple] = []

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: queries `rows` x candidates `ids`."""
        r, c = np.nonzero(scores >= self.floor[rows][:, None])
        keep = self.ids[rows[r]] != ids[c]
        r, c = r[keep], c[keep]
        if len(r):
            self.parts.append((rows[r], scores[r, c], ids[c]))
            self.more += len(r)
            if self.more > 16 * self.k * max(1, len(self.ids)) or self.more > 4 * len(self.ids):
                self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        q, s, i = (np.concatenate(x) for x in zip((self.q, self.score, self.id), *self.parts, strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.score, self.id = q[keep], s[keep], i[keep]
        self.parts, self.more = [], 0
        full = np.bincount(self.q, minlength=len(self.ids)) >= self.k
        last = np.searchsorted(self.q, np.arange(len(self.ids)), "right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last[full]])


_CELL = pa.schema([("pivot", pa.int32()), ("dists", pa.binary()), ("ids", pa.binary()), ("vecs", pa.binary())])


class Index:
    """The written cells of the vectors, with the pivots and the common length they were made with."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, cell: int = CELL):
        """vectors: vec_id, vec."""
        spark = vectors.sparkSession
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        dim, most = vectors.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
        self.dim, self.most, self.path = dim, most, new_path(spark, "cells")
        drawn = vectors.withColumn("place", F.md5(F.col("vec_id").cast("string"))).orderBy("place", "vec_id").limit(sample).select("vec_id", "vec").collect()
        self.sample_ids = np.array([r[0] for r in drawn], np.int64)
        self.sample = np.zeros((len(drawn), dim), np.int64)
        for i, r in enumerate(drawn):
            self.sample[i, : len(r[1])] = r[1]
        self.pivots = np.unique(self.sample[:pivots], axis=0)
        shared = spark.sparkContext.broadcast((self.pivots, most))

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points, most = shared.value
            extra = np.sqrt(np.maximum(0.0, most - (points.astype(np.float64) ** 2).sum(axis=1)))
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _matrix(batch.column(1), dim)
                f = m.astype(np.float64)
                norm = (f**2).sum(axis=1)
                own = np.sqrt(np.maximum(0.0, most - norm))
                d = norm[:, None] + (points.astype(np.float64) ** 2).sum(axis=1) - 2 * f @ points.T.astype(np.float64) + (own[:, None] - extra) ** 2
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(np.sqrt(np.maximum(0, d[np.arange(len(d)), near]))), batch.column(0), pa.array([r.tobytes() for r in m], pa.binary())], names=["pivot", "dist", "vec_id", "vec"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def cells(rows: pa.Table) -> Iterator[pa.RecordBatch]:
                pivot = rows.column(0).to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    for i in range(a, b, cell):
                        part = rows.slice(i, min(cell, b - i))
                        yield pa.RecordBatch.from_pylist([{"pivot": int(pivot[i]), "dists": part.column(1).to_numpy().tobytes(), "ids": part.column(2).to_numpy().tobytes(), "vecs": b"".join(part.column(3).to_pylist())}], schema=_CELL)

            n = 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= 4 * cell:
                    yield from cells(pa.Table.from_batches(held))
                    held, n = [], 0
            if n:
                yield from cells(pa.Table.from_batches(held))

        keyed = vectors.mapInArrow(key, "pivot int, dist double, vec_id long, vec binary")
        ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
        ranged.mapInArrow(cut, "pivot int, dists binary, ids binary, vecs binary").write.parquet(self.path)
        self.cells = spark.read.schema("pivot int, dists binary, ids binary, vecs binary").parquet(self.path)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """queries: vec_id, vec. query_id, rank, vec_id, score."""
        spark = queries.sparkSession
        with scratch(spark):
            return keep_written(self._found(written(queries.distinct(), "queries"), k), "nearest")

    def _found(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: a written table of distinct (vec_id, vec), taken in blocks in their order; an id may have more vectors than a block."""
        spark = queries.sparkSession
        size = max(1, BLOCK_BYTES // (8 * max(1, self.dim)))
        parts, rest, done = [], queries, 0
        while block := rest.orderBy("vec_id", "vec").limit(size).collect():
            last_id, last = F.lit(block[-1][0]), F.array(*(F.lit(x).cast("long") for x in block[-1][1]))
            rest = queries.filter((F.col("vec_id") > last_id) | (F.col("vec_id") == last_id) & (F.col("vec") > last))
            ids = np.array([r[0] for r in block], np.int64)
            matrix = np.zeros((len(block), self.dim), np.int64)
            for i, r in enumerate(block):
                matrix[i, : len(r[1])] = r[1]
            floor = self._floors(ids, matrix, k)
            parts.append(written(self._block(ids, matrix, floor, k, done), "found"))
            done += len(block)
        if not parts:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
        return reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def _floors(self, ids: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
        floor = np.full(len(ids), np.iinfo(np.int64).min)
        if len(self.sample) > k:
            for i in range(0, len(ids), 1024):
                s = products(matrix[i : i + 1024], self.sample)
                s[ids[i : i + 1024, None] == self.sample_ids] = np.iinfo(np.int64).min
                floor[i : i + 1024] = np.partition(s, len(self.sample) - k, axis=1)[:, len(self.sample) - k]
        return floor

    def _block(self, ids: np.ndarray, matrix: np.ndarray, floor: np.ndarray, k: int, before: int) -> DataFrame:
        """Candidates of a block of queries, which are numbered after those of the blocks before."""
        spark = self.cells.sparkSession
        dim, most = self.dim, self.most
        shared = spark.sparkContext.broadcast((ids, matrix, floor, self.pivots))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, floor, pivots = shared.value
            best = Best(ids, k, floor)
            exact = matrix.astype(np.float64)
            norm = (exact**2).sum(axis=1)
            away = np.sqrt(np.maximum(0.0, norm[:, None] + most - 2 * exact @ pivots.T.astype(np.float64)))
            slack = 1e-9 * (norm + most) + 1e-6
            for batch in batches:
                for row in batch.to_pylist():
                    dists, own = np.frombuffer(row["dists"]), np.frombuffer(row["ids"], np.int64)
                    vecs = np.frombuffer(row["vecs"], np.int64).reshape(-1, dim)
                    at = np.arange(0, len(own), ANNULUS)
                    inner, outer = dists[at], dists[np.minimum(at + ANNULUS, len(own)) - 1]
                    d = away[:, row["pivot"]]
                    near = np.maximum(0.0, np.maximum(inner - d[:, None], d[:, None] - outer))
                    reach = (norm[:, None] + most - near**2) / 2 + slack[:, None]
                    for a in np.argsort(near.min(axis=0), kind="stable"):
                        rows = np.flatnonzero(reach[:, a] >= best.floor)
                        for i in range(0, len(rows), 4096):
                            some = rows[i : i + 4096]
                            best.offer(some, products(matrix[some], vecs[at[a] : at[a] + ANNULUS]), own[at[a] : at[a] + ANNULUS])
            best.settle()
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(best.q + before), pa.array(ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["q", "query_id", "vec_id", "score"])

        return self.cells.mapInArrow(visit, "q long, query_id long, vec_id long, score long")

    def drop(self) -> None:
        remove(self.cells.sparkSession, self.path)
