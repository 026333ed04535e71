"""Quality classifier: naive Bayes support vectors.

A text's features are its distinct hashed character n-grams. Each is scaled by the log ratio of its
counts in the two classes, and a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent. The model is one weight per bucket (ratio times hinge weight), an offset, and
the slope and offset of a logistic curve that turns margins into probabilities; it is broadcast.

The fit takes at most `sample` labelled documents, those with the least md5 of their id, and no further
ones once their texts reach SAMPLE_BYTES: the sample is bounded so that the features fit in the driver's
memory, whatever ids and texts are like, and doesn't depend on partitioning. The orders of the n-grams and
the cost of the hinge loss are chosen among ORDERS and COSTS by cross-validation inside those rows, each
fold being a Spark task. Descent goes on until no row's multiplier moves any more, within a tolerance.

Results in special cases: a null text counts as empty, an empty text is scored by the offset alone;
without labels of both classes every score is the share of label 1 (0.5 without labels). Labels without
an id and ids with both labels teach nothing; an id that several documents have teaches each of them, equal ones among them once.
Texts of any length are taken whole; a document without an id is scored, and learnt from never.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.langid import decoded, passes
from sluice.llm.shared import lean, scratch, slices, trim, written

BUCKETS = 1 << 17
#: Orders of n-grams to choose from.
ORDERS = ((1, 2), (2, 3), (3, 4), (4, 5))
#: Labelled rows that a fit takes at most, and bytes of their texts after which no further row is taken.
SAMPLE, SAMPLE_BYTES = 8000, 64 << 20
ACCEPT = 0.7
#: Costs of the hinge loss to choose from, and the cross-validation: folds, rows at most.
COSTS = (0.01, 0.1, 1.0, 10.0)
FOLDS, FOLD_ROWS = 3, 3000
#: Descent ends when a round moves no multiplier by more than this share of the cost (of a fit, of a fold's fit), or after ROUNDS.
STILL, FOLD_STILL, ROUNDS = 1e-3, 1e-2, 1000


def features(texts: list[str], buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS[1]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, laid end to end, and the n + 1 places where texts begin. Case is kept."""
    joined = " " + "  ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lens)])
    shift = np.uint64(64 - (buckets - 1).bit_length())
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), lens)
    width = (buckets - 1).bit_length()
    seen = []
    for order in orders:
        n = len(points) - order + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        for k in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : n + k]
        h = (h * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(order)) * np.uint64(0xC2B2AE3D27D4EB4F) >> shift
        inside = doc[:n] == doc[order - 1 :]
        seen.append(((doc[:n].astype(np.uint64) << np.uint64(width)) | h)[inside])
    keys = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    ends = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(width))
    return (keys & np.uint64(buckets - 1)).astype(np.int32), ends


def logistic(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(label 1) over margins, by Newton steps on smoothed targets."""
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()]) + 1e-3 * np.array([a - 1, b])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


class Model:
    """weights by bucket, an offset, and the curve's slope and offset."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float, orders: tuple[int, ...]):
        self.weights, self.offset, self.slope, self.shift, self.orders = weights.astype(np.float32), offset, slope, shift, orders

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j in passes(texts):
            flat, ends = features(texts[i:j], len(self.weights), self.orders)
            run = np.concatenate([[0.0], np.cumsum(self.weights[flat], dtype=np.float64)])
            n = np.maximum(np.diff(ends), 1)
            margin = (run[ends[1:]] - run[ends[:-1]]) / np.sqrt(n) + self.offset
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700)))
        return out


def fit_rows(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS[1]) -> Model:
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = (float((y > 0).mean()) if len(y) else 0.5) * 0.98 + 0.01
        return Model(np.zeros(buckets), 0.0, 1.0, float(np.log(share / (1 - share))), orders)
    parts = [features(texts[i:j], buckets, orders) for i, j in passes(texts)]
    flat, lens = np.concatenate([f for f, _ in parts]), np.concatenate([np.diff(e) for _, e in parts])
    return fit_features(flat, lens, y, buckets, orders, chosen_cost(flat, np.concatenate([[0], np.cumsum(lens)]), y, buckets))


def _ratios(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    """The log ratio of each bucket's smoothed shares in the two classes, over rows from starts to ends; a row has a bucket once."""
    counts = {True: np.ones(buckets), False: np.ones(buckets)}
    for i, j, own in zip(starts.tolist(), ends.tolist(), (y > 0).tolist(), strict=True):
        counts[own][flat[i:j]] += 1.0
    p, q = counts[True], counts[False]
    return np.log((p / p.sum()) / (q / q.sum()))


def _margins(weights: np.ndarray, offset: float, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each row the sum of its buckets' weights over the root of their number, and the offset."""
    sums = np.fromiter((weights[flat[i:j]].sum() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), np.float64, len(starts))
    return sums / np.sqrt(np.maximum(ends - starts, 1)) + offset


def fold_hits(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, buckets: int, costs: tuple[float, ...] = COSTS) -> np.ndarray:
    """For each cost the share of the folds' unseen rows that its fits judge rightly, summed over classes and folds.

    Rows go to folds in turn, up to FOLD_ROWS of them, spread over all. Ratios are those of the rows fitted.
    """
    return np.array([sum(fold_hit(flat, ends, y, buckets, k, cost) for k in range(FOLDS)) for cost in costs])


def fold_hit(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, buckets: int, k: int, cost: float) -> float:
    """fold_hits' part of one fold and one cost."""
    rows = np.unique(np.linspace(0, len(y) - 1, min(len(y), FOLD_ROWS)).astype(np.int64))
    fold = np.arange(len(rows)) % FOLDS
    seen, asked = rows[fold != k], rows[fold == k]
    own, other = y[seen], y[asked]
    if min((own > 0).sum(), (own < 0).sum(), (other > 0).sum(), (other < 0).sum()) == 0:
        return 0.0
    begin, end = ends[:-1], ends[1:]
    ratio = _ratios(flat, begin[seen], end[seen], own, buckets)
    weights, offset = dual_descent(flat, begin[seen], end[seen], own, ratio, cost, still=FOLD_STILL)
    right = (_margins(weights, offset, flat, begin[asked], end[asked]) > 0) == (other > 0)
    return float(right[other > 0].mean() + right[other < 0].mean())


def cross_validated(spark: SparkSession, digest: tuple, buckets: int, costs: tuple[float, ...] = COSTS) -> np.ndarray:
    """fold_hits of a digest (classes, features, numbers of them), one Spark task for each fold; a task holds the features once."""
    shared = spark.sparkContext.broadcast(digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                y, flat, lens = shared.value
                ends = np.concatenate([[0], np.cumsum(lens)])
                found = [fold_hit(flat, ends, y, buckets, k, cost) for cost in costs]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(costs)), pa.array(range(len(costs)), pa.int64()), pa.array(found)], names=["fold", "cost", "hit"])
        trim()

    hits = np.zeros(len(costs))
    for _, c, hit in sorted(spark.range(0, FOLDS, 1, FOLDS).mapInArrow(run, "fold long, cost long, hit double").collect()):
        hits[c] += hit
    shared.destroy()
    return hits


def chosen_cost(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, buckets: int, costs: tuple[float, ...] = COSTS) -> float:
    """The cost with the most hits; of equals the least."""
    return costs[int(fold_hits(flat, ends, y, buckets, costs).argmax())]


def fit_features(flat: np.ndarray, lens: np.ndarray, y: np.ndarray, buckets: int, orders: tuple[int, ...], cost: float) -> Model:
    ends = np.concatenate([[0], np.cumsum(lens)])
    rows = flat, ends[:-1], ends[1:]
    weights, offset = dual_descent(*rows, y, _ratios(*rows, y, buckets), cost)
    slope, shift = logistic(_margins(weights, offset, *rows), y)
    return Model(weights, offset, slope, shift, orders)


def dual_descent(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, y: np.ndarray, ratio: np.ndarray, cost: float = 10.0, rounds: int = ROUNDS, still: float = STILL) -> tuple[np.ndarray, float]:
    """ratio times the weights, and the offset, of the linear SVM with hinge loss over rows from starts to ends.

    A row's value at each of its buckets is ratio[bucket] over the root of their number, so that rows have
    the length one before scaling, as long texts have more n-grams. As the weights are carried multiplied by
    the ratio, no value is stored for any feature.
    """
    weights, offset, square = np.zeros(len(ratio)), 0.0, ratio * ratio
    bounds = list(zip(starts.tolist(), ends.tolist(), strict=True))
    scale = (1 / np.sqrt(np.maximum(ends - starts, 1))).tolist()
    norms = [1.0 + float(square[flat[i:j]].sum()) * s * s for (i, j), s in zip(bounds, scale, strict=True)]
    alpha = np.zeros(len(y))
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(rounds):
        moved = 0.0
        for r in rng.permutation(len(y)).tolist():
            i, j = bounds[r]
            at = flat[i:j]
            slope = y[r] * (float(weights[at].sum()) * scale[r] + offset) - 1.0
            new = min(max(alpha[r] - slope / norms[r], 0.0), cost)
            step = (new - alpha[r]) * y[r]
            if step:
                weights[at] += (step * scale[r]) * square[at]
                offset += step
                moved = max(moved, abs(step))
                alpha[r] = new
        if moved < still * cost:
            break
    return weights, offset


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, buckets: int = BUCKETS, orders: tuple[tuple[int, ...], ...] = ORDERS) -> Model:
    """labels: doc_id and quality (rows with another value than 0 or 1 are left out); learn: a condition on doc_id; orders: those to choose from."""
    spark = lean(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(learn)
    known = known.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).filter("quality = least").drop("least")
    chosen = known.withColumn("place", F.md5(F.col("doc_id").cast("string"))).orderBy("place", "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("own", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    place = F.struct("place", "doc_id", "own")
    # An id may be that of very many documents, so documents are counted off, too: first without their texts.
    first = texts.groupBy("place", "doc_id", "own").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).orderBy("place", "doc_id", "own").limit(sample)
    reached = F.sum("size").over(Window.orderBy("place", "doc_id", "own"))
    end = first.withColumn("before", reached - F.col("size")).filter(F.col("before") < SAMPLE_BYTES).agg(F.max(place).alias("end")).first()["end"]
    texts = texts.filter(place <= F.struct(F.lit(end["place"]).alias("place"), F.lit(end["doc_id"]).cast("long").alias("doc_id"), F.lit(end["own"]).alias("own"))) if end else texts.limit(0)
    with scratch(spark):
        texts = written(texts.dropDuplicates(["doc_id", "own"]).select("doc_id", "quality", "text", "place"), "labelled")
        edge = texts.select("place").distinct().orderBy("place").limit(FOLD_ROWS).agg(F.max("place")).first()[0]
        few = texts.filter(F.col("place") <= F.lit(edge))
        # One choice of orders after the other, so that neither the driver nor a task holds the features of more than one.
        hits = np.stack([cross_validated(spark, _digested(few, buckets, some), buckets) for some in orders])
        d, c = np.unravel_index(int(hits.argmax()), hits.shape)
        choice = orders[d], COSTS[c]
        y, flat, lens = _digested(texts, buckets, choice[0])
        if not len(y) or (y > 0).all() or (y < 0).all():
            return fit_rows([""] * len(y), (y > 0).astype(int), buckets, choice[0])
        return fit_features(flat, lens, y, buckets, *choice)


def _digested(texts: DataFrame, buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the labelled texts: class (1 or -1), features laid end to end, numbers of them. Rows are in an order of their own contents."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offsets, raw in slices(batches):
            found = decoded(offsets, raw)
            for i, j in passes(found):
                flat, ends = features(found[i:j], buckets, orders)
                rows = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(rows, pa.binary())], names=["doc_id", "quality", "buckets"])

    held = texts.select("doc_id", "quality", "text").mapInArrow(digest, "doc_id long, quality int, buckets binary").toArrow()
    ids, labels = held.column("doc_id").to_numpy(), held.column("quality").to_numpy()
    rows = [np.frombuffer(b, np.int32) if (b := one.as_buffer()).size else np.zeros(0, np.int32) for chunk in held.column("buckets").chunks for one in chunk]
    same = Counter(ids.tolist())
    order = sorted(range(len(ids)), key=lambda i: (ids[i], rows[i].tobytes() if same[ids[i]] > 1 else b""))
    y = np.where(labels[order] == 1, 1.0, -1.0) if rows else np.zeros(0)
    return y, np.concatenate([np.zeros(0, np.int32), *(rows[i] for i in order)]), np.array([len(rows[i]) for i in order], np.int64)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, score."""
    shared = lean(docs.sparkSession).sparkContext.broadcast(model)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("text"))
    extra = "".join(f", {c} {frame.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offsets, raw in slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1 + len(keep))), pa.array(shared.value.score(decoded(offsets, raw)))], names=["doc_id", *keep, "score"])

    return frame.mapInArrow(run, f"doc_id long{extra}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = ACCEPT) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, with all their columns."""
    shared = lean(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                yield batch.filter(pa.array(shared.value.score(texts) >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)


__all__ = ["accepted", "dual_descent", "fit_rows", "score", "train"]
