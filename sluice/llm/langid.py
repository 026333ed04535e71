"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased code point sequences; every n-gram of the given orders is hashed into
`buckets`. Training sums counts by (language, bucket) over all training documents, each task
sending one row per pair it has seen. The log-probability matrix has a fixed number of rows and a
column per language, and is broadcast; train raises if there are so many languages that it would have
more than MODEL_BYTES. Scoring gathers the matrix rows of a batch's n-grams and
sums them by document.

Results in special cases: every row is judged, and counts in training, as often as it occurs, whatever
its id; a null id stays null; texts of any length are taken whole; a null text, or one without a letter,
is `und` with score 0; a text of one
letter is judged by its padding n-grams; without any training document every text is `und`; ties go
to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import lean, slices

BUCKETS = 1 << 15
ORDERS = (2, 3)
UNDETERMINED = "und"
#: Bytes of a matrix at most.
MODEL_BYTES = 256 << 20
#: Code points of a numpy pass.
PASS = 1 << 18
_LETTER = regex.compile(r"\p{L}")


def grams(texts: list[str], buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of each text, laid end to end, and the n + 1 places where texts begin.

    A text is padded with a space at both ends, so each has len + 3 - n of order n.
    """
    joined = " " + "  ".join(t.lower() for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lens)])
    out, per = [], []
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for order in orders:
        h = np.zeros(max(0, len(points) - order + 1), np.uint64)
        for k in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - order + 1 + k]
        h = (h * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(order)) * np.uint64(0xC2B2AE3D27D4EB4F) >> shift
        out.append(h.astype(np.int32))
        per.append(np.maximum(lens - order + 1, 0))
    # By text: for each order, the grams that lie within the text.
    ends = np.concatenate([[0], np.cumsum(sum(per))])
    flat = np.empty(int(ends[-1]), np.int32)
    at = ends[:-1].copy()
    for h, n in zip(out, per, strict=True):
        total = int(n.sum())
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(at, n) + within] = h[np.repeat(starts[:-1], n) + within]
        at += n
    return flat, ends


def passes(texts: list[str], limit: int = PASS) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `limit` code points."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if len(texts) > at:
        yield at, len(texts)


def decoded(offsets: np.ndarray, raw: np.ndarray) -> list[str]:
    data = raw.tobytes()
    return [data[i:j].decode("utf-8", "replace") for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def train(docs: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[list[str], np.ndarray]:
    """Languages and the (buckets, languages) matrix of log probabilities, from text and non-null lang of docs."""
    lean(docs.sparkSession)
    frame = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("binary").alias("text"))
    languages, most = frame.select("lang").distinct().count(), MODEL_BYTES // (4 * buckets)
    if languages > most:
        raise ValueError(f"{languages} languages in {buckets} buckets, at most {most}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, offsets, raw in slices(batches):
            names = np.asarray(batch.column(0).to_pylist(), object)
            texts = decoded(offsets, raw)
            for lang in set(names.tolist()):
                chosen = [t for t, n in zip(texts, names, strict=True) if n == lang]
                for i, j in passes(chosen):
                    flat, _ = grams(chosen[i:j], buckets, orders)
                    sums[lang] = sums.get(lang, 0) + np.bincount(flat, minlength=buckets)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    summed = frame.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(summed["lang"].unique())
    matrix = np.full((buckets, len(names)), 0.5)
    for k, lang in enumerate(names):
        own = summed[summed["lang"] == lang]
        matrix[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return names, np.log(matrix / matrix.sum(axis=0)).astype(np.float32) if names else matrix.astype(np.float32)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, orders: tuple[int, ...] = ORDERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, lang_pred and score (the posterior of that language, all languages being as likely before)."""
    spark = lean(docs.sparkSession)
    model = spark.sparkContext.broadcast((names, matrix))
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("text"))
    extra = "".join(f", {c} {frame.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = model.value
        buckets, n_lang = matrix.shape
        for batch, offsets, raw in slices(batches):
            texts = decoded(offsets, raw)
            lang, best = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if n_lang:
                for i, j in passes(texts):
                    flat, ends = grams(texts[i:j], buckets, orders)
                    sums = np.empty((j - i, n_lang))
                    for k in range(n_lang):
                        run = np.concatenate([[0.0], np.cumsum(matrix[:, k][flat], dtype=np.float64)])
                        sums[:, k] = run[ends[1:]] - run[ends[:-1]]
                    top = sums.argmax(axis=1)
                    p = 1 / np.exp(np.minimum(sums - sums.max(axis=1, keepdims=True), 0)).sum(axis=1)
                    for d in range(i, j):
                        if _LETTER.search(texts[d]):
                            lang[d], best[d] = names[top[d - i]], min(1.0, float(p[d - i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(1 + k) for k in range(len(keep))), pa.array(lang, pa.string()), pa.array(best)], names=["doc_id", *keep, "lang_pred", "score"])

    return frame.mapInArrow(score, f"doc_id long{extra}, lang_pred string, score double")

