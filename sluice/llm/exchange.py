"""Counting or naming keys over a whole corpus, with the answers returned to where the keys are.

A corpus is packed once into chunks: rows of (chunk, ids, lens, text), each with a few MB of whole
texts, in a table bucketed by chunk. A chunk sends its distinct keys, sorted, one message for each
range of the key space; a range sums the counts of equal keys and answers every message in the
message's own order, with the totals or with a name for each key. Answers join the chunk table
without moving it. A frequent key is one entry in each message, never a row for each occurrence, so
no key makes a hot task. There are as many ranges as keep one at about RANGE_BYTES of the corpus, so
that a range is as large at any size of the corpus.

A key is 64 bits that are spread over their whole range (`high`), and more bits (`low`) where those
alone could be the same for two things.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import at_end, binary_views, lean, new_path, remove, slices, trim

#: Bytes of text in a chunk (a longer document is a chunk of its own).
CHUNK_BYTES = 1 << 20
#: Bytes of text whose keys one range combines.
RANGE_BYTES = 16 << 20
CHUNK_SCHEMA = "chunk long, ids binary, lens binary, flags binary, rest binary, text binary"


#: Buckets that the chunks of one task go to, so that its writer opens few files.
BUCKETS_PER_TASK = 4


def bucket_of(value: int, buckets: int) -> int:
    """The bucket that Spark puts a non-negative long in: Murmur3 (x86, 32 bits, seed 42) of its two halves, modulo the number."""

    def turned(x: int, r: int) -> int:
        return (x << r | x >> (32 - r)) & 0xFFFFFFFF

    h = 42
    for half in (value & 0xFFFFFFFF, value >> 32):
        k = turned(half * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (turned(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


class Chunk:
    """One row of a chunk table. chunk + k is a number that no other row of the corpus has, k being a text's place in the chunk."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.flags = np.frombuffer(row["flags"], np.int8)
        self.packed_rest = row["rest"]
        self.raw = np.frombuffer(row["text"], np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)])

    def rest(self) -> pa.Table:
        """The columns that were kept beside id, flag and text."""
        return pa.ipc.open_stream(self.packed_rest).read_all()


class ChunkTable:
    """A corpus in chunks, written to the shared folder and bucketed by chunk."""

    def __init__(self, docs: DataFrame, flag=None, keep: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES):
        """docs: doc_id and text are read (null text: empty; null ids are not allowed); flag: a small integer column expression, and keep: columns, that go along."""
        self.spark: SparkSession = lean(docs.sparkSession)
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = new_path(self.spark, "chunks")
        self.name = "sluice_chunks_" + uuid.uuid4().hex
        flag = F.lit(0) if flag is None else flag
        frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.cast("tinyint").alias("flag"), *(F.col(f"`{c}`").alias(f"rest_{i}") for i, c in enumerate(keep)), F.col("text").cast("binary").alias("text"))

        parts = self.parts

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            base, seq, made = task << 32, 0, 0

            def next_name(after: int, made: int) -> int:
                while bucket_of(base + after, parts) != (task * BUCKETS_PER_TASK + made % BUCKETS_PER_TASK) % parts:
                    after += 1
                return after

            seq = next_name(0, 0)
            held: list[tuple] = []
            size = 0

            def row() -> pa.RecordBatch:
                ids, lens, flags, raw = (np.concatenate([h[k] for h in held]) for k in range(4))
                rest = b""
                if keep:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, held[0][4].schema) as out:
                        for h in held:
                            out.write_batch(h[4])
                    rest = sink.getvalue().to_pybytes()
                return pa.RecordBatch.from_pylist([{"chunk": base + seq, "ids": ids.tobytes(), "lens": lens.tobytes(), "flags": flags.tobytes(), "rest": rest, "text": raw.tobytes()}], schema=_CHUNK_ARROW)

            for batch, offsets, raw in slices(batches, chunk_bytes):
                if held and size + len(raw) > chunk_bytes:
                    yield row()
                    made += 1
                    seq = next_name(seq + sum(len(h[1]) for h in held), made)
                    held, size = [], 0
                held.append((np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), np.diff(offsets), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int8), raw.copy(), batch.select(range(2, 2 + len(keep)))))
                size += len(raw)
            if held:
                yield row()

        packed = frame.mapInArrow(pack, CHUNK_SCHEMA)
        self.tables = [(self.name, self.path)]
        at_end(self.drop)
        packed.write.bucketBy(self.parts, "chunk").option("path", self.path).format("parquet").saveAsTable(self.name)
        texts = self.frame().agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.ranges = max(2 * self.parts, -(-texts // RANGE_BYTES))

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def beside(self, df: DataFrame, what: str) -> DataFrame:
        """df (chunk, ...), written in the same buckets as the chunks, so that joining them moves neither. It goes with the table."""
        name, path = f"{self.name}_{what}", new_path(self.spark, what)
        self.tables.append((name, path))
        df.write.bucketBy(self.parts, "chunk").option("path", path).format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def map(self, f: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """f of each chunk, one at a time."""

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from f(Chunk(batch.slice(i, 1).to_pylist()[0]))
            trim()

        return self.frame().mapInArrow(run, schema)

    def map_with(self, answers: DataFrame, f: Callable[[Chunk, np.ndarray], Iterator[pa.RecordBatch]], schema: str, kind: type = np.uint8) -> DataFrame:
        """f of each chunk and the totals of the keys that it sent, in the keys' order."""
        return self.map_beside([by_chunk(answers)], lambda c, row: f(c, in_order(row["answers_0"], kind)), schema)

    def map_beside(self, frames: list[DataFrame], f: Callable[[Chunk, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """f of each chunk and its row of the frames, each (chunk, and one more column); their values are named answers_0, answers_1, ..."""
        joined = self.frame()
        for k, frame in enumerate(frames):
            (column,) = (c for c in frame.columns if c != "chunk")
            joined = joined.join(frame.select("chunk", F.col(column).alias(f"answers_{k}")).hint("shuffle_hash"), "chunk", "left")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield from f(Chunk(row), row)
            trim()

        return joined.mapInArrow(run, schema)

    def drop(self) -> None:
        while self.tables:
            name, path = self.tables.pop()
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)


def in_order(answers: list | None, kind: type) -> np.ndarray:
    """A chunk's answers as one array, in the order of the keys that it sent."""
    parts = sorted((a["bucket"], a["totals"]) for a in answers or ())
    return np.concatenate([np.frombuffer(b, kind) for _, b in parts]) if parts else np.zeros(0, kind)


_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("flags", pa.binary()), ("rest", pa.binary()), ("text", pa.binary())])
_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("lows", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("stats", pa.binary())])
MESSAGE = "bucket int, chunk long, keys binary, lows binary, counts binary"
ANSWER = "chunk long, bucket int, totals binary, stats binary"


@dataclass
class Keys:
    """Sorted distinct keys, how often each occurs, and where each of the keys that they were made from went."""

    high: np.ndarray
    count: np.ndarray
    place: np.ndarray
    low: np.ndarray | None = None

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray | None = None, counts: np.ndarray | None = None) -> Keys:
        if not len(high):
            return cls(high, np.zeros(0, np.int64), np.zeros(0, np.int64), low)
        order = np.argsort(high)
        s = high[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        if low is not None:
            t = low[order]
            if (~new[1:] & (t[1:] != t[:-1])).any():
                order = np.lexsort((low, high))
                t = low[order]
                new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(new)
        place = np.empty(len(high), np.int64)
        place[order] = np.cumsum(new) - 1
        total = np.diff(np.append(at, len(s))) if counts is None else np.add.reduceat(np.asarray(counts, np.int64)[order], at)
        return cls(s[at], total.astype(np.int64), place, None if low is None else t[at])

    def messages(self, chunk: int, ranges: int, width: int, kind: type) -> Iterator[pa.RecordBatch]:
        """One message for each range that has some of the keys. width: the leading bytes of `high` that are sent (8: all of it)."""
        n = len(self.high)
        if not n:
            return
        bounds = np.searchsorted(self.high, (np.arange(1, ranges, dtype=np.float64) * 2.0**64 / ranges).astype(np.uint64)) if ranges > 1 else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], bounds, [n]])
        packed = np.ascontiguousarray(self.high.view(np.uint8).reshape(-1, 8)[:, 8 - width :])
        counts = clipped(self.count, kind)
        some = np.flatnonzero(np.diff(bounds)).tolist()
        cut = lambda a: [a[bounds[b] : bounds[b + 1]].tobytes() for b in some]
        lows = [None] * len(some) if self.low is None else cut(self.low)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(cut(packed), pa.binary()), pa.array(lows, pa.binary()), pa.array(cut(counts), pa.binary())], schema=_MESSAGE)


def clipped(counts: np.ndarray, kind: type) -> np.ndarray:
    return np.minimum(counts, np.iinfo(kind).max).astype(kind)


def _received(part: pa.Table, width: int, kind: type, low: type | None) -> tuple[Keys, np.ndarray]:
    """A range's keys, and the n + 1 places at which its messages begin."""
    sizes, raw = binary_views(part.column("keys"))
    _, counts = binary_views(part.column("counts"))
    full = np.zeros((len(raw) // width, 8), np.uint8)
    full[:, 8 - width :] = raw.reshape(-1, width)
    high = full.view(np.uint64).ravel()
    lows = None if low is None else np.frombuffer(binary_views(part.column("lows"))[1].tobytes(), low)
    return Keys.of(high, lows, np.frombuffer(counts.tobytes(), kind)), sizes // width


def _answered(part: pa.Table, bucket: int, back: np.ndarray, ends: np.ndarray, stats: bytes | None) -> pa.Table:
    rows = [{"chunk": c, "bucket": bucket, "totals": back[i:j].tobytes(), "stats": stats if k == 0 else None} for k, (c, i, j) in enumerate(zip(part.column("chunk").to_pylist(), ends[:-1], ends[1:], strict=True))]
    return pa.Table.from_pylist(rows, schema=_ANSWER)


def count_messages(sent: DataFrame, width: int, kind: type, top: int = 0, low_bits: int = 0, low: type | None = None) -> DataFrame:
    """Answers to messages: (chunk, bucket, totals, stats).

    stats, once for each range, int64: keys with a count, their sum; then, if asked for, such keys and
    sums for each value of a key's low bits, and the `top` most frequent keys, their counts and their
    low parts.
    """

    def add(key, part):
        keys, ends = _received(part, width, kind, low)
        total = keys.count
        parts = [np.array([np.count_nonzero(total), total.sum()], np.int64)]
        if low_bits:
            own = ((keys.high if low is None else keys.low.astype(np.uint64)) & np.uint64((1 << low_bits) - 1)).astype(np.int64)
            parts += [np.bincount(own[total > 0], minlength=1 << low_bits), np.bincount(own, total, minlength=1 << low_bits).astype(np.int64)]
        if top:
            most = np.lexsort((keys.high, -total))[:top]
            parts += [keys.high[most].view(np.int64), total[most], np.zeros(len(most), np.int64) if low is None else keys.low[most].astype(np.int64)]
        return _answered(part, part.column("bucket")[0].as_py(), clipped(total, kind)[keys.place], ends, np.concatenate(parts).astype(np.int64).tobytes())

    return sent.groupBy("bucket").applyInArrow(add, ANSWER)


#: Bits of a name for its level and for its range; what a window's length leaves is the place in the range.
LEVEL_BITS, RANGE_BITS = 3, 20


def name_messages(sent: DataFrame, level: int, bits: int) -> DataFrame:
    """Answers to messages of whole keys: int64 names of `bits` bits, or 0 for a key that occurs once in all.

    Equal keys get equal names and others don't; names depend on the keys that occur alone.
    """
    room = bits - LEVEL_BITS - RANGE_BITS

    def name(key, part):
        keys, ends = _received(part, 8, np.uint8, np.uint64)
        bucket = part.column("bucket")[0].as_py()
        more = keys.count > 1
        if bucket >> RANGE_BITS or np.count_nonzero(more) >> room:
            raise ValueError("more ranges or names than a name has bits for: raise RANGE_BYTES or the number of shuffle partitions")
        names = np.where(more, (level << RANGE_BITS | bucket) << room | np.cumsum(more), 0)
        return _answered(part, bucket, names[keys.place], ends, None)

    return sent.groupBy("bucket").applyInArrow(name, ANSWER)


def totals(table: ChunkTable, send: Callable[[Chunk], Keys], width: int = 8, kind: type = np.uint8, top: int = 0, low_bits: int = 0, low: type | None = None) -> DataFrame:
    """(chunk, bucket, totals, stats): the corpus-wide total of every key that each chunk sent.

    Totals are of the integer type `kind` and stop at its end. low: the type of the keys' low parts, if
    they have some. With a width below 8, keys that agree in their leading bytes (and low parts) count
    together. stats, top and low_bits: see count_messages.
    """
    ranges = table.ranges

    def out(c: Chunk):
        yield from send(c).messages(c.chunk, ranges, width, kind)

    return count_messages(table.map(out, MESSAGE), width, kind, top, low_bits, low)


def by_chunk(answers: DataFrame) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "totals")).alias("answers"))
