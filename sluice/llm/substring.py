"""Removing repeated passages, found by recompression.

Spark names symbols in rounds, for the whole corpus at once. Round 0 names the words. Every later round
names what two neighbours make: each side is a run of equal symbols, and a left one is paired with the
right one after it in a split of all names that the round draws by hashing. A round is one exchange
(see sluice.llm.exchange): chunks send the distinct blocks that they hold, ranges of the key space give
equal blocks the same number and others another, and chunks get the numbers back. A block is known by
the names and lengths of its two runs in full, so that two symbols have the same name if and only if
they stand for the same words; only words themselves come in by a hash, of 128 bits.

A symbol also knows the range of words that its making depends on. Wherever a window of words stands,
the symbols whose range lies within it stand there too, under the same names. So a symbol that occurs
once, or whose range is longer than a window, can't be inside a repeat: it gets no name, and what is
left on either side of it goes on alone. A window that holds the range of a symbol that occurs once
doesn't occur elsewhere; it is closed, and symbols that lie in closed windows only go no further. The other windows have shared symbols only; an exchange of 128 bits over all
their words verifies them, and words under a window that occurs twice or more go. No window is dropped
unverified because of its count, and none is compared with others pairwise.

Results in special cases: null and empty texts have no word; texts shorter than a window lose
nothing; rows that are equal, or one text that repeats itself, lose the repeated words everywhere;
a null doc_id stays null; other columns go along untouched, whatever their names. A text is one value
of a chunk, so it may have 2 GB at most. Two different words, or windows, count as equal if all 128
bits are: at n of them a chance of about n**2 / 2**129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.llm.exchange import MESSAGE, Chunk, ChunkTable, Keys, by_chunk, count_messages, in_order, name_messages
from sluice.llm.shared import keep_written, scratch
from sluice.llm.words import Words, joined, mixed, window_hashes, words_of

#: Words of a window.
WINDOW = 35
#: Rounds that name blocks, after the one that names words.
ROUNDS = 3
#: Stands for a null doc_id inside chunks.
NO_ID = -(1 << 63)


class Level:
    """The symbols of a chunk in their order: name; lo, hi: the words the making depends on; leading, last: no symbol follows on before, after."""

    def __init__(self, words: Words):
        n = len(words.hash)
        self.name = np.zeros(n, np.uint64)
        narrow = n < 1 << 28
        self.far = 1 << (29 if narrow else 40)  # beyond any text, and twice as far is still a number
        self.lo = np.arange(n, dtype=np.int32 if narrow else np.int64)
        self.hi = self.lo + 1
        self.last = np.zeros(n, bool)
        self.last[words.first[1:][np.diff(words.first) > 0] - 1] = True
        self.leading = np.ones(n, bool)
        self.leading[1:] = self.last[:-1]

    def _merge(self, head: np.ndarray) -> None:
        """Symbols become one from each place in `head` up to the next, under the first one's name."""
        stop = np.append(head[1:], len(self.name)) - 1
        self.lo, self.hi = np.minimum.reduceat(self.lo, head), np.maximum.reduceat(self.hi, head)
        self.leading, self.last, self.name = self.leading[head], self.last[stop], self.name[head]

    def _reach(self, before: np.ndarray | bool, after: np.ndarray | bool) -> None:
        """Adds the ranges of the symbols before, and after, to those of the symbols marked; beyond reach where none follows on."""
        lo, hi = self.lo.copy(), self.hi.copy()
        look = np.ones(len(lo), bool) & before
        lo[look & self.leading] = -self.far
        at = np.flatnonzero(look & ~self.leading)
        lo[at], hi[at] = np.minimum(lo[at], self.lo[at - 1]), np.maximum(hi[at], self.hi[at - 1])
        look = np.ones(len(lo), bool) & after
        hi[look & self.last] = self.far
        at = np.flatnonzero(look & ~self.last)
        lo[at], hi[at] = np.minimum(lo[at], self.lo[at + 1]), np.maximum(hi[at], self.hi[at + 1])
        self.lo, self.hi = lo, hi

    def blocks(self, salt: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges runs, then pairs of runs. The two halves of each block's key (name and length of a run, in 64 bits; 0: none), and whether it is new.

        A length stops at its bits' end, which is beyond any window.
        """
        if not len(self.name):
            return self.name, self.name, np.zeros(0, bool)
        # Whatever a run is, it ends where the neighbours differ.
        self._reach(True, True)
        head = np.ones(len(self.name), bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | self.leading[1:]
        head = np.flatnonzero(head)
        size = np.minimum(np.diff(np.append(head, len(self.name))), (1 << bits) - 1).astype(np.uint64)
        self._merge(head)
        run = self.name << np.uint64(bits) | size
        # A left name looks at the one after it, a right name at the one before it.
        right = (mixed(run, 100 + salt) >> np.uint64(63)).astype(bool)
        self._reach(right, ~right)
        joins = np.zeros(len(run), bool)  # with the one before
        joins[1:] = right[1:] & ~right[:-1] & ~self.leading[1:]
        head = np.flatnonzero(~joins)
        two = np.append(joins[1:], False)[head]
        second = np.zeros(len(head), np.uint64)
        second[two] = run[head[two] + 1]
        first = run[head]
        self._merge(head)
        return first, second, two | (size[head] > 1)

    def keep(self, stay: np.ndarray) -> None:
        """Drops the other symbols; their neighbours end there."""
        gone = ~stay
        self.leading[1:] |= gone[:-1]
        self.last[:-1] |= gone[1:]
        self.name, self.lo, self.hi, self.leading, self.last = (a[stay] for a in (self.name, self.lo, self.hi, self.leading, self.last))


class Recompression:
    """A chunk's symbols after the rounds whose answers are given, the keys that it sends next, and the windows that are left open."""

    def __init__(self, c: Chunk, window: int, rounds: int, answers: list[np.ndarray]):
        self.words = words_of(c.offsets, c.raw, lanes=2)
        self.window, n = window, len(self.words.hash)
        self.bits = (window + 1).bit_length()
        self.once = np.zeros(n + 1, np.int32)
        self.whole = np.zeros(n, bool)  # windows that end within their text
        for a, b in zip(self.words.first[:-1].tolist(), self.words.first[1:].tolist(), strict=True):
            self.whole[a : max(a, b - window + 1)] = True
        level = Level(self.words)
        keys = Keys.of(self.words.hash, self.words.other)
        new = np.ones(n, bool)
        for r in range(rounds + 1):
            if r == len(answers):
                break
            names = level.name.copy()
            names[new] = answers[r][keys.place]
            self._alone(level, names == 0)
            level.name = names
            if r == rounds:
                break
            level.keep((names != 0) & self._inside_open(level))
            first, second, new = level.blocks(r, self.bits)
            fits = level.hi - level.lo <= window
            level.keep(fits)
            first, second, new = first[fits], second[fits], new[fits]
            # From the high part and one half the other half follows, so both together are the block.
            keys = Keys.of(joined(first[new], second[new], 300), second[new])
        self.keys = keys

    def _alone(self, level: Level, once: np.ndarray) -> None:
        """Closes the windows that hold the range of a symbol that occurs once."""
        lo, hi = level.lo[once], level.hi[once]
        np.add.at(self.once, np.maximum(hi - self.window, 0), 1)
        np.add.at(self.once, lo + 1, -1)

    def _inside_open(self, level: Level) -> np.ndarray:
        """Which symbols have their range inside a window that is still open: what closed windows hold can't be in a repeat."""
        before = np.concatenate([[0], np.cumsum(self.open_windows(), dtype=np.int32)])
        return before[level.lo + 1] > before[np.maximum(level.hi - self.window, 0)]

    def open_windows(self) -> np.ndarray:
        return self.whole & (np.cumsum(self.once[:-1]) == 0)


def window_keys(words: Words, window: int, starts: np.ndarray) -> Keys:
    if not len(starts):
        return Keys.of(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return Keys.of(window_hashes(words.hash, window)[starts], window_hashes(words.other, window)[starts])


def _names(row: dict, rounds: int) -> list[np.ndarray]:
    return [in_order(row[f"answers_{r}"], np.int64).astype(np.uint64) for r in range(rounds)]


def removed_words(table: ChunkTable, window: int, rounds: int, with_text: StructType | None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per text of the table, or with_text: those columns it keeps, and kept (binary)."""
    ranges, bits = table.ranges, 64 - (window + 1).bit_length()
    named: list[DataFrame] = []
    for r in range(rounds + 1):

        def send(c: Chunk, row: dict, r: int = r) -> Iterator[pa.RecordBatch]:
            yield from Recompression(c, window, rounds, _names(row, r)).keys.messages(c.chunk, ranges, 8, np.uint8)

        answers = name_messages(table.map_beside(named, send, MESSAGE), r, bits)
        named.append(table.beside(by_chunk(answers), f"names_{r}"))

    def opened(c: Chunk, row: dict) -> Iterator[pa.RecordBatch]:
        found = Recompression(c, window, rounds, _names(row, rounds + 1)).open_windows()
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array([c.chunk]), pa.array([np.packbits(found).tobytes()], pa.binary())], names=["chunk", "starts"])

    starts = table.beside(table.map_beside(named, opened, "chunk long, starts binary"), "windows")

    def windows(c: Chunk, row: dict) -> tuple[Words, np.ndarray, Keys]:
        words = words_of(c.offsets, c.raw, lanes=2)
        held = row["answers_0"]
        at = np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), count=len(words.hash))) if held else np.zeros(0, np.int64)
        return words, at, window_keys(words, window, at)

    def ask(c: Chunk, row: dict) -> Iterator[pa.RecordBatch]:
        if row["answers_0"]:
            yield from windows(c, row)[2].messages(c.chunk, ranges, 8, np.uint8)

    counted = count_messages(table.map_beside([starts], ask, MESSAGE), 8, np.uint8, low=np.uint64)
    out_schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text is not None:
        out_schema = "doc_id long, kept binary" + "".join(f", rest_{i} {f.dataType.simpleString()}" for i, f in enumerate(with_text.fields))
    texts_too = with_text is not None

    def cover(c: Chunk, row: dict) -> Iterator[pa.RecordBatch]:
        words, at, keys = windows(c, row)
        mark = np.zeros(len(words.hash) + 1, np.int64)
        twice = at[in_order(row["answers_1"], np.uint8)[keys.place] >= 2]
        np.add.at(mark, twice, 1)
        np.add.at(mark, twice + window, -1)
        yield kept_rows(c, words, np.cumsum(mark[:-1]) > 0, texts_too)

    return table.map_beside([starts, by_chunk(counted)], cover, out_schema)


def kept_rows(c: Chunk, words: Words, gone: np.ndarray, texts_too: bool) -> pa.RecordBatch:
    """A row per text of the chunk: the words that stay are joined by one space."""
    keep = ~gone
    start, end = words.start[keep], words.end[keep]
    lens = end - start + 1
    out = np.full(int(lens.sum()), 0x20, np.uint8)
    at = np.concatenate([[0], np.cumsum(lens)])
    if len(start):
        step = np.ones(len(out), np.int64)
        step[at[:-1]] = start - np.concatenate([[0], end[:-1]])
        step[0] = start[0]
        source = np.cumsum(step)
        inside = np.ones(len(out), bool)
        inside[at[1:] - 1] = False
        out[inside] = c.raw[source[inside]]
    data = out.tobytes()
    n_words = np.diff(words.first)
    lost = np.concatenate([[0], np.cumsum(gone)])
    n_removed = lost[words.first[1:]] - lost[words.first[:-1]]
    kept_before = words.first - lost[words.first]
    place = at[kept_before]
    texts = [data[i : max(i, j - 1)] for i, j in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
    if texts_too:
        rest = c.rest() if c.packed_rest else pa.table({})
        arrays = [pa.array(c.ids), pa.array(texts, pa.binary()), *(col.combine_chunks() for col in rest.columns)]
        return pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=["doc_id", "kept", *rest.column_names])
    digest = [hashlib.sha256(t).hexdigest() for t in texts]
    return pa.RecordBatch.from_arrays([pa.array(c.ids), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _run(docs: DataFrame, window: int, rounds: int, keep: tuple[str, ...] | None) -> DataFrame:
    """The written result; keep: None for digests, else the columns to return beside doc_id and the kept text."""
    with scratch(docs.sparkSession):
        table = ChunkTable(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), keep=keep or ())
        found = removed_words(table, window, rounds, None if keep is None else docs.select(*[f"`{c}`" for c in keep]).schema)
        return keep_written(found.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID))), "kept")


def digests(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs."""
    return _run(docs, window, rounds, None)


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs with their columns, text being the words that stay, joined by one space."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = _run(docs, window, rounds, keep)
    back = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept").cast("string")} | {c: F.col(f"rest_{i}") for i, c in enumerate(keep)}
    return out.select(*[back[c].alias(c) for c in docs.columns])
