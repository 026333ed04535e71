"""Packing token sequences by bounded-space online best-fit.

Each task packs the pieces of its documents as they come: a piece goes into the open sequence with
the least free space that still holds it; when none does and the fixed number of sequences is
open, the fullest one closes. Open sequences are kept by their free space, and the levels in use
are bits of one integer, so finding a fit is a shift and a count of trailing zeros. Nothing is
shuffled, and memory doesn't grow with the input; each task leaves some partly filled sequences.

Results in special cases: a null or empty text is a piece of the end token alone; repeated rows are
packed as often as they occur; a null doc_id stays null; an empty table has no pieces; a text of any
length is cut into pieces in its task, so that one text's ids must fit a task's memory.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import lean

#: Tokens of a sequence.
SEQUENCE = 1024
#: Sequences that a task holds open.
OPEN = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Texts in which both engines' classes of letters, numbers and white space are beyond doubt the same.
_COMMON = re.compile("[^\t\n\r -~\u00a1-\u024f]")


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if visible, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian uint32 bytes, as the library `tokenizers` gives them for the file, without special tokens around them.

    Where the file is a byte-level BPE whose ids follow the order of its merges, texts of common
    letters go through a faster engine with that same vocabulary; all others, and texts in which an
    added token is written out, through `tokenizers`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.fast = self._same_vocabulary(path)

    @staticmethod
    def _same_vocabulary(path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, pre = spec["model"].get("vocab"), spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        if any(vocab.get(m) != 256 + i for i, m in enumerate(merges)):
            return None
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.fast is None or _COMMON.search(text) or self.added.search(text):
            return self.plain(text)
        return np.asarray(self.fast.encode_ordinary(text), np.uint32).tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class BestFit:
    """Bins of `size`, at most `bound` of them open."""

    def __init__(self, size: int, bound: int):
        self.size, self.bound = size, bound
        self.levels: list[list[int]] = [[] for _ in range(size + 1)]
        self.used = 0  # bit f: a bin with free space f is open
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, place in it) of a piece."""
        fits = self.used >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            if self.open >= self.bound:
                self._take((self.used & -self.used).bit_length() - 1)
                self.open -= 1
            free, name = self.size, self.made
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.levels[left].append(name)
            self.used |= 1 << left
        else:
            self.open -= 1
        return name, self.size - free

    def _take(self, free: int) -> int:
        level = self.levels[free]
        name = level.pop()
        if not level:
            self.used &= ~(1 << free)
        return name


def pieces(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what the full ones leave."""
    if total <= size:
        return [(0, total)]
    first = total % size
    starts = [0] if first else []
    starts += range(first, total, size)
    return [(s, (first if first and s == 0 else size)) for s in starts]


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, size: int = SEQUENCE, bound: int = OPEN, with_ids: bool = False) -> DataFrame:
    """One row per piece. path: the tokenizer file; with_ids: adds the ids as little-endian uint32 bytes."""
    lean(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.asarray([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bins = encoder(path), BestFit(size, bound)
        base = TaskContext.get().partitionId() << 40
        schema = _ARROW.append(pa.field("ids", pa.binary())) if with_ids else _ARROW
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for i, name in enumerate(batch.column(0).to_pylist()):
                ids = ids_of(texts[i].as_py() or "") + end
                for k, (start, length) in enumerate(pieces(len(ids) // 4, size)):
                    sequence, offset = bins.put(length)
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((name, k, start, length, zlib.crc32(part), base + sequence, offset) + ((part,) if with_ids else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + ", ids binary" * with_ids)

