"""Exports that arrive in a folder, read as a stream; an addition to what the batch operators do.

Every new file's triples are stamped with their file and the time it changed; a watermark on that time
bounds the state of the windowed counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.graph import SCHEMA
from sluice.sources.encoding import decoded
from sluice.sources.turtle import Parser

_OUT = pa.schema([("file", pa.string()), ("changed", pa.timestamp("us", tz="UTC"))] + [(n, pa.string()) for n in ("s", "p", "o", "kind", "lang", "dt")] + [("pos", pa.int64())])


def read_stream(spark: SparkSession, folder: str, fallback: str | None = None, files_per_batch: int = 16) -> DataFrame:
    """(file, changed, s, p, o, ...) of every file that appears; blank nodes carry their file's path below the folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)

    below = folder.rstrip("/") + "/"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, _ = decoded(row["content"], fallback)
                # by its place below the folder: equal names in two folders are two files
                mark = row["path"].rpartition(below)[2]
                own = lambda x, mark=mark: f"_:{mark}/{x[2:]}" if x.startswith("_:") else x
                rows = [(row["path"], row["modificationTime"], own(s), p, own(o) if k == "B" else o, k, lang, dt, i) for i, (s, p, o, k, lang, dt) in enumerate(Parser(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)

    return files.select("path", "modificationTime", "content").mapInArrow(run, "file string, changed timestamp, " + SCHEMA)


def predicate_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, p, n): statements per predicate and window; files that come later than `late` are left out."""
    timed = stream.withWatermark("changed", late)
    return timed.groupBy(F.window("changed", window), "p").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "p", "n")
