"""Loops that end when nothing changes. State is written to the shared folder, so lineage stays short and lost executors can be replaced."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.errors import EngineError

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="sluice-"))


def kept(df: DataFrame) -> DataFrame:
    """df, written once."""
    path = f"{shared_folder(df.sparkSession)}/sluice-state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def until_stable(seed: DataFrame, step: Callable[[DataFrame], DataFrame], bound: int = 200) -> DataFrame:
    """The union of seed and all rows that steps from new rows alone lead to. step must give seed's columns."""
    known = frontier = kept(seed.distinct())
    for _ in range(bound):
        new = kept(step(frontier).distinct().join(known, known.columns, "left_anti"))
        if new.isEmpty():
            return known
        known, frontier = known.unionByName(new), new
    raise EngineError(f"no fixpoint within {bound} rounds")


def while_changing(state: DataFrame, step: Callable[[DataFrame], DataFrame], bound: int = 200) -> DataFrame:
    """step of the whole state, each from the last round's snapshot, until it changes no row."""
    now = kept(state)
    for _ in range(bound):
        new = kept(step(now))
        if new.exceptAll(now).isEmpty():
            return new
        now = new
    raise EngineError(f"no fixpoint within {bound} rounds")
